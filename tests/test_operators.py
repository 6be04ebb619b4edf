"""Invariants and small cases of the operators that no table query shows."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import alignment as al
from tessera.operators import corpus as co
from tessera.operators import reading
from tessera.operators import reports as rp
from tessera.operators import sequence as sq
from tessera.plans.catalogue import QUERIES
from tessera.sources import readers as rd
from tessera.sources import sinks
from tessera.streaming import events as st


def col(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(expr).collect()]


def test_folding(spark):
    assert col(spark, tx.fold_greek(F.col("x")), "Μῆνιν,", "λόγος") == ["μηνιν", "λογοσ"]
    assert col(spark, tx.loose_key(F.col("x")), "ετελλεν", "εν", "ανδρα") == ["ετελλε", "εν", "ανδρα"]
    assert col(spark, tx.nfc(tx.nfd(F.col("x"))), "é", None) == ["é", None]
    assert col(spark, tx.acute(F.col("x")), "τὸ") == ["τό"]


def test_numerals(spark):
    got = dict(tx.numeral_dim(spark, 200).collect())
    assert (got[4], got[16], got[151]) == ("Δʹ", "ΙΣΤʹ", "ΡΝΑʹ")


def test_place_spec(spark):
    got = col(spark, tx.parse_spec(F.col("x")), "27-31,13.1-2", "3.2-5.9")
    assert [tuple(p) for p in got[0]] == [(None, "27", None, "31"), (13, "1", 13, "2")]
    assert tuple(got[1][0]) == (3, "2", 5, "9")


def test_notes_and_marks(spark):
    assert tuple(col(spark, tx.split_lemma_note(F.col("x")), "μῆνιν] wrath")[0]) == ("μῆνιν", "wrath")
    df = spark.createDataFrame([(1, "intro 1:2 first words 1:3 more")], "k int, t string")
    assert [tuple(r) for r in rd.split_on_marks(df, "k", "t").collect()] == [(1, 1, 2, "first words"), (1, 1, 3, "more")]
    m = rd.milestone_passages(spark.createDataFrame([(1, "a<l n=5>b<l n=7>c")], "k int, t string"), "k", "t", r"<l n=(\d+)>")
    assert [(r.marker, r.passage) for r in m.orderBy("i").collect()] == [(None, "a"), ("5", "b"), ("7", "c")]


def test_redirects(spark):
    p = spark.createDataFrame([("a", "#REDIRECT [[b]]"), ("b", "#redirect [[c]]"), ("c", "text")], "p string, t string")
    assert {tuple(r) for r in rd.resolve_redirects(p, "p", "t").collect()} == {("a", "c"), ("b", "c"), ("c", "c")}


def test_alignment(spark):
    a = spark.createDataFrame([(1, i, w) for i, w in enumerate("the man sang of the sea".split())], "g int, i int, key string")
    b = spark.createDataFrame([(1, i, w) for i, w in enumerate("a man sang the sea".split())], "g int, i int, key string")
    assert sorted((r.a, r.b) for r in al.longest_runs(a, b, "g", "key").collect()) == [(1, 1), (2, 2), (4, 3), (5, 4)]
    df = spark.createDataFrame([("sing goddess the wrath", ["sing", "the"])], "t string, s array<string>")
    assert al.cut_points(df, "t", "s").first().pieces == ["sing goddess", "the wrath"]


def test_fixes_and_swaps(spark):
    s = spark.createDataFrame([(1, "ab ab"), (2, "cd")], "k int, content string")
    fixes = spark.createDataFrame([(1, "ab", "x"), (2, "zz", "y")], "k int, find string, put string")
    out, errors = co.apply_fixes(s, fixes, ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, "x ab"), (2, "cd")]
    assert [tuple(r) for r in errors.collect()] == [(2, "zz", 0)]
    d = spark.createDataFrame([(1, i, l, v) for i, (l, v) in enumerate([("a", "b"), ("b", "a"), ("c", "c")])], "g int, i int, l string, v string")
    assert [r.v for r in sq.swap_pairs(d, "l", "v", ["g"], "i").orderBy("i").collect()] == ["a", "b", "c"]


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), at, ["k"])
    sinks.overwrite_slice(spark.createDataFrame([("c", 2)], "v string, k int"), at, ["k"])
    assert {tuple(r) for r in spark.read.parquet(at).select("k", "v").collect()} == {(1, "a"), (2, "c")}
    sinks.export_tsv(spark.createDataFrame([(1, None)], "k int, v string"), str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).first().value == "1\t"
    assert rp.content_version(spark.range(5), ["id"]).first() == rp.content_version(spark.range(5).repartition(3), ["id"]).first()


def test_lexicon(spark, tmp_path):
    f = tmp_path / "lex.tsv"
    f.write_text("# note\nlogos\tword\nlogos\treason\nshort\n")
    assert {tuple(r) for r in rd.read_lexicon(spark, str(f)).collect()} == {("logos", "word"), ("short", "")}


def test_ordinals(spark):
    got = dict(tx.ordinal_dim(spark).collect())
    assert (got[2], got[11], got[20], got[21]) == ("Δεύτερον", "Ἑνδέκατον", "Εἰκοστόν", "Εἰκοστὸν Πρῶτον")
    assert got[112] == "Ἑκατοστὸν Δωδέκατον" and len(got) == 199


def test_reflow(spark):
    rows = [(0, 1, False), (1, 1, False), (2, 2, True), (3, 2, False), (4, None, True), (5, 3, True), (6, None, False)]
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, pos int, own int, stop boolean")
    got = [r.verse for r in al.reflow(df, "g", "own", "pos", "stop").orderBy("pos").collect()]
    assert got == [1, 1, 1, 2, 2, 3, 3]  # the sentence left open in verse 1 takes its last word from verse 2


def test_corrections_and_choices(spark):
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate("abcd")], "g int, line int, text string")
    fixes = spark.createDataFrame([(1, 10, [1, 0]), (1, 11, [1, 2])], "g int, line int, sources array<int>")
    made, wrong = al.correction_map(lines, fixes, ["g"])
    assert {tuple(r) for r in made.collect()} == {(1, 10, "b a"), (1, 11, "b c")}
    assert {tuple(r) for r in wrong.collect()} == {(1, 1, "repeated"), (1, 3, "unused")}
    o = spark.createDataFrame([(1, "x", 5.0), (1, "y", 7.0), (2, "x", 5.0), (2, "y", 9.0), (3, "y", 1.0)], "k int, reading string, score double")
    assert {(r.k, r.reading) for r in al.choose_reading(o, ["k"], "x", 3.0).collect()} == {(1, "x"), (2, "y"), (3, "y")}


def test_cursor_is_kept_in_order(spark):
    words = spark.createDataFrame([(1, n, k) for n, k in ((1, "a"), (2, "b"), (2, "a"), (3, "b"))], "g int, line int, key string")
    cited = spark.createDataFrame([(1, 0, "b", [2, 3]), (1, 1, "a", [1, 2]), (1, 2, ",", [9]), (1, 3, "b", [1, 3])], "g int, pos int, key string, lines array<int>")
    assert [r.line for r in al.cursor_lines(cited, words, "g").orderBy("pos").collect()] == [2, 2, 2, 3]


def test_strays_and_anchors(spark):
    at = [0, 500, 510, 520, 530, 540, 550, 900]
    df = spark.createDataFrame([(1, x) for x in at], "g int, at int")
    assert sorted(r.at for r in sq.trim_strays(df, ["g"], "at", 100).collect()) == at[1:-1]
    a = spark.createDataFrame([(1, p, q) for p, q in ((1, 1), (2, 9), (3, 3), (4, 4))], "g int, p int, q int")
    assert sorted(r.q for r in sq.drop_stray_anchors(a, ["g"], "p", "q").collect()) == [1, 3, 4]


def test_runs_and_groups_go_on_until_nothing_changes(spark):
    n = {2: 8, 1: 7, 4: 6, 3: 5, 6: 4, 5: 3, 8: 2, 7: 1}  # blocks of so many words; each crosses only its neighbours in this order
    said = lambda order: [(1, i, w) for i, w in enumerate(f"{x}w{k}" for x in order for k in range(n[x]))]
    a, b = said(range(1, 9)), said((2, 4, 1, 6, 3, 8, 5, 7))
    of = lambda rows: spark.createDataFrame(rows, "g int, i int, key string")
    at = {w: i for _, i, w in b}
    want = sorted((i, at[w]) for _, i, w in a if w[0] in "2468")
    assert sorted((r.a, r.b) for r in al.longest_runs(of(a), of(b), "g", "key").collect()) == want
    chain = spark.createDataFrame([(m, t) for m in range(80) for t in (m, m + 1)], "member long, target long")
    assert {r.group_id for r in al.sharing_groups(chain).collect()} == {0}


def test_rebuild_changed_collects_no_group(spark):
    now = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", None)], "k string, v string")
    was = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "x"), ("c", None)], "k string, v string").groupBy("k").agg(st.content_hash("v").alias("hash"))
    got = st.rebuild_changed(now, was, "k", "v")
    assert [r.k for r in got.collect()] == ["b"]
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_sharing_groups_of_a_long_chain(spark):
    links = spark.range(1000).selectExpr("id AS member", "explode(array(id, id + 1)) AS target")
    lone = spark.createDataFrame([(5000, 70000), (5000, 70001), (None, 3), (7, None)], "member long, target long")
    got = al.sharing_groups(links.union(lone)).collect()
    assert len(got) == 1000 and {r.group_id for r in got} == {0}


def test_nothing_imports_the_llm_folders():
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for p in root.glob("tessera/**/*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
    assert not [p for p in (root / "tests").glob("*.py") if p.name != "test_operators.py" and "corpus_pipeline" in p.read_text()]


def runs_by_hand(a, b):
    """Longest runs first (ties: the earlier a, then b); candidates that cross or share a kept pair go; again until none is left."""
    cand, kept = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y}, []
    while cand:
        runs = []
        for i, j in cand:
            if (i - 1, j - 1) not in cand:
                n = 1
                while (i + n, j + n) in cand:
                    n += 1
                runs.append((n, -i, -j))
        n, i, j = max(runs)
        new = [(k - i, k - j) for k in range(n)]
        kept += new
        cand = {(x, y) for x, y in cand if all((x < p and y < q) or (x > p and y > q) for p, q in new)}
    return sorted(kept)


def test_longest_runs_with_repeats_by_brute_force(spark):
    g = random.Random(8)
    pairs = [([g.choice("abcd") for _ in range(g.randrange(0, 14))], [g.choice("abcd") for _ in range(g.randrange(0, 14))]) for _ in range(40)]
    side = lambda k: spark.createDataFrame([(n, i, x) for n, p in enumerate(pairs) for i, x in enumerate(p[k])], "g int, i int, key string")
    got = {n: [] for n in range(len(pairs))}
    for r in al.longest_runs(side(0), side(1), "g", "key").collect():
        got[r.g].append((r.a, r.b))
    assert {n: sorted(v) for n, v in got.items()} == {n: runs_by_hand(*p) for n, p in enumerate(pairs)}


def test_match_classes(spark):
    lines = [("μηδέ τὸν ἔτελλεν", "μη δέ τὸν ἔτελλε"), ("ἦ τοι ὁ λόγος", "ἤτοι ὁ Λόγος"), ("ἐς πόλιν ἦλθεν", "ἐν πόλιν ἦλθεν"), ("πάλιν πλαγχθέντας οἴω", "παλιμπλαγχθέντας οἴω"), ("α β γ", "δ ε ζ η γ")]
    side = lambda k: spark.createDataFrame([(n, i, w) for n, p in enumerate(lines) for i, w in enumerate(p[k].split())], "g int, i int, word string").withColumn("key", tx.fold_greek(F.col("word"))).withColumn("loose", tx.loose_key(F.col("key")))
    got = {n: [] for n in range(len(lines))}
    for r in al.align_words(side(0), side(1), "g").collect():
        got[r.g].append((r.a, r.b if r.b is not None else -1, r.match))
    assert sorted(got[0]) == [(0, 0, "split"), (0, 1, "split"), (1, 2, "exact"), (2, 3, "movable_nu")]
    assert sorted(got[1]) == [(0, 0, "joined"), (1, 0, "joined"), (2, 1, "exact"), (3, 2, "orthographic")]
    assert sorted(got[2]) == [(0, 0, "variant"), (1, 1, "exact"), (2, 2, "exact")]
    assert sorted(got[3]) == [(0, 0, "variant"), (1, 0, "variant"), (2, 1, "exact")]
    assert sorted(got[4]) == [(0, -1, "none"), (1, -1, "none"), (2, 4, "exact")]


def test_gap_pass(spark):
    side = lambda words: spark.createDataFrame([(1, i, w) for i, w in enumerate(words.split())], "g int, i int, key string")
    got = al.gap_pass(side("ουδε ταληθη x λογοσ"), side("ου δε τα αληθη λογοσ"), "g").collect()
    assert sorted((r.i, r.part, r.j) for r in got) == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3), (3, 0, 4)]


def test_numbers_over_brackets(spark):
    s = spark.createDataFrame([(1, "a (b c) d"), (2, "[whole line kept] x"), (3, "x [gone now] y(z) (w)"), (4, "(open a"), (5, "-- a")], "doc_id int, content string").withColumn("seq", F.lit(0))
    got = sorted((r.doc_id, r.word_index, r.word) for r in co.numbered_words(s).collect())
    assert got == [(1, 0, "a"), (1, 3, "d"), (2, 0, "[whole"), (2, 1, "line"), (2, 2, "kept]"), (2, 3, "x"), (3, 0, "x"), (3, 3, "y(z)"), (4, 0, "(open"), (4, 1, "a"), (5, 1, "a")]


def test_brackets_by_plain_loops(spark):
    g = random.Random(29)
    lines = ["".join(g.choice("ab(()[]])  \x01\x02\x03\t\nλ$\\-") for _ in range(g.randrange(0, 30))) for _ in range(2000)] + [None, ""]
    want = []
    for n, line in enumerate(x or "" for x in lines):
        first, bare, at = line.lstrip(" ").startswith("["), "", 0
        for m in re.finditer(r"\([^)]*\)|\[[^\]]*\]", line):
            bare, at, first = bare + line[at : m.start()] + (m[0] if first else re.sub("[^ ]", "-", m[0])), m.end(), False
        kept = [x for x in (bare + line[at:]).split(" ") if x]
        want += [(n, i, w) for i, (w, k) in enumerate(zip([x for x in line.split(" ") if x], kept, strict=True)) if re.search("[abλ]", k)]
    segs = spark.createDataFrame(list(enumerate(lines)), "doc_id int, content string").withColumn("seq", F.lit(0))
    assert sorted((r.doc_id, r.word_index, r.word) for r in co.numbered_words(segs).collect()) == sorted(want)


def test_lines_are_split_once(spark):
    """A split within the loop over a line's words is made anew for these words: its time grows with the square of the line."""
    got = QUERIES["unbracketed_words"](spark, "/root/testdata/sf0.001")
    assert _plan(got).count(r"[()\[\]]") == 1


def test_redirects_and_circles(spark):
    rows = [(f"p{k}", f"#REDIRECT [[p{k - 1}]]") for k in range(1, 300)] + [("p0", "text"), ("x", "#redirect [[y]]"), ("y", "#REDIRECT [[x]]"), ("z", "#REDIRECT [[x]]"), ("out", "#REDIRECT [[nowhere]]")]
    got = {r.page: r.target for r in rd.resolve_redirects(spark.createDataFrame(rows, "name string, body string"), "name", "body", doublings=11).collect()}
    assert {got[f"p{k}"] for k in range(300)} == {"p0"} and got["out"] == "nowhere"
    assert got["x"] is got["y"] is got["z"] is None and len(got) == len(rows)


def test_headings_and_spelling(spark):
    assert col(spark, tx.is_caps_heading(F.col("x")), "ΤΟ ΒΙΒΛΙΟΝ", "ΕΝ ᾧ ΛΟΓΟΣ", "ΛΟΓΟΣ", "ΤΟ βιβλιον ΜΟΥ", "A B", "12 — AB CD") == [True, True, False, False, False, True]
    assert col(spark, tx.spelled(F.col("x")), "«δ᾽", "ἀλλʼ,", "Λόγος·") == ["δ’", "ἀλλ’", "Λόγος"]
    assert col(spark, tx.clean_wiki(F.col("x")), "1. '''''b'''''{{a|{{b|{{c}}}}}} [[x|y]]<ref>n</ref><br/>", None) == ["b y", None]
    assert col(spark, tx.tidy_punct(F.col("x")), "“ a b ” , c  d ( e ) .") == ["“a b”, c d (e)."]


def test_load_order_within_and_between_sides(spark):
    base, new = (spark.createDataFrame(rows, "k int, at int, v string") for rows in ([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], [(2, 1, "d"), (2, 0, "e"), (3, 9, "f")]))
    assert sorted(r.v for r in rp.insert_ignore(base, new, ["k"], ["at"]).collect()) == ["a", "c", "f"]
    assert sorted(r.v for r in rp.insert_replace(base, new, ["k"], ["at"]).collect()) == ["b", "d", "f"]


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, 'rare', 'hot') AS k", "id * 7919 % 1009 AS o", "id AS v")
    got = sq.running(df, ["k"], ["o"], {"cum": "v"}).collect()
    for key in ("rare", "hot"):
        mine, total = sorted((r for r in got if r.k == key), key=lambda r: r.o), 0
        for n, r in enumerate(mine, 1):
            total += r.v
            assert (r.i, r.cum) == (n, total)


def test_plan_days_never_go_back(spark):
    words = [1, 1, 1, 200, 1, 1, 1, 1]  # one unit holds nearly all: days fall back to unit counts
    units = spark.createDataFrame([("p", 0, "t", 0, k, w, True, True) for k, w in enumerate(words)], "plan string, sort int, text string, book int, u int, words int, open boolean, close boolean")
    for days in (1, 3, 5, 8, 20):
        cuts = [r.cut for r in reading.split_plan(units, days).orderBy("day").collect()]
        assert len(cuts) == min(days, 8) and cuts[-1] == 8 and all(x < y for x, y in zip([0, *cuts], cuts, strict=False))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_meet_verses_where_they_are(spark):
    """Few parts are sent to the verses: no task sorts all verses of a source."""
    v = spark.createDataFrame([("a", 1, 2, 2, "y"), ("a", 1, 1, 1, "x"), ("b", 5, 1, 9, "z")], "source string, chapter long, pos long, verse int, content string")
    parts = spark.createDataFrame([(1, "b", 1, None, None), (2, "a", None, None, "{v}a")], "k int, source string, to long, shift long, ref string")
    got = co.rehome_parts(v, parts)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "9", "z"), (1, 2, "1a", "x"), (1, 3, "2a", "y")]
    assert "Window" in _plan(got) and "__p" in _plan(got)


def test_run_ons_stay_in_their_rows(spark):
    texts = [(1, 5, "a b. 7 c d. 6 e f. 50 g"), (2, None, "a. 7 b"), (3, 5, None), (4, 5, "3 x. p. 8 says. 9 y")]
    got = al.split_run_ons(spark.createDataFrame(texts, "k int, line int, text string"), "text", "line")
    assert sorted(map(tuple, got.select("k", "part", "line", "text").collect()), key=str) == sorted([(1, 0, 5, "a b."), (1, 1, 7, "c d. 6 e f. 50 g"), (2, 0, None, "a. 7 b"), (4, 0, 5, "3 x. p. 8 says."), (4, 1, 9, "y")], key=str)
    assert "Exchange" not in _plan(got)
