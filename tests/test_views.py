"""Served views: nesting, precedence and pages on small tables with what each lacks."""

import re

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import corpus as co
from tessera.operators import reading as rd
from tessera.operators import reports as rp
from tessera.operators import sequence as sq
from tessera.operators import views as vw


def test_library_tree(spark):
    cats = spark.createDataFrame([("poems", 1), ("prose", 2), ("empty", 3)], "name string, sort int")
    rows = [("il", "poems", "Homer", 2), ("od", "poems", "Homer", 4), ("th", "poems", None, 3), ("hid", "poems", None, 1), ("hdt", "prose", None, 1)]
    texts = spark.createDataFrame([(s, s.upper(), None, "text", c, k, s == "hid", n) for s, c, k, n in rows], "slug string, title string, author string, reader string, category string, collection string, hidden boolean, sort int")
    books = spark.createDataFrame([("il", 2, "b"), ("il", 1, "a"), ("hdt", 1, "c")], "text string, n int, label string")
    sizes = spark.createDataFrame([("od", 1, 10)], "text string, n int, size int")
    got = {r.name: [(e.collection, [t.slug for t in e.texts]) for e in r.entries] for r in vw.library_tree(cats, texts, books, sizes).collect()}
    assert got == {"poems": [("Homer", ["il", "od"]), (None, ["th"])], "prose": [(None, ["hdt"])], "empty": []}
    il = next(t for r in vw.library_tree(cats, texts, books, sizes).collect() for e in r.entries for t in e.texts if t.slug == "il")
    assert [tuple(b) for b in il.books] == [(1, "a"), (2, "b")] and il.downloads is None


def test_lexicon_cards(spark):
    lexicon = spark.createDataFrame([(1, "λόγος", "word", "a word, speech"), (2, "θεός", "god", None)], "strongs int, lemma string, gloss string, definition string")
    short = spark.createDataFrame([("ἄλλος", "another"), ("ἄλλος", "another"), ("Λογος", "short")], "lemma string, definition string")
    words = [(0, 1, None, None), (1, 2, None, None), (2, 1, "Λογος", "own"), (3, 1, "ἄλλος", "own"), (4, 1, "ξένος", "guest"), (5, None, "ξένος", "guest"), (6, None, None, None), (7, 9, None, None)]
    got = {r.k: (r.strongs, r.lemma, r.gloss, r.definition) for r in vw.lexicon_cards(spark.createDataFrame(words, "k int, strongs int, lemma string, gloss string"), lexicon, short, tx.fold_letters).collect()}
    assert got[0] == (1, "λόγος", "word", "a word, speech") and got[1] == (2, "θεός", "god", "god")
    assert got[2] == (1, "Λογος", "own", "a word, speech") and got[3] == (None, "ἄλλος", "own", "another") and got[4] == (None, "ξένος", "guest", "guest")
    assert got[5] == (None, "ξένος", "guest", "guest") and got[6] == (None, None, None, None) and got[7] == (9, None, None, None)


def test_page(spark):
    seg = spark.createDataFrame([("b", 1, "verse"), ("b", 2, "prose"), ("b", 3, "verse")], "text string, seq int, form string")
    notes = spark.createDataFrame([("b", 1, 2), ("b", 2, 2)], "text string, start int, end int")
    said = spark.createDataFrame([("b", 1, "en", "one"), ("b", 1, "el", "ένα")], "text string, seq int, lang string, content string")
    passages = spark.createDataFrame([("b", 1, 3, "all"), ("b", 2, 3, "end")], "text string, start int, end int, content string")
    timed = spark.createDataFrame([("b", 1, 0, "x", 1.0, 2.0), ("b", 2, 1, "z", 3.0, 4.0), ("b", 2, 0, "y", 2.0, 3.0)], "text string, seq int, piece int, content string, start double, end double")
    got = {r.seq: r for r in vw.page_segments(seg, ["text"], notes, said, passages, timed).collect()}
    assert [got[k].notes for k in (1, 2, 3)] == [1, 2, None] and got[1].translations == {"en": "one", "el": "ένα"} and got[2].translations is None
    assert [tuple(p) for p in got[3].passages] == [(1, "all"), (2, "end")] and got[1].passages is None
    assert tuple(got[1].times) == (1.0, 2.0) and got[1].parts is None and got[2].times is None and [p.content for p in got[2].parts] == ["y", "z"] and got[3].times is None


def test_headings_and_parts(spark):
    divs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "text string, div int")
    own = spark.createDataFrame([("a", 1, None), ("b", 5, "Own")], "text string, div int, title string")
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "text string, k int, line string")
    got = sorted(tuple(r) for r in co.division_headings(divs, F.concat(F.lit("D"), F.col("div").cast("string")), own, lines).collect())
    assert got == [("a", 1, -1, "x"), ("a", 1, 0, "y"), ("a", 2, 0, "D2"), ("b", 5, -1, "z"), ("b", 5, 0, "Own")]
    verses = spark.createDataFrame([("p", 1, 1, "1", "pa"), ("m", 1, 1, "1", "ma"), ("m", 2, 2, "1b", "mb"), ("none", 1, 1, "1", "x")], "source string, chapter int, pos int, verse string, content string")
    parts = spark.createDataFrame([(1, "p", 1, None, "pr. {v}"), (2, "m", None, None, None)], "k int, source string, to int, shift int, ref string")
    assert sorted(tuple(r) for r in co.rehome_parts(verses, parts).collect()) == [(1, 1, "pr. 1", "pa"), (1, 2, "1", "ma"), (2, 1, "1b", "mb")]


def test_first_examples(spark):
    rows = [(1, n % 10, n) for n in range(50)] + [(2, 0, 7)]
    got = {r.g: r.examples for r in rp.first_examples(spark.createDataFrame(rows, "g int, at int, v int"), ["g"], ["at"], "v", 6).collect()}
    assert got == {1: [0, 10, 20, 30, 40, 1], 2: [7]}


def test_corpus_of_four_kinds_of_readers(spark, tmp_path):
    """Column files with offsets, wiki pages, marked-up pages and documents as one corpus."""
    from tessera.sources import readers as rd

    (tmp_path / "w.txt").write_text("alpha\nbeta\ngamma\ndelta\n")
    (tmp_path / "m.txt").write_text("A\nB\nC\nD\n")
    (tmp_path / "s.txt").write_text("1:1\t1\n1:2\t3\n2:1\t4\n2:2\t9\n")
    at = lambda n: f"file://{tmp_path}/{n}"
    spark.createDataFrame([("p", "''one'' {{x|{{y}}}}\n\n[[a|two]]"), ("r", "#REDIRECT [[p]]")], "name string, body string").write.parquet(at("wiki"))
    spark.createDataFrame([(7, "<p>first <b>bold</b></p><p>second"), (8, None)], "page long, html string").write.parquet(at("html"))
    spark.createDataFrame([(5, "line a\nline b")], "doc_id long, text string").write.parquet(at("docs"))
    words = {"word": at("w.txt"), "morph": at("m.txt")}
    verses = sorted((r.seq, r.ref, r.content, [x.morph for x in r.words]) for r in rd.column_verses(spark, words, at("s.txt"), "word").collect())
    assert verses == [(1, "1:1", "alpha beta", ["A", "B"]), (2, "1:2", "gamma", ["C"]), (3, "2:1", "delta", ["D"])]
    catalogue = [{"type": "columns", "slug": "col", "columns": words, "starts": at("s.txt"), "content": "word"}, {"type": "wiki", "slug": "wik", "path": at("wiki")}, {"type": "paragraphs", "slug": "par", "path": at("html"), "key": "page", "body": "html"}, {"type": "documents", "slug": "doc", "path": at("docs")}]
    got = sorted((r.text, r.div, r.seq, r.content) for r in rd.build_corpus(spark, catalogue).select("text", F.col("div").cast("string").alias("div"), "seq", "content").collect())
    assert got == sorted([("col", "1", 1, "alpha beta"), ("col", "1", 2, "gamma"), ("col", "2", 3, "delta"), ("wik", "p", 0, "one"), ("wik", "p", 2, "two"), ("par", "7", 0, "first bold"), ("par", "7", 1, "second"), ("doc", "5", 0, "line a"), ("doc", "5", 1, "line b")])


def test_poems_and_wiki_pages_have_readers_of_their_own(spark):
    """Poem lines are numbered with their markers; lines of wiki pages keep their place."""
    from tessera.sources import readers as rd

    poem = spark.createDataFrame([(1, "x <poem>\n{{r|5}}one\n\ntwo</poem> y <poem>three</poem>")], "k long, body string")
    assert sorted((r.k, r.line, r.content, r.marker) for r in rd.poem_lines(poem, "k", "body").collect()) == [(1, 1, "one", "5"), (1, 2, "two", None), (1, 3, "three", None)]
    wiki = spark.createDataFrame([("p", "one\n\n''two''"), ("r", "#REDIRECT [[p]]")], "name string, body string")
    assert sorted((r.div, r.seq, r.content) for r in rd.wiki_lines(wiki).collect()) == [("p", 0, "one"), ("p", 2, "two")]


def test_folders_of_files_are_one_column(spark, tmp_path):
    """Lines go on from file to file, in the order of names."""
    from tessera.sources import readers as rd

    for name, parts in {"w": ["alpha\nbeta\n", "gamma\n", "delta\n"], "m": ["A\n", "B\nC\nD\n"], "s": ["1:1\t1\n", "1:2\t3\n"]}.items():
        (tmp_path / name).mkdir()
        for k, x in enumerate(parts):
            (tmp_path / name / f"part-{k:05d}.txt").write_text(x)
    at = lambda n: f"file://{tmp_path}/{n}"
    got = rd.column_verses(spark, {"word": at("w"), "morph": at("m")}, at("s"), "word").collect()
    assert sorted((r.seq, r.ref, r.content, [x.morph for x in r.words]) for r in got) == [(1, "1:1", "alpha beta", ["A", "B"]), (2, "1:2", "gamma delta", ["C", "D"])]


def _tasks(df):
    return [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]


def test_tasks_have_bounded_rows(spark, monkeypatch):
    """More rows make more tasks, not larger ones; repeated places count once, null targets equal none, words with a null key have nothing."""
    monkeypatch.setattr(sq, "TASK_ROWS", 2)
    assert [sq.tasks_of(spark, n) for n in (0, 8, 9, 21)] == [4, 4, 5, 11]
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 4), ("b", 7), ("b", 7)], "k string, v int")
    assert sorted(map(tuple, sq.islands(rows, "v", ["k"], repeated=True).collect())) == [("a", 1, 2, 2), ("a", 4, 4, 1), ("b", 7, 7, 1)]
    side = lambda *r: spark.createDataFrame(r, "k int, v int")
    got = rp.link_report(side((1, 5), (1, 5), (2, 6), (3, None), (None, 8)), side((1, 5), (2, 7), (3, None), (None, 8), (9, 1)), side((1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (None, 0)), ["k"], "v")
    assert _tasks(got) == [7]
    assert [tuple(r) for r in got.collect()] == [(1, 333, 333, 3, 1, 3)]
    lines = spark.createDataFrame([("a", n, "x" * (n % 3)) for n in range(40)], "k string, n int, w string")
    chunks, dicts = rp.compact(lines, ["k"], ["w"], ["n"], chunk_rows=7)
    assert _tasks(chunks)[-1] == 20
    assert sorted(len(r.rows) for r in chunks.collect()) == [5, 7, 7, 7, 7, 7]
    assert sorted(map(tuple, rp.restore(chunks, dicts, ["k"], ["w"], lines.columns).collect())) == sorted(map(tuple, lines.collect()))


def test_readings_of_the_same_places_are_met_once(spark):
    verses = spark.createDataFrame([("A", c * 10 + v, c, v, c, v) for c in (1, 2) for v in range(1, 6)], "text string, idx int, div int, ref int, c int, v int")
    readings = spark.createDataFrame([(1, "A", "1:4-2:1, 3"), (2, "A", "1:4-2:1, 3"), (3, "A", "9:1"), (4, "A", None), (5, None, "1:1"), (6, "B", "1:1"), (7, "A", "1:2")], "id int, text string, refs string")
    got = rd.label_readings(readings, ["id"], verses, "text", "refs")
    want = rd.select_verses(rd.parse_places(readings, ["id", "text"], "refs"), ["id"], verses, "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.id for r in got.collect()} == {1, 2, 7}


def test_column_files_in_buckets(spark, tmp_path, monkeypatch):
    """Verses longer than a bucket, empty ones, words before the first verse and after the shorter file's end; plain and compressed files, one row of a shuffle for
    many lines."""
    import gzip
    import random

    from tessera.sources import readers as rd

    monkeypatch.setattr(rd, "_BUCKET", 8)
    g = random.Random(7)
    n = 300
    words, sizes = [f"w{k}" if k % 11 else "" for k in range(1, n + 1)], [str(k) for k in range(1, n - 20)]
    starts = sorted([4, 4, 90, *g.sample(range(5, 60), 20), *g.sample(range(150, n), 30), n + 50])
    want = []
    for k, at in enumerate(starts):
        lines = range(at, min([*starts[k + 1 :], n + 1][0], n + 1))
        if len(lines):
            want.append((k + 1, f"v{k}", " ".join(words[i - 1] for i in lines), [(i, words[i - 1], sizes[i - 1] if i <= len(sizes) else None) for i in lines]))
    for made in ("plain", "gz"):
        for name, lines in (("w", words), ("s", sizes), ("v", [f"v{k}\t{at}" for k, at in enumerate(starts)] + ["none"])):
            (tmp_path / made / name).mkdir(parents=True)
            for k in range(0, len(lines), 70):
                text = "".join(f"{x}\n" for x in lines[k : k + 70]).encode()
                at = tmp_path / made / name / f"part-{k:05d}.txt"
                at.write_bytes(text) if made == "plain" else at.with_suffix(".txt.gz").write_bytes(gzip.compress(text))
        at = lambda name: f"file://{tmp_path}/{made}/{name}"  # noqa: B023, E731
        df = rd.column_verses(spark, {"word": at("w"), "size": at("s")}, at("v"), "word")
        assert df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1 and "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r.seq, r.ref, r.content, [tuple(x) for x in r.words]) for r in df.collect()) == want
        assert df.dtypes[-1] == ("words", "array<struct<line:bigint,word:string,size:string>>")
