"""Reflow, cursors, pairs by rare words, cover sums, compaction, numbered files: by plain loops and in several pieces."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import alignment as al
from tessera.operators import linking as li
from tessera.operators import reports as rp
from tessera.sources import readers as rd
from tests.test_operators import runs_by_hand


def owners_by_hand(mine, theirs):
    """All verses by the rules, with the runs of the plain aligner."""
    pairs = runs_by_hand([k for _, k in mine], [k for k, _ in theirs])
    to = {b: a for a, b in pairs}
    out = []
    for j, (key, _) in enumerate(theirs):
        if j in to:
            out.append(mine[to[j]][0])
            continue
        i1 = max((a for a, b in pairs if b < j), default=-1) + 1
        i2 = min((a for a, b in pairs if b > j), default=len(mine))
        b1 = max((b for _, b in pairs if b < j), default=-1) + 1
        b2 = min((b for _, b in pairs if b > j), default=len(theirs))
        if i1 >= len(mine):
            out.append(mine[-1][0])
        elif i2 > i1 and mine[i1][0] != mine[i2 - 1][0]:
            at = i1
            for n in range(b1, j + 1):
                best = max((al.likeness(theirs[n][0], mine[i][1]), i) for i in range(at, i2))
                at = best[1] if best[0] >= 0.5 else at
            out.append(mine[at][0])
        else:
            ends = any(theirs[n][1] for n in range(j, b2)) and i1 > 0 and mine[i1 - 1][0] != mine[i1][0]
            out.append(mine[i1 - 1][0] if ends else mine[i1][0])
    return out


def test_owners_by_plain_loops():
    g = random.Random(12)
    words = ["alpha", "alphb", "beta", "betas", "gam", "delta", "deltoid", "x"]
    for _ in range(300):
        mine = [(v, g.choice(words)) for v in range(4) for _ in range(g.randrange(1, 5))]
        theirs = [(g.choice([k, k, k, k + "s", g.choice(words)]), g.random() < 0.2) for _, k in mine if g.random() < 0.9] + [("end", False)] * g.randrange(2)
        pairs = runs_by_hand([k for _, k in mine], [k for k, _ in theirs])
        assert al.owners(mine, theirs, pairs) == owners_by_hand(mine, theirs)


def test_reflow_examples(spark):
    """Two words for one across a verse's end; a sentence that ends at a verse's start; chapters without our words."""
    ours = {"a": "1 συμπαραλημφθησ|2 ειπεν δε", "b": "1 και απεθανε|2 ο λογος", "c": "", "d": "1 αβγ δεζ"}
    theirs = {"a": "συμπαραληφθησ. ειπε δε", "b": "και απεθανε και εζησε. ο λογος", "c": "x", "d": "αβγ δεζ ηθι"}
    mine = [(c, i, v, w) for c, t in ours.items() for i, (v, w) in enumerate((int(part.split()[0]), w) for part in t.split("|") if part for w in part.split()[1:])]
    other = [(c, i, w.rstrip("."), w.endswith(".")) for c, t in theirs.items() for i, w in enumerate(t.split())]
    got = al.reflow_words(spark.createDataFrame(mine, "g string, i int, verse int, key string"), spark.createDataFrame(other, "g string, i int, key string, stop boolean"), "g")
    out = {}
    for r in got.orderBy("g", "i").collect():
        out.setdefault(r.g, []).append(r.verse)
    assert out == {"a": [1, 2, 2], "b": [1, 1, 1, 1, 2, 2], "c": [None], "d": [1, 1, 1]}


def cursor_by_hand(cited, lines):
    at, out = (-(10**9), -1), []
    for key, cand in cited:
        places = sorted((n, i) for n in set(cand or []) for i, k in enumerate(lines.get(n, [])) if k == key and (n, i) > at)
        if places:
            at = places[0]
        out.append(places[0][0] if places else None)
    for i, n in enumerate(out):
        if n is None:
            before = [x for x in out[:i] if x is not None]
            out[i] = before[-1] if before else None
    first = next((x for x in out if x is not None), None)
    return [first if n is None else n for n in out]


def test_cursor_by_plain_loops(spark):
    g = random.Random(3)
    groups = {}
    for n in range(40):
        lines = {k: [g.choice("abc") for _ in range(g.randrange(0, 6))] for k in range(5)}
        cited = [(g.choice("abc,"), g.choice([None, [], [0], [1, 2], [2, 1, 3], [0, 1, 2, 3, 4]])) for _ in range(g.randrange(1, 12))]
        groups[n] = (cited, lines)
    c = spark.createDataFrame([(n, p, k, v) for n, (x, _) in groups.items() for p, (k, v) in enumerate(x)], "g int, pos int, key string, lines array<int>")
    w = spark.createDataFrame([(n, k, i, x) for n, (_, ls) in groups.items() for k, xs in ls.items() for i, x in enumerate(xs)], "g int, line int, i int, key string")
    got = {}
    for r in al.cursor_lines(c.repartition(3), w, "g").orderBy("g", "pos").collect():
        got.setdefault(r.g, []).append(r.line)
    assert got == {n: cursor_by_hand(*x) for n, x in groups.items()}


def pairs_by_hand(left, right, own, least):
    out = []
    for k in {k for k, _, _ in left}:
        r = {n: set(w) for g, n, w in right if g == k}
        cand = [(n, False, w) for n, w in r.items()] + [(n, True, w | r[n + 1]) for n, w in r.items() if n + 1 in r]
        for _, n, w in (x for x in left if x[0] == k):
            scored = [(2000 * len(set(w) & v) // (len(set(w)) + len(v)), joined, m) for m, joined, v in cand if set(w) & v]
            ranked = sorted((0 if not j and m == n and s >= own else 1 if not j and s >= own else 2, -s, j, m) for s, j, m in scored if s >= least or (not j and m == n and s >= own))
            if ranked:
                out.append((k, n, ranked[0][3], -ranked[0][1], ranked[0][2]))
    return sorted(out)


def test_pairs_by_plain_loops(spark):
    g = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    side = lambda: [(k, n, [g.choice(words) for _ in range(g.randrange(0, 9))]) for k in range(4) for n in range(8)]
    left, right = side(), side()
    df = lambda rows: spark.createDataFrame(rows, "k int, num int, words array<string>")
    for own, least in ((600, 500), (300, 200), (60, 50), (400, 500)):
        got = sorted(tuple(r) for r in li.pair_similar(df(left), df(right), ["k"], own, least).select("k", "l", "r", "score", "joined").collect())
        assert got == pairs_by_hand(left, right, own, least), (own, least)


def test_pairs_of_short_and_long_keys(spark):
    """One pass over whole keys and joins over all tasks find the same, also with nulls, empty rows and keys of two columns."""
    g = random.Random(30)
    words = [f"w{i}" for i in range(30)]
    side = lambda: [((k, "ab"[k % 2]), n, [g.choice(words) for _ in range(g.randrange(0, 12))]) for k in range(12) for n in range(9) if g.random() < 0.8]
    left, right = side(), side()
    odd = [((None, "a"), 0, ["w1"]), ((1, None), 0, ["w1"]), ((1, "b"), None, ["w1"]), ((1, "b"), 20, None), ((1, "b"), 21, []), ((99, "b"), 0, ["w1"])]
    df = lambda rows: spark.createDataFrame([(*k, n, w) for k, n, w in rows + odd], "k int, k2 string, num int, words array<string>").repartition(5)
    plain = [r for r in odd if None not in r[0] and r[1] is not None and r[2] is not None]
    for own, least in ((600, 500), (60, 50), (0, 0)):
        want = sorted((*k, *rest) for k, *rest in pairs_by_hand(left + plain, right + plain, own, least))
        for whole in (0, 40, 1 << 21):
            got = li.pair_similar(df(left), df(right), ["k", "k2"], own, least, whole)
            assert sorted(map(tuple, got.select("k", "k2", "l", "r", "score", "joined").collect())) == want, (own, least, whole)
        assert [got.schema[c].dataType.simpleString() for c in ("l", "r", "score", "joined")] == ["int", "int", "bigint", "boolean"]


def test_pairs_by_blocks():
    """Rows of one key, counted in blocks of any size."""
    g = random.Random(31)
    sets = [[sorted({g.choice("abcdefghijkl") for _ in range(6)}) for _ in range(30)] for _ in range(2)]
    x = {"g": np.repeat([0, 1], 60), "side": np.tile(np.repeat([0, 1], 30), 2), "num": np.tile(np.arange(30), 4), "words": pa.array([*sets[0], *sets[1], *sets[1], *sets[0]])}
    want = pairs_by_hand(*[[(k, n, w) for k in (0, 1) for n, w in enumerate(sets[side ^ k])] for side in (0, 1)], 600, 500)
    for cells in (1, 100, 1 << 22):
        got = li._paired(x, 600, 500, cells)
        assert sorted(zip(*(got[c].tolist() for c in ("g", "l", "r", "score", "joined")), strict=True)) == want


def test_pairs_are_not_shuffled(spark):
    """Rows of both sides are dealt by key once; neither pairs nor words are dealt again."""
    df = spark.createDataFrame([(k, n, ["the", f"w{n}"]) for k in range(3) for n in range(4)], "k int, num int, words array<string>")
    got = li.pair_similar(df, df, ["k"], 60, 50)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_common_words_make_no_pairs(spark):
    """Words that every row has are no reason to meet: candidates grow with the rows, not with their square."""
    rows = [(1, n, ["the", "and", "of", "a"] + [f"r{n}x{i}" for i in range(12)]) for n in range(400)]
    df = spark.createDataFrame(rows, "k int, num int, words array<string>")
    sized = df.select("k", F.col("num").alias("l"), F.col("words").alias("w"), F.size("words").alias("n"))
    counts = sized.select("k", F.explode("w").alias("word")).groupBy("k", "word").agg(F.count("*").alias("c"))
    x = li._rare_first(sized, counts, ["k"], ["l"], 500)
    assert x.join(x.withColumnRenamed("l", "r"), ["k", "word"]).select("l", "r").distinct().count() == 400
    got = li.pair_similar(df, df, ["k"]).collect()
    assert sorted((r.l, r.r, r.score, r.joined) for r in got) == [(n, n, 1000, False) for n in range(400)]


def test_cover_counts_of_long_ranges(spark):
    ranges = [(1, 0, 10**12), (1, 5, 5), (1, 7, 3), (2, -5, 5), (None, 0, 9), (1, 6, 10**9)]
    points = [(1, 4), (1, 5), (1, 6), (1, 10**12), (1, 10**12 + 1), (1, -1), (2, 5), (2, 6), (3, 0), (1, 5)]
    got = sorted((r.k, r.pos, r.n_cover) for r in li.count_cover(spark.createDataFrame(points, "k int, pos long"), spark.createDataFrame(ranges, "k int, start long, end long"), ["k"]).collect())
    assert got == sorted((k, p, sum(a <= p <= b for j, a, b in ranges if j == k)) for k, p in points)


def test_compact_with_derived_columns(spark):
    rows = [(k % 2, k, "v" * (k % 3), None if k % 5 == 0 else float(k) * 2 if k % 7 else -1.0, k + 1, None if k % 4 == 0 else "x") for k in range(100)]
    df = spark.createDataFrame(rows, "k int, i int, a string, b double, c int, d string")
    rules = {"b": F.col("i") * 2.0, "c": F.col("i") + 1, "d": F.when(F.col("i") % 4 != 0, "x")}
    chunks, dicts = rp.compact(df, ["k"], ["a"], ["i"], rules, 7)
    fields = chunks.schema["rows"].dataType.elementType.names
    assert "__kept_b" in fields and not any("c" == f or f in ("__kept_c", "__kept_d") for f in fields)
    assert {r.k: r.n for r in chunks.groupBy("k").agg(F.count("*").alias("n")).collect()} == {0: 8, 1: 8}
    back = rp.restore(chunks, dicts, ["k"], ["a"], df.columns, rules)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == rows
    same = rp.tables_equal(df, back).first()
    assert (same.only_a, same.only_b) == (0, 0)


def test_line_numbers_over_pieces(spark, tmp_path):
    lines = {f: [f"{f} line {k} " + "x" * (k % 50) for k in range(n)] for f, n in (("a.txt", 3000), ("b.txt", 1), ("c.txt", 2990))}
    for f, xs in lines.items():
        (tmp_path / f).write_text("\n".join(xs) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = {}
        for r in rd.numbered_lines(spark, f"file://{tmp_path}/*.txt").collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line] = r.value
        assert got == {f: dict(enumerate(xs, 1)) for f, xs in lines.items()}
        both = rd.parallel_files(spark, {"x": f"file://{tmp_path}/a.txt", "y": f"file://{tmp_path}/c.txt"}).collect()
        assert sorted((r.line, r.x, r.y) for r in both) == [(k + 1, lines["a.txt"][k], lines["c.txt"][k] if k < 2990 else None) for k in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
