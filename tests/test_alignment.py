"""Alignment of divisions: cuts, runs and the gap pass by plain loops; long divisions; edges."""

import os
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import alignment as al
from tests.test_operators import runs_by_hand

GIK = "g string, i int, key string"


def rising_by_hand(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    return max(best, default=0)


def test_rising():
    g = random.Random(4)
    for n in (0, 1, 2, 5, 30, 200):
        for _ in range(20):
            values = g.sample(range(10 * n + 1), n)
            at = al.rising(np.array(values, np.int64))
            got = [values[i] for i in at]
            assert sorted(at) == list(at) and got == sorted(got) and len(got) == rising_by_hand(values)


def chained_by_hand(x, y):
    return sorted(runs_by_hand(x, y))


def test_chained_runs():
    """The heap of pieces gives the longest run first, again and again, however runs cross."""
    g = random.Random(6)
    for _ in range(400):
        x, y = ([g.choice("ab" if g.random() < 0.3 else "abcdef") for _ in range(g.randrange(0, 25))] for _ in range(2))
        pairs = sorted(((i, j) for i, a in enumerate(x) for j, b in enumerate(y) if a == b), key=lambda p: (p[0] - p[1], p[0]))
        a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        got = list(zip(*(c.tolist() for c in al.chained_runs(a, b)), strict=True))
        assert got == chained_by_hand(x, y)


def division_by_hand(x, y):
    """Cuts where keys are unique on both sides (all in order here), runs within stretches, then one pass over what is left."""
    cx, cy = Counter(x), Counter(y)
    cuts = sorted((x.index(k), y.index(k)) for k in cx if cx[k] == cy.get(k) == 1)
    assert [b for _, b in cuts] == sorted(b for _, b in cuts)
    edges, out = [(0, 0), *cuts, (len(x), len(y))], []
    for (a0, b0), (a1, b1) in zip(edges, edges[1:], strict=False):
        pairs = [(a0 + i, b0 + j) for i, j in runs_by_hand(x[a0:a1], y[b0:b1])]
        out += [(i, 0, j) for i, j in pairs]
        marks = [(a0 - 1, b0 - 1), *sorted(pairs), (a1, b1)]
        for (p, q), (r, s) in zip(marks, marks[1:], strict=False):
            out += [(p + 1 + i, part, q + 1 + j) for i, part, j in al.split_words(x[p + 1 : r], y[q + 1 : s], 0.8)]
    return sorted(out)


def edition(g, words):
    out = []
    for w in words:
        u = g.random()
        if u < 0.08:
            continue
        if u < 0.16 and len(w) > 5:
            out += [w[:3], w[3:]]
        elif u < 0.22:
            out += [w, g.choice(["and", "the"])]
        else:
            out.append(g.choice(["so", "x", w]) if u < 0.3 else w)
    return out


def test_divisions_by_plain_loops(spark):
    g = random.Random(9)
    common = ["the", "and", "of", "in", "so", "people", "against"]
    divisions = {}
    for n in range(12):
        x = [g.choice(common) if g.random() < 0.7 else f"unique{n}x{k}" for k in range(g.randrange(0, 80))]
        divisions[f"d{n}"] = (x, edition(g, x))
    divisions |= {"same": (["a"] * 9, ["a"] * 7), "none": (["a", "b"], ["c"]), "left": (["a"], []), "right": ([], ["a"])}
    side = lambda k: spark.createDataFrame([(d, i, w) for d, p in divisions.items() for i, w in enumerate(p[k])] + [(None, 0, "a"), ("d0", 1000, None)], GIK)
    got = {d: [] for d in divisions}
    for r in al.align_division(side(0).repartition(3), side(1).repartition(2), "g").collect():
        got[r.g].append((r.i, r.part, r.j))
    assert {d: sorted(v) for d, v in got.items()} == {d: division_by_hand(*p) for d, p in divisions.items()}


def test_cuts_rise_over_ranges(spark):
    """Ranges of ranks are cut apart; cuts rise on both sides all the same, and moved passages don't stop them."""
    n, g = 500, random.Random(3)
    order = list(range(n))
    order[100:130], order[300:330] = order[300:330], order[100:130]
    side = lambda xs: spark.createDataFrame([("d", i, f"k{x}") for i, x in enumerate(xs)] + [("d", n + i, g.choice("ab")) for i in range(50)], GIK)
    for rows in (1 << 16, 64):
        cuts = sorted((r.a, r.b) for r in al.unique_cuts(side(range(n)), side(order), "g", "key", rows).collect())
        assert [b for _, b in cuts] == sorted({b for _, b in cuts}) and len(cuts) >= n - 60 - (0 if rows > n else 80)
        assert all(order[b] == a for a, b in cuts)


def test_long_division(spark):
    """100,000 words, nine of ten of them from 50 common ones: no pairs of a whole division are made."""
    g = random.Random(1)
    x = [f"c{g.randrange(50)}" if g.random() < 0.9 else f"u{k}" for k in range(100_000)]
    y = [w for w in x if g.random() > 0.05]
    began = time.time()
    a, b = (spark.createDataFrame([("d", i, w) for i, w in enumerate(v)], GIK) for v in (x, y))
    got = sorted((r.i, r.j) for r in al.align_division(a, b, "g").collect() if r.part == 0)
    assert time.time() - began < 120
    assert all(x[i] == y[j] for i, j in got) and [j for _, j in got] == sorted({j for _, j in got})
    assert len(got) >= 0.97 * len(y)


def test_marks_from_a_guide(spark):
    cases = {
        "equal": ("και ειπεν ο λογος", "“Καὶ εἶπεν, ὁ λόγος.”", "“Και ειπεν, ο λογος.”"),
        "odd": ("αβγ δεζ ηθι τελος", "«Αβ γ δ» ηθι τελος.", "«Αβγ δεζ» ηθι τελος."),
        "even": ("αβγ ξξξ τελος", "αβγ, (Ψψψ) τελος", "αβγ, (Ξξξ) τελος"),
        "stop": ("θεὸς καὶ", "θεὸς· καὶ", "θεός· καὶ"),
        "grave": ("τὸ", "τό.", "τό."),
        "less": ("α β γ", "α γ.", "α β γ."),
        "none": ("α β", "", "α β"),
    }
    side = lambda k: spark.createDataFrame([(n, i, w) for n, p in cases.items() for i, w in enumerate(p[k].split())], "g string, i int, word string").withColumn("key", tx.fold_letters(F.col("word")))
    got = {}
    for r in al.marks_from(side(0), side(1), "g").orderBy("g", "i").collect():
        got.setdefault(r.g, []).append(r.text)
    assert {n: " ".join(v) for n, v in got.items()} == {n: p[2] for n, p in cases.items()}


def test_long_divisions_as_short_ones(spark):
    """Divisions over the bound go by ranges, the others in one pass: the same pairs, with moved passages and ranges of few ranks."""
    g = random.Random(5)
    divisions = {}
    for n in range(6):
        x = [g.choice("abc") if g.random() < 0.5 else f"unique{n}x{k}" for k in range(g.randrange(20, 90))]
        y = edition(g, x)
        cut = len(y) // 3
        divisions[f"d{n}"] = (x, y[cut:] + y[:cut] if n % 2 else y)
    side = lambda k: spark.createDataFrame([(d, i, w) for d, p in divisions.items() for i, w in enumerate(p[k])], GIK)
    a, b = side(0), side(1)
    one, some = (sorted(map(tuple, al.align_division(a, b, "g", 8, whole=n).select("g", "i", "part", "j").collect())) for n in (1 << 20, 90))
    assert one == some and len(one) > 100


def test_distance_by_a_table():
    g = random.Random(2)
    for _ in range(500):
        x, y = ("".join(g.choice("abcd") for _ in range(g.randrange(0, 12))) for _ in range(2))
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        assert al._distance(x, y) == row[-1]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_words_and_marks_need_one_shuffle(spark):
    """Classes and marks are found where a group's words meet; words without a group or a key meet nothing."""
    side = lambda rows: spark.createDataFrame(rows, "g string, i int, word string, key string, loose string")
    a = side([("x", 0, "Ab", "ab", "ab"), ("x", 1, "cde", "cde", "cde"), ("x", 2, "f", "f", "f"), ("x", 3, "?", None, None), ("y", 0, "lone", "lone", "lone"), (None, 0, "ab", "ab", "ab")])
    b = side([("x", 0, "ab", "ab", "ab"), ("x", 1, "(Cd", "cd", "cd"), ("x", 2, "e!", "e", "e"), ("x", 3, "F", "f", "f"), ("x", 4, "?", None, None), ("z", 0, "lone", "lone", "lone"), (None, 0, "ab", "ab", "ab")])
    got = al.align_words(a, b, "g")
    assert exchanges(got) == 1
    want = [(None, 0, None, "none"), ("x", 0, 0, "orthographic"), ("x", 1, 1, "split"), ("x", 1, 2, "split"), ("x", 2, 3, "orthographic"), ("x", 3, 4, "variant"), ("y", 0, None, "none")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert dict(got.dtypes) == {"g": "string", "a": "int", "b": "int", "match": "string"}
    marked = al.marks_from(a.drop("loose"), b.drop("loose"), "g")
    assert exchanges(marked) == 1
    assert sorted(map(tuple, marked.collect()), key=repr) == sorted([(None, 0, "ab"), ("x", 0, "Ab"), ("x", 1, "(Cde!"), ("x", 2, "F"), ("x", 3, "??"), ("y", 0, "lone")], key=repr)


def _both(spark, groups, fields):
    """The groups' sides as two tables, and as rows that hold both."""
    side = lambda k: spark.createDataFrame([(g, *w) for g, *p in groups for w in p[k]], f"g string, {fields}")
    names = [x.strip().split(" ")[0] for x in fields.split(",")]
    packed = spark.createDataFrame([(g, *([dict(zip(names, w, strict=True)) for w in x] for x in p)) for g, *p in groups], "g string, " + ", ".join(f"s{k} array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>" for k in range(len(groups[0]) - 1)))
    return side, al.side_by_side(packed, "g", *({c: F.col(f"s{k}.{c}") for c in names} for k in range(len(groups[0]) - 1)))


def _editions(n=40, seed=8):
    """Groups of repeated words against an edition of theirs; some empty, one without a name, a key that is null."""
    g = random.Random(seed)
    out = []
    for k in range(n):
        x = [g.choice(["so", "people", "against", "a", "Ab", "unheard"]) for _ in range(g.randrange(0, 30))]
        out.append((None if k == 5 else f"g{k}", x, edition(g, x)))
    return [*out, ("empty", [], []), ("left", ["a", None], []), ("right", [], ["a"])]


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_words_side_by_side_need_no_shuffle(spark):
    """Rows that hold both sides give what two tables give; nothing is shuffled."""
    keyed = lambda xs: [(i, w, w and w.lower(), w and w.lower()) for i, w in enumerate(xs)]
    side, both = _both(spark, [(n, keyed(x), keyed(y)) for n, x, y in _editions()], "i int, word string, key string, loose string")
    for made in (lambda a, b: al.align_words(a, b, "g"), lambda a, b: al.longest_runs(a, b, "g", "key")):
        want, got = made(side(0), side(1)), made(both, None)
        assert exchanges(got) == 0
        assert _sorted(got) == _sorted(want) and got.dtypes == want.dtypes and got.count() > 300
    twice = al.side_by_side(spark.createDataFrame([("x", [{"i": 0, "key": "a"}])] * 2, "g string, w array<struct<i:int,key:string>>").coalesce(1), "g", {"key": F.col("w.key")}, {"i": F.col("w.i"), "key": F.col("w.key")})
    assert _sorted(al.longest_runs(twice, None, "g", "key")) == [("x", 0, 0), ("x", 0, 0)]  # rows of one name don't meet


def test_occurrence_keys(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "", "b", ""]), (2, []), (3, None), (4, ["b"])], "k int, w array<string>")
    got = {r.k: r.key for r in al.occurrence_keys(rows.coalesce(1), "w", "key").collect()}
    assert got == {1: ["b#1", "a#1", "b#2", "#1", "b#3", "#2"], 2: [], 3: [], 4: ["b#1"]}


def _exchanges_of(spark, name):
    """Exchanges of a query's plan, and what it wrote for itself."""
    from tessera.plans.catalogue import QUERIES

    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = set(os.listdir(at))
    return exchanges(QUERIES[name](spark, "/root/testdata/sf0.001")), set(os.listdir(at)) - held


def test_values_are_taken_over_where_words_are_matched(spark):
    """As by the joins of `transfer`, of two tables by one shuffle and of rows that hold both sides by none."""
    keyed = lambda xs, k: [(i, w and w.lower(), None if k == 0 or i % 4 == 1 else 7 * i) for i, w in enumerate(xs)]
    side, both = _both(spark, [(n, keyed(x, 0), keyed(y, 1)) for n, x, y in _editions()], "i int, key string, value int")
    a, b = side(0).drop("value"), side(1)
    want = al.transfer(al.longest_runs(a, b, "g", "key"), a.select("g", F.col("i").alias("a")), b.select("g", F.col("i").alias("b"), "value"), "g").select("g", "a", "value")
    for got, n in ((al.transfer_words(a, b, "g", "key", "value"), 1), (al.transfer_words(both, None, "g", "key", "value"), 0)):
        assert exchanges(got) == n
        assert _sorted(got) == _sorted(want) and got.dtypes == want.dtypes and got.filter("value IS NOT NULL").count() > 200


def test_transferred_attributes_shuffles_texts_only(spark):
    assert _exchanges_of(spark, "transferred_attributes") == (1, set())


def test_notes_move_where_words_are_matched(spark):
    """As by the join of `reindex`, several notes of one word and notes of no word among them."""
    keyed = lambda xs: [(i, w and w.lower()) for i, w in enumerate(xs)]
    side, both = _both(spark, [(n, keyed(x), keyed(y), [(i, None) for i in (0, 0, 3, 7, 900)]) for n, x, y in _editions()], "i int, key string")
    a, b, notes = side(0), side(1), side(2).drop("key")
    want = al.reindex(notes, al.longest_runs(a, b, "g", "key"), "g")
    for got, n in ((al.reindex_words(a, b, notes, "g", "key"), 1), (al.reindex_words(both, None, None, "g", "key"), 0)):
        assert exchanges(got) == n
        assert _sorted(got) == _sorted(want) and got.dtypes == want.dtypes and got.count() > 50


def test_reindexed_shuffles_texts_only(spark):
    assert _exchanges_of(spark, "reindexed") == (1, set())


def test_aligned_words_shuffles_texts_only(spark):
    assert _exchanges_of(spark, "aligned_words") == (1, set())


def test_split_words_side_by_side(spark):
    keyed = lambda xs: [(i, w and w.lower()) for i, w in enumerate(xs)]
    side, both = _both(spark, [(n, keyed(x), keyed(y)) for n, x, y in _editions()], "i int, key string")
    want, got = al.gap_pass(side(0), side(1), "g"), al.gap_pass(both, None, "g")
    assert exchanges(got) == 0
    assert _sorted(got) == _sorted(want) and got.dtypes == want.dtypes and got.filter("part = 1").count() > 5


def test_split_in_two_shuffles_texts_only(spark):
    from tessera.plans.catalogue import QUERIES

    got = QUERIES["split_in_two"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc_id" in plan  # (before: words of both sides, by line)


def test_reflowed_words_side_by_side(spark):
    named = [(n, x, y) for n, x, y in _editions(seed=11)]
    ours = lambda xs: [(i, w and w.lower(), i // 4, False) for i, w in enumerate(xs)]
    others = lambda xs: [(i, w and w.lower(), -1, i % 6 == 5) for i, w in enumerate(xs)]
    side, both = _both(spark, [(n, ours(x), others(y)) for n, x, y in named], "i int, key string, verse long, stop boolean")
    want, got = al.reflow_words(side(0).drop("stop"), side(1).drop("verse"), "g"), al.reflow_words(both, None, "g")
    assert exchanges(got) == 0
    assert _sorted(got) == _sorted(want) and got.dtypes == want.dtypes and got.count() > 300


def _shuffles_words(spark, name):
    """Does a query's plan deal rows that were exploded before?"""
    from tessera.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    return bool(re.search(r"RepartitionByExpression(?:(?!Relation)[\s\S])*Generate", plan))


def test_reflowed_verses_shuffles_texts_only(spark):
    assert not _shuffles_words(spark, "reflowed_verses")


def test_division_rows(spark):
    """Rows with both sides give what two tables give, in one pass and by ranges; in one pass nothing is shuffled."""
    keyed = lambda xs: [(i, w and w.lower()) for i, w in enumerate(xs)]
    groups = [(n, keyed(x), keyed(y)) for n, x, y in _editions(seed=12)]
    side, _ = _both(spark, groups, "i long, key string")
    rows = spark.createDataFrame([(n, [k for _, k in x], [k for _, k in y]) for n, x, y in groups], "g string, a array<string>, b array<string>")
    want = al.align_division(side(0), side(1), "g").select("g", "i", "part", "j")
    for whole, most in ((1 << 20, None), (1 << 20, F.size("a") * 3), (30, None), (30, F.size("a") + F.size("b") + 1)):
        got = al.align_division_rows(rows, "g", F.col("a"), F.col("b"), most, whole=whole)
        assert whole < 1 << 20 or exchanges(got) == 0
        assert _sorted(got.select("g", "i", "part", "j")) == _sorted(want)
    assert want.count() > 300


def test_aligned_divisions_shuffles_texts_only(spark):
    assert not _shuffles_words(spark, "aligned_divisions")


def test_rows_of_many_words_go_in_pieces(spark, monkeypatch):
    """Rows of a batch go through numpy a few at a time, also where one has more words than that, or none, or a null array."""
    keyed = lambda xs: [(i, w and w.lower(), w and w.lower(), w and w.lower()) for i, w in enumerate(xs)]
    side, both = _both(spark, [(n, keyed(x), keyed(y)) for n, x, y in _editions()], "i int, word string, key string, loose string")
    want = _sorted(al.align_words(side(0), side(1), "g"))
    none = spark.createDataFrame([("null", None, None)], "g string, w array<string>, v array<string>")
    rows = both.unionByName(al.side_by_side(none, "g", *({"i": F.col("w").cast("array<int>"), "word": F.col("w"), "key": F.col("w"), "loose": F.col("w")} for _ in range(2)))).coalesce(1)
    for chunk in (1, 20, 1 << 17):
        monkeypatch.setattr(al, "_CHUNK", chunk)
        assert _sorted(al.align_words(rows, None, "g")) == want
