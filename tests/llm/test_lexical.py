"""Ranked lexical search by plain loops: copies, ties, slices of items, bags of one hash, edges."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def cut(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    bags = [(d, Counter(cut(t))) for d, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            m = 100 - 50 + (50 * b.total() * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(cut(text)) if t in b)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def made(spark, docs, items, k, **how):
    rows = ls.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k, **how).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


def test_by_plain_loops(spark):
    g = random.Random(2)
    words = ["the", "The", "a", "of", "ñandú", "漢字", "x1", "rare", "cat", "dog", "mat"] + [f"w{i}" for i in range(30)]
    text = lambda n: "".join(g.choice(words) + g.choice([" ", "  ", ", ", "_", "\n", "-\t"]) for _ in range(n))
    docs = [(k, text(g.randint(0, 40))) for k in range(150)]
    docs += [(1000 + k, docs[7][1]) for k in range(90)] + [(2000 + k, "cat mat") for k in range(70)] + [(3000 + k, "mat! CAT.") for k in range(70)] + [(5, "rare cat"), (5, "rare cat"), (None, None), (None, "rare dog"), (9999, ""), (9998, "?!")]
    items = [(k, text(g.randint(1, 12))) for k in range(12)] + [(50, "cat mat"), (50, "cat mat"), (51, "unknownword"), (52, None), (53, ""), (54, "rare"), (None, "dog"), (55, " ".join(words))]
    want = by_hand(docs, items, 20)
    assert made(spark, docs, items, 20) == want
    assert made(spark, docs, items, 20, slice_bytes=150) == want  # several slices
    assert made(spark, docs, items, 500) == by_hand(docs, items, 500)


def test_classes_keep_all_that_can_be_among_the_best(spark):
    rows = [(i, 60, [1, 2], [1, 1]) for i in range(30)] + [(i, 61, [1, 2], [1, 1]) for i in range(100, 103)] + [(i, 60, [1, 2], [1, 2]) for i in range(200, 203)] + [(None, 60, [3], [1]), (None, 60, [3], [1]), (7, 60, [3], [1])]
    got = {(r.m, tuple(r.terms), tuple(r.tfs)): r.ids for r in ls.classes(spark.createDataFrame(rows, "doc_id long, m long, terms array<int>, tfs array<long>").repartition(4), 5).collect()}
    assert got == {(60, (1, 2), (1, 1)): [0, 1, 2, 3, 4], (61, (1, 2), (1, 1)): [100, 101, 102], (60, (1, 2), (1, 2)): [200, 201, 202], (60, (3,), (1,)): [7, None, None]}


def test_scores_in_runs(monkeypatch):
    """Runs of classes give the same scores however short they are."""
    g = np.random.default_rng(1)
    lists = ls._Items([sorted(g.choice(50, 9, replace=False).tolist()) for _ in range(7)], g.integers(0, 9000, 50))
    sizes = g.integers(1, 20, 200)
    terms, tfs, m = g.integers(0, 50, sizes.sum()), g.integers(1, 9, sizes.sum()), g.integers(50, 500, 200)
    whole = None
    for most in (1 << 21, 100, 1):
        monkeypatch.setattr(ls, "SCORES", most)
        got = np.concatenate([s for _, s in lists.scores(m, terms, tfs, np.cumsum(sizes))])
        assert whole is None or (got == whole).all()
        whole = got


def test_edges(spark):
    docs = spark.createDataFrame([(1, "cat " * 1_500_000 + "dog"), (2, "cat"), (3, "x" * 100_000)], DOCS).withColumn("n", F.lit("x")).withColumn("m", F.lit(1)).withColumn("terms", F.lit(2)).withColumn("item_id", F.lit(3))
    items = spark.createDataFrame([(1, "dog cat"), (2, "x" * 100_000)], ITEMS).withColumn("doc_id", F.lit(3)).withColumn("bytes", F.lit("y"))
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in ls.search(docs, items).collect())
    assert got == by_hand([(1, "cat " * 1_500_000 + "dog"), (2, "cat"), (3, "x" * 100_000)], [(1, "dog cat"), (2, "x" * 100_000)], 50)
    assert ls.search(docs.limit(0), items).count() == 0 and ls.search(docs, items.limit(0)).count() == 0
    assert sum(ls.terms(b"ab " * 3_000_000 + b"c").values()) == 3_000_001
