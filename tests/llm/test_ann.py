"""Nearest neighbours by brute force: order of ties, repeated rows, wide and odd vectors, many groups and runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann_blocks


def by_hand(vecs, asked, k):
    fine = [(i, np.array(v, float)) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in fine:
        if asked(q):
            near = sorted((-float(a @ b), i) for i, b in fine if i != q and len(b) == len(a))[:k]
            out[q] = [(r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return out


@pytest.mark.parametrize("how", [{}, {"query_rows": 3, "block_rows": 16, "group_queries": 5, "run_rows": 40}])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_by_brute_force(spark, how, kind):
    g = np.random.default_rng(2)
    grid = g.integers(-3, 4, (260, 6)).astype(float)  # whole numbers: scores are exact and full of ties
    vecs = [(i, v.tolist()) for i, v in enumerate(grid)]
    vecs += [(300, vecs[3][1]), (301, [0.0] * 6), (302, [float("nan")] * 6), (303, None), (None, vecs[0][1]), (304, [1.0, 2.0]), (305, [1.0, None]), (306, [float("inf"), 1.0]), (320, [2.0, 1.0]), (7, vecs[7][1]), (40, vecs[40][1]), (340, [1.0] * 3)]
    vecs += [(400 + i, [1.0] * 6) for i in range(60)]  # one common vector
    df = spark.createDataFrame(vecs, f"vec_id long, embedding array<{kind}>").withColumn("score", F.lit("x")).withColumn("id", F.lit(1)).withColumn("block", F.lit(1))
    got = ann_blocks.nearest(df.repartition(3), F.col("id") % 20 == 0, 20, **how).collect()
    want = by_hand(vecs, lambda i: i % 20 == 0, 20)
    have = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        have.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert have == {q: v for q, v in want.items() if v}
    assert ann_blocks.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert ann_blocks.nearest(df.filter("vec_id % 20 <> 0"), F.col("id") % 20 == 0).count() == 0


def test_wide_vectors(spark):
    g = np.random.default_rng(3)
    vecs = [(i, v.tolist()) for i, v in enumerate(g.standard_normal((90, 2500)))]
    got = ann_blocks.nearest(spark.createDataFrame(vecs, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 5).collect()
    want = by_hand(vecs, lambda i: i % 20 == 0, 5)
    for r in got:
        assert want[r.query_id][r.rank - 1][1] == r.vec_id and abs(want[r.query_id][r.rank - 1][2] - r.score) < 1e-9
    assert len(got) == 25


def test_whole_range_of_doubles(spark):
    """One-hot and other queries against vectors near the ends of the range of doubles, all pairs by plain sums."""
    g = np.random.default_rng(12)
    hot = [[1.0, 0, 0, 0], [0, 0, 1e-300, 0], [1e200, 0, 0, 0], [0, 1e308, 0, 0], [5e-324, 0, 0, 0], [0, 1.0, -1.0, 0]]
    vecs = [(20 * k, list(map(float, v))) for k, v in enumerate(hot)]
    vecs += [(1000 + 2 * k + 1, v) for k, v in enumerate(g.normal(size=(60, 4)).tolist())]
    odd = [[1e200, 1e200, 0, 0], [1e-310, 0, 0, 0], [1e308, 1e308, 1e308, 1e308], [-1e308, 1e-308, 5e-324, 0], [0, 0, 1e155, 1e155], [1e-155, 1e155, 0, 0], [0, 0, 0, 5e-324], [1e308, -1e308, 1e308, 0]]
    vecs += [(2001 + 2 * k, list(map(float, v))) for k, v in enumerate(odd)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann_blocks.nearest(df, F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(got) == [20 * k for k in range(len(hot))]
    for q, a in vecs[: len(hot)]:
        with np.errstate(over="ignore"):
            want = sorted((-float(np.dot(a, b)), i) for i, b in vecs if i != q)[:20]
        assert [(-got[q][r][1], got[q][r][0]) for r in range(1, 21)] == want, q
    both = np.array([[1e300, 1e300], [1e300, -1e300]]), np.array([[1e300, -1e299], [1e300, 1e300]])
    assert ann_blocks.products(*both).tolist() == [np.inf, 0.0]
