"""The Merkle manifest by plain loops, for several fanouts and block sizes; edges."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """(last node, siblings level by level of every node as (before, after))."""
    paths, owners, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        up, up_owners = [], []
        for at in range(0, len(level), fanout):
            run = level[at : at + fanout]
            for j in range(len(run)):
                for o in owners[at + j]:
                    paths[o].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h("".join(run)))
            up_owners.append([o for j in range(len(run)) for o in owners[at + j]])
        level, owners = up, up_owners
    return level[0], paths


def by_hand(rows, fanout):
    """doc_id, leaf -> subroot, root, path (a multiset: equal rows have one leaf and several places)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    low = {k: (sorted(groups[k], key=lambda x: x[:3]),) for k in order}
    low = {k: (v[0], *climb([x[2] for x in v[0]], fanout)) for k, v in low.items()}
    root, high = climb([low[k][1] for k in order], fanout) if order else (None, [])
    return sorted((x[3][0] or -1, x[2], low[k][1], root, tuple(p + high[i])) for i, k in enumerate(order) for x, p in zip(low[k][0], low[k][2], strict=True))


def made(spark, rows, **how):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((r.doc_id or -1, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in mm.manifest(docs, **how).collect())


@pytest.mark.parametrize(("fanout", "block", "n"), [(2, 4, 150), (2, 256, 150), (3, 9, 100), (2, 2, 17)])
def test_by_plain_loops(spark, fanout, block, n):
    g = random.Random(fanout * block)
    rows = [(k, g.choice(["a", None, "ü"]), g.choice(["en"] * 8 + ["de", None, "", "é", "z"]), g.choice([None, k]), "x" * g.randint(0, 9)) for k in range(n)]
    rows += [(5, "a", "en", 1, "twice")] * 9 + [(5, "a", "en", 2, "other"), (None, None, None, None, None), (None, "s", "en", 1, "no id"), (999, "s", "only one", 1, "漢字")]
    assert made(spark, rows, fanout=fanout, block=block) == by_hand(rows, fanout)


def test_small_tables(spark):
    for n in (1, 2, 3, 5):
        rows = [(k, "s", "en", k, "t") for k in range(n)]
        assert made(spark, rows, block=4) == by_hand(rows, 2)
    one = made(spark, [(7, "s", "en", 1, "t")])
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == ()
    assert made(spark, []) == []


def test_tampering_shows(spark):
    rows = [(k, "s", "en" if k % 3 else "de", None if k % 10 == 0 else k, "text " * k) for k in range(60)] + [(100, "s", "fr", 1, "word " * 200_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit(1)).withColumn("grp", F.lit("x")).withColumn("leaf", F.lit(None).cast("string"))
    columns = [F.col(x) + 1 if x == "n_chars" else F.col(x) for x in mm.FIELDS]
    got = mm.manifest(docs, F.when(F.col("doc_id") % 2 == 0, mm.leaf(columns)), block=16)
    got = got.select("doc_id", "leaf", "root", "claimed", mm.fold(F.coalesce("claimed", "leaf"), F.col("path")).alias("folded"), F.sha2(mm.siblings(F.col("path")), 256).alias("proof"), "path").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.folded == r.root) == (r.doc_id % 2 == 1 or r.doc_id % 10 == 0 and r.doc_id < 100)
        assert r.proof == h("".join(s.before + s.after for s in r.path))
