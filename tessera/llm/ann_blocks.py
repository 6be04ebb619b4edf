"""Approximate nearest neighbours by a block matrix join, with results that are exact.

Vectors are packed into blocks, in the precision they came in.  Query blocks are dealt into groups of about `group_queries` and
candidate blocks into runs; a cell of this grid is one task, which holds its group's query blocks and lets its run's candidate blocks
pass by.  So a query block is copied once per run and a candidate block once per group: no block is ever joined to a block as rows, and
what is shuffled and sorted is a copy per group or run, not per pair.  Groups and runs grow in number with the data, not in size.

In a cell, int8 codes with a scale per vector give product tiles, and |q.c - q^.c^| <= |q - q^| |c^| + |q| |c - c^| bounds their
error.  Pairs whose upper bound reaches the k-th best lower bound are recomputed in double precision; a heap per query keeps the
best k over all tiles of a task, and the tasks' heaps are merged by a second one.  The bounds hold for vectors whose largest component lies
within SAFE, where neither norms nor their products overflow or vanish; pairs with another vector are always recomputed.  A sum in
which products overflow is infinite, with the sign that the vectors scaled to a largest component of 1 give.

The tile is a float32 BLAS product of int8 values: exact, as sums stay under 2**24 for up to 1040 dimensions (wider
vectors are multiplied in parts).

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id.  Ties go to the
smaller id.  Vectors of another dimension than the query's are no candidates.  Rows that repeat an id are candidates
each; none of them is a candidate of a query with that id.  A query row that repeats id and vector is asked once.  An empty table, or
one without queries, gives no rows.  Only the two named columns are read: further ones, whatever their names, play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shuffle_parts

#: Where the largest component's size lies in vectors that codes stand for.
SAFE = 1e-100, 1e100
_BLOCK = "dim int, block long, n int, ids binary, vecs binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    narrow = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    v = F.col(vec_col).cast("array<float>" if narrow else "array<double>")
    ok = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).filter(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))


def _blocks(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """Rows packed by dimension; a block's number is its task and a running number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}
        out, number = [], TaskContext.get().partitionId() << 24

        def flush(dim: int) -> None:
            nonlocal number
            ids = np.concatenate([x[0] for x in held[dim]])
            vecs = np.concatenate([x[1] for x in held[dim]])
            for at in range(0, len(ids), size):
                out.append({"dim": dim, "block": number, "n": len(ids[at : at + size]), "ids": ids[at : at + size].tobytes(), "vecs": vecs[at : at + size].tobytes()})
                number += 1
            held[dim], count[dim] = [], 0

        kind = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary())])
        for b in batches:
            ids = b.column(0).to_numpy()
            lists = b.column(1)
            flat = np.asarray(lists.flatten())
            offsets = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            dims = np.diff(offsets)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                vecs = flat[(offsets[at][:, None] + np.arange(dim)[None, :])]
                held.setdefault(int(dim), []).append((ids[at], vecs))
                count[int(dim)] = count.get(int(dim), 0) + len(at)
                if count[int(dim)] >= size:
                    flush(int(dim))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        for dim in [d for d in held if held[d]]:
            flush(dim)
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    return rows.repartition(parts, "id").mapInArrow(run, _BLOCK)


class _Side:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        kind = np.float32 if len(row["vecs"]) == 4 * row["dim"] * len(self.ids) else np.float64
        self.vecs = np.frombuffer(row["vecs"], kind).reshape(len(self.ids), row["dim"]).astype(np.float64)
        top = np.abs(self.vecs).max(1, keepdims=True)
        self.safe = (top[:, 0] >= SAFE[0]) & (top[:, 0] <= SAFE[1])
        vecs = np.where(self.safe[:, None], self.vecs, 0.0)
        scale = np.where(self.safe[:, None], top, 127.0) / 127
        self.codes = np.rint(vecs / scale).astype(np.int8)
        hat = self.codes * scale
        self.scale = scale[:, 0]
        norm = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x)) * (1 + 1e-12)
        self.norm, self.hat_norm, self.lost = norm(vecs), norm(hat), norm(vecs - hat)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 times int8, exactly: parts of 1024 dimensions fit float32's whole numbers."""
    total = a[:, :1024].astype(np.float32) @ b[:, :1024].astype(np.float32).T
    if a.shape[1] <= 1024:
        return total.astype(np.float64)
    total = total.astype(np.float64)
    for at in range(1024, a.shape[1], 1024):
        total += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return total


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision; an overflow is infinite, never nan."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.einsum("ij,ij->i", a, b)
        bad = np.flatnonzero(np.isnan(out))
        if len(bad):
            unit = lambda x: x / np.abs(x).max(1, keepdims=True)
            sign = np.einsum("ij,ij->i", unit(a[bad]), unit(b[bad]))
            out[bad] = np.where(sign == 0, 0.0, np.copysign(np.inf, sign))
    return out


def tile(q: _Side, c: _Side, k: int, best: list[list[tuple[float, int]]], rows: int = 2048) -> None:
    """Bring the candidates of block c into the queries' heaps of (score, -id)."""
    for lo in range(0, len(c.ids), rows):
        part = slice(lo, lo + rows)
        estimate = _product(q.codes, c.codes[part]) * (q.scale[:, None] * c.scale[part][None, :])
        slack = q.lost[:, None] * c.hat_norm[part][None, :] + q.norm[:, None] * c.lost[part][None, :]
        slack += 1e-9 * (q.norm[:, None] * c.norm[part][None, :])
        slack[~q.safe[:, None] | ~c.safe[part][None, :]] = np.inf
        own = q.ids[:, None] == c.ids[part][None, :]
        low = np.where(own, -np.inf, estimate - slack)
        have = low.shape[1]
        kth = np.partition(low, have - k, axis=1)[:, have - k] if have > k else np.full(len(q.ids), -np.inf)
        floor = np.maximum(kth, [h[0][0] if len(h) == k else -np.inf for h in best])
        up = (estimate + slack >= floor[:, None]) & ~own
        i, j = np.nonzero(up)
        exact = np.zeros(len(i))
        a, b = q.vecs, c.vecs[part]
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            exact[s] = products(a[i[s]], b[j[s]])
        ids = c.ids[part][j]
        for qi, score, ident in zip(i.tolist(), exact.tolist(), ids.tolist(), strict=True):
            item = (score, -ident)
            if len(best[qi]) < k:
                heapq.heappush(best[qi], item)
            elif item > best[qi][0]:
                heapq.heapreplace(best[qi], item)


def nearest(vectors: DataFrame, queries: F.Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", query_rows: int = 512, block_rows: int = 4096, group_queries: int = 1 << 14, run_rows: int = 1 << 18) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score for the rows that `queries` (over column id) selects."""
    spark = vectors.sparkSession
    parts = shuffle_parts(spark)
    rows = usable(vectors, id_col, vec_col)
    few = max(1, parts // 3)
    candidates = materialize(_blocks(rows, block_rows, few), "candidates")
    asked = materialize(_blocks(rows.filter(queries).dropDuplicates(["id", "vec"]), query_rows, few), "queries")
    n_asked, n_candidates = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (asked, candidates))
    groups = max(1, -(-n_asked // group_queries))
    runs = max(1, -(-parts // groups), -(-n_candidates // run_rows))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("dim", "ids", "vecs", dealt(groups).alias("g"), each(runs).alias("r"), F.lit(0).alias("side"))
    right = candidates.select("dim", "ids", "vecs", each(groups).alias("g"), dealt(runs).alias("r"), F.lit(1).alias("side"))
    cells = left.unionByName(right).withColumn("cell", F.col("g") * runs + F.col("r")).repartitionById(groups * runs, "cell").sortWithinPartitions("dim", "side")
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, held = None, []  # the query blocks of this dimension, each with its heaps

        def close() -> Iterator[pa.RecordBatch]:
            for q, best in held:
                found = [(query, -neg, score) for query, heap in zip(q.ids.tolist(), best, strict=True) for score, neg in heap]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found, strict=True), kind.types, strict=True)], schema=kind)

        for b in batches:
            for i in range(b.num_rows):
                row = {x: b.column(b.schema.names.index(x))[i].as_py() for x in ("dim", "side", "ids", "vecs")}
                if row["dim"] != dim:
                    yield from close()
                    dim, held = row["dim"], []
                block = _Side(row)
                if row["side"] == 0:
                    held.append((block, [[] for _ in block.ids]))
                else:
                    for q, best in held:
                        tile(q, block, k, best)
        yield from close()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []
        cols: list[list] = [[], [], [], []]

        def close() -> None:
            for r, (score, neg) in enumerate(sorted(heap, key=lambda x: (-x[0], -x[1])), 1):
                for c, v in zip(cols, (now, r, -neg, score), strict=True):
                    c.append(v)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])
            for c in cols:
                c.clear()
            return made

        for b in batches:
            for query, vec, score in zip(*(b.column(b.schema.names.index(x)).to_pylist() for x in ("query_id", "vec_id", "score")), strict=True):
                if query != now:
                    close()
                    now, heap = query, []
                item = (score, -vec)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            yield batch()
        close()
        yield batch()

    found = cells.select("dim", "side", "ids", "vecs").mapInArrow(run, "query_id long, vec_id long, score double")
    return found.repartition(parts, "query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
