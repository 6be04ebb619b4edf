"""Ranked lexical search of whole tables, with documents that score alike scored once.

A document's score depends on its length class m and on how often it holds the terms that items ask for, on nothing else.  So documents are
restricted to the items' vocabulary: what stays of a text is its bag, the term numbers it holds and how often.  Documents whose m and
bag are the same form a class: they are dealt by a hash of both, and the grouping by the full values verifies it, so that two bags of
one hash are never taken for one.  A class is scored once against all items, and its members follow by ascending id.

* Texts are cut into terms where they are read, in Arrow batches; a bag has at most the vocabulary's size.  What is shuffled are bags, and of
  copies only the `k` smallest ids: no more of a class can be among an item's `k` best.  A class of a third of all
  documents is cut down to `k` rows in every task before the shuffle.
* Items are the stated queries.  They are dealt into slices of about `slice_bytes` of terms; a slice's vocabulary and its
  lists (term -> items) are sent to all tasks, so what is broadcast is bounded by the slice, or by the longest single item.  Each slice is
  one pass over the documents; the document counts are taken once.
* A task keeps a heap of `k` documents per item of the slice, and the tasks' heaps are merged by a ranking of at most `k` rows a task and item.

Weights and scores are whole numbers, so that ties are exact; equal scores go by ascending id, documents without an id come
last among them.  Nulls: a null text has no terms; a null item text finds nothing.  Rows that repeat an id are documents each, and
rows that repeat an item are items each, with results of their own (rank is unique within each).  An empty table, or items without known terms, give no
rows.  Texts of any length are read whole, in pieces of bounded size.  Only the named columns are read: further ones, whatever their names,
play no part.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Letters and digits of ASCII, A-Z lower-cased, and all bytes of other characters stay; all else parts terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are cut into terms at a time.
PIECE = 4 << 20
#: Scores of a task that are held at a time.
SCORES = 1 << 21


def terms(text: bytes) -> Counter:
    """Every term of a text and how often it occurs."""
    flat = text.translate(_TABLE)
    if len(flat) <= PIECE:
        return Counter(flat.split())
    out: Counter = Counter()
    at = 0
    while at < len(flat):
        to = flat.find(b" ", at + PIECE)
        to = to if to >= 0 else len(flat)
        out.update(flat[at:to].split())
        at = to
    return out


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number of its own), item_id, terms (distinct), bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(terms(x or b"")) for x in b.column(2).to_pylist()]
            size = [sum(len(t) + 16 for t in ts) for ts in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.binary())), pa.array(size, pa.int64())], names=["item", "item_id", "terms", "bytes"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "item long, item_id long, terms array<binary>, bytes long")


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs: doc_id, text (binary) -> doc_id, n (all terms), terms (numbers of the vocabulary, ascending), tfs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n, ids, times = [], [], []
                for text in part.column(1).to_pylist():
                    counts = terms(text or b"")
                    n.append(counts.total())
                    held = sorted((i, c) for t, c in counts.items() if (i := number(t)) is not None)
                    ids.append([i for i, _ in held])
                    times.append([c for _, c in held])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """rows: doc_id, m, terms, tfs -> m, terms, tfs, ids: one row per distinct (m, bag), with the k smallest ids of its documents."""
    key = ["hash", "m", "terms", "tfs"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("doc_id")))
    few = rows.withColumn("hash", F.xxhash64("m", "terms", "tfs")).withColumn("__first", first).filter(F.col("__first") <= k)
    ids = F.sort_array(F.collect_list(F.struct("__first", "doc_id")))["doc_id"]
    return few.groupBy(*key).agg(ids.alias("ids")).select("m", "terms", "tfs", "ids")


class _Items:
    """A slice's items, by the terms they hold: term i is held by items held[at[i] : at[i + 1]]."""

    def __init__(self, found: list[list[int]], weights: np.ndarray):
        pairs = sorted((t, i) for i, ts in enumerate(found) for t in ts)
        self.n, self.weights = len(found), weights
        self.held = np.array([i for _, i in pairs], np.int64)
        self.at = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(weights) + 1))

    def scores(self, m: np.ndarray, terms: np.ndarray, tfs: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first class, scores of classes x items) for runs of classes; class j has the entries ends[j - 1] to ends[j]."""
        sizes = np.diff(ends, prepend=0)
        worth = self.weights[terms] * ((10**9 * tfs) // (1000 * tfs + 20 * np.repeat(m, sizes)))
        lists = self.at[terms + 1] - self.at[terms]
        work = np.concatenate([[0], np.cumsum(lists)])[ends]  # pairs of an entry and an item, up to the end of a class
        most, lo = max(1, SCORES // self.n), 0
        while lo < len(m):
            done = work[lo - 1] if lo else 0
            hi = max(lo + 1, min(lo + most, int(np.searchsorted(work, done + SCORES, "right"))))
            a, b = (ends[lo - 1] if lo else 0), ends[hi - 1]
            n = lists[a:b]
            start = np.repeat(self.at[terms[a:b]] - np.concatenate([[0], np.cumsum(n)[:-1]]) if b > a else n, n)
            items = self.held[start + np.arange(n.sum())]
            rows = np.repeat(np.repeat(np.arange(hi - lo), sizes[lo:hi]), n)
            total = np.zeros((hi - lo) * self.n, np.int64)
            np.add.at(total, rows * self.n + items, np.repeat(worth[a:b], n))
            yield lo, total.reshape(hi - lo, self.n)
            lo = hi


def _best(found: DataFrame, items: list[tuple[int, int | None, list[int]]], weights: np.ndarray, k: int) -> DataFrame:
    """Each task's k best documents of every item: item, item_id, doc_id, score."""
    sent = found.sparkSession.sparkContext.broadcast((items, weights))
    kind = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, worth = sent.value
        lists = _Items([ts for _, _, ts in asked], worth)
        heaps: list[list[tuple[int, bool, int]]] = [[] for _ in asked]  # score, has an id, -id
        floor = np.ones(len(asked), np.int64)  # the least score that may enter
        for b in batches:
            m, ids = b.column(0).to_numpy(), b.column(3)
            flat, tfs, ends = np.asarray(b.column(1).flatten()).astype(np.int64), np.asarray(b.column(2).flatten()), np.cumsum(np.asarray(b.column(1).value_lengths()))
            for lo, scores in lists.scores(m, flat, tfs, ends):
                least = floor
                if len(scores) > k:  # any k classes hold k documents
                    least = np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                for c, i in zip(*(x.tolist() for x in np.nonzero(scores >= least)), strict=True):
                    heap, score = heaps[i], int(scores[c, i])
                    for doc in ids[lo + c].as_py():
                        entry = (score, doc is not None, -(doc or 0))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                        else:
                            break
                    if len(heap) == k:
                        floor[i] = heap[0][0]
        for (item, item_id, _), heap in zip(asked, heaps, strict=True):
            cols = [[item] * len(heap), [item_id] * len(heap), [-d if known else None for _, known, d in heap], [s for s, _, _ in heap]]
            if heap:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kind.types, strict=True)], schema=kind)

    return found.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", slice_bytes: int = 16 << 20) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: the k documents of the highest score above 0 of every item."""
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{doc_text}`").cast("string").cast("binary").alias("text"))
    asked = materialize(item_terms(items, item_id, item_text), "items")
    slices = max(1, -(-(asked.agg(F.sum("bytes")).first()[0] or 0) // slice_bytes))
    at = F.pmod(F.xxhash64("item"), F.lit(slices))
    whole = None
    best: DataFrame | None = None
    for s in range(slices):
        rows = asked.filter(at == s).select("item", "item_id", "terms").collect()  # about slice_bytes
        number = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        held = materialize(bags(texts, number), f"bags{s}")
        if whole is None:
            whole = held.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = {r["t"]: r["df"] for r in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # the vocabulary at most
        weights = np.array([weight(whole["documents"], df.get(i, 0)) for i in range(len(number))], np.int64)
        m = F.expr(f"100 - 50 + (50 * n * {whole['documents']}L) div {max(1, whole['terms'])}L")
        one = classes(held.filter(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs"), k)
        found = _best(one, [(r["item"], r["item_id"], [number[bytes(t)] for t in r["terms"]]) for r in rows if r["terms"]], weights, k)
        found = materialize(found, f"best{s}")
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
