"""Exact Jaccard similarity join over word shingles, in regions of the metric space.

Distance is 1 - Jaccard, a metric.  Texts of a corpus are mostly at distance 1 from one another and from any pivot,
so pivots alone can't divide it: triangle windows around a distance of 1 replicate every document to every region.
Documents are therefore first dealt into regions that no link can cross, and pivots divide the regions:

1. Equal sets become one class; only the class's smallest id goes on.
2. A set's prefix is its first n - ceil(t n) + m shingles in one global order, m = 1 + n / 50.  Two sets that link share
   m prefix shingles of the smaller one's m.  The order is by hash, with the shingles found most often in the corpus last.
3. Of the classes with a prefix shingle, ordered by size, up to NEIGHBOURS are each compared by sizes; of more, every
   class points to the first of its run, which ends where sizes are too far apart to link.  A pair known from small
   groups alone that shares under m shingles can't link and goes.  Connected components of what stays are the regions:
   rows stay linear in the input, and a link never leaves its region.
4. Within a region a pivot meets all members; |d(x, p) - d(y, p)| <= 1 - t is the window outside which two members
   can't link.  The pivot's ball is grown member by member, each compared with the members still outside within its
   window; what no ball takes in is a region again, with a pivot of its own.
5. A region of over `region_members` members or `region_shingles` shingles is not brought into one task.  It is a smaller join of the same kind:
   its shingles are ordered anew, by how many of its own members have them, so that what ties the region together (a shared passage) comes last, and
   steps 2 and 3 deal it into smaller regions, again and again as long as these halve.  Members far from all others fall out here without
   meeting anyone.  A region that doesn't fall apart is dense, and a pivot divides it: the pivot meets its members by a
   salted join.  Members that link to it are one component, so only the far ones still have links that matter: among themselves, and
   with near ones inside the triangle window.  Members are dealt to rings by their distance to the pivot, rings to blocks of at most
   `block_members`, and blocks of rings that the window joins meet in cells, each small enough for a task.
6. A shingle that over HOT sets share is not gathered into one task either: its classes point to the first of their size band, and
   that one to the first of the band below.  Such shingles are counted exactly before each grouping; the sightings of the first pass spare most of the work.

Shingles are 64-bit hashes (a pair of different shingles falls together with a chance of 2**-64).  A document with
fewer words than a shingle has one shingle, its whole sequence; one without words has none and links with nothing.
Ties: of equal counts the smaller hash comes first, of a component's documents the smallest id names it; neither affects who is linked.  Very long texts
are hashed in slices, and a set is one row.  Nulls: a null text has no words; a row with a null id gets its set's size and the component of the texts with equal
sets that have an id, else null.  Repeated rows are equal sets.  An empty table gives no rows.  Only doc_id and the text column are read:
further ones, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, materialize, release
from tessera.llm.wordhash import each_slice, mix, window_hashes
from tessera.operators.graph import components

_U = np.uint64
#: Groups of a shingle up to this size are looked at member by member.
NEIGHBOURS = 16
#: Shingles that a prefix is longer than needed: one in so many of a set's.
SPARE = 50
#: Sightings from which a shingle's group is taken for too large for one task.
HOT = 1 << 14
#: What a task that joins regions is given, of members and of shingles; a larger region is split.
TASK_MEMBERS, TASK_SHINGLES = 1 << 10, 1 << 20
#: Document ids that are sent to every executor at most, as a filter of the second read; more are joined by a shuffle.
SENT_IDS = 1_000_000


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data, offsets = bytes_of(col)
    for i, j, h, first in each_slice(data, offsets, lower=True):
        windows = window_hashes(h, k)
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= k:
                yield np.unique(windows[a : b - k + 1])
            elif b > a:
                yield mix(window_hashes(h[a:b], b - a) + _U(b - a))
            else:
                yield np.zeros(0, _U)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=_U).astype(np.int64)), int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).astype(np.int64))


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def common_shingles(docs: DataFrame, k: int, keep: int, hot: int = HOT, flush: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most `keep` (sorted), and those of them sighted `hot` times or more; texts with equal sets count
    once in a task's run.

    Tasks send what they meet in two sets or more of a run of `flush` shingles; the sums only shape the prefix order,
    any order gives the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        release()

        def counted() -> pa.RecordBatch:
            if held:
                u, n = np.unique(np.concatenate(held), return_counts=True)
                u, n = u[n > 1], n[n > 1]
            else:
                u, n = np.zeros(0, _U), np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(_long(u), pa.int64()), pa.array(n, pa.int64())], names=["s", "n"])

        for b in batches:
            for s in shingle_sets(b.column(0), k):
                mark = fingerprint(s)
                if len(s) and mark not in seen:
                    seen.add(mark)
                    held.append(s)
                    size += len(s)
                if size >= flush:
                    yield counted()
                    held, size, seen = [], 0, set()
        yield counted()

    counts = materialize(docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.least(F.sum("n"), F.lit(1 << 16)).alias("n")), "common")
    held = least = 0
    for n, some in sorted(((r["n"], r["c"]) for r in counts.groupBy("n").agg(F.count("*").alias("c")).collect()), reverse=True):
        if held + some > keep:
            break
        held, least = held + some, n
    if not held:
        return np.zeros(0, _U), np.zeros(0, _U)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            often = b.column(1).to_numpy() >= hot
            cols = [b.column(0).to_numpy().tobytes(), b.column(0).to_numpy()[often].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], names=["b", "h"])

    rows = counts.filter(F.col("n") >= least).select("s", "n").mapInArrow(packed, "b binary, h binary").collect()  # 16 bytes each of at most `keep`
    return tuple(np.sort(np.frombuffer(b"".join(r[c] for r in rows), _U)) for c in ("b", "h"))


def _prefixes(docs: DataFrame, k: int, percent: int, common: np.ndarray, hot: np.ndarray) -> DataFrame:
    """doc_id, n, f1, f2, prefix and which of it are hot shingles, of every row."""
    held = docs.sparkSession.sparkContext.broadcast((common, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, hottest = held.value
        release()
        for b in batches:
            n, f1, f2, prefix, hot_ones = [], [], [], [], []
            for s in shingle_sets(b.column(1), k):
                n.append(len(s))
                a, c = fingerprint(s)
                f1.append(a)
                f2.append(c)
                most = len(s) - (percent * len(s) + 99) // 100 + 1 + len(s) // SPARE if len(s) else 0
                if len(often) and len(s):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    late = often[at] == s
                    p = s[~late][:most]
                    if len(p) < most:
                        p = np.concatenate([p, s[late][: most - len(p)]])
                else:
                    p = s[:most]
                is_hot = np.isin(p, hottest) if len(hottest) else np.zeros(len(p), bool)
                prefix.append(_long(p[~is_hot]))
                hot_ones.append(_long(p[is_hot]))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (prefix, hot_ones)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), *lists], names=["doc_id", "n", "f1", "f2", "prefix", "hot"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, prefix array<long>, hot array<long>")


class _Region:
    """Members of a region, for one pivot against many."""

    def __init__(self, reps: list[int], sets: list[np.ndarray], percent: int):
        order = sorted(range(len(reps)), key=lambda i: reps[i])
        self.reps, self.sets, self.percent = [reps[i] for i in order], [sets[i] for i in order], percent
        self.size = np.array([len(s) for s in self.sets])

    def _against(self, p: int, others: np.ndarray, code: np.ndarray, starts: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of p with `others`, whose coded sets lie one after another."""
        mark[self.code[p]] = 1
        hit = np.add.reduceat(mark[code], starts)
        mark[self.code[p]] = 0
        return hit

    def links(self) -> Iterator[tuple[int, int]]:
        """(member, smallest member of its component), both ids."""
        if len(self.reps) == 2:
            both = len(np.intersect1d(self.sets[0], self.sets[1], assume_unique=True))
            if 100 * both >= self.percent * (self.size.sum() - both):
                yield self.reps[1], self.reps[0]
            return
        values, inverse = np.unique(np.concatenate(self.sets), return_inverse=True)
        ends = np.cumsum(self.size)
        self.code = [inverse[e - n : e] for e, n in zip(ends, self.size, strict=True)]
        mark = np.zeros(len(values), np.int32)
        left = np.arange(len(self.reps))
        slack = (100 - self.percent) / 100 + 1e-9
        while len(left) > 1:
            pivot, left = left[0], left[1:]
            code = np.concatenate([self.code[i] for i in left])
            starts = np.concatenate([[0], np.cumsum(self.size[left])[:-1]])
            both = self._against(pivot, left, code, starts, mark)
            union = self.size[left] + self.size[pivot] - both
            far = 1 - both / union
            near = 100 * both >= self.percent * union
            ball = [(int(i), float(d)) for i, d in zip(left[near], far[near], strict=True)]
            left, far = left[~near], far[~near]
            at = 0
            while at < len(ball):
                x, d = ball[at]
                at += 1
                yield self.reps[x], self.reps[pivot]
                if not len(left):
                    continue
                fits = (np.abs(far - d) <= slack) & (100 * np.minimum(self.size[left], self.size[x]) >= self.percent * np.maximum(self.size[left], self.size[x]))
                some = np.flatnonzero(fits)
                if not len(some):
                    continue
                rows = left[some]
                code = np.concatenate([self.code[i] for i in rows])
                starts = np.concatenate([[0], np.cumsum(self.size[rows])[:-1]])
                both = self._against(x, rows, code, starts, mark)
                got = 100 * both >= self.percent * (self.size[rows] + self.size[x] - both)
                if got.any():
                    ball += [(int(i), float(f)) for i, f in zip(rows[got], far[some][got], strict=True)]
                    stay = np.ones(len(left), bool)
                    stay[some[got]] = False
                    left, far = left[stay], far[stay]


def _join_regions(members: DataFrame, percent: int) -> DataFrame:
    """members (a table): region, rep, set -> rep, other: links that connect each component."""
    kind = pa.schema([("rep", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, sets, out = None, [], [], []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], schema=kind)

        for b in batches:
            region, rep, flat = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            values, ends = np.asarray(flat.flatten()).view(_U), np.cumsum(np.asarray(flat.value_lengths()))
            for i, (g, r) in enumerate(zip(region, rep, strict=True)):
                if g != now:
                    if len(reps) > 1:
                        out.extend(_Region(reps, sets, percent).links())
                    now, reps, sets = g, [], []
                reps.append(r)
                sets.append(values[(ends[i - 1] if i else 0) : ends[i]].copy())
            yield batch()
        if len(reps) > 1:
            out.extend(_Region(reps, sets, percent).links())
        yield batch()

    # as many tasks as the work needs: many small regions share one, and a region is never more than one task's share
    rows = members.select("region", "rep", "set")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("set")), F.lit(0)).alias("s")).first()
    tasks = max(1, -(-size["n"] // TASK_MEMBERS), -(-size["s"] // TASK_SHINGLES))
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("region"), F.lit(tasks)).cast("int")).repartitionById(tasks, "task").select("region", "rep", "set").sortWithinPartitions("region")
    return dealt.mapInArrow(run, "rep long, other long")


def _split_regions(pool: DataFrame, percent: int, block_members: int, block_shingles: int, salts: int = 32) -> tuple[DataFrame, DataFrame]:
    """pool (a table): region, rep, set -> (links to the regions' pivots, cells: region, rep, set) whose links are all that is left to find."""
    pivots = pool.groupBy("region").agg(F.min("rep").alias("pivot"))
    pivots = pivots.join(pool.select("region", F.col("rep").alias("pivot"), F.col("set").alias("pivot_set")), ["region", "pivot"])
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = pool.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")).join(pivots.hint("shuffle_hash"), ["region", "salt"])
    both = F.size(F.array_intersect("set", "pivot_set"))
    met = met.select("region", "rep", "pivot", F.size("set").alias("n"), both.alias("both"), (F.size("set") + F.size("pivot_set") - both).alias("union"))
    near = 100 * F.col("both") >= percent * F.col("union")
    met = materialize(met.select("region", "rep", "pivot", "n", near.alias("near"), (1 - F.col("both") / F.col("union")).alias("d")), "met")
    links = met.filter("near AND rep <> pivot").select(F.col("rep").alias("u"), F.col("pivot").alias("v"))
    slack, rings = (100 - percent) / 100 + 1e-9, 8
    nearest = met.filter("NOT near").groupBy("region").agg(F.min("d").alias("nearest"))
    open_ = met.join(nearest, "region").filter(~F.col("near") | (F.col("d") >= F.col("nearest") - slack)).withColumn("ring", F.floor(F.col("d") * rings / slack).cast("int"))
    size = open_.groupBy("region", "near", "ring").agg(F.greatest(F.ceil(F.count("*") / block_members), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("parts"))
    placed = materialize(open_.join(size, ["region", "near", "ring"]).select("region", "rep", "near", "ring", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part")), "placed")
    blocks = size.select("region", "near", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    x = blocks.filter("NOT near").select("region", F.struct("near", "ring", "part").alias("x"))
    y = blocks.select("region", F.struct("near", "ring", "part").alias("y"))
    pairs = x.join(y, "region").filter((F.abs(F.col("x.ring") - F.col("y.ring")) <= rings + 1) & (F.col("y.near") | (F.col("x") <= F.col("y"))))
    cells = pairs.select("region", F.xxhash64("region", "x", "y").alias("cell"), F.explode(F.array_distinct(F.array("x", "y"))).alias("b")).select("region", "cell", "b.*")
    rows = placed.join(cells, ["region", "near", "ring", "part"]).select("cell", "region", "rep")
    return links, rows.join(pool, ["region", "rep"]).select(F.col("cell").alias("region"), "rep", "set")


def _pointers(dealt: DataFrame, percent: int) -> DataFrame:
    """rep, n, s (a row per prefix shingle) -> u, v: pairs whose components hold every link."""
    by_size = Window.partitionBy("s").orderBy("n", "rep")
    whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fits = lambda small, large: 100 * small >= percent * large
    before = [F.struct(F.lag("rep", k).over(by_size).alias("v"), F.lag("n", k).over(by_size).alias("m")) for k in range(1, NEIGHBOURS)]
    torn = F.when(F.coalesce(fits(F.lag("n").over(by_size), F.col("n")), F.lit(False)), F.lit(None)).otherwise(F.struct(F.col("rep").alias("v"), F.col("n").alias("m")))
    shared = dealt.withColumn("c", F.count("*").over(whole)).filter("c > 1").withColumn("before", F.array(*before)).withColumn("torn", torn)
    shared = shared.withColumn("head", F.last("torn", ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.filter("before", lambda b: b["v"].isNotNull() & fits(b["m"], F.col("n")))
    first = F.filter(F.array("head"), lambda h: h["v"] != F.col("rep"))
    pairs = shared.select("rep", "n", (F.col("c") > NEIGHBOURS).alias("many"), F.explode(F.when(F.col("c") > NEIGHBOURS, first).otherwise(near)).alias("b"))
    met = pairs.groupBy(F.col("rep").alias("u"), F.col("b.v").alias("v"), F.least("n", "b.m").alias("n")).agg(F.count("*").alias("k"), F.max("many").alias("many"))
    return met.filter(F.col("many") | (F.col("k") >= 1 + F.floor(F.col("n") / SPARE))).select("u", "v")


def _band_pointers(hot: DataFrame, percent: int, salts: int = 32) -> DataFrame:
    """rep, n, s (a row per hot prefix shingle) -> u, v: sizes of links are in one band or in neighbouring ones, so each class points to its
    band's first, and that one to the first of the band below.  Sums come before shuffles, and a hot band is spread over `salts` keys."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("long") if percent < 100 else F.col("n")
    rows = hot.select("rep", "s", band.alias("band"))
    heads = materialize(rows.groupBy("s", "band").agg(F.min("rep").alias("head")), "heads")
    below = heads.select("s", (F.col("band") + 1).alias("band"), F.col("head").alias("v"))
    chain = heads.join(below, ["s", "band"]).select(F.col("head").alias("u"), "v")
    spread = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    star = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")).join(spread, ["s", "band", "salt"]).select(F.col("rep").alias("u"), F.col("head").alias("v"))
    return star.unionByName(chain).filter("u <> v").distinct()


def _dealt_pointers(dealt: DataFrame, percent: int, hot: int) -> DataFrame:
    """rep, n, s -> u, v by groups of a shingle; groups of over `hot` classes, counted exactly, by size bands."""
    many = materialize(dealt.groupBy("s").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("s"), "hot")
    if not many.limit(1).count():
        return _pointers(dealt, percent)
    return _pointers(dealt.join(many, "s", "left_anti"), percent).unionByName(_band_pointers(dealt.join(many, "s", "left_semi"), percent))


def _regrouped(pool: DataFrame, percent: int, hot: int, salts: int = 16) -> DataFrame:
    """pool (a table): region, rep, set -> region (a new one), rep, set, of (the old one): the regions that are left when each region's shingles are
    ordered by its own counts, rarest first.  Members that share no rare shingles with any other are in none."""
    rows = pool.select("region", "rep", F.size("set").alias("n"), F.explode("set").alias("s"))
    counts = rows.groupBy("region", "s").agg(F.count("*").alias("c")).filter("c > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ranked = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")).join(counts.hint("shuffle_hash"), ["region", "s", "salt"], "left")
    in_order = F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "s")))
    most = F.expr(f"n - ({percent} * n + 99) div 100 + 1 + n div {SPARE}").cast("int")
    prefix = ranked.groupBy("region", "rep", "n").agg(in_order.alias("x")).select("region", "rep", "n", F.slice("x", F.lit(1), most).alias("x"))
    dealt = prefix.select("rep", F.col("n").cast("long").alias("n"), "region", F.explode(F.filter("x", lambda x: x["c"] > 1)).alias("x"))
    dealt = materialize(dealt.select("rep", "n", F.xxhash64("region", "x.s").alias("s")), "prefixes")
    pointers = materialize(_dealt_pointers(dealt, percent, hot), "pointers")
    new = components(pointers).select(F.col("node").alias("rep"), F.col("root").alias("__new"))
    return materialize(pool.withColumnRenamed("region", "of").join(new, "rep").select(F.col("__new").alias("region"), "rep", "set", "of"), "regrouped")


def _large_links(pool: DataFrame, percent: int, region_members: int, region_shingles: int, block_members: int, hot: int) -> DataFrame:
    """pool (a table): region, rep, set of regions that are too large for a task -> u, v: links that connect each component."""
    sized = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("members"), F.sum(F.size("set")).alias("total"))
    pair = lambda found: found.select(F.col("rep").alias("u"), F.col("other").alias("v"))
    links = None
    while True:
        new = _regrouped(pool, percent, min(hot, max(1, region_members // 4)))
        was = sized(pool, "region").select(F.col("region").alias("of"), F.col("members").alias("before"), F.col("total").alias("shingles_before"))
        sizes = sized(new, "region", "of").join(was, "of")
        over = (F.col("total") > region_shingles) | (F.col("members") > region_members)
        halved = (2 * F.col("members") <= F.col("before")) | (2 * F.col("total") <= F.col("shingles_before"))
        fate = F.when(~over, "small").when(halved, "again").otherwise("dense")
        fates = materialize(sizes.select("region", fate.alias("fate")), "fates")
        of = {x: new.join(fates.filter(F.col("fate") == x).select("region"), "region", "left_semi").select("region", "rep", "set") for x in ("small", "again", "dense")}
        have = {r["fate"] for r in fates.select("fate").distinct().collect()}
        if "small" in have:
            links = _both(links, pair(_join_regions(materialize(of["small"], "small"), percent)))
        if "dense" in have:
            near, cells = _split_regions(materialize(of["dense"], "dense"), percent, block_members, max(1, region_shingles // 4))
            links = _both(_both(links, near), pair(_join_regions(materialize(cells, "cells"), percent)))
        if links is None:
            links = pool.sparkSession.createDataFrame([], "u long, v long")
        if "again" not in have:
            return links
        pool = materialize(of["again"], "pool")


def _both(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def similar_groups(docs: DataFrame, k: int = 4, percent: int = 85, text_col: str = "text", common: int = 2_000_000, region_shingles: int = TASK_SHINGLES, region_members: int = TASK_MEMBERS, block_members: int = TASK_MEMBERS // 4, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link at Jaccard >= percent / 100."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    often, hottest = common_shingles(texts, k, common, hot)
    rows = materialize(_prefixes(texts, k, percent, often, hottest), "prefixes")
    key = ["n", "f1", "f2"]
    classes = rows.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    known = rows.filter("n > 0 AND doc_id IS NOT NULL")
    first = lambda df, c: df.groupBy(*key).agg(F.min(F.struct("doc_id", c)).alias("m")).select(F.col("m.doc_id").alias("rep"), "n", F.col(f"m.{c}").alias(c))
    heads = materialize(first(known, "prefix"), "heads")
    pointers = _dealt_pointers(heads.select("rep", "n", F.explode("prefix").alias("s")), percent, hot)
    if len(hottest):
        # equal sets have equal hot shingles: only the rows that have some are read for these
        pointers = pointers.unionByName(_band_pointers(first(known.filter(F.size("hot") > 0), "hot").select("rep", "n", F.explode("hot").alias("s")), percent))
    pointers = materialize(pointers, "pointers")
    regions = materialize(components(pointers).select(F.col("node").alias("rep"), F.col("root").alias("region")), "regions")

    wanted = regions.select(F.col("rep").alias("doc_id"), "region")
    wanted = F.broadcast(wanted) if regions.count() <= SENT_IDS else wanted.hint("shuffle_hash")
    some = texts.join(wanted, "doc_id").select("doc_id", "text", "region")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(shingle_sets(b.column(1), k))
            marks = [fingerprint(s) for s in made]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([_long(s) for s in made], pa.list_(pa.int64()))], names=["region", "rep", "f1", "f2", "set"])

    members = some.mapInArrow(sets, "region long, rep long, f1 long, f2 long, set array<long>")
    if rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b")).filter("a <> b").limit(1).count():
        # an id with two texts: only the rows of the class that the id stands for
        members = members.join(classes.select("rep", "f1", "f2"), ["rep", "f1", "f2"], "left_semi").dropDuplicates(["rep", "f1", "f2"])
    sizes = regions.join(heads.select("rep", "n"), "rep").groupBy("region").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    over = (F.col("total") > region_shingles) | (F.col("members") > region_members)
    large = materialize(sizes.filter(over).select("region"), "large")
    pair = lambda found: found.select(F.col("rep").alias("u"), F.col("other").alias("v"))
    members = materialize(members, "members")
    if not large.limit(1).count():
        links = pair(_join_regions(members, percent))
    else:
        links = pair(_join_regions(members.join(large, "region", "left_anti"), percent))
        pool = materialize(members.join(large, "region", "left_semi").select("region", "rep", "set").dropDuplicates(["region", "rep"]), "pool")
        links = links.unionByName(_large_links(pool, percent, region_members, region_shingles, block_members, hot))
    found = components(materialize(links, "links"))
    found = found.select(F.col("node").alias("rep"), "root")
    labels = materialize(classes.join(found, "rep", "left").select(*key, F.coalesce("root", "rep").alias("component_id")), "labels")
    linked = rows.select("doc_id", *key).filter("n > 0").join(labels, key, "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
