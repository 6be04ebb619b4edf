"""A Merkle manifest of a dataset: leaves, subroots by group, one root, and a proof for every row.

Rows are hashed where they are read; from there on only digests move.  Leaves are numbered within their group by a range sort (a hot
group lies over many tasks), and every `block` consecutive nodes of a group (a power of the fanout) form an aligned block.  A block keeps
each of its levels as one hex string, 64 characters a node: fixed-width substrings of a level are the runs, whose hashes are
joined to the next level's string; what a run's substring holds before and after a node are the sibling segments of that node.  A block ends
in one node, and blocks' nodes are blocked again until a group has one node, its subroot; subroots, ordered by group, go up to the root
in the same way.  Proofs are put together downwards: a block's own proof is appended to those of its nodes.

A level's string is read as bytes, so that a substring is a slice.  A task holds a block's rows (`block` digests and ids), whatever the size of a group.

Nulls: a null field is hashed as "-", a null id comes first in its group, a null group before all others; a null in the tampered field
stays null, so that row verifies.  Rows that repeat an id are leaves each, ordered by their digest; equal rows have equal leaves, and
which of them has which place is arbitrary (the multiset of results is the same).  A group of one row has its leaf as subroot, a table of one
group its subroot as root.  An empty table gives no rows.  Texts of any length are hashed whole.  Only the named columns are read: further ones,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shuffle_parts

HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def field(x: Column) -> Column:
    """A field's text: its length in bytes, a colon and its value; "-" for a null."""
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field, columns)))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes: grp and more -> with pos (from 0 within grp, by `order`) and total (nodes of grp).

    A range sort numbers the rows of a task; what the tasks before hold of a group is added from a table of a row per task and group."""
    parts = shuffle_parts(nodes.sparkSession)
    keyed = materialize(nodes.withColumn("__tie", F.monotonically_increasing_id()), "nodes")  # the tie splits runs of equal rows
    by = ["grp", *order, "__tie"]
    at = F.monotonically_increasing_id()
    dealt = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = materialize(dealt.withColumn("__at", at).withColumn("__task", F.shiftright("__at", 33)), "sorted")
    runs = dealt.groupBy("grp", "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("grp").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("total", F.sum("__n").over(Window.partitionBy("grp")))
    placed = dealt.join(runs.drop("__n"), ["grp", "__task"]).withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before"))
    return placed.drop("__at", "__task", "__first", "__before", "__tie")


def _up(level: Column, width: int) -> Column:
    """The next level's string: the hash of every fixed-width substring."""
    starts = F.sequence(F.lit(0), ((F.octet_length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(starts, lambda i: digest(F.substring(level, i * width + 1, F.lit(width)))), "").cast("binary")


def blocks(nodes: DataFrame, fanout: int, block: int, carried: list[str]) -> DataFrame:
    """nodes: grp, pos, total, hash and `carried` -> grp, pos (the block's), total (blocks of grp), levels (leaves first), rows.

    The last level of a block is one node; a group's only block ends where one node remains."""
    width, height = fanout * HEX, 0
    while fanout**height < block:
        height += 1
    rows = F.sort_array(F.collect_list(F.struct((F.col("pos") % block).cast("int").alias("i"), "hash", *carried)))
    held = nodes.groupBy("grp", F.floor(F.col("pos") / block).cast("long").alias("pos")).agg(rows.alias("rows"), F.max("total").alias("nodes"))
    few = F.size("rows")
    alone = F.lit(height)  # of a group that fits into one block: as many levels as its nodes need
    for h in range(height - 1, -1, -1):
        alone = F.when(few <= fanout**h, h).otherwise(alone)
    held = held.withColumn("steps", F.when(F.col("nodes") <= block, alone).otherwise(height))
    first = F.array(F.array_join(F.col("rows.hash"), "").cast("binary"))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(height)), first, lambda levels, k: F.when(k <= F.col("steps"), F.concat(levels, F.array(_up(F.element_at(levels, -1), width)))).otherwise(levels))
    own = F.transform("rows", lambda r: F.struct(r["i"].alias("i"), *[r[c].alias(c) for c in carried]))
    return held.select("grp", "pos", F.ceil(F.col("nodes") / block).cast("long").alias("total"), grown.alias("levels"), own.alias("rows"))


def _path(levels: Column, i: Column, fanout: int) -> Column:
    """The sibling segments of node i, level by level: what its run's substring holds before it and after it."""
    width = fanout * HEX

    def segment(k: Column) -> Column:
        level, node = F.element_at(levels, k + 1), F.floor(i / F.pow(F.lit(float(fanout)), k)).cast("int")
        run = (node % fanout) * HEX
        start = node * HEX - run
        cut = lambda at, n: F.substring(level, at + 1, n).cast("string")
        return F.struct(cut(start, run).alias("before"), cut(start + run + HEX, F.lit(width) - run - HEX).alias("after"))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), segment)).otherwise(F.array().cast(_PATH))


def _tree(nodes: DataFrame, fanout: int, block: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The stages of blocks from the leaves up, and grp, hash of every group's last node."""
    stages: list[DataFrame] = []
    while True:
        stage = materialize(blocks(nodes, fanout, block, carried if not stages else []), f"stage{len(stages)}")
        stages.append(stage)
        nodes = stage.select("grp", "pos", "total", F.element_at("levels", -1).cast("string").alias("hash"))
        if not nodes.filter("total > 1").limit(1).count():
            return stages, nodes.select("grp", "hash")


def _down(stages: list[DataFrame], tops: DataFrame, fanout: int, block: int, kept: list[str]) -> DataFrame:
    """tops: grp, path and `kept` of every group's last node -> grp, leaf, path, `kept` and what was carried of every leaf."""
    above = tops.withColumn("pos", F.lit(0).cast("long"))
    for n, stage in reversed(list(enumerate(stages))):
        met = stage.join(above, ["grp", "pos"]).withColumn("row", F.explode("rows"))
        i = F.col("row.i")
        path = F.concat(_path(F.col("levels"), i, fanout), F.col("path")).alias("path")
        if n:
            above = materialize(met.select("grp", (F.col("pos") * block + i).alias("pos"), path, *kept), f"down{n}")
        else:
            own = F.substring(F.element_at("levels", 1), i * HEX + 1, F.lit(HEX)).cast("string")
            above = met.select("grp", own.alias("leaf"), path, *kept, "row.*").drop("i")
    return above


def manifest(docs: DataFrame, claimed: Column | None = None, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", fanout: int = 2, block: int = 256) -> DataFrame:
    """`order`, leaf, subroot, root, path of every row: array<struct<before,after>> from its leaf to the root, and claimed, a column over docs.

    `block` is a power of `fanout`."""
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = docs.select(key.alias("grp"), F.col(f"`{order}`").alias("id"), leaf([F.col(f"`{x}`") for x in fields]).alias("hash"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    stages, subroots = _tree(ranked(rows, ["id", "hash"]), fanout, block, ["id", "claimed"])
    subroots = materialize(subroots, "subroots")
    high, root = _tree(ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "hash"), ["of"]), fanout, block, ["of"])
    tops = _down(high, root.select("grp", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root")), fanout, block, ["root"])
    tops = materialize(tops.select(F.col("of").alias("grp"), F.col("leaf").alias("subroot"), "root", "path"), "tops")
    return _down(stages, tops, fanout, block, ["subroot", "root"]).select(F.col("id").alias(order), "leaf", "subroot", "root", "path", "claimed")


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the sibling segments of its path."""
    return F.aggregate(path, start, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def siblings(path: Column) -> Column:
    """All siblings of a path as one hex string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")
