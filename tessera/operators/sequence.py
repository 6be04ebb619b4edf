"""Windows over ordered rows, intervals and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.store import materialize


def last_known(col: str, keys: list[str], order: list) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(col, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def next_known(col: str, keys: list[str], order: list) -> Column:
    """The first value that is not null, from this row on.  Read backwards: a frame up to the last row is computed anew for every row."""
    back = [F.desc(c) if isinstance(c, str) else c.desc() for c in order]
    return F.last(col, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(df: DataFrame, col: str, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(col, F.last(col, ignorenulls=True).over(w))


def fill_both(df: DataFrame, col: str, keys: list[str], order: list[str]) -> DataFrame:
    """From the row before, else from the row after."""
    return df.withColumn(col, F.coalesce(last_known(col, keys, order), next_known(col, keys, order)))


def cumulative_before(df: DataFrame, col: str, keys: list[str], order: list[str], out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(col).over(w), F.lit(0)))


def ends_at_next(df: DataFrame, start: str, keys: list[str], last: Column, out: str = "end") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(start)), last))


def increasing_markers(df: DataFrame, marker: str, keys: list[str], order: list[str]) -> DataFrame:
    """kept: larger than all markers before; grp: the kept marker that a row belongs to."""
    w = Window.partitionBy(*keys).orderBy(*order)
    top = F.max(marker).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = df.withColumn("kept", F.coalesce(F.col(marker) > top, F.col(marker).isNotNull()))
    return kept.withColumn("grp", F.sum(F.col("kept").cast("int")).over(w))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys over all shuffle partitions, which are then not made fewer and larger: what is distinct or in order within a key needs no other shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of a task where their number is known before a shuffle: what a task holds doesn't grow with the input then.
TASK_ROWS = 1 << 18


def tasks_of(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: all shuffle partitions, more where these would hold over TASK_ROWS rows each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def islands(df: DataFrame, pos: str, keys: list[str], repeated: bool = False) -> DataFrame:
    """Runs of consecutive positions: first, last, n.  repeated: a position may come more than once, and counts once."""
    w = Window.partitionBy(*keys).orderBy(pos)
    if repeated:
        runs = df.withColumn("__g", F.col(pos) - F.dense_rank().over(w)).groupBy(*keys, "__g").agg(F.min(pos).alias("first"), F.max(pos).alias("last"))
        return runs.withColumn("n", (F.col("last") - F.col("first") + 1).cast("long")).drop("__g")
    return df.withColumn("__g", F.col(pos) - F.row_number().over(w)).groupBy(*keys, "__g").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n")).drop("__g")


def merge_intervals(df: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """start, end: intervals whose gap is under the tolerance become one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("__g", F.sum(F.when(F.col("start") - reach < tolerance, 0).otherwise(1)).over(w))
    return opened.groupBy(*keys, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("__g")


def proportional_share(df: DataFrame, keys: list[str], order: list[str], slots: int) -> DataFrame:
    """slot of n items over m slots: slot k takes items k*n/m up to (k+1)*n/m, in whole numbers."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("slot", F.floor(((i + 1) * slots - 1) / n).cast("int"))


def swap_pairs(df: DataFrame, label: str, value: str, keys: list[str], order: str) -> DataFrame:
    """Neighbours each of which fits the other's label take each other's value; chains resolve from the left."""
    w = Window.partitionBy(*keys).orderBy(order)
    fits = (F.col(value) != F.col(label)) & (F.lead(value).over(w) == F.col(label)) & (F.lead(label).over(w) == F.col(value))
    marked = df.withColumn("__s", F.coalesce(fits, F.lit(False)))
    run = marked.withColumn("__g", F.sum(F.when(F.col("__s"), 0).otherwise(1)).over(w)).withColumn("__g", F.col("__g") + F.when(F.col("__s"), 1).otherwise(0))
    odd = F.row_number().over(Window.partitionBy(*keys, "__g", "__s").orderBy(order)) % 2 == 1
    first = run.withColumn("__first", F.col("__s") & odd)
    second = F.coalesce(F.lag("__first").over(w), F.lit(False))
    new = F.when(F.col("__first"), F.lead(value).over(w)).when(second, F.lag(value).over(w)).otherwise(F.col(value))
    return first.withColumn(value, new).drop("__s", "__g", "__first")


def pauses(df: DataFrame, keys: list[str], file_end: Column) -> DataFrame:
    """pause after each unit (start, speech_end): next start, or the file's end, less speech_end."""
    w = Window.partitionBy(*keys).orderBy("start")
    return df.withColumn("pause", F.coalesce(F.lead("start").over(w), file_end) - F.col("speech_end"))


def silence_spans(marks: DataFrame, keys: list[str]) -> DataFrame:
    """marks: at, kind (start or end).  A start goes with the end right after it; other marks are dropped."""
    w = Window.partitionBy(*keys).orderBy("at", "kind")
    nxt = marks.withColumn("__k", F.lead("kind").over(w)).withColumn("end", F.lead("at").over(w))
    return nxt.filter("kind = 'start' AND __k = 'end'").select(*keys, F.col("at").alias("start"), "end")


def stitched(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Where merged spans lie on one timeline without the gaps: offset per span."""
    w = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("offset", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0)))


def skip_rule(gap: Column, keep: float = 1.5, over: float = 4.0) -> Column:
    """Seconds to skip within a gap."""
    return F.when(gap > over, gap - keep).otherwise(F.lit(0))


def skip_spans(units: DataFrame, keys: list[str], second: float = 1.0) -> DataFrame:
    """units: start, speech_end, cut, jump.  What is passed over before the next unit, from and to: a silence of over 4 seconds, but for 1.5 after the
    speech and 0.6 before the next; what lies between the pieces of a selection (jump), or speech outside the text (cut) of 3.5 seconds or
    more, but for 0.1 and 0.2.  `second` is a second in the unit of the times."""
    w = Window.partitionBy(*keys).orderBy("start")
    met = units.withColumn("__next", F.lead("start").over(w))
    gap = F.col("__next") - F.col("speech_end")
    told = F.coalesce("jump", F.lit(False)) | (F.coalesce("cut", F.lit(False)) & (gap >= 3.5 * second))
    keep, lead = F.when(told, 0.1 * second).otherwise(1.5 * second), F.when(told, 0.2 * second).otherwise(0.6 * second)
    spans = met.filter(told | (gap > 4 * second)).select(*keys, "start", (F.col("speech_end") + keep).alias("from"), (F.col("__next") - lead).alias("to"))
    return spans.filter(F.col("to") > F.col("from"))


def portions(units: DataFrame, key: str, order: list[str], weight: str, days: int) -> DataFrame:
    """Near-equal portions of ordered units by weight: the cut after day d is the unit whose running weight lies nearest to
    d/days of the total (the first of equals); every portion has a unit where there are enough."""
    run = portion_reach(units, key, order, weight)
    # a unit may be the nearest of the days whose marks lie between the unit before it and the unit after it
    at = lambda c: c * days / F.greatest(F.col("total"), F.lit(1))
    low = F.greatest(F.lit(1), F.floor(at(F.col("cum") - F.col(weight)))).cast("int")
    high = F.least(F.lit(days - 1), F.ceil(at(F.when(F.col("i") == F.col("n"), F.col("total")).otherwise(F.col("cum") + F.col("next"))))).cast("int")
    run = run.join(run.select(key, (F.col("i") - 1).alias("i"), F.col(weight).alias("next")), [key, "i"], "left")
    near = run.withColumn("__low", low).withColumn("__high", high).filter("__low <= __high")
    near = near.select(key, "i", "n", "cum", "total", F.explode(F.sequence("__low", "__high")).alias("day"))
    far = F.abs(F.col("cum") * days - F.col("day") * F.col("total"))
    return near.groupBy(key, "day").agg(F.min(F.struct(far.alias("far"), F.col("i").alias("cut"))).alias("m")).select(key, "day", F.col("m.cut").alias("cut"))


def drop_stray_anchors(df: DataFrame, keys: list[str], pos: str, target: str) -> DataFrame:
    """Anchors (pos, target) whose offset differs from both neighbours' while theirs agree go; of the rest, those not above the
    candidate before go too."""
    w = Window.partitionBy(*keys).orderBy(pos)
    off = F.col(target) - F.col(pos)
    seen = df.withColumn("__p", F.lag(off).over(w)).withColumn("__n", F.lead(off).over(w)).withColumn("__o", off)
    stray = F.coalesce((F.col("__p") == F.col("__n")) & (F.col("__o") != F.col("__p")), F.lit(False))
    kept = seen.filter(~stray).drop("__p", "__n", "__o")
    return kept.withColumn("__b", F.lag(target).over(w)).filter(F.col("__b").isNull() | (F.col(target) > F.col("__b"))).drop("__b")


def regroup_from(rows: DataFrame, rules: DataFrame, keys: list[str], pos: str, out: str) -> DataFrame:
    """rules: keys, pos, out.  From a rule's position on, rows belong to its group until the next rule."""
    met = rows.join(rules.select(*keys, pos, F.col(out).alias("__rule")), [*keys, pos], "left")
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn(out, F.coalesce(F.last("__rule", ignorenulls=True).over(w), F.col(out) if out in rows.columns else F.lit(None))).drop("__rule")


def gap_classes(units: DataFrame, heard: DataFrame, keys: list[str], least: float, lead_in: float, symbols: int = 3, alike: float = 0.6) -> DataFrame:
    """units: start, speech_end; heard: at.  gap to the next unit, how many symbols are heard in it, and its class: speech, pause
    or last.  Symbols meet their gap by one window over both, not by pairs.

    Where units have an opening (their first words' letters) and heard a letter, a gap whose letters are like the next unit's opening, at least
    `alike` by edit distance, is a pause: the unit's own words, said before it."""
    told = "opening" in units.columns and "letter" in heard.columns
    w = Window.partitionBy(*keys).orderBy("start")
    gaps = units.withColumn("until", F.lead("start").over(w)).withColumn("gap", F.col("until") - F.col("speech_end") - lead_in)
    if told:
        gaps = gaps.withColumn("ahead", F.lead("opening").over(w))
    both = gaps.select(*keys, F.col("start").alias("at"), F.struct("start", "speech_end", "until").alias("u")).unionByName(heard.select(*keys, "at", *(["letter"] if told else [])), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("at", F.col("u").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("of", F.last("u", ignorenulls=True).over(order)).filter("u IS NULL AND at >= of.speech_end AND at < of.until")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "") if told else F.lit(None).cast("string")  # a gap's letters
    n = placed.groupBy(*keys, F.col("of.start").alias("start")).agg(F.count("*").alias("heard"), said.alias("said"))
    met = gaps.join(n, [*keys, "start"], "left").withColumn("heard", F.coalesce("heard", F.lit(0)))
    front = F.substr("ahead", F.lit(1), F.length("said") + 4) if told else F.lit(None).cast("string")
    own = F.coalesce(1 - F.levenshtein("said", front) / F.greatest(F.length("said"), F.length(front)) >= alike, F.lit(False))
    kind = F.when(F.col("until").isNull(), "last").when((F.col("gap") >= least) & (F.col("heard") >= symbols) & ~own, "speech").otherwise("pause")
    return met.withColumn("kind", kind).drop("said", "ahead")


def continued_groups(units: DataFrame, keys: list[str], group: str, within: float) -> DataFrame:
    """Does the next group of the key start where this one ends?  group, start, end, continues."""
    spans = units.groupBy(*keys, group).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    nxt = F.lead("start").over(Window.partitionBy(*keys).orderBy(group))
    return spans.withColumn("continues", F.coalesce(F.abs(nxt - F.col("end")) < within, F.lit(False)))


def trim_strays(letters: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """Letters of a unit, in order: those before the last wide gap within its first quarter and after the first wide gap within
    its last quarter go."""
    w = Window.partitionBy(*keys).orderBy(at)
    whole = Window.partitionBy(*keys)
    seen = letters.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count("*").over(whole)).withColumn("__wide", F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(False)))
    low = F.max(F.when(F.col("__wide") & (F.col("__i") - 1 <= F.col("__n") / 4), F.col("__i"))).over(whole)
    high = F.min(F.when(F.col("__wide") & (F.col("__i") - 1 >= F.col("__n") * 3 / 4), F.col("__i"))).over(whole)
    cut = seen.withColumn("__low", low).withColumn("__high", high)
    inside = (F.col("__i") >= F.coalesce("__low", F.lit(1))) & (F.col("__i") < F.coalesce("__high", F.col("__n") + 1))
    return cut.filter(inside).drop("__i", "__n", "__wide", "__low", "__high")


def lead_ins(units: DataFrame, announced: DataFrame, keys: list[str], longest: float, before: float, slack: float) -> DataFrame:
    """announced: from, to (spans).  A unit starts at the last announced span that begins after the unit before it ends, is no longer
    than `longest` and no earlier than `before`; never sooner than the end of the unit before plus slack."""
    w = Window.partitionBy(*keys).orderBy("start")
    prev = units.withColumn("__prev", F.lag("end").over(w))
    both = announced.select(*keys, F.col("from").alias("start"), F.struct("from", "to").alias("s")).unionByName(prev.select(*keys, "start", F.struct("end", "__prev").alias("__u")), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("start", F.col("__u").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    met = both.withColumn("s", F.last("s", ignorenulls=True).over(order)).filter("__u IS NOT NULL")
    fits = (F.col("s.to") - F.col("s.from") <= longest) & (F.col("start") - F.col("s.from") <= before) & (F.col("s.from") >= F.coalesce(F.col("__u.__prev"), F.col("s.from")))
    moved = F.greatest(F.col("s.from"), F.coalesce(F.col("__u.__prev") + slack, F.col("s.from")))
    return met.select(*keys, "start", F.col("__u.end").alias("end"), F.when(fits, F.least("start", moved)).otherwise(F.col("start")).alias("lead_start"))


def map_times(points: DataFrame, spans: DataFrame, keys: list[str], back: bool = False) -> DataFrame:
    """points: at; spans of stitched(): start, end, offset.  Adds mapped: a file's time on the timeline (one between spans is where the next begins), or,
    `back`, a time of the timeline in the file; null before the first span, and the end of the last one after it.  One window, no pairs."""
    unit = F.struct("start", "end", "offset").alias("__u")
    marks = spans.select(*keys, (F.col("offset") if back else F.col("start")).alias("at"), unit)
    both = points.withColumn("__k", F.lit(1)).unionByName(marks.withColumn("__k", F.lit(0)), allowMissingColumns=True)
    # (of empty spans at one place of the timeline the last counts)
    w = Window.partitionBy(*keys).orderBy("at", "__k", "__u.start").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("__u", F.last("__u", ignorenulls=True).over(w)).filter("__k = 1")
    u = lambda c: F.col(f"__u.{c}")
    there = F.least(u("start") + (F.col("at") - u("offset")), u("end")) if back else u("offset") + F.least("at", u("end")) - u("start")
    return placed.withColumn("mapped", there).drop("__u", "__k")


def recording_plan(files: DataFrame, key: str, name: str, rules: DataFrame, divisions: DataFrame | None = None) -> DataFrame:
    """rules: key, kind, div_from, div_to, first, prefix, order -> key, place, div, name: which files hold which divisions, and in what order.

    range (or no kind): divisions div_from..div_to, each in the next file by name from number `first` on.  single: division div_from in all files, in
    their order.  all: all divisions of `divisions` (key, div) in file number `first`, or in the one whose name starts with `prefix`, rising, falling
    (`order` is "reverse") or as the array `custom` lists them.  A file number beyond the files, or a prefix that not one file has, gives no rows."""
    have = set(rules.columns)
    rule = rules.withColumns({c: F.lit(None).cast(t) for c, t in (("kind", "string"), ("prefix", "string"), ("order", "string"), ("custom", "array<int>"), ("first", "int")) if c not in have})
    numbered = files.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(name)))
    kind = F.coalesce("kind", F.lit("range"))
    ranged = rule.filter(kind == "range").select(key, "div_from", "first", F.explode(F.sequence("div_from", "div_to")).alias("div"))
    ranged = ranged.withColumn("nth", F.col("div") - F.col("div_from") + F.coalesce("first", F.lit(1))).join(numbered, [key, "nth"]).select(key, F.lit(1).alias("place"), "div", name)
    single = rule.filter(kind == "single").select(key, F.col("div_from").alias("div")).join(numbered, key).select(key, F.col("nth").alias("place"), "div", name)
    if divisions is None:
        return ranged.unionByName(single)
    whole = rule.filter(kind == "all").select(key, "first", "prefix", "order", "custom")
    named = whole.filter("prefix IS NOT NULL").join(files, key).filter(F.col(name).startswith(F.col("prefix")))
    one = named.groupBy(key, "order", "custom").agg(F.min(name).alias(name), F.count("*").alias("n")).filter("n = 1").drop("n")
    by_number = whole.filter("prefix IS NULL").withColumnRenamed("first", "nth").join(numbered, [key, "nth"]).select(key, "order", "custom", name)
    held = one.unionByName(by_number).join(divisions.select(key, "div"), key)
    at = F.when(F.col("custom").isNotNull(), F.array_position("custom", F.col("div"))).when(F.col("order") == "reverse", -F.col("div")).otherwise(F.col("div"))
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy(key, name).orderBy(at)))
    return ranged.unionByName(single).unionByName(placed.select(key, "place", "div", name))


def within_span(df: DataFrame, first: tuple[int, int], last: tuple[int, int], chapter: str = "c", verse: str = "v") -> DataFrame:
    """Rows from c:v up to c:v, both included."""
    at = F.struct(F.col(chapter).cast("long").alias("c"), F.col(verse).cast("long").alias("v"))
    end = lambda p: F.struct(F.lit(p[0]).cast("long").alias("c"), F.lit(p[1]).cast("long").alias("v"))
    return df.filter((at >= end(first)) & (at <= end(last)))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], rows: int | None = None) -> DataFrame:
    """Adds i (from 1) and running sums (new column -> column) within keys by `order`, which must be total.

    Rows are dealt to ranges of (keys, order); a range numbers and sums its own rows, and the sums of the ranges before it are added:
    a key that holds most rows is spread over as many tasks as any other.  rows: how many there are, where that is known; ranges and tasks then
    have a bounded number of them."""
    n = [] if rows is None else [tasks_of(df.sparkSession, rows)]
    spread = materialize(df.repartitionByRange(*n, *keys, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*keys, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = spread.groupBy(*keys, "__p").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{new}") for new, c in sums.items()])
    # (without keys: one window over a row per range)
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    names = ["__n", *(f"__{new}" for new in sums)]
    offsets = parts.select(*keys, "__p", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in names])
    own = (spread.repartition(*n, *keys, "__p") if n else spread).withColumn("i", F.count("*").over(inside))
    for new, c in sums.items():
        own = own.withColumn(new, F.sum(c).over(inside))
    joined = own.join(offsets, [*keys, "__p"]).withColumn("i", F.col("i") + F.col("__n"))
    for new in sums:
        joined = joined.withColumn(new, F.col(new) + F.col(f"__{new}"))
    return joined.drop("__p", *names)


def next_of(df: DataFrame, keys: list[str], order: list[str], col: str, out: str) -> DataFrame:
    """The value of the next row of the key, without a window over a whole key."""
    placed = materialize(running(df, keys, order, {}), "placed")
    after = placed.select(*keys, (F.col("i") - 1).alias("i"), F.col(col).alias(out))
    return placed.join(after, [*keys, "i"], "left").drop("i")


def portion_reach(units: DataFrame, key: str, order: list[str], weight: str) -> DataFrame:
    """units with i, cum, total and n of their key, without a window over a whole key."""
    placed = running(units, [key], order, {"cum": weight})
    return placed.join(placed.groupBy(key).agg(F.sum(weight).alias("total"), F.count("*").alias("n")), key)
