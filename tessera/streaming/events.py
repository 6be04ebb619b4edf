"""Event streams of reading positions, bookmarks and plans, each with a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(folder)


def latest_place(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last event of every key (ties: the greater id).  Batch and stream (update or complete mode) alike."""
    return events.groupBy(*keys).agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select(*keys, F.col("m.ts").alias("ts"), F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"))


def activity_spans(events: DataFrame, keys: list[str], gap: str | Column, late: str = "0 seconds") -> DataFrame:
    """Contiguous activity: sessions that end after `gap` without an event; a column gives every event a gap of its own (its length and
    what may lie after it), and a session reaches to the latest end of its events.

    As a stream in append mode a span is given out once the latest time seen, less `late`, has passed its end, and its state is dropped; an event that
    would end before that time comes too late and is left out.  What has not ended by then stays open: in the batch twin these are the spans that end
    after the last time less `late`."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_adds(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Adds without removals: a key once, as often as it comes within `late` of its first; a key's state is dropped after that.  Batch twin: a key once
    for every run of adds in which each comes within `late` of the run's first."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def _ends(state, at_ms: int, forget_ms: int | None) -> int:
    """When a state ends: `forget_ms` after the last event, or after the watermark where that is later."""
    return 2**62 if forget_ms is None else max(at_ms, state.getCurrentWatermarkMs()) + forget_ms


def _held(state, forget_ms: int | None) -> tuple | None:
    """The state, unless it has ended: Spark times states out after a batch's events, so one of these may still meet it."""
    if not state.exists or (forget_ms is not None and state.get[-1] <= state.getCurrentWatermarkMs()):
        return None
    return state.get[:-1]


def _hold(state, values: tuple, at_ms: int, forget_ms: int | None) -> None:
    ends = _ends(state, at_ms, forget_ms)
    state.update((*values, ends))
    if forget_ms is not None:
        state.setTimeoutTimestamp(ends)


def _keep_first(key: tuple, batches: Iterator[pd.DataFrame], state, forget_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """State: the last removal, and all adds after it in order (times and ids): a removal that comes late leaves the first add after it."""
    if state.hasTimedOut:
        state.remove()
        return
    removed, times, ids = _held(state, forget_ms) or (-(2**62), [], [])
    adds, latest = set(zip(times, ids, strict=True)), 0
    for b in batches:
        latest = max([latest, *_millis(b)])
        removed = max([removed, *b.loc[b["removed"], "at"].tolist()])
        new = b.loc[~b["removed"] & (b["at"] > removed), ["at", "event_id"]]
        adds.update(zip(new["at"].tolist(), new["event_id"].tolist(), strict=True))
    kept = sorted(x for x in adds if x[0] > removed)
    _hold(state, (removed, [x for x, _ in kept], [i for _, i in kept]), latest, forget_ms)
    yield pd.DataFrame([[*key, kept[0][1] if kept else None]]).astype("Int64")


def _millis(b: pd.DataFrame) -> list[int]:
    return (b["ts"].astype("int64") // 10**6 if str(b["ts"].dtype).startswith("datetime64[ns") else b["ts"].astype("datetime64[ms]").astype("int64")).tolist() if "ts" in b else []


def bookmarks(events: DataFrame, keys: list[str], late: str | None = None, forget_ms: int | None = None) -> DataFrame:
    """events: keys (longs), at, event_id, removed.  keys, event_id: the first add after the key's last removal, null if there is none.  The
    batch twin says the same by aggregates, whatever the order in which events come; as a stream (update mode) a key's state is its last removal and the
    adds after it, as a removal that comes late may drop the first of them.

    With `late` and `forget_ms` events also have ts (a timestamp): a key's state is dropped `forget_ms` after its last event, by event time; what was given
    out stays so, and an event of the key after that begins anew."""
    if events.isStreaming:
        kind = ", ".join(f"`{k}` long" for k in keys) + ", event_id long"
        named = lambda key, batches, state: (df.set_axis([*keys, "event_id"], axis=1) for df in _keep_first(key, batches, state, forget_ms))
        seen = events if forget_ms is None else events.withWatermark("ts", late)
        return seen.groupBy(*keys).applyInPandasWithState(named, kind, "removed long, times array<long>, ids array<long>, ends long", "update", "NoTimeout" if forget_ms is None else "EventTimeTimeout")
    last = events.filter("removed").groupBy(*keys).agg(F.max("at").alias("__r"))
    adds = events.filter("NOT removed").join(last, keys, "left").filter("__r IS NULL OR at > __r")
    firsts = adds.groupBy(*keys).agg(F.min(F.struct("at", "event_id")).alias("m")).select(*keys, F.col("m.event_id").alias("event_id"))
    return events.select(*keys).distinct().join(firsts, keys, "left")


def rebuild_slices(stream: DataFrame, path: str, key: str, ident: str, checkpoint: str) -> None:
    """Every micro-batch rebuilds the slices (partitions of `path` by key) that it has rows for, from what the slice held and the new rows, one row
    per id; the other slices are not touched.  A batch that is run again after a failure gives the same slices."""
    from tessera.sources.sinks import overwrite_slice
    from tessera.store import materialize

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = materialize(batch, f"batch-{epoch}")
        try:
            held = spark.read.schema(new.schema).parquet(path).join(new.select(key).distinct(), key, "left_semi")  # Spark measures the written batch
            both = held.unionByName(new)
        except Exception as e:  # the table isn't there before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            both = new
        overwrite_slice(materialize(both.dropDuplicates([key, ident]), f"slices-{epoch}"), path, [key])

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def enrich(events: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Stream-static range join: the units (start, until) that hold the event's value, from start to before until.

    A unit lies on the level of its length: buckets of the next power of two, of which it touches two at most.  An event looks into one bucket of every
    level that units have, so it meets the units around it and not all of its key.  The levels are read from the static side once.  Units that are empty
    or lack a bound hold nothing."""
    length = F.col("until") - F.col("start")
    level = F.least(F.greatest(F.ceil(F.log2(length)), F.lit(-1000)), F.lit(1023)).cast("int")
    held = units.filter(length > 0).withColumn("__level", F.coalesce(level, F.lit(1023)))
    levels = sorted(r["__level"] for r in held.select("__level").distinct().collect())  # of one number type: a thousand or two at most
    bucket = lambda c, n: F.floor(F.col(c).cast("double") / F.pow(F.lit(2.0), n)).cast("double")
    first, last = bucket("start", F.col("__level")), bucket("until", F.col("__level"))
    dealt = held.withColumn("__bucket", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))
    asked = events.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bucket", bucket("value", F.col("__level")))
    met = asked.join(dealt, [*keys, "__level", "__bucket"])
    return met.filter((F.col("value") >= F.col("start")) & (F.col("value") < F.col("until"))).drop("__level", "__bucket")


def saved_bytes(pieces: DataFrame, keys: list[str]) -> DataFrame:
    return pieces.groupBy(*keys).agg(F.sum(F.least("piece", "remaining")).alias("saved"))


def _progress(key: tuple, batches: Iterator[pd.DataFrame], state, forget_ms: int | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    days, times, flags = _held(state, forget_ms) or ([], [], [])
    held = {d: (t, f) for d, t, f in zip(days, times, flags, strict=True)}
    latest = 0
    for b in batches:
        latest = max([latest, *_millis(b)])
        for d, t, f in zip(b["day"], b["at"], b["done"], strict=True):
            if int(d) not in held or held[int(d)][0] <= int(t):
                held[int(d)] = (int(t), bool(f))
    days = sorted(held)
    _hold(state, (days, [held[d][0] for d in days], [held[d][1] for d in days]), latest, forget_ms)
    done = [d for d in days if held[d][1]]
    yield pd.DataFrame({"user_id": [key[0]], "n_done": [len(done)], "days_done": [done]})


def plan_progress(marks: DataFrame, late: str | None = None, forget_ms: int | None = None) -> DataFrame:
    """marks: user_id, day, at (micros), done -> n_done and days_done (ascending) per user; a day's last mark counts, late marks are ignored.  A state has a
    plan's days.  With `late` and `forget_ms` marks also have ts, and the state of a plan without marks is dropped `forget_ms` after the last."""
    if marks.isStreaming:
        seen = marks if forget_ms is None else marks.withWatermark("ts", late)
        run = lambda key, batches, state: _progress(key, batches, state, forget_ms)
        return seen.groupBy("user_id").applyInPandasWithState(run, "user_id long, n_done long, days_done array<int>", "days array<int>, times array<long>, flags array<boolean>, ends long", "update", "NoTimeout" if forget_ms is None else "EventTimeTimeout")
    last = marks.groupBy("user_id", "day").agg(F.max_by("done", "at").alias("done"))
    days = F.array_sort(F.collect_list(F.when(F.col("done"), F.col("day").cast("int"))))
    return last.groupBy("user_id").agg(F.sum(F.col("done").cast("long")).alias("n_done"), days.alias("days_done"))


def plan_status(progress: DataFrame, today: str | Column, days: str | Column) -> DataFrame:
    """progress with days_done; today: the plan's day, 1 on its first.  Adds status, behind (days before today that aren't done) and ahead (done days after today):
    finished (as many done as the plan has), not started, ended (days are left), behind, ahead or on schedule.  Batch and stream alike."""
    now, of = (F.col(x) if isinstance(x, str) else x for x in (today, days))
    due = F.greatest(F.least(now, of + 1) - 1, F.lit(0))
    behind = due - F.size(F.filter("days_done", lambda d: (d >= 1) & (d <= due)))
    ahead = F.size(F.filter("days_done", lambda d: d > now))
    status = F.when(F.size("days_done") >= of, "finished").when(now < 1, "not started").when(now > of, "ended").when(behind > 0, "behind").when(ahead > 0, "ahead").otherwise("on schedule")
    return progress.withColumn("status", status).withColumn("behind", behind).withColumn("ahead", ahead)


def drain(stream: DataFrame, path: str, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Run a stream over what is there now and return its rows; `path` is a shared folder of its own.  progress gets what Spark reports of every batch."""
    spark = stream.sparkSession
    out = f"{path}/out"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/{epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.option("recursiveFileLookup", "true").schema(f"{', '.join(f'`{c}` {t}' for c, t in stream.dtypes)}, epoch int").parquet(out)


def content_hash(content: str) -> Column:
    """An aggregate that tells a group's rows in any order: their count and sums of two hashes, so a hot group is summed in parts."""
    total = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(20,0)")).cast("string")
    return F.concat_ws(":", F.count("*").cast("string"), total(F.col(content)), total(F.lit(1), F.col(content)))


def rebuild_changed(current: DataFrame, built: DataFrame, key: str, content: str) -> DataFrame:
    """Groups whose content hash differs from what was built (or that are new): what an incremental run redoes."""
    now = current.groupBy(key).agg(content_hash(content).alias("hash"))
    return now.join(built.select(key, "hash"), [key, "hash"], "left_anti")
