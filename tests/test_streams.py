"""Streams over several batches: state that ends, late rows, interval buckets; the batch twins by plain loops."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tessera.streaming import events as st

NOON = dt.datetime(2024, 1, 1, 12)


def feed(spark, tmp_path, schema, batches):
    """A stream that reads one file a batch, in order."""
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/b{k}")
        for f in (folder / f"b{k}").glob("*.parquet"):
            f.rename(folder / f"{k:03d}.parquet")
            (folder / f"{k:03d}.parquet").touch()
            os.utime(folder / f"{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/*.parquet")


def state_rows(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


def minutes(*ns):
    return [NOON + dt.timedelta(minutes=n) for n in ns]


def test_spans_end_and_late_rows_go(spark, tmp_path):
    schema = "user_id long, ts timestamp, gap string"
    batches = [
        [(1, t, "10 minutes") for t in minutes(0, 5, 14)] + [(2, t, "1 minute") for t in minutes(0, 2)],
        [(1, t, "10 minutes") for t in minutes(200, 201)] + [(3, minutes(120)[0], "90 minutes")],
        [(4, minutes(260)[0], "1 minute")],
        [(1, minutes(15)[0], "10 minutes"), (4, minutes(260)[0], "1 minute")],  # the first is late: its span has been given out
    ]
    progress: list = []
    stream = st.activity_spans(feed(spark, tmp_path, schema, batches), ["user_id"], F.col("gap"), "30 minutes")
    got = sorted((r.user_id, r.start, r.end, r.n) for r in st.drain(stream, f"file://{tmp_path}/out", progress=progress).collect())
    m = minutes
    assert got == [(1, m(0)[0], m(24)[0], 3), (1, m(200)[0], m(211)[0], 2), (2, m(0)[0], m(1)[0], 1), (2, m(2)[0], m(3)[0], 1), (3, m(120)[0], m(210)[0], 1)]
    assert state_rows(progress)[-1] == 1  # user 4's span alone is still open
    rows = [r for b in batches for r in b if r[:2] != (1, minutes(15)[0])]
    twin = st.activity_spans(spark.createDataFrame(rows, schema), ["user_id"], F.col("gap"))
    assert sorted((r.user_id, r.start, r.end, r.n) for r in twin.filter(F.col("end") <= F.lit(m(230)[0])).collect()) == got


def test_first_adds_forget(spark, tmp_path):
    schema = "k long, ts timestamp"
    batches = [[(1, t) for t in minutes(0, 1)] + [(2, t) for t in minutes(3)], [(1, minutes(5)[0]), (3, minutes(100)[0])], [(4, minutes(200)[0])], [(1, minutes(201)[0]), (4, minutes(202)[0])]]
    progress: list = []
    got = st.drain(st.first_adds(feed(spark, tmp_path, schema, batches), ["k"], "10 minutes"), f"file://{tmp_path}/out", progress=progress)
    assert sorted(r.k for r in got.collect()) == [1, 1, 2, 3, 4]  # 1 again, long after its first add
    assert state_rows(progress)[-1] <= 2


def test_bookmark_and_plan_states_end(spark, tmp_path):
    schema = "k long, at long, event_id long, removed boolean, ts timestamp"
    row = lambda k, n, ident, gone=False: (k, n, ident, gone, minutes(n)[0])
    batches = [[row(1, 0, 10), row(1, 2, 11), row(2, 1, 12), row(2, 3, 13, True), row(2, 4, 14)], [row(3, 500, 15)], [row(3, 501, 16), row(1, 502, 17)], [row(3, 1000, 18, True)]]
    progress: list = []
    stream = st.bookmarks(feed(spark, tmp_path, schema, batches), ["k"], "1 minute", 60_000 * 60)
    out = st.drain(stream, f"file://{tmp_path}/out", "update", progress).collect()
    by_epoch = sorted((r.epoch, r.k, r.event_id) for r in out)
    assert [x[1:] for x in by_epoch if x[1] != 3] == [(1, 10), (2, 14), (1, 17)]  # 1 begins anew after an hour
    assert [x[2] for x in by_epoch if x[1] == 3] == [15, 15, None]
    rows = state_rows(progress)
    assert max(rows) == 3 and rows[-1] == 1
    plain = st.bookmarks(spark.createDataFrame(batches[0], schema), ["k"]).collect()
    assert sorted((r.k, r.event_id) for r in plain) == [(1, 10), (2, 14)]


def test_plan_state_ends(spark, tmp_path):
    schema = "user_id long, day int, at long, done boolean, ts timestamp"
    row = lambda u, d, n, done=True: (u, d, n, done, minutes(n)[0])
    batches = [[row(1, 1, 0), row(1, 2, 1), row(2, 1, 2), row(1, 2, 3, False)], [row(1, 3, 500)], [row(2, 2, 501)]]
    progress: list = []
    stream = st.plan_progress(feed(spark, tmp_path, schema, batches), "1 minute", 60_000 * 60)
    out = st.drain(stream, f"file://{tmp_path}/out", "update", progress).collect()
    assert sorted((r.epoch, r.user_id, r.days_done) for r in out if r.epoch < 1) == [(0, 1, [1]), (0, 2, [1])]
    assert [r.days_done for r in out if r.user_id == 2 and r.epoch > 0] == [[2]]  # the state of user 2 had ended
    whole = {r.user_id: (r.n_done, r.days_done) for r in st.plan_progress(spark.createDataFrame([r for b in batches for r in b], schema)).collect()}
    assert whole == {1: (2, [1, 3]), 2: (2, [1, 2])}


def status_by_hand(done, today, days):
    done = set(done)
    if len(done) >= days:
        return "finished"
    if today < 1:
        return "not started"
    behind = sum(d not in done for d in range(1, min(today, days + 1)))
    if today > days:
        return "ended"
    return "behind" if behind else "ahead" if any(d > today for d in done) else "on schedule"


def test_plan_status_by_plain_loops(spark):
    g = random.Random(2)
    rows = [(sorted(g.sample(range(1, 8), g.randrange(0, 8))), g.randrange(-1, 10), g.randrange(1, 8)) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, days_done array<int>, today int, days int")
    for r in st.plan_status(df, "today", "days").collect():
        done, today, days = rows[r.i]
        assert r.status == status_by_hand(done, today, days)
        assert r.behind == sum(d not in done for d in range(1, max(1, min(today, days + 1)))) and r.ahead == sum(d > today for d in done)


def test_enrich_by_plain_loops(spark):
    g = random.Random(7)
    units = [(g.randrange(4), a, a + g.choice([0.0, 0.5, 3.0, 100.0, 1e6, -1.0]), k) for k in range(300) if (a := g.uniform(-200, 200)) is not None]
    units += [(0, -1e300, 1e300, 1000), (1, None, 5.0, 1001), (1, 0.0, float("inf"), 1002), (2, 0.0, 8.0, 1003), (None, 0.0, 8.0, 1004)]
    events = [(k, g.randrange(4), g.uniform(-220, 220)) for k in range(300)] + [(900, 2, 0.0), (901, 2, 8.0), (902, 1, None), (903, None, 1.0), (904, 2, -0.0)]
    e = spark.createDataFrame(events, "event_id long, k long, value double")
    u = spark.createDataFrame(units, "k long, start double, until double, unit long")
    joined = st.enrich(e, u, ["k"])
    got = sorted((r.event_id, r.unit) for r in joined.collect())
    want = sorted((i, n) for i, k, v in events for j, a, b, n in units if k is not None and k == j and None not in (v, a, b) and a <= v < b)
    assert got == want and len(got) > 1000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_bookmarks_in_any_order(spark, tmp_path):
    """A removal that comes after later adds, in the next Arrow batch or in the next micro-batch, leaves the first add after it."""
    schema = "k long, at long, event_id long, removed boolean"
    g = random.Random(5)
    batches = [[(1, 9, 90, False), (1, 5, 50, False), (1, 12, 120, False), (2, 5, 50, False), (2, 9, 90, False)] + [(k, g.randrange(1, 99) * 10 + k, g.randrange(10**6), g.random() < 0.1) for k in range(3, 9) for _ in range(20)] for _ in range(2)]
    batches[0].append((1, 7, 70, True))
    batches[1].append((2, 7, 70, True))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = st.drain(st.bookmarks(feed(spark, tmp_path, schema, batches), ["k"]), f"file://{tmp_path}/out", "update")
        got = {r.k: r.event_id for r in out.orderBy("epoch").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    rows = [r for b in batches for r in b]
    last = {k: max((a for q, a, _, gone in rows if q == k and gone), default=-1) for k in range(1, 9)}
    want = {k: min(((a, i) for q, a, i, gone in rows if q == k and not gone and a > last[k]), default=(0, None))[1] for k in range(1, 9)}
    assert got == want and got[1] == got[2] == 90
