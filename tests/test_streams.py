import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from hazardlake.streaming import arrivals

SCHEMA = "id long, at timestamp, Description string, sif boolean"


def scratch():
    return tempfile.mkdtemp(prefix="stream-", dir="/tmp")


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def arrive(spark, landing, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)


def forget_last_batch(checkpoint):
    """What a crash between a batch's output and its commit leaves behind."""
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    return last


def trend(frame):
    return {r["week"]: (r["report_count"], r["sif_count"]) for r in frame.collect()}


def batch_trend(rows):
    weeks = {}
    for _, at, _, sif in rows:
        if at is not None:
            monday = (at - dt.timedelta(days=at.weekday())).date()
            n, s = weeks.get(monday, (0, 0))
            weeks[monday] = (n + 1, s + bool(sif))
    return weeks


def test_late_rows_reenter_the_batch_trend(spark):
    landing, out, ckpt = scratch(), scratch() + "/trend", scratch()
    first = [(n, day(n % 30), "a", n % 3 == 0) for n in range(60)] + [(900, None, "no time", True)]
    # weeks closed by day 29 less 14 days are late, open ones are not
    second = [(100 + n, day(n), "late", True) for n in range(0, 14)] + [(200 + n, day(14 + n), "in time", None) for n in range(20)]
    third = [(300, day(1), "very late", False), (301, day(60), "new", True)]

    def run():
        arrivals.trend_stream(arrivals.landing_stream(spark, landing, spark.createDataFrame([], SCHEMA).schema), "at", "sif", out, ckpt).awaitTermination()

    arrive(spark, landing, first)
    run()
    closed = {w: v for w, v in trend(arrivals.live_trend(spark, out)).items() if w <= dt.date(2024, 1, 8)}
    arrive(spark, landing, second)
    run()
    live = trend(arrivals.live_trend(spark, out))
    assert {w: live[w] for w in closed} == closed and len(closed) == 2
    assert spark.read.parquet(f"{out}/late").count() == 14
    assert trend(arrivals.full_trend(spark, out, "at", "sif")) == batch_trend(first + second)
    # the last batch runs again: nothing is counted twice, and it decides as before
    forget_last_batch(ckpt)
    run()
    assert trend(arrivals.live_trend(spark, out)) == live and spark.read.parquet(f"{out}/late").count() == 14
    arrive(spark, landing, third)
    run()
    assert trend(arrivals.full_trend(spark, out, "at", "sif")) == batch_trend(first + second + third)
    assert sorted((r["rows"], r["late"]) for r in spark.read.parquet(f"{out}/clock").collect()) == [(2, 1), (34, 14), (61, 0)]


@pytest.fixture
def job(spark):
    landing, base = scratch(), scratch()
    paths = {"store": f"{base}/store", "counters": f"{base}/counters", "ckpt": f"{base}/ckpt", "progress": f"{base}/progress"}

    def run(listen=False, arrived="at"):
        listener = arrivals.ProgressTable(spark, f"import {base}", paths["progress"])
        if listen:
            spark.streams.addListener(listener)
        try:
            rows = arrivals.landing_stream(spark, landing, spark.createDataFrame([], SCHEMA).schema)
            arrivals.import_stream(rows, paths["store"], paths["counters"], paths["ckpt"], lambda: spark.read.parquet(paths["store"]) if os.path.isdir(paths["store"]) else None,
                                   arrived=arrived, name=f"import {base}").awaitTermination()
            spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
        finally:
            if listen:
                spark.streams.removeListener(listener)

    return landing, paths, run


def test_repeats_inside_the_watermark_never_reach_the_store_check(spark, job):
    landing, paths, run = job
    arrive(spark, landing, [(n, day(1), "Guard removed from the mill", True) for n in range(50)] + [(90, day(1), "", None), (91, day(1), " ", None), (92, day(1), None, None), (93, day(2), "No harness", True)])
    run()
    assert spark.read.parquet(paths["store"]).count() == 2
    assert spark.read.parquet(paths["counters"]).agg(F.sum("processed"), F.sum("skipped_empty"), F.sum("duplicates")).first()[:] == (5, 3, 0)
    # after a restart the state still knows the text; one that comes back after the watermark meets the store
    arrive(spark, landing, [(60, day(3), "guard REMOVED from the mill!", True), (61, day(3), "Another text", False), (62, day(20), "A newer text", False)])
    run()
    assert spark.read.parquet(paths["counters"]).agg(F.sum("duplicates")).first()[0] == 0 and spark.read.parquet(paths["store"]).count() == 4
    arrive(spark, landing, [(70, day(21), "Guard removed from the mill", True)])
    run()
    assert spark.read.parquet(paths["counters"]).agg(F.sum("duplicates")).first()[0] == 1 and spark.read.parquet(paths["store"]).count() == 4


def test_progress_equals_what_is_stored_after_a_replay(spark, job):
    landing, paths, run = job
    arrive(spark, landing, [(n, day(1), f"Text number {n % 4}", True) for n in range(10)] + [(50, day(1), " ", None)])
    run(listen=True)
    arrive(spark, landing, [(n, day(2), f"Text number {n}", True) for n in range(3, 8)])
    run(listen=True)

    def check():
        rows = arrivals.import_progress(spark, paths["progress"], paths["counters"]).collect()
        assert sum(r["rows"] for r in rows) == 16 and sum(r["blank"] for r in rows) == 1
        assert sum(r["imported"] for r in rows) == spark.read.parquet(paths["store"]).count() == 8
        assert len({r["batch_id"] for r in rows}) == len(rows) and all(r["milliseconds"] > 0 for r in rows)
        return {r["batch_id"]: r["run"] for r in rows}

    before = check()
    last = forget_last_batch(paths["ckpt"])
    run(listen=True)
    after = check()
    assert set(before) == set(after) and after[last if last in after else max(after)] != before[last if last in before else max(before)]
