"""Queries on streams: late rows, repeats inside the watermark, progress of an import."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.plans.catalog import query
from hazardlake.plans.texts import FP_SQL
from hazardlake.session import shared_folder
from hazardlake.sources.tables import Tables
from hazardlake.streaming import arrivals


def _scratch(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _read(t: Tables, path: str) -> DataFrame | None:
    try:
        return t.spark.read.parquet(path)
    except AnalysisException:
        return None


_WEEKS = """WITH e AS (SELECT *, date_trunc('week', ts)::DATE AS week, event_id % 10 = 0 AS second FROM events),
m AS (SELECT *, second AND week + 7 <= (SELECT max(ts) - INTERVAL 14 DAY FROM e WHERE NOT second) AS late FROM e)
"""


def _arrived_in_two_parts(t: Tables) -> str:
    """All events, every tenth of them after the others; those of closed weeks are late."""
    base = _scratch(t)
    second = F.col("event_id") % 10 == 0
    for part in (~second, second):
        t.raw("events").filter(part).write.mode("append").parquet(f"{base}/landing")
        rows = arrivals.landing_stream(t.spark, f"{base}/landing", t.raw("events").schema).withColumns({"ts": F.col("ts").cast("timestamp"), "sif": F.col("value") > 50})
        arrivals.trend_stream(rows, "ts", "sif", f"{base}/out", f"{base}/ckpt").awaitTermination()
    return f"{base}/out"


@query("n5_full_trend", "SELECT date_trunc('week', ts)::DATE AS week, count(*) AS report_count, count_if(value > 50) AS sif_count FROM events GROUP BY 1")
def _(t: Tables):
    return arrivals.full_trend(t.spark, _arrived_in_two_parts(t), "ts", "sif")


@query("n5_late_rows", _WEEKS + "SELECT event_id, user_id, event_type, value FROM m WHERE late")
def _(t: Tables):
    return t.spark.read.parquet(f"{_arrived_in_two_parts(t)}/late").select("event_id", "user_id", "event_type", "value")


@query("n5_live_trend", _WEEKS + "SELECT week, count(*) AS report_count, count_if(value > 50) AS sif_count FROM m WHERE NOT late GROUP BY 1")
def _(t: Tables):
    return arrivals.live_trend(t.spark, _arrived_in_two_parts(t))


@query("n3_repeats_dropped", "SELECT DISTINCT " + FP_SQL.format("'Event ' || event_type || ' of user ' || user_id") + " AS seen FROM events")
def _(t: Tables):
    # Every text repeats within the delay, so each arrives once.
    base = _scratch(t)
    t.raw("events").write.parquet(f"{base}/landing")
    rows = arrivals.landing_stream(t.spark, f"{base}/landing", t.raw("events").schema).select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("Event "), "event_type", F.lit(" of user "), F.col("user_id").cast("string")).alias("text"))
    kept = arrivals.without_repeats(rows, "ts", "text", "60 days")
    kept.writeStream.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).format("parquet").option("path", f"{base}/out").start().awaitTermination()
    from hazardlake.functions.text import fingerprint
    return t.spark.read.parquet(f"{base}/out").select(fingerprint(F.col("text")).alias("seen"))


@query("n2_import_progress", "WITH k AS (SELECT nullif(" + FP_SQL.format("text") + """, '') AS k FROM conversations)
SELECT count(*) AS rows, count(*) - count(k) AS blank, count(DISTINCT k) AS imported, count(DISTINCT k) AS stored FROM k""")
def _(t: Tables):
    base, name = _scratch(t), f"import-{uuid.uuid4().hex}"
    t.raw("conversations").select(F.col("text").alias("Description"), "role", F.lit("2024-01-01").cast("timestamp").alias("arrived")).write.parquet(f"{base}/landing")
    listener = arrivals.ProgressTable(t.spark, name, f"{base}/progress")
    t.spark.streams.addListener(listener)
    try:
        rows = arrivals.landing_stream(t.spark, f"{base}/landing", t.spark.read.parquet(f"{base}/landing").schema)
        arrivals.import_stream(rows, f"{base}/store", f"{base}/counters", f"{base}/ckpt", lambda: _read(t, f"{base}/store"), arrived="arrived", name=name).awaitTermination()
        t.spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(60_000)
    finally:
        t.spark.streams.removeListener(listener)
    seen = arrivals.import_progress(t.spark, f"{base}/progress", f"{base}/counters").agg(F.sum("rows").alias("rows"), F.sum("blank").alias("blank"), F.sum("imported").alias("imported"))
    return seen.crossJoin(F.broadcast(t.spark.read.parquet(f"{base}/store").agg(F.count(F.lit(1)).alias("stored"))))  # one row each
