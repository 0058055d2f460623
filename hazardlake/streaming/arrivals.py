"""Reports screened as they arrive: import stream, trend, review state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from hazardlake.operators.dedupe import text_key
from hazardlake.operators.mapping import resolve_mapping
from hazardlake.operators.normalise import import_counters
from hazardlake.operators.ranking import group_positions
from hazardlake.plans.imports import import_reports


def landing_stream(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema)
    return reader.format(kind).option("header", "true").load(folder)


def import_stream(rows: DataFrame, store_path: str, counters_path: str, checkpoint: str, read_store: Callable[[], DataFrame | None],
                  arrived: str | None = None, delay: str = "7 days", name: str | None = None) -> StreamingQuery:
    """Import each micro-batch against everything stored so far.

    Batches are written under their batch id, so a replayed batch replaces its own output and
    nothing is stored twice.  With ``arrived`` (a time column), texts that repeat within ``delay`` are dropped by bounded
    state before they reach the store check, which then sees each text once in that time.  What arrives is counted by
    ``observe`` under the name ``arrivals``; a ``ProgressTable`` gathers it.
    """
    text = resolve_mapping([c for c in rows.columns if c != arrived])["text"]
    rows = rows.observe("arrivals", F.count(F.lit(1)).alias("rows"), F.count_if(text_key(F.col(f"`{text}`")).isNull()).alias("blank"))
    if arrived is not None:
        rows = without_repeats(rows, arrived, text, delay)
    def step(batch: DataFrame, batch_id: int) -> None:
        store = read_store()
        if store is not None and "batch_id" in store.columns:
            store = store.filter(F.col("batch_id") != batch_id)
        done = import_reports(batch, store, source="stream").persist(StorageLevel.DISK_ONLY)  # analysed once for store and counters
        new = done.filter(F.col("import_state") == "new")
        # Positions inside the batch stay far below 2^40, whatever the partitions were.
        placed = group_positions(new.select("row_no"), [], ["row_no"])
        kept = new.join(placed, "row_no").withColumns({"id": F.lit(batch_id) * F.lit(1 << 40) + F.col("position"),
                                                       "report_id": F.concat(F.lit(f"RPT-{batch_id:04d}-"), F.col("position").cast("string"))}).drop("position")
        kept.write.mode("overwrite").parquet(f"{store_path}/batch_id={batch_id}")
        import_counters(done).write.mode("overwrite").parquet(f"{counters_path}/batch_id={batch_id}")
        done.filter(F.col("import_state") != "new").select("row_no", "import_state", "duplicate_of", "source_id", "text_key").write.mode("overwrite").parquet(f"{store_path}_left_out/batch_id={batch_id}")
        done.unpersist()

    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def _first_of_each_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(batch.num_columns - 1).to_pylist()
        first = dict(zip(reversed(keys), range(len(keys) - 1, -1, -1), strict=True))
        yield batch.take(pa.array(sorted(first.values()), pa.int64()))


def without_repeats(rows: DataFrame, time: str, text: str, delay: str = "7 days") -> DataFrame:
    """Drops equal texts that arrive within the watermark; state is bounded by it and holds keys only.

    Blank texts repeat nothing and pass.  Repeats inside one Arrow batch go before the shuffle, so a text that fills a
    third of the stream does not send all its rows to the task that holds its key.
    """
    marked = rows.withColumn("_key", text_key(F.col(f"`{text}`")))
    keyed = by_place(marked.filter("_key IS NOT NULL"))
    few = keyed.mapInArrow(_first_of_each_key, keyed.schema).toDF(*marked.columns)
    kept = few.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"])  # behind the Arrow step, which loses a column's mark
    return kept.unionByName(marked.filter("_key IS NULL")).drop("_key")


def weekly_stream(rows: DataFrame, time: str, sif: str, delay: str = "14 days") -> DataFrame:
    """Counts per Monday week; rows later than the watermark are left to the batch trend."""
    # Windows start on Thursdays (day zero), four days later is a Monday.
    week = F.window(time, "7 days", startTime="4 days")
    return rows.withWatermark(time, delay).groupBy(week).agg(F.count(F.lit(1)).alias("report_count"), F.count_if(sif).alias("sif_count")).select(
        F.col("window.start").cast("date").alias("week"), "report_count", "sif_count")


def review_state_stream(reviews: DataFrame) -> DataFrame:
    """Latest decision per report, kept current as reviews arrive (one state row per report)."""
    return reviews.groupBy("report_pk").agg(F.max_by("decision", "id").alias("decision"), F.max("id").alias("review_id"))


def by_place(df: DataFrame) -> DataFrame:
    """Columns named by place, since Arrow functions can't take every header."""
    return df.toDF(*(f"c{n}" for n in range(len(df.columns))))


# ---- weekly trend with a table for late rows --------------------------------

def week_start(time: Column) -> Column:
    return F.date_trunc("week", time)


def _batches(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing was written yet
        return None


def watermark_before(spark: SparkSession, folder: str, batch_id: int, delay: str) -> object:
    """The newest time of the batches before this one, less the delay: what Spark itself would use, and the same on a replay."""
    clock = _batches(spark, f"{folder}/clock")
    if clock is None:
        return None
    return clock.filter(F.col("batch_id") < batch_id).agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("mark")).first()["mark"]


def trend_stream(rows: DataFrame, time: str, sif: str, folder: str, checkpoint: str, delay: str = "14 days") -> StreamingQuery:
    """Weekly counts of arriving rows; rows of weeks that the watermark has closed go to a side table instead.

    Each batch leaves, under its id, its counts per open week (``trend``), its late rows whole (``late``), and its newest
    time with the numbers that ``observe`` saw while it was written (``clock``).  The clock is written last, and a batch
    knows only the clocks before its own, so a replayed batch decides as it did the first time and replaces its output.
    A closed week never changes in ``live_trend``; ``full_trend`` takes the late rows in.  Rows without a time belong to no week.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = watermark_before(spark, folder, batch_id, delay)
        starts = week_start(F.col(time))
        late = F.lit(False) if mark is None else F.coalesce(starts + F.expr("INTERVAL 7 days") <= F.lit(mark), F.lit(False))
        marked = batch.withColumns({"week": starts.cast("date"), "_late": late})
        seen = Observation("arrivals")
        counted = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("late"), F.max(time).alias("newest"))
        weekly = counted.filter(~F.col("_late") & F.col("week").isNotNull()).groupBy("week").agg(F.count(F.lit(1)).alias("report_count"), F.count_if(sif).alias("sif_count"))
        weekly.write.mode("overwrite").parquet(f"{folder}/trend/batch_id={batch_id}")
        marked.filter("_late").drop("_late", "week").write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")
        numbers = seen.get
        clock = spark.createDataFrame([(numbers["rows"], numbers["late"], numbers["newest"])], "rows long, late long, newest timestamp")
        clock.coalesce(1).write.mode("overwrite").parquet(f"{folder}/clock/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per week as the stream knows them."""
    parts = spark.read.parquet(f"{folder}/trend")
    return parts.groupBy("week").agg(F.sum("report_count").alias("report_count"), F.sum("sif_count").alias("sif_count"))


def full_trend(spark: SparkSession, folder: str, time: str, sif: str) -> DataFrame:
    """The live trend and the late rows in one."""
    late = spark.read.parquet(f"{folder}/late").groupBy(week_start(F.col(time)).cast("date").alias("week")).agg(F.count(F.lit(1)).alias("report_count"), F.count_if(sif).alias("sif_count"))
    both = live_trend(spark, folder).unionByName(late)
    return both.groupBy("week").agg(F.sum("report_count").alias("report_count"), F.sum("sif_count").alias("sif_count"))


# ---- progress ---------------------------------------------------------------

PROGRESS = "run string, batch_id long, rows long, blank long, dropped_repeats long, milliseconds long"


class ProgressTable(StreamingQueryListener):
    """Gathers a row for each finished micro-batch of the named query into a Parquet table.

    The row stands under its batch id, so a batch that is run again replaces it.
    """

    def __init__(self, spark: SparkSession, query_name: str, folder: str):
        self.spark, self.query_name, self.folder = spark, query_name, folder

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.name == self.query_name:
            self.record(json.loads(event.progress.json))

    def record(self, progress: dict) -> None:
        seen = progress.get("observedMetrics", {}).get("arrivals")
        if seen is None:  # a batch without rows, run to move the watermark
            return
        dropped = sum(o.get("customMetrics", {}).get("numDroppedDuplicateRows", 0) for o in progress.get("stateOperators", []))
        row = (progress["runId"], progress["batchId"], seen["rows"], seen["blank"], dropped, progress["durationMs"].get("triggerExecution"))
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).drop("batch_id").write.mode("overwrite").parquet(f"{self.folder}/batch_id={progress['batchId']}")


def import_progress(spark: SparkSession, progress: str, counters: str) -> DataFrame:
    """What arrived, what state dropped and what the import made of the rest, for each batch."""
    return spark.read.parquet(progress).join(spark.read.parquet(counters), "batch_id", "left")
