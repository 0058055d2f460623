"""Exact duplicates by a streaming query with disk-backed keyed state.  DataFrame operations only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlake.llm.common import SPACE, stage
from hazardlake.session import shared_folder

# Digests of repeated texts up to this many rows (some 60 bytes each) are sent to every executor; more are joined by shuffle.
BROADCAST_ROWS = 100_000
# Spark passes over files this much older than the newest one it has seen, by default seven days.
FILE_AGE = "365000d"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no disk is reserved ahead, and a batch writes its changes instead of whole snapshots
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(raw: DataFrame, digest: Digest) -> DataFrame:
    """Digest, rank and content locator (file and row) of each document; the text itself stays where it is."""
    text = F.coalesce("text", F.lit(""))
    plain = F.regexp_replace(text, f"{SPACE}+", "")
    return raw.select("doc_id", digest(plain).alias("digest"), F.sha2(plain, 256).alias("text_sha256"), plain.alias("plain"),
                      # the smallest of these names the row that stays
                      F.struct((-F.length(text)).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"),
                               F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("best"))


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("group_size"))


def streamed_groups(spark: SparkSession, path: str, digest: Digest = sha256, folder: str | None = None) -> DataFrame:
    """``(digest, best, group_size)``: what the keyed state holds of each digest after all files under ``path``.

    The state never expires: it keeps one small row per digest (identifier, length and locator of the row that
    stays, and a counter) in RocksDB on disk, with its log in ``folder``.  Called again with the same folder,
    only new files are read, whatever their modification times.  Each micro-batch appends the groups it changed; the newest row of a group is the
    one with the largest counter, since groups only grow.
    """
    folder = folder or f"{shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        # As a pattern, the path may name one file as well as a folder.
        place = path.rstrip("/")
        stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFileAge", FILE_AGE).parquet(f"{place[:-1]}[{place[-1]}]")
        groups = _groups(_rows(stream, digest).select("digest", "best"), "digest")

        def append(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{folder}/groups/batch={batch}")  # a repeated batch replaces itself

        groups.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(append).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    seen = spark.read.schema(groups.schema).parquet(f"{folder}/groups")
    return seen.groupBy("digest").agg(F.min("best").alias("best"), F.max("group_size").alias("group_size"))


def exact_duplicates(spark: SparkSession, path: str, digest: Digest = sha256, folder: str | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of the Parquet table at ``path``.

    Texts are equal when they are the same after deleting ASCII white space; null counts as empty.  The row with
    the most code points stays, then the smallest doc_id (one without doc_id comes last), then the first in file
    order, so exactly one row of a group is ``kept``, repeated rows included.  Digest hits are checked on the
    full texts; groups in which a digest covers different texts are told apart by the texts.  An empty table
    gives an empty result; other columns are ignored.
    """
    raw = spark.read.parquet(path)
    if raw.isEmpty():
        groups = _groups(_rows(raw, digest).select("digest", "best"), "digest")
    else:
        groups = stage(streamed_groups(spark, path, digest, folder))
    rows = _rows(raw, digest)
    hits = groups.filter("group_size > 1").select("digest")
    if hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    # Both ends of the order of whole texts: they are one text exactly if all texts of the digest are one.
    ends = rows.select("digest", "plain").join(hits, "digest").groupBy("digest").agg(F.min("plain").alias("low"), F.max("plain").alias("high"))
    mixed = stage(ends.filter("low <> high").select("digest"))
    final = lambda found: found.select("doc_id", F.col("g.best.id").alias("keep_id"), F.col("g.group_size").alias("group_size"),
                                       ((F.col("r.best.file") == F.col("g.best.file")) & (F.col("r.best.row") == F.col("g.best.row"))).alias("kept"), "text_sha256")
    if mixed.isEmpty():
        light = rows.drop("plain")
        return final(light.alias("r").join(groups.alias("g"), F.col("r.digest") == F.col("g.digest")))
    clean = rows.join(mixed, "digest", "left_anti").drop("plain")
    told = rows.join(mixed, "digest", "left_semi")
    apart = _groups(told, "digest", "plain")
    return final(clean.alias("r").join(groups.alias("g"), F.col("r.digest") == F.col("g.digest"))).union(
        final(told.alias("r").join(apart.alias("g"), (F.col("r.digest") == F.col("g.digest")) & (F.col("r.plain") == F.col("g.plain")))))
