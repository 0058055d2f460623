"""Document lengths in flat token files without an index, from their end-of-document ids."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import bounded_batches, field, stage
from hazardlake.llm.tokens import token_ids, vocabulary
from hazardlake.session import shared_folder

END_ID, BLOCK_BYTES = 50256, 4 << 20


def _open(uri: str):
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` as flat files of little-endian 16-bit numbers, an end id behind each document.

    One file for each task, named by its attempt, so a repeated task leaves no half file in the result.  Returns
    ``(doc_id, file, position)`` for checks; the files themselves hold nothing but ids.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, files = TaskContext.get(), vocabulary()
        name = f"tokens-{context.partitionId():05d}-{context.taskAttemptId()}.bin"
        out, position = None, 0
        for batch in batches:
            if out is None:
                system, path = _open(f"{folder}/{name}")
                out = system.open_output_stream(path)
            for text in batch.column(1).to_pylist():
                out.write(np.append(token_ids(text or "", files, special=False), END_ID).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * batch.num_rows), pa.array(np.arange(position, position + batch.num_rows))], names=["doc_id", "file", "position"])
            position += batch.num_rows
        if out is not None:
            out.close()

    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    return stage(docs.select("doc_id", "text").mapInArrow(run, T.StructType([field(docs, "doc_id"), T.StructField("file", T.StringType()), T.StructField("position", T.LongType())])))


def scan_blocks(spark: SparkSession, folder: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file, start, n_ids, ends)``: for each block of each file, where it starts (in ids), how many ids it holds, and the places of
    end ids in it (in ids of the file).  A block is a byte range; a file of any size is read by many tasks."""
    if block_bytes % 2:
        raise ValueError("blocks hold whole 16-bit ids")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")  # names and sizes only
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))).alias("at")).repartition("path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = _open(path)
                with system.open_input_file(place) as data:
                    data.seek(at)
                    ids = np.frombuffer(data.read(min(block_bytes, length - at)), "<u2")
                ends = np.flatnonzero(ids == end_id) + at // 2
                yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([at // 2]), pa.array([len(ids)]), pa.array([ends], pa.list_(pa.int64()))], names=["file", "start", "n_ids", "ends"])

    return ranges.mapInArrow(run, "file string, start long, n_ids long, ends array<long>")


def document_lengths(blocks: DataFrame) -> DataFrame:
    """``(file, position, start, n_tokens, ended)`` of every document; ``n_tokens`` leaves the end id out.

    A document that crosses blocks is stitched by a prefix scan over each file's blocks: how many ends came before,
    and where the last of them was.  Ids behind a file's last end id are a document with ``ended`` false.
    An empty file has no documents; two end ids in a row hold an empty one.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    scanned = blocks.withColumn("last", F.try_element_at("ends", F.lit(-1))).withColumns(
        {"first": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)), "behind": F.coalesce(F.max("last").over(before), F.lit(-1).cast("long"))})
    starts = F.transform("ends", lambda e, i: F.when(i == 0, F.col("behind")).otherwise(F.element_at("ends", i)) + 1)
    whole = scanned.select("file", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e"))).alias("i", "d"), "first").select(
        "file", (F.col("first") + F.col("i")).alias("position"), F.col("d.s").alias("start"), (F.col("d.e") - F.col("d.s")).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = blocks.groupBy("file").agg(F.max(F.try_element_at("ends", F.lit(-1))).alias("last"), F.sum(F.size("ends")).alias("position"), F.max(F.col("start") + F.col("n_ids")).alias("n"))
    tail = rest.withColumn("start", F.coalesce("last", F.lit(-1)) + 1).filter("start < n").select("file", "position", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(tail)


def token_counts(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, file, position, start)`` of all ``docs(doc_id, text)``, counted from flat files that it writes first.

    Null and empty texts have no tokens; the end token's name inside a text is ordinary text; repeated rows each get
    a row; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    written = write_token_files(docs, folder)
    # Written tables are many times larger than their files, by which Spark would judge a broadcast.
    return written.join(document_lengths(scan_blocks(spark, folder)).hint("merge"), ["file", "position"]).select("doc_id", "n_tokens", "file", "position", "start")
