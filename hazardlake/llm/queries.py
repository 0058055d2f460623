"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlake.llm.arrow_files import token_sequences
from hazardlake.llm.decontaminate import contamination
from hazardlake.llm.exact_dedup import exact_duplicates
from hazardlake.llm.hard_negatives import hard_negatives, relabelled
from hazardlake.llm.licenses import license_notices
from hazardlake.llm.line_dedup import line_report
from hazardlake.llm.oracles import SQL as SQL  # noqa: PLC0414
from hazardlake.llm.packing import packed
from hazardlake.llm.pii import personal_data
from hazardlake.llm.simhash import near_duplicates
from hazardlake.llm.token_scan import token_counts
from hazardlake.llm.toxicity import toxicity
from hazardlake.llm.url_filter import url_verdicts
from hazardlake.llm.whitening import whitened


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": lambda spark, folder: near_duplicates(_table(spark, folder, "documents")),
    "op2_licenses": lambda spark, folder: license_notices(_table(spark, folder, "documents")),
    "op3_decontamination": lambda spark, folder: contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"),
    "op4_toxicity": lambda spark, folder: toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels")),
    "op5_pii": lambda spark, folder: personal_data(_table(spark, folder, "documents")),
    "op6_token_counts": lambda spark, folder: token_counts(_table(spark, folder, "documents")),
    "op7_line_dedup": lambda spark, folder: line_report(_table(spark, folder, "documents")),
    "op8_packing": lambda spark, folder: packed(_table(spark, folder, "documents")),
    "op9_url_filter": lambda spark, folder: url_verdicts(_table(spark, folder, "pages")),
    "op10_exact_dedup": lambda spark, folder: exact_duplicates(spark, f"{folder}/documents.parquet"),
    "op11_whitening": lambda spark, folder: whitened(_table(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").cast("long")),
    "op12_arrow_tokens": lambda spark, folder: token_sequences(_table(spark, folder, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32"),
    "op13_hard_negatives": lambda spark, folder: hard_negatives(relabelled(_table(spark, folder, "embeddings"))),
}
