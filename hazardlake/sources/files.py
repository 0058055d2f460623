"""Readers for report files of any layout, and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.operators.mapping import map_columns, resolve_mapping
from hazardlake.operators.normalise import normalise
from hazardlake.operators.registry import export_rows

# File kinds read directly; column names tried in order for text and label.
EXTENSIONS = ["csv", "tsv", "txt", "json", "jsonl"]
TEXT_COLUMNS = ["description", "report_text", "text"]
BOM = "\ufeff"
LABEL_COLUMNS = ["sif_potential", "expect_sif", "target", "label"]


def separator(spark: SparkSession, path: str) -> str:
    """Tab when the first line has a tab and no comma."""
    first = spark.read.text(path).limit(1).collect()  # one line
    line = first[0][0] if first else ""
    return "\t" if "\t" in line and "," not in line else ","


def read_delimited(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """All cells as text; rows without any content are dropped.

    Cells with line breaks need ``multiline``, which reads a file in one task; turn it off to have large files split.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, escape='"', sep=separator(spark, path), encoding="UTF-8")
    clean = df.toDF(*[c.removeprefix(BOM) for c in df.columns])
    return clean.filter(F.exists(F.array(*[F.col(f"`{c}`") for c in clean.columns]), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""))


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or an object with a ``rows`` array."""
    df = spark.read.json(path, multiLine=True)
    field = df.schema["rows"].dataType if "rows" in df.columns else None
    if isinstance(field, T.ArrayType) and isinstance(field.elementType, T.StructType):
        df = df.select(F.explode("rows").alias("r")).select("r.*")
    if "_corrupt_record" in df.columns or not df.columns:
        raise ValueError("JSON rows must be objects with column names as keys")
    return df


def read_any(spark: SparkSession, path: str) -> DataFrame:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in EXTENSIONS:
        raise ValueError(f"Unsupported file type: {kind}")
    if kind == "jsonl":  # an object on each line: split like any text
        return spark.read.json(path)
    return read_json_rows(spark, path) if kind == "json" else read_delimited(spark, path)


def read_chunks(spark: SparkSession, folder: str, multiline: bool = True) -> DataFrame:
    """All CSV files of a folder with their file name, columns matched by name.

    Files with one header are read together, and the groups are united by name; a column that a file lacks is null there.
    """
    lines = spark.read.text(f"{folder}/*.csv").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    first = lines.filter("block = 0").withColumn("at", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "at").alias("header")).collect()  # a row for each file
    alike: dict[str, list[str]] = {}
    for r in sorted(first, key=lambda r: r["path"]):
        alike.setdefault(r["header"].removeprefix(BOM), []).append(unquote(r["path"]))
    read = None
    for paths in alike.values():
        part = spark.read.csv(paths, header=True, inferSchema=False, multiLine=multiline, escape='"')
        part = part.toDF(*[c.removeprefix(BOM) for c in part.columns]).withColumn("source_file", F.col("_metadata.file_name"))
        read = part if read is None else read.unionByName(part, allowMissingColumns=True)
    if read is None:
        raise ValueError(f"no CSV files in {folder}")
    return read


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows handed over in memory (an interactive import, small by nature)."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([[None if r.get(n) is None else str(r.get(n)) for n in names] for r in rows],
                                 T.StructType([T.StructField(n, T.StringType()) for n in names]))


def preview(df: DataFrame, override: dict | None = None, samples: int = 5) -> tuple[int, dict, DataFrame]:
    """Row count, resolved mapping and the first normalised samples; nothing is written."""
    shown = normalise(map_columns(df, override)).limit(samples)
    return df.count(), resolve_mapping(df.columns, override), shown.withColumn("report_text", F.substring("report_text", 1, 180))


def labelled_columns(df: DataFrame) -> DataFrame:
    """Text and label under fixed names, from the first columns that exist."""
    pick = lambda names: F.coalesce(*[F.col(c).cast("string") for c in names if c in df.columns])
    if not set(TEXT_COLUMNS) & set(df.columns) or not set(LABEL_COLUMNS) & set(df.columns):
        raise ValueError("A text column and a label column are required")
    return df.withColumns({"case_text": pick(TEXT_COLUMNS), "case_label": pick(LABEL_COLUMNS)})


def append_reports(df: DataFrame, path: str, partition: str = "source", writers: int = 32) -> None:
    """Append to the store; rows are gathered by partition value with a salt, so ``writers`` tasks share one hot source."""
    salted = df.repartition(F.col(partition), F.pmod(F.xxhash64("report_text"), F.lit(writers)))
    salted.write.mode("append").partitionBy(partition).parquet(path)


def write_export(df: DataFrame, columns: list[str], path: str) -> None:
    export_rows(df, columns).write.mode("overwrite").csv(path, header=True, lineSep="\r\n", quoteAll=False, escape='"')


def write_splits(df: DataFrame, columns: list[str], path: str) -> None:
    """One folder per split, sorted by report id inside range partitions."""
    (df.select("split", *columns).repartitionByRange("split", "report_id").sortWithinPartitions("split", "report_id")
     .write.mode("overwrite").partitionBy("split").csv(path, header=True, escape='"'))


def phase_cache(df: DataFrame, path: str) -> DataFrame:
    """Write a phase's rows once and go on from the stored copy; survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_export_union(frames: Sequence[DataFrame], path: str) -> None:
    """Rows of different columns as one CSV export: columns in the order they are first seen, cells that a row has not are
    empty, every file starts with a byte-order mark so that spreadsheets read it as UTF-8."""
    shaped = [export_rows(f, f.columns) for f in frames]
    whole = shaped[0]
    for more in shaped[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    filled = whole.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c if n else BOM + c) for n, c in enumerate(whole.columns)])
    filled.write.mode("overwrite").csv(path, header=True, lineSep="\r\n", quoteAll=False, escape='"', emptyValue="")
