"""Helpers the operators share: written intermediate tables, free column names, bounded Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.session import shared_folder

# Fixed values of the task: what counts as white space, and what separates words.
SPACE = r"[\x20\x09-\x0D]"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ASCII letters to lower case, every other separating byte to a blank; bytes of other characters stay.
WORD_BYTES = bytes(b if chr(b).islower() or chr(b).isdigit() or b > 127 else b + 32 if chr(b).isupper() else 32 for b in range(256))

_STAGED: dict[str, list[str]] = {}


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later readers never compute it anew,
    and a lost executor takes nothing with it.  ``purge`` removes the tables when a job is done."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete every table staged by this application; frames built on them can't be read afterwards."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    for path in _STAGED.pop(context.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def free_name(taken: Iterable[str], wish: str) -> str:
    """A column name that ``taken`` doesn't hold, whatever its case."""
    used = {t.lower() for t in taken}
    while wish.lower() in used:
        wish += "_"
    return wish


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, since a thousand long texts don't fit where a thousand short ones do."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place, since Arrow functions can't take every name (``a.b``, say)."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def filter_batches(docs: DataFrame, run) -> DataFrame:
    """Rows of ``docs`` that ``run`` keeps; it gets Arrow batches with the text's UTF-8 bytes as last column, and returns them without it."""
    plain = by_place(docs)
    text = F.col(f"c{docs.columns.index('text')}")
    return plain.withColumn("bytes", text.cast("binary")).mapInArrow(run, plain.schema).toDF(*docs.columns)


def field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    """The column's field, nullable, under the given name."""
    return T.StructField(as_name or name, df.schema[name].dataType, True)


def words(data: bytes | None) -> list[bytes]:
    """ASCII-lower-cased words of UTF-8 bytes, split at every ASCII character that is no letter or digit."""
    return data.translate(WORD_BYTES).split() if data else []
