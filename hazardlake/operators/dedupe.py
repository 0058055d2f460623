"""Exact duplicates by text fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.functions.columns import fence, let
from hazardlake.functions.text import fingerprint


def text_key(text: Column) -> Column:
    """Fixed-width key of a fingerprint; null for texts without one. Long texts never enter a shuffle as keys."""
    return fence(let(fingerprint(text), lambda fp: F.when(fp != "", F.sha2(fp, 256))))


def first_of_key(df: DataFrame, key: str, order: Column, value: Column) -> DataFrame:
    """First value of each key; combined before the shuffle, so a hot key sends one row per task."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order.alias("o"), value.alias("v"))).alias("first"))


def join_first(keyed: DataFrame, first: DataFrame, row: Column) -> DataFrame:
    """Left join on ``_key``; rows without a key are spread by their own id instead of meeting in one task."""
    spread = keyed.withColumn("_on", F.coalesce("_key", F.concat(F.lit("~"), row.cast("string"))))
    return spread.join(first.withColumnRenamed("_key", "_on"), "_on", "left").drop("_on")


def import_guard(batch: DataFrame, store: DataFrame | None, text_col: str = "report_text", row_col: str = "row_no", sound: Column | None = None) -> DataFrame:
    """Marks each batch row as ``new``, ``duplicate`` or ``empty`` and names what it repeats.

    Where ``sound`` is false the row is known to fail: nothing can repeat it, so the next row of its text is the first.

    A stored report with the same fingerprint wins over a row of the same batch.  Owners are
    found by an aggregate on the key and joined back; the join has one owner row per key, so a
    hot key is split by the skew join.
    """
    keyed = batch.withColumn("_key", text_key(F.col(text_col)))
    own_rows = keyed if sound is None else keyed.filter(sound)
    owners = own_rows.select("_key", F.struct(F.lit(1).alias("rank"), F.col(row_col).cast("long").alias("at")).alias("o"),
                          F.col(row_col).cast("string").alias("v"))
    if store is not None:
        # Keys written at import are read as they are; only those of the batch go on to the aggregate.
        known = F.col("text_key") if "text_key" in store.columns else text_key(F.col("report_text"))
        asked = keyed.select("_key").distinct()
        stored = store.select(known.alias("_key"),
                              F.struct(F.lit(0).alias("rank"), F.col("id").cast("long").alias("at")).alias("o"),
                              F.col("report_id").alias("v"))
        owners = owners.unionByName(stored.join(asked, "_key", "left_semi"))
    first = first_of_key(owners, "_key", F.col("o"), F.col("v"))
    joined = join_first(keyed, first, F.col(row_col))
    blank = F.col("_key").isNull()
    repeats = ~blank & F.coalesce((F.col("first.o.rank") == 0) | (F.col("first.o.at") < F.col(row_col)), F.lit(False))
    return joined.withColumns({
        "import_state": F.when(blank, F.lit("empty")).when(repeats, F.lit("duplicate")).otherwise(F.lit("new")),
        "duplicate_of": F.when(repeats, F.col("first.v")), "text_key": F.col("_key"),
    }).drop("_key", "first")


def split_duplicates(df: DataFrame, text_col: str, order: Column, id_col: str) -> DataFrame:
    """Adds ``is_duplicate``: every row but the first of its fingerprint, and every row without one."""
    keyed = df.withColumn("_key", text_key(F.col(text_col)))
    first = first_of_key(keyed, "_key", order, F.col(id_col)).select("_key", F.col("first.v").alias("_owner"))
    return (join_first(keyed, first, F.col(id_col))
            .withColumn("is_duplicate", ~F.coalesce(F.col("_owner") == F.col(id_col), F.lit(False))).drop("_key", "_owner"))


def duplicate_groups(df: DataFrame, text_col: str, id_col: str, min_length: int = 8) -> DataFrame:
    """Each member of a group of equal fingerprints with the group's size and first id.

    Members stay rows: a group of any size never becomes one list.
    """
    key = fence(let(fingerprint(F.col(text_col)), lambda fp: F.when(F.length(fp) >= min_length, F.sha2(fp, 256))))
    keyed = df.select(id_col, key.alias("_key")).filter(F.col("_key").isNotNull())
    groups = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("group_size"), F.min(id_col).alias("first_id")).filter(F.col("group_size") > 1)
    return keyed.join(groups, "_key").select(id_col, "group_size", "first_id")


def dedupe_by_priority(df: DataFrame, text_col: str, rank: Column, id_col: str) -> DataFrame:
    """Keeps, per fingerprint, the row of the best source (lowest rank), then the smallest id."""
    keyed = df.withColumn("_key", fence(F.sha2(fingerprint(F.col(text_col)), 256)))
    best = keyed.groupBy("_key").agg(F.min(F.struct(rank.alias("r"), F.col(id_col).alias("i"))).alias("best"))
    return keyed.join(best, "_key").filter(F.col("best.i") == F.col(id_col)).drop("_key", "best")
