"""Tables about tables, and labelled texts made from templates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.functions.columns import blank_to_null
from hazardlake.functions.text import fingerprint, strip
from hazardlake.operators.dedupe import split_duplicates
from hazardlake.operators.ranking import group_positions

# ---- data dictionary ---------------------------------------------------------


def kind_of(data_type: T.DataType) -> str:
    """A column's type in plain words."""
    if isinstance(data_type, T.IntegralType):
        return "whole number"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return {"string": "text", "boolean": "yes or no", "array": "list", "map": "names and values", "struct": "record"}.get(data_type.typeName(), data_type.typeName())


def shown(df: DataFrame, name: str) -> Column:
    """A cell as text; null when it is missing or blank.  Floating numbers are told apart to six decimals."""
    kind, cell = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return cell.try_cast("decimal(38,6)").cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(cell)
    return blank_to_null(strip(cell.cast("string")))


def _cells(df: DataFrame) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("place"), shown(df, name).alias("value")) for n, name in enumerate(df.columns)])
    return df.select(F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("c")).select("c.place", "c.value")


def data_dictionary(df: DataFrame, samples: int = 3) -> DataFrame:
    """``(place, column, type, rows, present, share, distinct, sketch, samples)`` of every column of a table.

    One pass counts all columns: cells travel as digests, counted where they are read, so neither a long text nor a value that
    fills a column weighs on the shuffle.  ``distinct`` is exact, ``sketch`` the estimate of the same number from registers of
    fixed size.  ``samples`` are the values with the smallest digests, the same on every run and in every layout; a
    second pass fetches these few.  A column without a value has zeros and an empty list.
    """
    spark = df.sparkSession
    cells = _cells(df).withColumn("digest", F.md5("value"))
    counts = cells.groupBy("place", "digest").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("place").agg(F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct"), F.approx_count_distinct("digest").alias("sketch"))
    # distinct digests only, and each task keeps its own smallest before the shuffle
    near = counts.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy("digest"))).filter(F.col("rank") <= samples).select("place", "digest", "rank")
    values = cells.join(F.broadcast(near), ["place", "digest"]).groupBy("place", "digest", "rank").agg(F.min("value").alias("value"))  # columns x samples rows
    listed = values.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("samples"))
    names = spark.createDataFrame([(n, f.name, kind_of(f.dataType)) for n, f in enumerate(df.schema.fields)], "place int, column string, type string")
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    joined = names.crossJoin(F.broadcast(total)).join(per, "place", "left").join(listed, "place", "left")  # one row for each column
    filled = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("present", "distinct", "sketch")}
    return joined.withColumns({**filled, "samples": F.coalesce("samples", F.array().cast("array<string>"))}).withColumn(
        "share", F.when(F.col("rows") > 0, F.round(F.col("present") / F.col("rows"), 4)).otherwise(F.lit(0.0))).select(
        "place", "column", "type", "rows", "present", "share", "distinct", "sketch", "samples")


# ---- labelled texts from templates ---------------------------------------------

def template_corpus(templates: DataFrame, counts: Mapping[str, int], sites: int = 5) -> DataFrame:
    """``(report_id, label, site, event_type, template, description)``: ``counts`` rows of each label, made from ``templates(label, template)``.

    Templates are numbered within their label; row i takes number i modulo their count, so each is used equally often, and
    carries its own number and site.  A label without templates gives no rows.
    """
    spark = templates.sparkSession
    known = templates.select("label", "template").filter(blank_to_null(strip(F.col("template"))).isNotNull()).distinct()
    placed = group_positions(known, ["label"], ["template"])
    sizes = placed.groupBy("label").agg(F.count(F.lit(1)).alias("size"))  # one row for each label
    rows = None
    for label, n in counts.items():
        made = spark.range(n).select(F.lit(label).alias("label"), F.col("id").alias("i"))
        rows = made if rows is None else rows.unionByName(made)
    chosen = rows.join(F.broadcast(sizes), "label").withColumn("position", F.col("i") % F.col("size")).join(placed, ["label", "position"])
    number = F.concat(F.lit("RPT-"), F.substring("label", 1, 1), F.lpad((F.col("i") + 1).cast("string"), F.greatest(F.lit(4), F.length((F.col("i") + 1).cast("string"))), F.lit("0")))
    site = F.concat(F.lit("Site "), F.char(65 + F.col("i") % sites))
    event = F.when(F.col("label") == "Yes", F.when(F.col("i") % 2 == 0, "Unsafe Act").otherwise("Near Miss")).otherwise(
        F.when(F.col("i") % 2 == 0, "Unsafe Condition").otherwise("Routine Observation"))
    return chosen.select(number.alias("report_id"), "label", site.alias("site"), event.alias("event_type"), "template").withColumn(
        "description", F.concat("report_id", F.lit(", "), "site", F.lit(": "), "template"))


def with_given_texts(corpus: DataFrame, given: DataFrame) -> DataFrame:
    """The corpus and ``given(report_id, label, description)`` texts in one, each text once.

    Texts are equal when their fingerprints are; of equal ones a given text stays before a made one, then the smallest id.
    """
    columns = ["report_id", "label", "template", "description"]
    both = given.withColumn("template", F.lit(None).cast("string")).select(*columns, F.lit(0).alias("made")).unionByName(corpus.select(*columns, F.lit(1).alias("made")))
    marked = split_duplicates(both, "description", F.struct("made", "report_id"), "report_id")
    return marked.filter(~F.col("is_duplicate")).select(*columns, fingerprint(F.col("description")).alias("fingerprint"))
