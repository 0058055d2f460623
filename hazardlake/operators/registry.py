"""Report registry, review queue and joins with reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERIFIED = ["confirmed", "reviewed", "edited"]
# Field of the coverage table, report column, field of a file override, analysis column.
COVERAGE_FIELDS = [
    ("report_type", "report_type", None, None), ("source_id", "source_id", None, None), ("date", "date", None, None), ("site", "site", None, None),
    ("activity", "activity", "activity", "analysis_activity"), ("hazard", None, "hazard", "hazard"), ("rule", None, "life_saving_rule", "life_saving_rule"),
    ("barrier_failure", None, "barrier_failure", "barrier_failure"), ("location", None, "location", "location"), ("equipment", None, "equipment", "equipment"),
    ("consequence", None, "potential_consequence", "potential_consequence"), ("sif", None, None, "sif_potential"), ("priority", None, None, "priority"),
    ("confidence", None, None, "confidence"), ("languages", None, None, "languages"),
]


def with_analysis(reports: DataFrame, analyses: DataFrame, how: str = "inner") -> DataFrame:
    return reports.join(analyses, reports["id"] == analyses["report_pk"], how).drop("report_pk")


def latest_review(reviews: DataFrame) -> DataFrame:
    """Last review of each report by insertion order; the aggregate combines before the shuffle."""
    last = F.max_by(F.struct("reviewer", "decision", "comments", "reviewed_at"), "id")
    return (reviews.groupBy("report_pk").agg(F.max("id").alias("review_id"), last.alias("r"))
            .select("report_pk", "review_id", "r.reviewer", "r.decision", "r.comments", "r.reviewed_at"))


def filter_registry(reports: DataFrame, analyses: DataFrame, *, site: str | None = None, activity: str | None = None,
                    q: str | None = None, source: str | None = None, rule: str | None = None,
                    hazard: str | None = None, priority: str | None = None, sif: bool | None = None,
                    barrier: str | None = None) -> DataFrame:
    """Predicates exist only for the given filters; analyses are joined only when one needs them."""
    has = lambda column, needle: F.lower(column).contains(needle.lower())
    out = reports
    if site:
        out = out.filter(has(F.col("site"), site))
    if activity:
        out = out.filter(has(F.col("activity"), activity))
    if q:
        out = out.filter(has(F.col("report_text"), q))
    if source:
        out = out.filter(F.col("source") == source)
    wanted: list[Column] = []
    if rule:
        wanted.append(F.col("life_saving_rule") == rule)
    if hazard:
        wanted.append(F.col("hazard") == hazard)
    if priority:
        wanted.append(F.col("priority") == priority.upper())
    if sif is not None:
        wanted.append(F.col("sif_potential") == sif)
    if barrier:
        wanted.append(F.exists("barrier_failure", lambda b: has(b, barrier)))
    if wanted:
        out = with_analysis(out, analyses)
        for test in wanted:
            out = out.filter(test)
    return out


def filter_status(reports: DataFrame, reviews: DataFrame, status: str) -> DataFrame:
    """``pending`` = no review at all; otherwise the latest decision equals the status."""
    if status == "pending":
        return reports.join(reviews.select(F.col("report_pk").alias("id")), "id", "left_anti")
    current = latest_review(reviews).filter(F.col("decision") == status).select(F.col("report_pk").alias("id"))
    return reports.join(current, "id", "left_semi")


def newest_first(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("date"), F.desc("id")).limit(limit)


def search_fields(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Needle anywhere in the joined text of the columns."""
    return df.filter(F.lower(F.concat_ws(" ", *columns)).contains(needle.lower()))


def review_status(df: DataFrame, reviews: DataFrame) -> DataFrame:
    """Adds ``review_status``: latest decision, ``pending`` without review, null for a review without decision."""
    current = latest_review(reviews).select(F.col("report_pk").alias("_pk"), "decision", F.lit(True).alias("_seen"))
    return (df.join(current, df["id"] == F.col("_pk"), "left")
            .withColumn("review_status", F.when(F.col("_seen").isNull(), F.lit("pending")).otherwise(F.col("decision")))
            .drop("_pk", "_seen", "decision"))


def view_tests() -> dict[str, Column]:
    """What each named view holds, on rows with analysis columns and ``review_status``."""
    status = F.col("review_status")
    return {"all": F.lit(True), "sif": F.col("sif_potential"), "high": F.col("priority") == "HIGH", "pending": (status == "pending") & (F.col("processing_status") == "analyzed"),
            "verified": status.isin(VERIFIED), "rejected": status == "rejected"}


def view(df: DataFrame, name: str) -> DataFrame:
    return df.filter(view_tests()[name])


def view_counts(df: DataFrame) -> DataFrame:
    """``(view_name, n)`` of all views in one aggregate."""
    tests = view_tests()
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("view_name"), F.col(n).alias("n")) for n in tests])
    return counts.select(F.explode(pairs).alias("p")).select("p.view_name", "p.n")


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "HIGH", 3).when(priority == "MEDIUM", 2).when(priority == "LOW", 1).otherwise(0)


def review_queue(df: DataFrame) -> DataFrame:
    """Analyzed, pending reports: highest priority first, SIF before others, then newest."""
    waiting = df.filter((F.col("processing_status") == "analyzed") & (F.col("review_status") == "pending"))
    weight = (4 - priority_rank(F.col("priority"))) * 100 + F.when(F.col("sif_potential"), 0).otherwise(10)
    return waiting.withColumn("queue_rank", weight)


def field_coverage(df: DataFrame) -> DataFrame:
    """One row per report and field with its value and where it came from.

    A file override comes first, then the report's own column, then the analysis.  Lists are joined with commas, a verdict reads
    ``Yes (flagged)`` or ``No``, confidence is a whole percentage.  Fields whose columns the frame lacks have no value.
    """
    kinds = dict(df.dtypes)

    def shown(name: str | None) -> Column:
        if name is None or name not in kinds:
            return F.lit(None).cast("string")
        c = F.col(name)
        if kinds[name].startswith("array"):
            text = F.array_join(c, ", ")
        elif kinds[name] == "boolean":
            text = F.when(c, "Yes (flagged)").when(~c, "No")
        elif name == "confidence":
            text = F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))
        else:
            text = c.cast("string")
        return F.nullif(text, F.lit(""))

    def used(field: str | None) -> Column:
        if field is None or "modified_fields" not in kinds:
            return F.lit(None).cast("string")
        mine = F.filter("modified_fields", lambda m: m["field"] == field)
        return F.nullif(F.array_join(F.get(F.transform(mine, lambda m: m["used"]), F.lit(0)), ", "), F.lit(""))

    def entry(name: str, file_col: str | None, override: str | None, ai_col: str | None) -> Column:
        given, inferred = F.coalesce(used(override), shown(file_col)), shown(ai_col)
        origin = F.when(given.isNotNull(), "file").when(inferred.isNotNull(), "ai").otherwise("none")
        return F.struct(F.lit(name).alias("field"), F.coalesce(given, inferred).alias("value"), origin.alias("origin"))

    rows = F.explode(F.array(*[entry(*f) for f in COVERAGE_FIELDS])).alias("f")
    return df.select("id", rows).select("id", "f.field", "f.value", "f.origin")


def facet_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value) for every distinct value, in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))
                                for c in columns])).alias("f")
    return df.select(pairs).select("f.facet", "f.value").filter(F.col("value").isNotNull()).distinct()


def human_sif(decision: Column, ai_sif: Column) -> Column:
    """Label implied by a decision; unknown decisions give null."""
    return (F.when(decision == "confirmed", F.lit(True)).when(decision == "rejected", F.lit(False))
            .when(decision == "reviewed", ai_sif))


def display_source(source: Column) -> Column:
    """Upload prefix removed, ``upload`` when blank."""
    label = F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("upload"))
    return F.when(label.startswith("upload:"), F.substr(label, F.lit(8))).otherwise(label)


def export_cell(df: DataFrame, column: str) -> Column:
    """One export cell: null empty, Yes/No, two decimals, bars between items, control characters blanked."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind == "boolean":
        text = F.when(c, "Yes").otherwise("No")
        text = F.when(c.isNull(), "").otherwise(text)
    elif kind in ("double", "float"):
        text = F.when(c.isNotNull(), F.format_string("%.2f", F.round(c, 2)))
    elif kind.startswith("array"):
        text = F.concat_ws(" | ", c)
    else:
        text = c.cast("string")
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def export_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[export_cell(df, c).alias(c) for c in columns])


def natural_key(value: Column) -> tuple[Column, Column]:
    """Sort keys for text with a trailing number: lowercased stem, then the number."""
    stem = F.lower(F.regexp_extract(value, r"^(.*?)(\d*)$", 1))
    return stem, F.regexp_extract(value, r"(\d+)$", 1).try_cast("bigint")


# What an export calls a review state.
REVIEW_LABELS = {"pending": "Pending review", "confirmed": "Confirmed", "rejected": "Rejected", "edited": "Edited", "reviewed": "Reviewed"}


def export_table(rows: DataFrame) -> DataFrame:
    """The registry's export: sixteen columns, from report rows with analysis, ``review_status`` and ``modified_fields``."""
    state = F.coalesce(*[F.when(F.col("review_status") == k, F.lit(v)) for k, v in REVIEW_LABELS.items()], F.lit(""))
    shaped = rows.select(
        F.col("report_id").alias("Report ID"), F.col("source_id").alias("Actual ID (file)"), display_source(F.col("source")).alias("Source File"),
        F.when(F.col("processing_status") == "failed", "Analysis failed").otherwise(state).alias("Status"),
        F.when(F.exists(F.coalesce("modified_fields", F.array().cast(rows.schema["modified_fields"].dataType)), lambda m: m["changed"]), "Y").otherwise("N").alias("Modified (Y/N)"),
        F.col("date").alias("Date"), F.col("report_type").alias("Type"), F.col("site").alias("Site"), F.coalesce("activity", "analysis_activity").alias("Activity"),
        F.coalesce("sif_potential", F.lit(False)).alias("SIF-potential"), F.round(F.col("confidence") * 100).cast("int").alias("Confidence (%)"), F.col("priority").alias("Priority"),
        F.col("life_saving_rule").alias("Life-Saving Rule"), F.col("barrier_failure").alias("Barrier Failure"), F.col("hazard").alias("Hazard"), F.col("report_text").alias("Report Text"))
    return shaped.select(*[export_cell(shaped, c).alias(c) for c in shaped.columns])


def detail_pages(shown: DataFrame, similar: DataFrame, reports: DataFrame, reviews: DataFrame, copy_at: float = 0.88) -> DataFrame:
    """Each shown report's similar ones with their site and latest review, and which of them it may be a copy of.

    ``similar(query_id, match_id, place, similarity)`` has a few rows for each report, so only those reports and
    reviews are joined.  The first match is a possible original where it is as close as ``copy_at``.
    """
    near = similar.join(shown.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    matched = near.select(F.col("match_id").alias("id")).distinct()
    sites = reports.join(matched, "id", "left_semi").select(F.col("id").alias("match_id"), "site")
    last = latest_review(reviews.join(matched.select(F.col("id").alias("report_pk")), "report_pk", "left_semi"))
    rows = near.join(sites, "match_id", "left").join(last.withColumnRenamed("report_pk", "match_id"), "match_id", "left")
    first = F.when((F.col("place") == 0) & (F.col("similarity") >= copy_at), F.col("match_id"))
    return rows.select("query_id", "place", "match_id", "similarity", "site", "decision", "reviewer", "reviewed_at", first.alias("duplicate_of"))
