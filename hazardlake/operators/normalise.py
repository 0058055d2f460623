"""Canonical report rows: cleaning, identifiers, file overrides, import counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.functions import text as tx
from hazardlake.functions.columns import blank_to_null, first_label, let
from hazardlake.operators.ranking import group_positions
from hazardlake.vocab.headers import RULE_FIELD_HINTS

NO_DETAIL = ["na", "n/a", "-", "nil", "none"]
# File field and the analysis column it overrides, in order.
OVERRIDES = [
    ("activity", "activity"), ("hazard", "hazard"), ("consequence", "potential_consequence"),
    ("barrier_failure", "barrier_failure"), ("location", "location"), ("equipment", "equipment"),
    ("unsafe_type", "unsafe_type"), ("rule", "life_saving_rule"),
]
MODIFIED = "struct<field:string,canonical:string,ai:array<string>,used:array<string>,changed:boolean>"


def whole(value: Column) -> Column:
    """Trimmed value of any length; null when blank."""
    return blank_to_null(tx.cell(value))


def merged_site(site: Column, detail: Column) -> Column:
    """Site with its detail behind a middle dot."""
    base, extra = tx.cell(site), tx.cell(detail)
    usable = (base != "") & (extra != "") & ~F.lower(extra).isin(NO_DETAIL)
    full = F.when(usable, F.concat(base, F.lit(" · "), extra)).otherwise(base)
    return blank_to_null(full)


def joined_text(title: Column, body: Column) -> Column:
    """Title and body as one text; a title equal to the body is dropped."""
    t, b = tx.cell(title), tx.cell(body)
    lead = F.when((t != "") & (t != b), F.concat(F.rtrim(t, F.lit(".")), F.lit(".")))
    return tx.strip(F.concat_ws(" ", lead, blank_to_null(b)))


def normalise(mapped: DataFrame, *keep: str) -> DataFrame:
    """One projection from the mapped text columns to typed report fields."""
    c = lambda f: F.col(f"in_{f}")
    return mapped.select(
        *keep, joined_text(c("title"), c("text")).alias("report_text"), tx.cell(c("title")).alias("title"),
        whole(c("report_type")).alias("report_type"), tx.parse_date(c("date")).alias("date"),
        merged_site(c("site"), c("location_detail")).alias("site"), whole(c("activity")).alias("activity"),
        whole(c("report_id")).alias("source_id"), whole(c("hazard")).alias("hazard"),
        whole(c("consequence")).alias("consequence"), tx.list_cell(tx.cell(c("barrier_failure"))).alias("barrier_failure"),
        whole(c("location")).alias("location"), tx.list_cell(tx.cell(c("equipment"))).alias("equipment"),
        whole(c("unsafe_type")).alias("unsafe_type"), whole(c("rule")).alias("rule"))


def source_label(name: Column | None) -> Column:
    """``upload:<file>``."""
    raw = F.lit("upload") if name is None else F.concat(F.lit("upload:"), F.coalesce(name, F.lit("")))
    return F.coalesce(blank_to_null(F.trim(raw)), F.lit("upload"))


def next_report_number(store: DataFrame) -> DataFrame:
    """One row: the number after the newest stored id, one when there is none or it has no number."""
    newest = store.agg(F.max_by("report_id", "id").alias("last"))
    number = F.regexp_extract(F.coalesce("last", F.lit("RPT-0")), r"([^-]*)$", 1).try_cast("bigint")
    return newest.select((F.coalesce(number, F.lit(0)) + 1).alias("next_number"))


def assign_report_ids(batch: DataFrame, store: DataFrame, order: str) -> DataFrame:
    """Sequential ``RPT-0001`` identifiers in row order without sorting through one task."""
    placed = group_positions(batch.select(order), [], [order])
    numbered = placed.crossJoin(F.broadcast(next_report_number(store)))  # one row
    ids = numbered.select(order, F.format_string("RPT-%04d", F.col("next_number") + F.col("position")).alias("report_id"))
    return batch.join(ids, order)


def estimate_rule(hazard: Column, activity: Column) -> Column:
    """Rule implied by structured fields; null when nothing points to one."""
    text = F.lower(F.concat(F.coalesce(hazard, F.lit("")), F.lit(" "), F.coalesce(activity, F.lit(""))))
    return let(text, lambda low: F.when(F.trim(low) != "", first_label(low, RULE_FIELD_HINTS)))


def _as_list(column: Column, kind: str) -> Column:
    return column if kind.startswith("array") else F.when(column.isNotNull(), F.array(column))


def apply_overrides(df: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """File values replace analysis values; each use is recorded.

    ``pairs`` holds (canonical field, file column, analysis column).  ``changed`` is true only where
    an analysis value was replaced; a changed rule empties the condition map made for the old rule.
    """
    kinds = dict(df.dtypes)
    records, values, rule_changed = [], {}, F.lit(False)
    for field, file_col, ai_col in pairs:
        given, ai = F.col(file_col), F.col(ai_col)
        if kinds[file_col] == "string":
            given = blank_to_null(tx.strip(given))
        used, before = _as_list(given, kinds[file_col]), _as_list(ai, kinds[ai_col])
        changed = F.coalesce((F.size(before) > 0) & (F.get(before, F.lit(0)) != "") & ~before.eqNullSafe(used), F.lit(False))
        records.append(F.when(given.isNotNull(), F.struct(
            F.lit(ai_col).alias("field"), F.lit(field).alias("canonical"), before.cast("array<string>").alias("ai"),
            used.cast("array<string>").alias("used"), changed.alias("changed"))))
        values[ai_col] = F.coalesce(given, ai)
        if field == "rule":
            rule_changed = given.isNotNull() & changed
    out = {"modified_fields": F.array_compact(F.array(*records)), **values}
    if "rule_conditions" in kinds:
        out["rule_conditions"] = F.when(rule_changed, F.array().cast(kinds["rule_conditions"])).otherwise(F.col("rule_conditions"))
    return df.withColumns(out)


def fill_estimated_rule(df: DataFrame, hazard: str, activity: str) -> DataFrame:
    """Estimate a rule where an analysed row has none and say so in the note."""
    guess = F.when(F.col("life_saving_rule").isNull() & (F.col("processing_status") == "analyzed"), estimate_rule(F.col(hazard), F.col(activity)))
    note = F.concat(F.lit("The file's hazard and activity suggest the rule '"), F.col("_guess"), F.lit("'; the text names none."))
    return (df.withColumn("_guess", guess)
            .withColumn("uncertainty_note", blank_to_null(F.concat_ws(" ", "uncertainty_note", note)))
            .withColumn("life_saving_rule", F.coalesce("life_saving_rule", "_guess")).drop("_guess"))


def import_counters(rows: DataFrame) -> DataFrame:
    """Counters of one import from rows with ``import_state``, status and verdict; exact, in one aggregate."""
    state, fine = F.col("import_state"), F.col("processing_status") == "analyzed"
    new = state == "new"
    return rows.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(new & fine).alias("imported"),
        F.count_if(state == "empty").alias("skipped_empty"), F.count_if(new & ~fine).alias("failed"),
        F.count_if(state == "duplicate").alias("duplicates"), F.count_if(new & fine & F.col("sif_potential")).alias("sif_potential"),
        F.count_if(new & fine & (F.col("priority") == "HIGH")).alias("high_priority"),
        F.min(F.when(new & fine, F.col("row_no"))).alias("first_row"))


def last_duplicates(rows: DataFrame, limit: int = 20) -> DataFrame:
    return rows.filter(F.col("import_state") == "duplicate").orderBy(F.desc("row_no")).limit(limit).select("row_no", "duplicate_of")
