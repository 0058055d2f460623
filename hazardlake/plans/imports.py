"""The whole import: any table in, checked and analysed report rows out."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.lexicon import DEFAULT, Lexicon
from hazardlake.operators.analysis import ANALYSIS_COLUMNS, analyze
from hazardlake.operators.dedupe import import_guard
from hazardlake.operators.isolation import Attempt, is_failed, last_failures, normalise_checked, settle
from hazardlake.operators.mapping import map_columns
from hazardlake.operators.normalise import apply_overrides, fill_estimated_rule, import_counters, last_duplicates, source_label
from hazardlake.session import ensure_checkpoint_dir

FILE_FIELDS = ["activity", "hazard", "consequence", "barrier_failure", "location", "equipment", "unsafe_type", "rule"]
ANALYSIS_FIELDS = {"activity": "analysis_activity", "consequence": "potential_consequence", "rule": "life_saving_rule"}


def import_reports(rows: DataFrame, store: DataFrame | None = None, override: dict | None = None, source: str | None = None,
                   row_no: Column | None = None, lexicon: Lexicon = DEFAULT, fatal: Collection[str] | None = (),
                   extra: Mapping[str, Callable[[Column], Attempt]] | None = None) -> DataFrame:
    """Map, normalise, guard against duplicates, analyse, apply file values, estimate a rule where none is known.

    No cell stops the batch: ``errors`` names every cell that was given and could not be read.  An error in one of the
    ``fatal`` fields (None: in any) makes its row ``failed``; the report stays, without an analysis, and the next row of
    the same text is taken as new.  ``extra`` reads further columns of the table by an attempt each.

    Only the duplicate guard shuffles, and only fixed-width keys decide there; the analysis is a
    narrow step over the rows that passed.  Empty and duplicate rows stay in the result, marked.

    ``row_no`` is a stable number of each row, from a key or a place in a file.  Without one, rows are numbered as they
    arrive and written down before anything reads the numbers, so a repeated scan can't change them.
    """
    keep = {"row_no": F.monotonically_increasing_id() if row_no is None else row_no, **{name: F.col(f"`{name}`") for name in extra or {}}}
    shaped = normalise_checked(map_columns(rows, override, keep=keep), "row_no", extra=extra)
    if row_no is None:
        ensure_checkpoint_dir(rows.sparkSession)
        shaped = shaped.checkpoint()
    guarded = import_guard(shaped, store, sound=~is_failed(fatal))
    renamed = guarded.select("row_no", "report_text", "report_type", "date", "site", "source_id", "import_state", "duplicate_of", "text_key", "errors", *(extra or {}),
                             *[F.col(f).alias(f"file_{f}") for f in FILE_FIELDS])
    # Only new rows need analysis; the text of others is left out of it.
    todo = renamed.withColumn("_todo", F.when((F.col("import_state") == "new") & ~is_failed(fatal), F.col("report_text")))
    analysed = analyze(todo, "_todo", lexicon).drop("_todo")
    merged = apply_overrides(analysed, [(f, f"file_{f}", ANALYSIS_FIELDS.get(f, f)) for f in FILE_FIELDS])
    final = settle(fill_estimated_rule(merged, "file_hazard", "file_activity"), [*ANALYSIS_COLUMNS, "modified_fields"], fatal)
    return final.drop(*[f"file_{f}" for f in FILE_FIELDS]).withColumn("source", source_label(F.lit(source) if source else None))



def import_summary(rows: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counters of an import, its newest failures and its newest duplicates."""
    return import_counters(rows), last_failures(rows, limit), last_duplicates(rows, limit)
