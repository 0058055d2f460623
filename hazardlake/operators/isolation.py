"""Row isolation: every step gives a value or an error for each row, so a bad cell marks its row and the batch goes on."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.functions import text as tx
from hazardlake.functions.columns import blank_to_null
from hazardlake.operators.normalise import normalise

ERRORS = "array<struct<stage:string,field:string,value:string,message:string>>"
# Length of a stored message; the whole value stands beside it.
MESSAGE_LENGTH = 400


@dataclass(frozen=True)
class Attempt:
    """A converted cell: its value, and what is wrong with the cell (null if nothing is)."""

    value: Column
    error: Column


def _given(raw: Column) -> Column:
    """The trimmed cell; null when blank or a word for a missing value."""
    cell = blank_to_null(tx.cell(raw))
    return F.when(~F.lower(cell).isin(tx.MISSING_DATES), cell)


def attempt_date(raw: Column) -> Attempt:
    value = tx.parse_date(raw)
    return Attempt(value, F.when(_given(raw).isNotNull() & value.isNull(), F.lit("no known date format, or no such day")))


def attempt_number(raw: Column, kind: str = "double") -> Attempt:
    value = _given(raw).try_cast(kind)
    return Attempt(value, F.when(_given(raw).isNotNull() & value.isNull(), F.lit(f"not a number of type {kind}")))


def attempt_list(raw: Column) -> Attempt:
    """Items between commas, semicolons or bars; a cell with separators only is an error."""
    value = tx.list_cell(tx.cell(raw))
    return Attempt(value, F.when(blank_to_null(tx.cell(raw)).isNotNull() & value.isNull(), F.lit("separators without an item")))


def attempt_map(raw: Column) -> Attempt:
    """A JSON object as text values by name."""
    cell = blank_to_null(tx.cell(raw))
    value = F.from_json(cell, "map<string,string>", {"mode": "PERMISSIVE"})
    # a broken object may give some of its entries before it breaks; only a whole one counts
    sound = F.try_parse_json(cell).isNotNull() & cell.startswith("{")
    return Attempt(F.when(sound, value), F.when(cell.isNotNull() & ~F.coalesce(sound, F.lit(False)), F.lit("not a JSON object")))


def attempt_text(raw: Column) -> Attempt:
    """Text that came through decoding whole; replacement and null characters show that it didn't."""
    value = blank_to_null(tx.cell(raw))
    return Attempt(value, F.when(value.contains("�") | value.contains("\x00"), F.lit("undecodable characters")))


def error(stage: str, field: str, value: Column, message: Column) -> Column:
    """One entry of the error channel; null where the message is."""
    return F.when(message.isNotNull(), F.struct(F.lit(stage).alias("stage"), F.lit(field).alias("field"), value.cast("string").alias("value"),
                                                F.substring(message, 1, MESSAGE_LENGTH).alias("message")))


def errors_of(*entries: Column) -> Column:
    return F.array_compact(F.array(*entries)) if entries else F.array().cast(ERRORS)


def normalise_checked(mapped: DataFrame, *keep: str, extra: Mapping[str, Callable[[Column], Attempt]] | None = None) -> DataFrame:
    """``normalise`` with an error channel: ``errors`` names each cell that was given and could not be read.

    ``extra`` converts further columns (kept under their names) by an attempt of one's own choice.
    """
    cells = {"report_text": ("in_text", attempt_text), "date": ("in_date", attempt_date),
             "barrier_failure": ("in_barrier_failure", attempt_list), "equipment": ("in_equipment", attempt_list)}
    entries = [error("normalise", field, F.col(raw), attempt(F.col(raw)).error) for field, (raw, attempt) in cells.items()]
    more = {name: attempt(F.col(name)) for name, attempt in (extra or {}).items()}
    entries += [error("normalise", name, F.col(name), a.error) for name, a in more.items()]
    checked = mapped.withColumn("errors", errors_of(*entries))
    return normalise(checked.withColumns({name: a.value for name, a in more.items()}), *keep, *more, "errors")


def isolated(step: Callable[[pd.Series], Iterable], kind: T.DataType | str):
    """A Python step over a text column that may raise: ``struct<value, error>`` for each row.

    A batch is tried whole first.  If it raises, its rows are tried one by one, so that only those that raise carry an
    error (``Type: message``) and the others keep their value.
    """
    value_type = T.DataType.fromDDL(kind) if isinstance(kind, str) else kind
    limit = MESSAGE_LENGTH

    @F.pandas_udf(T.StructType([T.StructField("value", value_type), T.StructField("error", T.StringType())]))
    def run(column: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"value": list(step(column)), "error": [None] * len(column)}, dtype=object)
        except Exception:
            rows = []
            for k in range(len(column)):
                try:
                    rows.append((list(step(column.iloc[k:k + 1]))[0], None))
                except Exception as exc:
                    rows.append((None, f"{type(exc).__name__}: {exc}"[:limit]))
            return pd.DataFrame(rows, columns=["value", "error"], dtype=object)

    return run


def is_failed(fatal: Collection[str] | None) -> Column:
    """Whether the row has an error in one of the fatal fields; None means that every error is fatal."""
    return F.size("errors") > 0 if fatal is None else F.exists("errors", lambda e: e["field"].isin(list(fatal)))


def failure_text(fatal: Collection[str] | None) -> Column:
    """The first fatal error in words."""
    own = F.col("errors") if fatal is None else F.filter("errors", lambda e: e["field"].isin(list(fatal)))
    first = F.get(own, F.lit(0))
    return F.when(first.isNotNull(), F.substring(F.concat(first["stage"], F.lit(": "), first["field"], F.lit(": "), first["message"]), 1, MESSAGE_LENGTH))


def settle(rows: DataFrame, analysis_columns: Collection[str], fatal: Collection[str] | None = None) -> DataFrame:
    """A row with a fatal error keeps its report, status ``failed`` and the reason, and carries no analysis; an error that the
    analysis itself named stays."""
    failed = is_failed(fatal)
    cleared = {c: F.when(~failed, F.col(c)) for c in analysis_columns if c in rows.columns}
    return rows.withColumns({**cleared, "processing_status": F.when(failed, F.lit("failed")).otherwise(F.col("processing_status")),
                             "error": F.coalesce(F.when(failed, failure_text(fatal)), F.col("error"))})


def last_failures(rows: DataFrame, limit: int = 20) -> DataFrame:
    """The newest failing rows of an import with their reasons."""
    failing = rows.filter((F.col("import_state") == "new") & (F.col("processing_status") == "failed"))
    return failing.orderBy(F.desc("row_no")).limit(limit).select("row_no", "error")


def failures_by_kind(rows: DataFrame) -> DataFrame:
    """``(stage, field, message, rows)`` over all entries of the error channel."""
    return rows.select(F.explode("errors").alias("e")).groupBy("e.stage", "e.field", "e.message").agg(F.count(F.lit(1)).alias("rows"))
