"""Small helpers to write per-row logic as native column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    A plain alias may be inlined by the optimizer into a lambda, where it would be
    computed once per array element; a lambda variable is computed exactly once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fence(value: Column) -> Column:
    """The same value, marked so that filters above it stay above it.

    A filter on a costly derived column would otherwise be rewritten in terms of the raw text,
    and the whole derivation would be evaluated again, often many times, inside the filter.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def constant(value: Any, schema: str) -> Column:
    """A nested literal; folded to one constant by the optimizer."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def any_of(words: Sequence[str]) -> str:
    """Regular expression that finds any of the literal words."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def one_of(words: Sequence[str]) -> str:
    """As ``any_of``, but shared beginnings are tested once, and the longest word is tried first."""
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[:1], []).append(word[1:])
    ends = by_first.pop("", None) is not None
    if not by_first:
        return ""
    steps = [re.escape(c) + one_of(rests) for c, rests in sorted(by_first.items())]
    return steps[0] if len(steps) == 1 and not ends else "(?:" + "|".join(steps) + ")" + ("?" if ends else "")


def word_list(words: Sequence[str]) -> Column:
    return constant(list(words), "array<string>")


def has_any(text: Column, words: Sequence[str]) -> Column:
    """True when any literal word is a substring; stops at the first hit."""
    return F.exists(word_list(words), lambda w: text.contains(w))


def _label_table(table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    return constant([{"label": label, "words": list(words)} for label, words in table],
                    "array<struct<label:string,words:array<string>>>")


def first_label(text: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Label of the first entry with any hit, else null; later entries are not tested."""
    return F.aggregate(_label_table(table), F.lit(None).cast("string"), lambda found, entry: F.coalesce(
        found, F.when(F.exists(entry["words"], lambda w: text.contains(w)), entry["label"])))


def all_labels(text: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Labels of all entries with a hit, in table order."""
    return F.transform(F.filter(_label_table(table), lambda e: F.exists(e["words"], lambda w: text.contains(w))),
                       lambda e: e["label"])


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))
