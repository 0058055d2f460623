"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlake.functions.columns import blank_to_null, let, word_list

# Cell contents that mean "missing" in the two source families.
MISSING_SHORT = ["nan", "none", "na", "n/a", "-", "--", "null"]
MISSING_LONG = ["", "?", "n/a", "na", "none", "null", "nan", "no value found",
                "not reported", "not listed", "not marked"]
# Dates that mean "missing", month names and acronyms.
MISSING_DATES = ["na", "n/a", "-", "--", "null", "none", "nan"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LONG_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august",
               "september", "october", "november", "december"]
ACRONYMS = [("loto", "lockout tagout"), ("ptw", "permit to work"), ("ppe", "personal protective equipment"),
            ("h2s", "hydrogen sulfide"), ("jsa", "job safety analysis"), ("jha", "job hazard analysis"),
            ("ba", "breathing apparatus")]
# Words ignored when reports are compared.
SIMILARITY_STOP = """the and was were with from that this have had has been not but for are his her one two
report reported said while during when then they their there him them who which will would should could also
after before into onto than very just about every some any all more most other such only she its out being
did does doing am""".split()
SIMILARITY_WORD = r"[a-z0-9']+|[\x{900}-\x{9ff}]+"

# White space as str.split() sees it (the engine's own \\s is ASCII only), and the characters trimmed from cells.
SPACE = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
BLANKS = " \t\n\r\x0b\x0c"
# A run that isn't one blank already; most are, and need no replacement. Printable ASCII is settled by its first test.
_UNEVEN = rf"[^!-~](?:(?<= ){SPACE}++|(?<=[{SPACE}&&[^ ]]){SPACE}*+)"
ZERO_WIDTH = "\u200b"
# Characters of a fingerprint, the Latin ones singly: the engine looks those up in a table, but tries ranges one by one.
_KEPT = r"abcdefghijklmnopqrstuvwxyz0123456789\x{900}-\x{9ff}"
_DROPPED = f" [^{_KEPT}]++|[^ {_KEPT}][^{_KEPT}]*+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    """Whitespace runs become one blank; ends trimmed."""
    return F.btrim(F.regexp_replace(text, _UNEVEN, " "))


def analysis_text(text: Column) -> Column:
    """Text the analysis reads, whole: collapsed, without zero-width blanks; null when nothing is left."""
    return blank_to_null(F.btrim(F.replace(collapse(text), F.lit(ZERO_WIDTH), F.lit(""))))


def cell(value: Column) -> Column:
    """Null becomes empty, everything else trimmed text."""
    return F.coalesce(strip(value.cast("string")), F.lit(""))


def cell_or_default(value: Column, default: str = "") -> Column:
    text = strip(value.cast("string"))
    keep = text.isNotNull() & (text != "") & ~F.lower(text).isin(MISSING_SHORT)
    return F.when(keep, text).otherwise(F.lit(default))


def clean_cell(value: Column) -> Column:
    text = strip(value.cast("string"))
    keep = text.isNotNull() & ~F.lower(text).isin(MISSING_LONG)
    return F.when(keep, F.regexp_replace(text, SPACE + "+", " ")).otherwise(F.lit(""))


def iso_prefix(value: Column) -> Column:
    return F.regexp_extract(clean_cell(value), r"^(\d{4}-\d{2}-\d{2})", 1)


def fingerprint(text: Column) -> Column:
    """Lowercase letters, digits and Indic script; all else one blank."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _DROPPED, " "))


def description_hash(text: Column) -> Column:
    return F.sha2(F.lower(collapse(text)), 256)


def is_noise(text: Column) -> Column:
    """Too short, or no letter at all."""
    body = strip(F.coalesce(text, F.lit("")))
    return (F.length(body) < 15) | ~body.rlike(r"[A-Za-z\x{900}-\x{9ff}]")


def model_text(text: Column) -> Column:
    """Lowercased, collapsed, acronyms spelled out."""
    def spelled(out: Column) -> Column:
        for short, full in ACRONYMS:
            out = F.regexp_replace(out, rf"\b{short}\b", full)
        return out

    starts = "".join(sorted({short[0] for short, _ in ACRONYMS}))  # one lookup settles most characters
    some = rf"(?=[{starts}])\b(?:" + "|".join(short for short, _ in ACRONYMS) + r")\b"
    return let(collapse(F.lower(F.coalesce(text, F.lit("")))), lambda out: F.when(out.rlike(some), spelled(out)).otherwise(out))


def binary_label(value: Column) -> Column:
    word = F.lower(strip(value.cast("string")))
    return F.when(word.isin("yes", "true", "1"), F.lit(1)).when(word.isin("no", "false", "0"), F.lit(0))


def list_cell(value: Column) -> Column:
    """Split on comma, semicolon or bar; null when nothing is left."""
    parts = F.filter(F.transform(F.split(value, r"[,;|]"), lambda x: strip(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def words(text: Column) -> Column:
    """All word tokens in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(SIMILARITY_WORD), F.lit(0))


def similarity_tokens(text: Column) -> Column:
    """Distinct tokens of three or more characters without stop words."""
    kept = F.filter(words(text), lambda t: F.length(t) >= 3)
    return F.array_except(kept, word_list(SIMILARITY_STOP))


def _month_number(name: Column) -> Column:
    low = F.lower(name)
    short = F.array_position(word_list(MONTHS), low)
    full = F.array_position(word_list(LONG_MONTHS), low)
    return F.coalesce(F.nullif(short, F.lit(0)), F.nullif(full, F.lit(0)))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def parse_date(value: Column) -> Column:
    """First date the accepted formats give; day-first is tried before month-first.

    Formats are recognised by shape, so no parser runs into errors on foreign shapes.
    """
    whole = strip(value.cast("string"))
    head = F.btrim(F.regexp_extract(whole, r"^[^T ]*", 0))
    part = lambda text, pattern, n: F.regexp_extract(text, pattern, n)
    ymd = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$"
    dmy = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$"
    compact = r"^(\d{4})(\d{2})(\d{2})$"
    name_mid = r"^(\d{1,2})(?:\s+|-)([A-Za-z]+)(?:,?\s+|-)(\d{4})$"
    name_first = r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
    any_ymd = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
    tries = [
        F.when(head.rlike(ymd), _date(part(head, ymd, 1), part(head, ymd, 3), part(head, ymd, 4))),
        F.when(head.rlike(dmy), F.coalesce(
            _date(part(head, dmy, 4), part(head, dmy, 3), part(head, dmy, 1)),
            F.when(part(head, dmy, 2) != ".", _date(part(head, dmy, 4), part(head, dmy, 1), part(head, dmy, 3))))),
        F.when(head.rlike(compact), _date(part(head, compact, 1), part(head, compact, 2), part(head, compact, 3))),
        F.when(whole.rlike(name_mid), _date(part(whole, name_mid, 3), _month_number(part(whole, name_mid, 2)),
                                            part(whole, name_mid, 1))),
        F.when(whole.rlike(name_first), _date(part(whole, name_first, 3), _month_number(part(whole, name_first, 1)),
                                              part(whole, name_first, 2))),
        F.when(whole.rlike(any_ymd), _date(part(whole, any_ymd, 1), part(whole, any_ymd, 2), part(whole, any_ymd, 3))),
    ]
    known = whole.isNotNull() & (whole != "") & ~F.lower(whole).isin(MISSING_DATES)
    return F.when(known, F.coalesce(*tries))
