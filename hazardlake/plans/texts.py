"""Queries on report texts: cleaning, duplicates, phrase matching, scoring, extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlake.functions import spans
from hazardlake.functions import text as tx
from hazardlake.functions.columns import any_of, constant, fence, let
from hazardlake.lexicon import DEFAULT as LEX
from hazardlake.operators import analysis as na
from hazardlake.operators import dedupe as dd
from hazardlake.operators import normalise as nm
from hazardlake.operators.conditions import BREACHED, term_positions
from hazardlake.plans.catalog import query, views
from hazardlake.sources.tables import Tables
from hazardlake.vocab import english, foreign
from hazardlake.vocab.headers import RULE_FIELD_HINTS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_COLLAPSED = "trim(regexp_replace({0}, " + q(tx.SPACE + "+") + ", ' ', 'g'))"


def collapsed(column: str) -> str:
    return _COLLAPSED.replace("{0}", column)


_Z = "replace(" + collapsed("report_text") + ", chr(8203), '')"
TEXTS = views("texts") + f""",
clean AS (SELECT doc_id, lang, source, report_text, nullif(trim({_Z}), '') AS clean_text FROM texts),
low AS (SELECT *, lower(clean_text) AS low_text FROM clean)
"""
FP_SQL = r"trim(regexp_replace(lower({0}), '[^a-z0-9\x{{900}}-\x{{9ff}}]+', ' ', 'g'))"


def clean_texts(t: Tables, rows=None):
    return (t.texts if rows is None else rows).withColumn("clean_text", tx.analysis_text(F.col("report_text"))).withColumn("low_text", fence(F.lower("clean_text")))


# ---- B: cleaning ------------------------------------------------------------

@query("b6_site_detail", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus WHEN o_orderkey % 4 = 1 THEN o_orderstatus
  ELSE o_orderstatus || ' · ' || o_orderpriority END AS site FROM orders""")
def _(t: Tables):
    detail = F.when(F.col("o_orderkey") % 4 == 0, "n/a").when(F.col("o_orderkey") % 4 == 1, "  ").otherwise(F.col("o_orderpriority"))
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), nm.merged_site(F.col("o_orderstatus"), detail).alias("site"))


@query("b7_cell_text", f"SELECT conv_id, turn, coalesce(trim(text, {BLANKS_SQL}), '') AS cell FROM conversations")
def _(t: Tables):
    return t.raw("conversations").select("conv_id", "turn", tx.cell(F.col("text")).alias("cell"))


@query("b8_missing_tokens", """
WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN ' - ' WHEN 2 THEN 'Not reported' WHEN 3 THEN '?' WHEN 4 THEN ' a  b ' ELSE o_orderpriority END AS v FROM orders)
SELECT id, CASE WHEN lower(trim(v)) IN ('nan', 'none', 'na', 'n/a', '-', '--', 'null', '') THEN '' ELSE trim(v) END AS short_clean,
  CASE WHEN lower(trim(v)) IN ('', '?', 'n/a', 'na', 'none', 'null', 'nan', 'no value found', 'not reported', 'not listed', 'not marked') THEN '' ELSE regexp_replace(trim(v), '\\s+', ' ', 'g') END AS long_clean FROM r""")
def _(t: Tables):
    k = F.col("o_orderkey") % 6
    v = F.when(k == 0, "N/A").when(k == 1, " - ").when(k == 2, "Not reported").when(k == 3, "?").when(k == 4, " a  b ").otherwise(F.col("o_orderpriority"))
    rows = t.raw("orders").select(F.col("o_orderkey").alias("id"), v.alias("v"))
    return rows.select("id", tx.cell_or_default(F.col("v")).alias("short_clean"), tx.clean_cell(F.col("v")).alias("long_clean"))


_SHAPES = ["yyyy-MM-dd", "dd/MM/yyyy", "d-MMM-yyyy", "dd.MM.yyyy", "MMMM d, yyyy", "yyyyMMdd", "yyyy/MM/dd", "d MMM yyyy"]


@query("b9_parse_date", """
SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 8 THEN NULL WHEN 9 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def _(t: Tables):
    k, day = F.col("o_orderkey") % 10, F.col("o_orderdate")
    shown = F.when(k == 8, "n/a").when(k == 9, F.concat(F.lit("seen on "), F.date_format(day, "yyyy.M.d"), F.lit(" at noon")))
    for n, shape in enumerate(_SHAPES):
        shown = shown.when(k == n, F.date_format(day, shape))
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), tx.parse_date(shown).alias("parsed"))


@query("b10_iso_prefix", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS iso FROM events")
def _(t: Tables):
    return t.raw("events").select("event_id", tx.iso_prefix(F.col("ts").cast("string")).alias("iso"))


@query("b11_list_cell", """
SELECT doc_id, nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,;|]'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda x: x <> ''), '|'), '') AS items FROM documents""")
def _(t: Tables):
    return t.raw("documents").select("doc_id", F.when(tx.list_cell(F.col("text")).isNotNull(), F.concat_ws("|", tx.list_cell(F.col("text")))).alias("items"))


@query("b12_normalise_row", f"""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN source || '.' ELSE text END AS title, text, source, lang FROM documents)
SELECT doc_id, trim(concat_ws(' ', CASE WHEN trim(coalesce(title, ''), {BLANKS_SQL}) NOT IN ('', trim(text, {BLANKS_SQL})) THEN rtrim(trim(title, {BLANKS_SQL}), '.') || '.' END, nullif(trim(text, {BLANKS_SQL}), '')), {BLANKS_SQL}) AS report_text,
  source AS site, lang AS report_type FROM r""")
def _(t: Tables):
    k = F.col("doc_id") % 3
    rows = t.raw("documents").withColumn("title", F.when(k == 1, F.concat("source", F.lit("."))).when(k == 2, F.col("text")))
    nothing = F.lit(None).cast("string")
    given = {"title": F.col("title"), "text": F.col("text"), "site": F.col("source"), "report_type": F.col("lang")}
    from hazardlake.vocab.headers import CANONICAL_FIELDS
    mapped = rows.select("doc_id", *[given.get(f, nothing).alias(f"in_{f}") for f in CANONICAL_FIELDS], nothing.alias("in_location_detail"))
    return nm.normalise(mapped, "doc_id").select("doc_id", "report_text", "site", "report_type")


@query("b13_fingerprint", "SELECT doc_id, md5(" + FP_SQL.format("text") + ") AS fingerprint FROM documents")
def _(t: Tables):
    return t.raw("documents").select("doc_id", F.md5(tx.fingerprint(F.col("text"))).alias("fingerprint"))


@query("b14_description_hash", "SELECT doc_id, sha256(lower(" + collapsed("text") + ")) AS description_hash FROM documents")
def _(t: Tables):
    return t.raw("documents").select("doc_id", tx.description_hash(F.col("text")).alias("description_hash"))


_GUARD_SQL = TEXTS + """,
f AS (SELECT doc_id, nullif(""" + FP_SQL.format("report_text") + """, '') AS fp, doc_id % 5 = 0 AS stored FROM clean),
s AS (SELECT fp, min(doc_id) AS sid FROM f WHERE stored AND fp IS NOT NULL GROUP BY 1),
b AS (SELECT *, min(doc_id) OVER (PARTITION BY fp) AS fid FROM f WHERE NOT stored),
g AS (SELECT b.doc_id AS row_no, CASE WHEN fp IS NULL THEN 'empty' WHEN sid IS NOT NULL THEN 'duplicate' WHEN fid = b.doc_id THEN 'new' ELSE 'duplicate' END AS import_state,
  CASE WHEN fp IS NULL THEN NULL WHEN sid IS NOT NULL THEN 'RPT-' || lpad(CAST(sid AS VARCHAR), 4, '0') WHEN fid <> b.doc_id THEN CAST(fid AS VARCHAR) END AS duplicate_of
  FROM b LEFT JOIN s USING (fp))
"""


def _guarded(t: Tables):
    """A fifth of the texts plays the stored reports, the rest the batch."""
    stored = t.texts.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.format_string("RPT-%04d", "doc_id").alias("report_id"), "report_text")
    batch = t.texts.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("row_no"), "report_text")
    return dd.import_guard(batch, stored)


@query("b15_import_guard", _GUARD_SQL + "SELECT * FROM g")
def _(t: Tables):
    return _guarded(t).select("row_no", "import_state", "duplicate_of")


@query("b16_empty_rows", TEXTS + "SELECT count(*) AS total, count_if(clean_text IS NULL) AS skipped_empty FROM clean")
def _(t: Tables):
    return t.texts.agg(F.count(F.lit(1)).alias("total"), F.count_if(tx.strip(F.col("report_text")) == "").alias("skipped_empty"))


@query("b17_sequential_ids", """
SELECT event_id, 'RPT-' || lpad(CAST((SELECT count(*) FROM orders) + row_number() OVER (ORDER BY event_id) AS VARCHAR), CAST(greatest(4, length(CAST((SELECT count(*) FROM orders) + row_number() OVER (ORDER BY event_id) AS VARCHAR))) AS INTEGER), '0') AS report_id FROM events""")
def _(t: Tables):
    return nm.assign_report_ids(t.raw("events").select("event_id"), t.reports.select("id", "report_id"), "event_id").select("event_id", "report_id")


def _overridden(t: Tables):
    rows = t.reports.join(t.analyses, F.col("id") == F.col("report_pk"))
    k = F.col("id")
    files = rows.select(
        "id", "hazard", "life_saving_rule", "barrier_failure", F.col("analysis_activity").alias("activity_ai"),
        F.when(k % 3 == 0, F.col("activity")).alias("file_activity"), F.when(k % 5 == 0, F.lit("Hazard P")).alias("file_hazard"),
        F.when(k % 4 == 0, F.array("site")).when(k % 4 == 1, F.col("barrier_failure")).alias("file_barriers"),
        F.when(k % 6 == 0, F.lit("BUILDING")).when(k % 6 == 1, F.lit("  ")).alias("file_rule"))
    return nm.apply_overrides(files, [("activity", "file_activity", "activity_ai"), ("hazard", "file_hazard", "hazard"),
                                      ("barrier_failure", "file_barriers", "barrier_failure"), ("rule", "file_rule", "life_saving_rule")])


@query("b18_file_overrides", views("reports", "analyses") + """,
r AS (SELECT id, hazard, life_saving_rule, barrier_failure, analysis_activity AS aa, CASE WHEN id % 3 = 0 THEN activity END AS fa, CASE WHEN id % 5 = 0 THEN 'Hazard P' END AS fh,
  CASE WHEN id % 4 = 0 THEN [site] WHEN id % 4 = 1 THEN barrier_failure END AS fb, CASE WHEN id % 6 = 0 THEN 'BUILDING' END AS fr FROM reports JOIN analyses ON id = report_pk)
SELECT id, coalesce(fa, aa) AS activity, coalesce(fh, hazard) AS hazard, coalesce(fr, life_saving_rule) AS life_saving_rule,
  concat_ws(',', CASE WHEN fa IS NOT NULL THEN 'activity:' || CASE WHEN aa IS NOT NULL AND aa <> fa THEN 'Y' ELSE 'N' END END,
    CASE WHEN fh IS NOT NULL THEN 'hazard:' || CASE WHEN hazard IS NOT NULL AND hazard <> fh THEN 'Y' ELSE 'N' END END,
    CASE WHEN fb IS NOT NULL THEN 'barrier_failure:' || CASE WHEN barrier_failure IS NOT NULL AND barrier_failure IS DISTINCT FROM fb THEN 'Y' ELSE 'N' END END,
    CASE WHEN fr IS NOT NULL THEN 'rule:' || CASE WHEN life_saving_rule IS NOT NULL AND life_saving_rule <> fr THEN 'Y' ELSE 'N' END END) AS modified FROM r""")
def _(t: Tables):
    marks = F.transform("modified_fields", lambda m: F.concat(m["canonical"], F.lit(":"), F.when(m["changed"], "Y").otherwise("N")))
    return _overridden(t).select("id", F.col("activity_ai").alias("activity"), "hazard", "life_saving_rule", F.concat_ws(",", marks).alias("modified"))


@query("b19_estimated_rule", "WITH r AS (SELECT doc_id, lower(coalesce(source, '') || ' ' || text) AS h FROM documents UNION ALL SELECT 1000000 + p_partkey, lower(p_name || ' ' || p_type) FROM part) SELECT doc_id, CASE "
       + " ".join(f"WHEN {sql_any('h', words)} THEN {q(rule)}" for rule, words in RULE_FIELD_HINTS) + " END AS rule FROM r")
def _(t: Tables):
    docs = t.raw("documents").select("doc_id", F.col("source").alias("h"), F.col("text").alias("a"))
    parts = t.raw("part").select((F.lit(1000000) + F.col("p_partkey")).alias("doc_id"), F.col("p_name").alias("h"), F.col("p_type").alias("a"))
    return docs.unionByName(parts).select("doc_id", nm.estimate_rule(F.col("h"), F.col("a")).alias("rule"))


@query("b20_row_isolation", TEXTS + """
SELECT doc_id, CASE WHEN clean_text IS NULL THEN 'failed' ELSE 'analyzed' END AS processing_status,
  CASE WHEN clean_text IS NULL THEN 'Report text is required' END AS error FROM clean""")
def _(t: Tables):
    return na.analyze(t.texts).select("doc_id", "processing_status", "error")


@query("b21_import_counters", _GUARD_SQL + """
SELECT count(*) AS processed, count_if(import_state = 'new') AS imported, count_if(import_state = 'empty') AS skipped_empty, 0 AS failed,
  count_if(import_state = 'duplicate') AS duplicates, count_if(import_state = 'new' AND row_no % 3 = 0) AS sif_potential,
  count_if(import_state = 'new' AND row_no % 7 = 0) AS high_priority, min(CASE WHEN import_state = 'new' THEN row_no END) AS first_row FROM g""")
def _(t: Tables):
    rows = _guarded(t).withColumns({"processing_status": F.lit("analyzed"), "sif_potential": F.col("row_no") % 3 == 0,
                                    "priority": F.when(F.col("row_no") % 7 == 0, "HIGH").otherwise("LOW")})
    return nm.import_counters(rows)


@query("b22_source_label", views("reports") + """
SELECT id, 'upload:' || source_id AS label, CASE WHEN starts_with(source, 'upload:') THEN substr(source, 8) ELSE source END AS shown FROM reports""")
def _(t: Tables):
    from hazardlake.operators.registry import display_source
    return t.reports.select("id", nm.source_label(F.col("source_id")).alias("label"), display_source(F.col("source")).alias("shown"))


@query("b23_noise", f"""SELECT conv_id, turn, length(trim(text, {BLANKS_SQL})) < 15 OR NOT regexp_matches(trim(text, {BLANKS_SQL}), '[A-Za-z\\x{{900}}-\\x{{9ff}}]') AS is_noise FROM conversations""")
def _(t: Tables):
    return t.raw("conversations").select("conv_id", "turn", tx.is_noise(F.col("text")).alias("is_noise"))


@query("b24_dedupe_split", TEXTS + ", f AS (SELECT doc_id, nullif(" + FP_SQL.format("report_text") + """, '') AS fp FROM clean)
SELECT doc_id, fp IS NULL OR doc_id <> min(doc_id) OVER (PARTITION BY fp) AS is_duplicate FROM f""")
def _(t: Tables):
    return dd.split_duplicates(t.texts, "report_text", F.col("doc_id"), "doc_id").select("doc_id", "is_duplicate")


_MODEL_SQL = collapsed("lower(report_text)")
for _short, _full in tx.ACRONYMS:
    _MODEL_SQL = f"regexp_replace({_MODEL_SQL}, '\\b{_short}\\b', '{_full}', 'g')"


@query("b25_model_text", TEXTS + f"SELECT doc_id, md5({_MODEL_SQL}) AS model_text FROM texts")
def _(t: Tables):
    return t.texts.select("doc_id", F.md5(tx.model_text(F.col("report_text"))).alias("model_text"))


@query("b26_label_coercion", f"""SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS target FROM labels JOIN documents USING (doc_id) WHERE length({collapsed('lower(text)')}) >= 8 AND doc_id % 4 <> 3""")
def _(t: Tables):
    k = F.col("doc_id") % 4
    word = F.when(k == 0, F.when(F.col("quality") == 1, " Yes ").otherwise("NO")).when(k == 1, F.when(F.col("quality") == 1, "true").otherwise("False")).when(
        k == 2, F.col("quality").cast("string")).otherwise("unsure")
    rows = t.raw("labels").join(t.raw("documents"), "doc_id")
    return rows.select("doc_id", tx.binary_label(word).alias("target"), tx.model_text(F.col("text")).alias("m")).filter(
        F.col("target").isNotNull() & (F.length("m") >= 8)).select("doc_id", "target")


@query("b27_severity_label", """
SELECT l_orderkey, l_linenumber, contains(lower(CASE l_returnflag WHEN 'R' THEN 'FATALITY' WHEN 'A' THEN 'Days away from work only' ELSE 'NO DAYS AWAY' END), 'fatality')
  OR contains(lower(CASE l_returnflag WHEN 'R' THEN 'FATALITY' WHEN 'A' THEN 'Days away from work only' ELSE 'NO DAYS AWAY' END), 'away from work') OR l_linenumber - 1 <> 0 AS expect_sif FROM lineitem""")
def _(t: Tables):
    from hazardlake.operators.metrics import severity_label
    flag = F.col("l_returnflag")
    degree = F.when(flag == "R", "FATALITY").when(flag == "A", "Days away from work only").otherwise("NO DAYS AWAY")
    days = F.when(F.col("l_linenumber") == 1, "0").otherwise((F.col("l_linenumber") - 1).cast("string"))
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", severity_label(degree, days).alias("expect_sif"))


# ---- C: phrase matching ------------------------------------------------------

_LEX_ROWS = ", ".join(f"({i['ord']}, {i['r']}, {q(i['p'])}, {'true' if i['neg'] else 'false'}, {'true' if i['one'] else 'false'})" for i in LEX.indicators)
_FOREIGN_ROWS = ", ".join(f"({f['ord']}, {f['r']}, {q(f['p'])})" for f in LEX.foreign_phrases)
_RULE_ROWS = ", ".join(f"({n}, {q(name)})" for n, name in enumerate(LEX.rule_names))
_NEG = q(any_of(english.NEGATION_TOKENS).replace("\\ ", " ").replace("\\-", "-"))
_NUL = q(any_of(english.NULLIFY_PHRASES).replace("\\ ", " ").replace("\\-", "-"))
OCCURRENCES = TEXTS + f""",
lex(ord, r, p, neg, one) AS (VALUES {_LEX_ROWS}),
rules(r, rule) AS (VALUES {_RULE_ROWS}),
cand AS (SELECT doc_id, ord, r, p, neg, one, string_split(low_text, p) AS pieces FROM low JOIN lex ON contains(low_text, p)),
spot AS (SELECT doc_id, ord, r, p, neg, one, CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * length(p) AS BIGINT) AS pos
  FROM cand, unnest(range(1, len(pieces))) u(i)),
occ AS (SELECT a.*, substr(low_text, greatest(pos - 60, 0) + 1, least(pos, 60)) AS pre, substr(low_text, pos + length(p) + 1, 60) AS post FROM spot a JOIN low USING (doc_id)),
ok AS (SELECT doc_id, ord, r, p, neg,
    regexp_matches(regexp_replace(pre, {_NUL}, '', 'g'), {_NEG}) OR regexp_matches(regexp_replace(post, {_NUL}, '', 'g'), {_NEG}) AS negated
  FROM occ WHERE NOT one OR (NOT regexp_matches(pre, '[a-z0-9_\\-''\\x{{2d}}]$') AND NOT (p = 'guard' AND starts_with(post, 'rail')))),
hit AS (SELECT * FROM ok WHERE negated OR NOT neg)
"""


@query("c1_normalised_text", TEXTS + "SELECT doc_id, md5(clean_text) AS clean_text FROM clean")
def _(t: Tables):
    return t.texts.select("doc_id", F.md5(tx.analysis_text(F.col("report_text"))).alias("clean_text"))


@query("c2_phrase_scan", OCCURRENCES + "SELECT doc_id, ord, p AS phrase, len(pieces) - 1 AS occurrences FROM cand")
def _(t: Tables):
    low = F.col("low_text")
    found = F.transform(spans.phrases_in(low, LEX.indicator_column()), lambda e: F.struct(
        e["ord"], e["p"].alias("phrase"), F.size(spans.positions(low, e["p"], e["n"])).alias("occurrences")))
    return clean_texts(t).select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


@query("c3_clean_occurrences", OCCURRENCES + "SELECT doc_id, ord, count(*) AS clean_occurrences FROM ok GROUP BY 1, 2")
def _(t: Tables):
    low = F.col("low_text")
    found = F.transform(spans.phrases_in(low, LEX.indicator_column()), lambda e: F.struct(
        e["ord"], F.size(spans.occurrences(low, e, spans.WORD)).alias("clean_occurrences")))
    return clean_texts(t).select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*").filter("clean_occurrences > 0")


def _candidates(t: Tables):
    return clean_texts(t).withColumn("candidates", spans.english_candidates(F.col("clean_text"), F.col("low_text"), LEX))


@query("c4_negation_window", OCCURRENCES + "SELECT doc_id, r, ord, count(*) AS kept, count_if(negated) AS negated FROM hit GROUP BY 1, 2, 3")
def _(t: Tables):
    rows = _candidates(t).select("doc_id", F.explode("candidates").alias("c"))
    return rows.groupBy("doc_id", F.col("c.r").alias("r"), F.col("c.ord").alias("ord")).agg(
        F.count(F.lit(1)).alias("kept"), F.count_if("c.negated").alias("negated"))


# Spans said once more in SQL: nullifying phrases are masked by as many tildes, so positions stay; the last negation before
# a phrase and the first behind it then widen the span; the greedy choice is a fold over the ordered spans.
def _masked(column: str) -> str:
    for phrase in english.NULLIFY_PHRASES:
        column = f"replace({column}, {q(phrase)}, {q('~' * len(phrase))})"
    return column


def _outermost(column: str, last: bool) -> str:
    """Start of the last negation in a text, or end of the first, from zero; null without one."""
    if last:
        spots = [f"CASE WHEN contains({column}, {q(t)}) THEN length({column}) - strpos(reverse({column}), {q(t[::-1])}) + 1 - {len(t)} END" for t in english.NEGATION_TOKENS]
        return "greatest(" + ", ".join(spots) + ")"
    return "least(" + ", ".join(f"CASE WHEN contains({column}, {q(t)}) THEN strpos({column}, {q(t)}) - 1 + {len(t)} END" for t in english.NEGATION_TOKENS) + ")"


def _fold(spans_of: str, first: str) -> str:
    """Spans taken in the order ``first``, unless they overlap one of the same rule taken before."""
    return f"""(SELECT doc_id, unnest(list_reduce(list_transform(list({{'r': r, 'ord': ord, 's': s, 'e': e, 'phrase': phrase, 'negated': negated}} ORDER BY {first}), lambda x: [x]),
  lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.r = x[1].r AND k.s < x[1].e AND x[1].s < k.e)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS m FROM {spans_of} GROUP BY doc_id)"""


_EDGE = r"[^ \t\n.,;:!?()\[\]{}''\"|«»“”‘’—–]*"
_GLUED = r"'[a-z0-9_\-''\x{2d}]$'"
_CONSEQUENCES = ", ".join(f"({n}, {q(rule['consequence'])})" for n, rule in enumerate(LEX.rules))
SPANS = OCCURRENCES + f""", seen AS (SELECT doc_id, ord, r, pos, length(p) AS n, neg, greatest(pos - 60, 0) AS lo, pre, post,
    regexp_matches(regexp_replace(pre, {_NUL}, '', 'g'), {_NEG}) OR regexp_matches(regexp_replace(post, {_NUL}, '', 'g'), {_NEG}) AS negated
  FROM occ WHERE NOT one OR (NOT regexp_matches(pre, {_GLUED}) AND NOT (p = 'guard' AND starts_with(post, 'rail')))),
around AS (SELECT *, {_masked("pre")} AS mpre, {_masked("post")} AS mpost FROM seen WHERE negated OR NOT neg),
bounds AS (SELECT doc_id, r, ord, negated, clean_text, least(pos - length(regexp_extract(substr(low_text, 1, pos), '[a-z0-9_''-]*$')), lo + {_outermost("mpre", True)}) AS s,
  greatest(pos + n + length(regexp_extract(substr(low_text, pos + n + 1), '^[a-z0-9_''-]*')), pos + n + {_outermost("mpost", False)}) AS e FROM around JOIN low USING (doc_id)),
espan AS (SELECT doc_id, r, ord, s, e, trim(substr(clean_text, greatest(s, 0) + 1, e - greatest(s, 0)), ' ,;.:"''') AS phrase, negated FROM bounds),
english AS (SELECT doc_id, m.* FROM {_fold("espan", "s - e, r, ord, s, e, phrase")}),
fl(ord, r, p) AS (VALUES {_FOREIGN_ROWS}),
fat AS (SELECT doc_id, ord, r, strpos(low_text, p) - 1 AS s, strpos(low_text, p) - 1 + length(p) AS e, clean_text FROM low JOIN fl ON contains(low_text, p)),
fspan AS (SELECT doc_id, ord, r, s, e, trim(regexp_extract(substr(clean_text, 1, s), '{_EDGE}$') || substr(clean_text, s + 1, e - s) || regexp_extract(substr(clean_text, e + 1), '^{_EDGE}')) AS phrase, true AS negated FROM fat),
strange AS (SELECT doc_id, m.* FROM {_fold("fspan", "ord")}),
merged AS (SELECT 0 AS part, * FROM english UNION ALL SELECT 1, * FROM strange f WHERE NOT EXISTS (SELECT 1 FROM english e WHERE e.doc_id = f.doc_id AND e.r = f.r AND e.s < f.e AND f.s < e.e)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, s, length(phrase) DESC, CASE WHEN part = 1 THEN ord ELSE s - e END, r, ord) - 1 AS n FROM merged),
grave(r, consequence) AS (VALUES {_CONSEQUENCES}),
counted AS (SELECT doc_id, count(*) AS k, bool_or(negated) AS negated, bool_or(regexp_matches(lower(consequence), 'fatality|serious injury')) AS grave FROM merged JOIN grave USING (r) GROUP BY 1),
factors AS (SELECT doc_id, coalesce(k, 0)::INT AS indicators, (CASE WHEN k IS NULL THEN 0 WHEN grave THEN 2 ELSE 1 END)::INT AS severity,
  (CASE WHEN k > 0 AND {sql_any('low_text', english.EXPOSURE_TERMS)} THEN 1 ELSE 0 END)::INT AS exposure, (CASE WHEN k > 0 AND (negated OR {sql_any('low_text', english.MISSING_CONTROL_TERMS)}) THEN 1 ELSE 0 END)::INT AS barrier_failure
  FROM low LEFT JOIN counted USING (doc_id) WHERE clean_text IS NOT NULL),
final_counts AS (SELECT doc_id, r, rule, count(*) AS k FROM merged JOIN rules USING (r) GROUP BY 1, 2, 3)
"""


@query("c5_evidence_spans", SPANS + 'SELECT doc_id, r, ord, s AS start, e AS "end", phrase FROM espan')
def _(t: Tables):
    return _candidates(t).select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.r", "c.ord", "c.start", "c.end", "c.phrase")


def _english(t: Tables):
    return clean_texts(t).withColumn("matches", spans.english_matches(F.col("clean_text"), F.col("low_text"), LEX))


@query("c6_longest_matches", SPANS + 'SELECT doc_id, rule, s AS start, e AS "end", phrase FROM english JOIN rules USING (r)')
def _(t: Tables):
    return _english(t).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.rule", "m.start", "m.end", "m.phrase")


@query("c7_indicators", OCCURRENCES + "SELECT DISTINCT doc_id, rule, true AS found FROM hit JOIN rules USING (r)")
def _(t: Tables):
    return _english(t).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.rule", F.lit(True).alias("found")).distinct()


@query("c8_exposure", TEXTS + f"SELECT doc_id, {sql_any('low_text', english.EXPOSURE_TERMS)} AS exposed FROM low WHERE low_text IS NOT NULL")
def _(t: Tables):
    return clean_texts(t).filter("low_text IS NOT NULL").select("doc_id", na.has_exposure(F.col("low_text")).alias("exposed"))


@query("c9_act_condition", TEXTS + f"SELECT doc_id, CASE WHEN {sql_any('low_text', english.ACT_ACTORS)} THEN 'Unsafe Act' WHEN {sql_any('low_text', english.CONDITION_WORDS)} THEN 'Unsafe Condition' END AS unsafe_type FROM low")
def _(t: Tables):
    return clean_texts(t).select("doc_id", na.act_or_condition(F.col("low_text")).alias("unsafe_type"))


_FOREIGN_SQL = TEXTS + f""", fl(ord, r, p) AS (VALUES {_FOREIGN_ROWS}), rules(r, rule) AS (VALUES {_RULE_ROWS}),
fhit AS (SELECT DISTINCT doc_id, r FROM low JOIN fl ON contains(low_text, p))
"""


@query("c10_foreign_matches", _FOREIGN_SQL + "SELECT doc_id, rule, true AS found FROM fhit JOIN rules USING (r)")
def _(t: Tables):
    rows = clean_texts(t).select("doc_id", F.explode(spans.foreign_matches(F.col("clean_text"), F.col("low_text"), LEX)).alias("m"))
    return rows.select("doc_id", "m.rule", F.lit(True).alias("found")).distinct()


@query("c10_foreign_spans", SPANS + 'SELECT doc_id, rule, s AS start, e AS "end", phrase FROM strange JOIN rules USING (r)')
def _(t: Tables):
    rows = clean_texts(t).select("doc_id", F.explode(spans.foreign_matches(F.col("clean_text"), F.col("low_text"), LEX)).alias("m"))
    return rows.select("doc_id", "m.rule", "m.start", "m.end", "m.phrase")


@query("c11_merged_matches", SPANS + 'SELECT doc_id, n, rule, phrase, s AS start, e AS "end", negated FROM numbered JOIN rules USING (r)')
def _(t: Tables):
    rows = na.with_matches(t.texts).select("doc_id", F.posexplode("matches").alias("n", "m"))
    return rows.select("doc_id", "n", "m.rule", "m.phrase", "m.start", "m.end", "m.negated")


def _roman_sql(key: str) -> str:
    hits = " + ".join(f"CAST(contains(loose, {q(' ' + m + ' ')}) AS INTEGER)" for m in foreign.ROMAN_MARKERS[key])
    base = {"hi": "hi", "bn": "(bn AND NOT asm)", "as": "(bn AND asm)"}[key.split("-")[0]]
    return f"CASE WHEN latin AND NOT {base} AND {hits} >= 2 THEN '{key}' END"


@query("c12_languages", TEXTS + r""",
x AS (SELECT doc_id, ' ' || regexp_replace(low_text, '[^a-z0-9 ]', ' ', 'g') || ' ' AS loose, regexp_matches(clean_text, '[A-Za-z]') AS latin,
  regexp_matches(clean_text, '[\x{900}-\x{963}\x{966}-\x{97f}]') AS hi, regexp_matches(clean_text, '[\x{980}-\x{9ff}]') AS bn, regexp_matches(clean_text, '[\x{9f0}\x{9f1}]') AS asm FROM low WHERE low_text IS NOT NULL)
SELECT doc_id, concat_ws(',', CASE WHEN hi THEN 'hi' END, CASE WHEN bn AND asm THEN 'as' WHEN bn THEN 'bn' END, CASE WHEN latin THEN 'en' END, """
       + ", ".join(_roman_sql(k) for k in foreign.ROMAN_MARKERS) + ") AS languages FROM x")
def _(t: Tables):
    rows = clean_texts(t).filter("low_text IS NOT NULL")
    return rows.select("doc_id", F.concat_ws(",", na.languages(F.col("clean_text"), F.col("low_text"))).alias("languages"))


@query("c13_foreign_equipment", TEXTS + "SELECT doc_id, concat_ws('|', " + ", ".join(
    f"CASE WHEN {sql_any('clean_text', words)} THEN {q(label)} END" for label, words in foreign.EQUIPMENT_TERMS.items()) + ") AS equipment FROM low WHERE low_text IS NOT NULL")
def _(t: Tables):
    return clean_texts(t).filter("low_text IS NOT NULL").select("doc_id", F.concat_ws("|", spans.foreign_equipment(F.col("clean_text"))).alias("equipment"))


_RULESETS_SQL = OCCURRENCES + f""", fl(ord, r, p) AS (VALUES {_FOREIGN_ROWS}),
e AS (SELECT DISTINCT doc_id, r FROM hit), f AS (SELECT DISTINCT doc_id, r FROM low JOIN fl ON contains(low_text, p))
"""


def _rule_sets(t: Tables):
    text, low = F.col("clean_text"), F.col("low_text")
    rule_ids = lambda m: F.array_distinct(F.transform(m, lambda x: F.struct(x["rule_ord"], x["rule"])))
    return clean_texts(t).filter("low_text IS NOT NULL").select(
        "doc_id", rule_ids(spans.english_matches(text, low, LEX)).alias("en"), rule_ids(spans.foreign_matches(text, low, LEX)).alias("fo"))


@query("c14_foreign_only_rules", _RULESETS_SQL + """
SELECT doc_id, string_agg(rule, '|' ORDER BY rule) AS rules FROM (SELECT * FROM f EXCEPT SELECT * FROM e) JOIN rules USING (r) GROUP BY 1""")
def _(t: Tables):
    only = F.array_sort(F.transform(F.array_except("fo", "en"), lambda x: x["rule"]))
    return _rule_sets(t).select("doc_id", F.concat_ws("|", only).alias("rules")).filter("rules <> ''")


@query("c34_detected_rules", _RULESETS_SQL + """
SELECT doc_id, string_agg(rule, '|' ORDER BY r) AS rules FROM (SELECT * FROM e UNION SELECT * FROM f) JOIN rules USING (r) GROUP BY 1""")
def _(t: Tables):
    both = F.transform(F.array_sort(F.array_union("en", "fo")), lambda x: x["rule"])
    return _rule_sets(t).select("doc_id", F.concat_ws("|", both).alias("rules")).filter("rules <> ''")


# ---- C: scores and classes ---------------------------------------------------

_FACTOR_SQL = """WITH x AS (SELECT o_orderkey AS id, o_orderkey % 6 AS n, CASE WHEN o_orderkey % 6 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS sev,
  CASE WHEN o_orderkey % 6 > 0 AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS expo, CASE WHEN o_orderkey % 6 > 0 AND o_orderkey % 5 < 2 THEN 1 ELSE 0 END AS bar FROM orders) """


def _factors(t: Tables):
    k = F.col("o_orderkey")
    n = (k % 6).cast("int")
    flag = lambda c: F.when((n > 0) & c, 1).otherwise(0)
    severity = F.when(n == 0, 0).when(F.col("o_orderstatus") == "F", 2).otherwise(1)
    return t.raw("orders").select(k.alias("id"), F.struct(n.alias("indicators"), severity.alias("severity"), flag(k % 3 == 0).alias("exposure"),
                                                          flag(k % 5 < 2).alias("barrier_failure")).alias("factors"))


@query("c15_priority", _FACTOR_SQL + "SELECT id, CASE WHEN least(n, 3) + sev + expo + bar >= 5 THEN 'HIGH' WHEN least(n, 3) + sev + expo + bar >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM x")
def _(t: Tables):
    return _factors(t).select("id", na.priority_label(F.col("factors")).alias("priority"))


@query("c16_confidence", _FACTOR_SQL + "SELECT id, CASE WHEN n = 0 THEN 0.55::DOUBLE ELSE round(least(0.97::DOUBLE, 0.62::DOUBLE + 0.11::DOUBLE * n + 0.05::DOUBLE * sev), 2) END AS confidence FROM x")
def _(t: Tables):
    return _factors(t).select("id", na.confidence(F.col("factors")).alias("confidence"))


@query("c15_report_scores", SPANS + """SELECT *, CASE WHEN least(indicators, 3) + severity + exposure + barrier_failure >= 5 THEN 'HIGH' WHEN least(indicators, 3) + severity + exposure + barrier_failure >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE WHEN indicators = 0 THEN 0.55::DOUBLE ELSE round(least(0.97::DOUBLE, 0.62::DOUBLE + 0.11::DOUBLE * indicators + 0.05::DOUBLE * severity), 2) END AS confidence FROM factors""")
def _(t: Tables):
    rows = na.with_matches(t.texts).filter("clean_text IS NOT NULL")
    scored = rows.select("doc_id", na.priority_factors(F.col("matches"), F.col("low_text")).alias("f"))
    return scored.select("doc_id", "f.*", na.priority_label(F.col("f")).alias("priority"), na.confidence(F.col("f")).alias("confidence"))


@query("c17_report_rule", SPANS + """SELECT doc_id, rule, round(least(0.98::DOUBLE, 0.60::DOUBLE + 0.12::DOUBLE * k), 2) AS confidence FROM final_counts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, r) = 1""")
def _(t: Tables):
    rows = na.with_matches(t.texts).filter(F.size("matches") > 0)
    return rows.select("doc_id", na.primary_rule(F.col("matches"), F.col("low_text"), LEX).alias("p")).select("doc_id", "p.rule", "p.confidence")


@query("c19_report_rule_counts", SPANS + "SELECT doc_id, rule, k AS matches, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, r) - 1 AS place FROM final_counts")
def _(t: Tables):
    rows = na.with_matches(t.texts).select("doc_id", F.posexplode(na.rule_counts(F.col("matches"))).alias("place", "c"))
    return rows.select("doc_id", "c.rule", F.col("c.count").alias("matches"), "place")


_PRIMARY_SQL = OCCURRENCES + """, n AS (SELECT doc_id, r, rule, count(*) AS k FROM hit JOIN rules USING (r) GROUP BY 1, 2, 3) """


def _named_candidates(t: Tables) -> Column:
    return _candidates(t).withColumn("matches", spans.named(F.col("candidates"), LEX))


@query("c17_primary_rule", _PRIMARY_SQL + """
SELECT doc_id, rule, round(least(0.98::DOUBLE, 0.60::DOUBLE + 0.12::DOUBLE * k), 2) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, r) AS rn FROM n) WHERE rn = 1""")
def _(t: Tables):
    rows = _named_candidates(t).filter(F.size("matches") > 0)
    return rows.select("doc_id", na.primary_rule(F.col("matches"), F.col("low_text"), LEX).alias("p")).select("doc_id", "p.rule", "p.confidence")


@query("c19_rule_counts", _PRIMARY_SQL + "SELECT doc_id, rule, k AS matches, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, r) - 1 AS place FROM n")
def _(t: Tables):
    rows = _named_candidates(t).select("doc_id", F.posexplode(na.rule_counts(F.col("matches"))).alias("place", "c"))
    return rows.select("doc_id", "c.rule", F.col("c.count").alias("matches"), "place")


_WEIGHTS = ", ".join(f"({w['r']}, {q(w['token'])}, {w['w']})" for w in LEX.profile_weights)
_PROFILE_SQL = TEXTS + f""", w(r, token, w) AS (VALUES {_WEIGHTS}), rules(r, rule) AS (VALUES {_RULE_ROWS}),
tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(low_text, '[a-z0-9]+')) AS token FROM low WHERE low_text IS NOT NULL),
sc AS (SELECT doc_id, r, sum(w) AS s FROM tok JOIN w USING (token) GROUP BY 1, 2),
best AS (SELECT doc_id, rule, s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, r) AS rn FROM sc) JOIN rules USING (r) WHERE rn = 1),
pr AS (SELECT doc_id, coalesce(rule, (SELECT rule FROM rules WHERE r = 0)) AS rule,
  CASE WHEN s IS NULL THEN 0.10::DOUBLE ELSE round(least(0.55::DOUBLE, 0.15::DOUBLE + 0.05::DOUBLE * s), 2) END AS confidence
  FROM low LEFT JOIN best USING (doc_id) WHERE low_text IS NOT NULL)
"""


@query("c18_profile_fallback", _PROFILE_SQL + "SELECT * FROM pr")
def _(t: Tables):
    rows = clean_texts(t).filter("low_text IS NOT NULL")
    return rows.select("doc_id", na.profile_rule(F.col("low_text"), LEX).alias("p")).select("doc_id", "p.rule", "p.confidence")


def _case(column: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(column, words)} THEN {q(label)}" for label, words in table) + " END"


@query("c20_activity_location", TEXTS + f"SELECT doc_id, {_case('low_text', english.EXPLICIT_ACTIVITIES + list(english.ACTIVITY_TERMS.items()))} AS activity, "
       + f"{_case('low_text', [(label, [term]) for term, label in english.LOCATION_TERMS])} AS location, "
       + f"{_case('low_text', [(term, [term]) for term, _ in english.LOCATION_TERMS])} AS term FROM low")
def _(t: Tables):
    low = F.col("low_text")
    return clean_texts(t).select("doc_id", na.activity(low).alias("activity"), na.location(low).alias("l")).select(
        "doc_id", "activity", F.col("l.label").alias("location"), F.col("l.term").alias("term"))


@query("c21_equipment_hazards", TEXTS + "SELECT doc_id, concat_ws('|', " + ", ".join(
    f"CASE WHEN {sql_any('low_text', w)} THEN {q(n)} END" for n, w in english.EQUIPMENT_TERMS.items()) + ") AS equipment, concat_ws('|', "
       + ", ".join(f"CASE WHEN {sql_any('low_text', w)} THEN {q(n)} END" for n, w in english.EXTRA_HAZARDS.items()) + ") AS hazards FROM low WHERE low_text IS NOT NULL")
def _(t: Tables):
    low = F.col("low_text")
    nothing = F.array().cast(f"array<{na.MATCH}>")
    return clean_texts(t).filter("low_text IS NOT NULL").select(
        "doc_id", F.concat_ws("|", na.english_equipment(low)).alias("equipment"), F.concat_ws("|", na.hazards(low, nothing)).alias("hazards"))


_FAIL_WORDS = q(any_of(spans.FAILURE_WORDS).replace("\\ ", " ").replace("\\-", "-"))
_FAIL_FOREIGN = q("(^|[^a-z0-9])" + any_of(english.FOREIGN_NEGATION_TOKENS).replace("\\ ", " ") + "($|[^a-z0-9])")


def _clause(at: str, width: str) -> str:
    """Text around a term up to sentence ends and connectors, without nullifying phrases."""
    left = f"regexp_extract(substr(low_text, greatest({at} - 45, 0) + 1, least({at}, 45)), '[^.!?;]*$')"
    right = f"regexp_extract(substr(low_text, {at} + {width} + 1, 30), '^[^.!?;]*')"
    for connector in english.CLAUSE_CONNECTORS:
        left, right = f"string_split({left}, {q(connector)})[-1]", f"string_split({right}, {q(connector)})[1]"
    return f"regexp_replace({left} || substr(low_text, {at} + 1, {width}) || {right}, {_NUL}, '', 'g')"


def _term_spots(table: str) -> str:
    """Places of control terms (from zero); a single word must not continue another one."""
    blocked = " OR ".join(f"(term = {q(word)} AND starts_with(substr(low_text, place + length(term) + 1, 12), {q(end)}))" for word, ends in english.FOLLOW_BLOCKS.items() for end in ends)
    return f"""(SELECT * FROM (SELECT *, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * length(term))::BIGINT AS place
  FROM (SELECT *, string_split(low_text, term) AS pieces FROM low JOIN {table} ON contains(low_text, term)), unnest(range(1, len(pieces))) u(i))
  WHERE contains(term, ' ') OR NOT ((place > 0 AND regexp_matches(substr(low_text, place, 1), '[\\p{{L}}\\p{{N}}]')) OR {blocked}))"""


def _values_of(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else q(v) for v in row) + ")" for row in rows)


_BARRIERS = _values_of((n, label, term) for n, (label, terms) in enumerate(english.BARRIER_TERMS.items()) for term in terms)
_RULE_FACTS = _values_of((n, rule["hazard"], rule["barriers"][0]) for n, rule in enumerate(LEX.rules))


def _labels_sql(column: str, table) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_any(column, words)} THEN {q(label)} END" for label, words in table) + "], lambda x: x IS NOT NULL)"


_PROFILE_PARTS = _PROFILE_SQL[len(TEXTS):].replace(f"rules(r, rule) AS (VALUES {_RULE_ROWS}),", "", 1)
FINDINGS = SPANS + _PROFILE_PARTS + f""", bt(b, label, term) AS (VALUES {_BARRIERS}), facts(r, hazard, barrier) AS (VALUES {_RULE_FACTS}),
windows AS (SELECT doc_id, b, label, {_clause("place", "length(term)")} AS w FROM {_term_spots("bt")}),
weak AS (SELECT DISTINCT doc_id, b, label FROM windows WHERE regexp_matches(w, {_FAIL_WORDS}) OR regexp_matches(w, {_FAIL_FOREIGN})),
barriers AS (SELECT doc_id, label, min(part * 100000 + n) AS place FROM (SELECT doc_id, 0 AS part, n, barrier AS label FROM numbered JOIN facts USING (r) UNION ALL SELECT doc_id, 1, b, label FROM weak) GROUP BY 1, 2),
barrier_lists AS (SELECT doc_id, string_agg(label, '|' ORDER BY place) AS barriers FROM barriers GROUP BY 1),
match_lists AS (SELECT doc_id, list(hazard ORDER BY n) AS hazards, list(phrase ORDER BY n) AS phrases FROM numbered JOIN facts USING (r) GROUP BY 1),
main_rule AS (SELECT doc_id, rule, round(least(0.98::DOUBLE, 0.60::DOUBLE + 0.12::DOUBLE * k), 2) AS confidence FROM final_counts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, r) = 1),
whole AS (SELECT doc_id, k IS NOT NULL AS sif_potential, coalesce(m.rule, pr.rule) AS life_saving_rule, coalesce(m.confidence, pr.confidence) AS rule_confidence, coalesce(barriers, '') AS barriers,
  list_concat(coalesce(hazards, []), {_labels_sql('low_text', english.EXTRA_HAZARDS.items())}) AS all_hazards, coalesce(phrases, []) AS phrases, clean_text, low_text,
  {_case('low_text', english.EXPLICIT_ACTIVITIES + list(english.ACTIVITY_TERMS.items()))} AS stated, {_case('low_text', [(label, [term]) for term, label in english.LOCATION_TERMS])} AS location,
  list_concat({_labels_sql('low_text', english.EQUIPMENT_TERMS.items())}, {_labels_sql('clean_text', foreign.EQUIPMENT_TERMS.items())}) AS all_equipment
  FROM low LEFT JOIN counted USING (doc_id) LEFT JOIN main_rule m USING (doc_id) LEFT JOIN pr USING (doc_id) LEFT JOIN barrier_lists USING (doc_id) LEFT JOIN match_lists USING (doc_id) WHERE clean_text IS NOT NULL)
"""


def _once(column: str) -> str:
    """Distinct items in the order of their first place, joined."""
    return f"array_to_string(list_filter({column}, lambda x, i: list_position({column}, x) = i), '|')"


@query("c22_barrier_failures", FINDINGS + "SELECT doc_id, label AS barrier FROM barriers")
def _(t: Tables):
    rows = na.with_matches(t.texts).filter("clean_text IS NOT NULL")
    return rows.select("doc_id", F.explode(na.barrier_failures(F.col("low_text"), F.col("matches"))).alias("barrier"))


@query("c23_term_windows", FINDINGS + "SELECT doc_id, label AS barrier, md5(w) AS window_text, count(*) AS times FROM windows GROUP BY 1, 2, 3")
def _(t: Tables):
    # every place of every control term
    low = F.col("low_text")
    table = constant([{"label": label, "term": term} for label, terms in english.BARRIER_TERMS.items() for term in terms], "array<struct<label:string,term:string>>")
    rows = F.flatten(F.transform(table, lambda b: F.transform(term_positions(low, b["term"]), lambda at: F.struct(
        b["label"].alias("barrier"), F.md5(spans.clause_window(low, at, F.length(b["term"]))).alias("window_text")))))
    return clean_texts(t).filter("low_text IS NOT NULL").select("doc_id", F.explode(rows).alias("x")).groupBy("doc_id", "x.barrier", "x.window_text").agg(F.count(F.lit(1)).alias("times"))


@query("c23_clause_windows")
def _(t: Tables):
    low, width = F.col("low_text"), F.lit(len("harness"))
    at = spans.positions(low, F.lit("harness"), width)
    rows = F.transform(at, lambda p: F.struct(p.alias("at"), spans.clause_window(low, p, width).alias("window_text"),
                                              spans.fails_nearby(low, p, width).alias("failed")))
    return clean_texts(t).filter(low.contains("harness")).select("doc_id", F.explode(rows).alias("w")).select("doc_id", "w.*")


@query("c29_implied_activity", views("findings") + "SELECT report_pk, CASE WHEN life_saving_rule = 'BUILDING' THEN NULL END AS implied, "
       + "coalesce(analysis_activity, CASE report_pk % 3 " + " ".join(f"WHEN {n} THEN {q(english.RULE_TO_ACTIVITY[r])}" for n, r in enumerate(LEX.rule_names[:3])) + " END) AS activity FROM findings")
def _(t: Tables):
    names = F.get(F.array(*[F.lit(n) for n in LEX.rule_names[:3]]), (F.col("report_pk") % 3).cast("int"))
    return t.findings.select("report_pk", na.implied_activity(F.when(F.col("life_saving_rule") == "BUILDING", "unknown rule")).alias("implied"),
                             F.coalesce("analysis_activity", na.implied_activity(names)).alias("activity"))


def _analysed(t: Tables):
    return na.analyze(t.texts).filter("processing_status = 'analyzed'")


@query("c24_rule_conditions")
def _(t: Tables):
    rows = _analysed(t).select("doc_id", "life_saving_rule", F.posexplode("rule_conditions").alias("n", "c"))
    return rows.select("doc_id", "life_saving_rule", "n", "c.condition", "c.status", F.concat_ws(" || ", "c.evidence").alias("evidence"))


@query("c25_sentences", TEXTS + "SELECT DISTINCT doc_id, trim(s) AS quote FROM (SELECT doc_id, unnest(string_split_regex(clean_text, '[.!?;]')) AS s FROM low) WHERE contains(lower(s), 'permit')")
def _(t: Tables):
    at = spans.positions(F.col("low_text"), F.lit("permit"), F.lit(6))
    quotes = F.transform(at, lambda p: spans.sentence_around(F.col("clean_text"), p, F.lit(6)))
    return clean_texts(t).select("doc_id", F.explode(quotes).alias("quote")).distinct()


@query("c25_summary_sentences")
def _(t: Tables):
    at = F.get(spans.positions(F.col("low_text"), F.lit("permit"), F.lit(6)), F.lit(0))
    return clean_texts(t).filter(F.col("low_text").contains("permit")).select("doc_id", let(at, lambda p: na.sentence_at(F.col("clean_text"), p)).alias("sentence"))


@query("c26_explanation")
def _(t: Tables):
    return _analysed(t).select("doc_id", "explanation")


@query("c27_summary")
def _(t: Tables):
    return _analysed(t).select("doc_id", "summary")


_FOLLOW_UPS = _values_of((rule["name"], rule["follow_up"]) for rule in LEX.rules)


@query("c28_suggested_actions", FINDINGS + f""", follow(rule, follow_up) AS (VALUES {_FOLLOW_UPS}),
steps AS (SELECT doc_id, 0 AS part, 0 AS k, follow_up AS action FROM whole JOIN follow ON rule = life_saving_rule WHERE sif_potential
  UNION ALL SELECT doc_id, 1, place, 'Check on site and restore: ' || lower(label) || '; note who did it.' FROM barriers JOIN whole USING (doc_id) WHERE sif_potential
  UNION ALL SELECT doc_id, 2, 0, 'Go through “' || life_saving_rule || '” with the crew and compare the papers with the job.' FROM whole WHERE sif_potential
  UNION ALL SELECT doc_id, 3, 0, CASE WHEN least(indicators, 3) + severity + exposure + barrier_failure >= 5 THEN 'Site visit by HSE today.' ELSE 'HSE review within two days; site on this week''s inspection round.' END
    FROM whole JOIN factors USING (doc_id) WHERE sif_potential AND least(indicators, 3) + severity + exposure + barrier_failure >= 3
  UNION ALL SELECT doc_id, 0, 0, 'No precursor found: keep the report on file, nothing else to do.' FROM whole WHERE NOT sif_potential)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, k) - 1 AS n, action FROM steps""")
def _(t: Tables):
    return _analysed(t).select("doc_id", F.posexplode("suggested_actions").alias("n", "action"))


@query("c30_analysis")
def _(t: Tables):
    return _analysed(t).select("doc_id", "sif_potential", "priority", "confidence", "life_saving_rule", "rule_confidence", "hazard",
                               F.concat_ws("|", "barrier_failure").alias("barriers"), F.concat_ws("|", "evidence").alias("evidence"),
                               F.size(F.filter("rule_conditions", lambda c: c["status"] == BREACHED)).alias("breached"))


@query("c30_findings", FINDINGS + f"""SELECT doc_id, sif_potential, CASE WHEN least(indicators, 3) + severity + exposure + barrier_failure >= 5 THEN 'HIGH' WHEN least(indicators, 3) + severity + exposure + barrier_failure >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE WHEN indicators = 0 THEN 0.55::DOUBLE ELSE round(least(0.97::DOUBLE, 0.62::DOUBLE + 0.11::DOUBLE * indicators + 0.05::DOUBLE * severity), 2) END AS confidence, life_saving_rule, rule_confidence, all_hazards[1] AS hazard, barriers,
  {_once("phrases")} AS evidence FROM whole JOIN factors USING (doc_id)""")
def _(t: Tables):
    return _analysed(t).select("doc_id", "sif_potential", "priority", "confidence", "life_saving_rule", "rule_confidence", "hazard", F.concat_ws("|", "barrier_failure").alias("barriers"), F.concat_ws("|", "evidence").alias("evidence"))


@query("c31_backfill_rule", _PROFILE_SQL + "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN rule ELSE 'Line of Fire' END AS life_saving_rule FROM pr")
def _(t: Tables):
    rows = clean_texts(t).filter("low_text IS NOT NULL").withColumn("life_saving_rule", F.when(F.col("doc_id") % 3 != 0, "Line of Fire"))
    return na.backfill_rule(rows, "clean_text").select("doc_id", "life_saving_rule")


@query("c32_reanalysis", views("reviews", "findings") + """
SELECT v.id, v.report_pk FROM reviews v WHERE v.report_pk NOT IN (SELECT report_pk FROM findings WHERE priority = 'HIGH')""")
def _(t: Tables):
    # Reviews of re-analyzed reports go, all others stay.
    redone = t.findings.filter(F.col("priority") == "HIGH").select("report_pk")
    return t.reviews.join(redone, "report_pk", "left_anti").select("id", "report_pk")


_SIGNALS = [{"phrase": "fire watch", "direction": "+", "weight": 4}, {"phrase": "gas test", "direction": "+", "weight": 6}, {"phrase": "permit to work", "direction": "-", "weight": 3}]


@query("c33_learned_signals", TEXTS + r""",
x AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(low_text, '[a-z0-9'']+|[\x{900}-\x{9ff}]+'), ' ') || ' ' AS s, round(0.55::DOUBLE + (doc_id % 40) / 100.0::DOUBLE, 2) AS c, doc_id % 2 = 0 AS sif FROM low WHERE low_text IS NOT NULL),
y AS (SELECT *, CASE WHEN contains(s, ' fire watch ') THEN 4 ELSE 0 END + CASE WHEN contains(s, ' gas test ') THEN 6 ELSE 0 END AS w FROM x)
SELECT doc_id, w AS tuned_weight, CASE WHEN w > 0 AND sif THEN round(least(0.99::DOUBLE, c + least(0.15::DOUBLE, 0.05::DOUBLE + w * 0.01::DOUBLE)), 2) WHEN w > 0 THEN greatest(0.55::DOUBLE, c) ELSE c END AS confidence,
  CASE WHEN w > 0 AND NOT sif THEN 'MEDIUM' ELSE 'LOW' END AS priority, CASE WHEN w > 0 THEN 'rules-v1+tuned' ELSE 'rules-v1' END AS model FROM y""")
def _(t: Tables):
    rows = clean_texts(t).filter("low_text IS NOT NULL").withColumns({
        "sif_potential": F.col("doc_id") % 2 == 0, "confidence": F.round(F.lit(0.55) + (F.col("doc_id") % 40) / F.lit(100.0), 2), "priority": F.lit("LOW"),
        "evidence": F.array().cast("array<string>"), "uncertainty_note": F.lit(None).cast("string"), "model": F.lit("rules-v1")})
    return na.apply_signals(rows, _SIGNALS, 12).select("doc_id", "tuned_weight", "confidence", "priority", "model")


@query("c35_lexicon_hits", _FOREIGN_SQL.replace("SELECT DISTINCT doc_id, r FROM", "SELECT doc_id, r, p FROM") + "SELECT rule, p AS phrase, count(DISTINCT doc_id) AS reports FROM fhit JOIN rules USING (r) GROUP BY 1, 2")
def _(t: Tables):
    low = F.col("low_text")
    found = F.transform(spans.phrases_in(low, LEX.foreign_column()), lambda e: F.struct(e["r"], e["p"].alias("phrase")))
    rules = t.spark.createDataFrame(list(enumerate(LEX.rule_names)), "r int, rule string")
    rows = clean_texts(t).select("doc_id", F.explode(F.array_distinct(found)).alias("f")).select("doc_id", "f.*")
    # ``rules`` has one row per configured rule.
    return rows.groupBy("r", "phrase").agg(F.countDistinct("doc_id").alias("reports")).join(F.broadcast(rules), "r").select("rule", "phrase", "reports")


_IMPLIED = "CASE life_saving_rule " + " ".join(f"WHEN {q(rule)} THEN {q(act)}" for rule, act in english.RULE_TO_ACTIVITY.items()) + " END"


_PHRASE_ROWS = _values_of([("en", i["ord"], i["r"], i["p"]) for i in LEX.indicators] + [(f["lang"], f["ord"], f["r"], f["p"]) for f in LEX.foreign_phrases])


@query("c35_phrase_use", TEXTS + f", ph(lang_of, ord, r, phrase) AS (VALUES {_PHRASE_ROWS}), rules(r, rule) AS (VALUES {_RULE_ROWS}) SELECT lang_of AS lang, rule, phrase, ord, count(doc_id) AS reports FROM ph JOIN rules USING (r) LEFT JOIN low ON contains(low_text, phrase) GROUP BY ALL")
def _(t: Tables):
    # every phrase of every language, unused ones too; the lexicon is a few hundred rows
    low = F.col("low_text")
    ords = lambda groups, english_part: F.transform(spans.phrases_in(low, groups), lambda e: F.struct(F.lit(english_part).alias("english"), e["ord"].alias("ord")))
    hits = clean_texts(t).filter("low_text IS NOT NULL").select(F.explode(F.concat(ords(LEX.indicator_column(), True), ords(LEX.foreign_column(), False))).alias("h"))
    counts = hits.groupBy("h.english", "h.ord").agg(F.count(F.lit(1)).alias("reports"))
    phrases = LEX.phrase_frame(t.spark).withColumn("english", F.col("lang") == "en")
    return phrases.join(F.broadcast(counts), ["english", "ord"], "left").select("lang", "rule", "phrase", "ord", F.coalesce("reports", F.lit(0)).cast("long").alias("reports"))


@query("c36_extraction", FINDINGS + f"""SELECT doc_id, coalesce(stated, {_IMPLIED}) AS analysis_activity, {_once("all_hazards")} AS hazards, barriers, {_once("all_equipment")} AS equipment, location,
  CASE WHEN {sql_any('low_text', english.ACT_ACTORS)} THEN 'Unsafe Act' WHEN {sql_any('low_text', english.CONDITION_WORDS)} THEN 'Unsafe Condition' END AS unsafe_type FROM whole""")
def _(t: Tables):
    return _analysed(t).select("doc_id", "analysis_activity", F.concat_ws("|", "hazards").alias("hazards"), F.concat_ws("|", "barrier_failure").alias("barriers"),
                               F.concat_ws("|", "equipment").alias("equipment"), "location", "unsafe_type")


@query("d16_score_rows", SPANS + """SELECT doc_id, f.factor, f.points FROM (SELECT doc_id, unnest([{'factor': 'indicators', 'points': indicators}, {'factor': 'severity', 'points': severity}, {'factor': 'exposure', 'points': exposure},
  {'factor': 'barrier_failure', 'points': barrier_failure}]) AS f FROM factors) WHERE f.points > 0""")
def _(t: Tables):
    rows = na.with_matches(t.texts).filter("clean_text IS NOT NULL").select("doc_id", na.priority_factors(F.col("matches"), F.col("low_text")).alias("f"))
    pairs = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"f.{n}").alias("points")) for n in ("indicators", "severity", "exposure", "barrier_failure")])
    return rows.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*").filter("points > 0")
