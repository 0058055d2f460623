"""Queries on similarity, feedback, label metrics and dataset building."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardlake.functions import text as tx
from hazardlake.lexicon import DEFAULT as LEX
from hazardlake.operators import analysis as na
from hazardlake.operators import datasets as ds
from hazardlake.operators import dedupe as dd
from hazardlake.operators import feedback as fb
from hazardlake.operators import metrics as me
from hazardlake.operators import similarity as sm
from hazardlake.plans.catalog import query, views
from hazardlake.plans.texts import FP_SQL, TEXTS, collapsed, q
from hazardlake.sources.tables import Tables

# ---- J: similarity ------------------------------------------------------------


def _similar_input(t: Tables):
    k = F.col("doc_id")
    return t.raw("documents").select(
        k.alias("id"), F.col("text").alias("report_text"), F.when(k % 9 != 0, F.concat(F.lit("Rule "), (k % 10).cast("string"))).alias("rule"),
        F.col("lang").alias("hazard"), F.upper("source").alias("activity"),
        F.array(F.concat(F.lit("B"), (k % 7).cast("string")), F.concat(F.lit("B"), (k % 11).cast("string"))).alias("barriers"))


_STOP_SQL = ", ".join(q(w) for w in dict.fromkeys(tx.SIMILARITY_STOP))
# A search asks for every hundredth report, among all reports; ``WHOM`` says which.
_ALL_PAIRS_SQL = rf"""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 <> 0 THEN doc_id % 10 END AS rule, lang, source FROM documents),
tok AS (SELECT DISTINCT id, token FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+|[\x{{900}}-\x{{9ff}}]+')) AS token FROM documents)
  WHERE length(token) >= 3 AND token NOT IN ({_STOP_SQL})),
sz AS (SELECT id, count(*) AS n FROM tok GROUP BY 1),
it AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM tok a JOIN tok b USING (token) WHERE a.id <> b.id GROUP BY 1, 2),
p AS (SELECT x.id AS query_id, y.id AS match_id, coalesce(i, 0) AS i, sx.n AS nx, sy.n AS ny, x.rule = y.rule AS same_rule,
    x.id % 7 = y.id % 7 OR x.id % 11 = y.id % 11 OR x.id % 7 = y.id % 11 OR x.id % 11 = y.id % 7 AS same_barrier, x.lang = y.lang AS same_hazard, x.source = y.source AS same_activity
  FROM d x JOIN d y ON x.id <> y.id JOIN sz sx ON sx.id = x.id JOIN sz sy ON sy.id = y.id LEFT JOIN it ON it.a = x.id AND it.b = y.id),
s AS (SELECT *, 0.5::DOUBLE * (i::DOUBLE / (nx + ny - i)) + CASE WHEN same_rule THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN same_barrier THEN 0.12::DOUBLE ELSE 0 END
  + CASE WHEN same_hazard THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN same_activity THEN 0.12::DOUBLE ELSE 0 END AS score FROM p),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) - 1 AS place FROM s WHERE score >= 0.16::DOUBLE AND WHOM) WHERE place < 5)
"""
_PAIRS_SQL = _ALL_PAIRS_SQL.replace("WHOM", "query_id % 100 = 0")


def _asked(rows):
    return rows.filter(F.col("id") % 100 == 0)


@query("j1_token_sets", rf"""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+|[\x{{900}}-\x{{9ff}}]+')), lambda x: length(x) >= 3 AND x NOT IN ({_STOP_SQL}))) AS tokens FROM documents""")
def _(t: Tables):
    return t.raw("documents").select("doc_id", F.size(tx.similarity_tokens(F.col("text"))).alias("tokens"))


@query("j2_similar_reports", _PAIRS_SQL + "SELECT query_id, match_id, place, round(least(score, 0.99::DOUBLE) + 1e-9::DOUBLE, 2) AS similarity, CASE WHEN same_rule THEN 'Rule ' || (match_id % 10) END AS common_rule FROM top")
def _(t: Tables):
    rows = _similar_input(t)
    return sm.with_shared_concepts(sm.similar_reports(_asked(rows), rows), rows).select("query_id", "match_id", "place", "similarity", "common_rule")


@query("j3_near_duplicates", _ALL_PAIRS_SQL.replace("WHOM", "true") + "SELECT query_id, match_id FROM top WHERE place = 0 AND round(least(score, 0.99::DOUBLE) + 1e-9::DOUBLE, 2) >= 0.88::DOUBLE")
def _(t: Tables):
    return sm.near_duplicates(_similar_input(t)).select("query_id", "match_id")


_GROUPS_SQL = "WITH f AS (SELECT doc_id, " + FP_SQL.format("text") + " AS fp FROM documents), g AS (SELECT doc_id, count(*) OVER (PARTITION BY fp) AS group_size, min(doc_id) OVER (PARTITION BY fp) AS first_id FROM f WHERE length(fp) >= 8) "


@query("j4_exact_duplicates", _GROUPS_SQL + "SELECT first_id, max(group_size) AS group_size FROM g WHERE group_size > 1 GROUP BY 1")
def _(t: Tables):
    return dd.duplicate_groups(t.raw("documents"), "text", "doc_id").groupBy("first_id").agg(F.max("group_size").alias("group_size"))


@query("g4_duplicate_groups", _GROUPS_SQL + "SELECT * FROM g WHERE group_size > 1")
def _(t: Tables):
    return dd.duplicate_groups(t.raw("documents"), "text", "doc_id")


@query("i4_token_overlap", rf"""WITH d AS (SELECT conv_id, list_distinct(list_concat_agg) AS w FROM (SELECT conv_id, flatten(list(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS list_concat_agg FROM conversations GROUP BY 1)),
b AS (SELECT list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9'']+')))) AS w FROM benchmark)
SELECT conv_id, len(list_intersect(d.w, b.w)) AS shared, len(list_distinct(list_concat(d.w, b.w))) AS united FROM d, b""")
def _(t: Tables):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']+"), F.lit(0))
    mine = t.raw("conversations").select("conv_id", F.explode(tokens).alias("w")).distinct()
    base = t.raw("benchmark").select(F.explode(tokens).alias("w")).distinct().withColumn("in_base", F.lit(1))
    total = base.agg(F.count(F.lit(1)).alias("base_size"))
    counts = mine.join(base, "w", "left").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count("in_base").alias("shared"))
    return counts.crossJoin(F.broadcast(total)).select("conv_id", "shared", (F.col("n") + F.col("base_size") - F.col("shared")).alias("united"))  # one row


_RECENT_SQL = ("WITH " + Tables.FINDINGS_SQL + ", " + _ALL_PAIRS_SQL.removeprefix("WITH ").replace(
    "WHOM", "query_id IN (SELECT doc_id FROM documents JOIN findings ON report_pk = doc_id WHERE priority = 'HIGH' ORDER BY doc_id DESC LIMIT 10)"))


@query("h2_recent_with_similar", _RECENT_SQL + "SELECT query_id, match_id, place, round(score, 9) AS score FROM top WHERE place < 3")
def _(t: Tables):
    rows = _similar_input(t)
    high = t.findings.filter("priority = 'HIGH'").select(F.col("report_pk").alias("id"))
    recent = rows.join(high, "id", "left_semi").orderBy(F.desc("id")).limit(10)
    return sm.similar_reports(recent, rows, k=3).withColumn("score", F.round("score", 9))


@query("e5_match_enrichment", _PAIRS_SQL + "SELECT query_id, match_id, source AS site FROM top JOIN documents ON doc_id = match_id")
def _(t: Tables):
    rows = _similar_input(t)
    names = t.raw("documents").select(F.col("doc_id").alias("match_id"), F.col("source").alias("site"))
    return sm.similar_reports(_asked(rows), rows).join(names, "match_id").select("query_id", "match_id", "site")


@query("d13_solved_references", _PAIRS_SQL.replace("WITH d AS", views("reviews") + ", d AS") + """,
l AS (SELECT report_pk, arg_max(coalesce(decision, '-'), id) AS d, arg_max(coalesce(comments, '-'), id) AS c FROM reviews GROUP BY 1)
SELECT query_id, match_id, d AS decision, c <> '-' AS has_notes FROM top JOIN l ON report_pk = match_id WHERE d IN ('confirmed', 'reviewed', 'edited')""")
def _(t: Tables):
    from hazardlake.operators.registry import VERIFIED, latest_review
    rows = _similar_input(t)
    solved = latest_review(t.reviews).filter(F.col("decision").isin(VERIFIED)).select(
        F.col("report_pk").alias("match_id"), "decision", F.col("comments").isNotNull().alias("has_notes"))
    return sm.similar_reports(_asked(rows), rows).join(solved, "match_id").select("query_id", "match_id", "decision", "has_notes")


# ---- K: feedback ----------------------------------------------------------------

_CAPTURE_SQL = views("reviews", "findings") + """,
c AS (SELECT v.id, v.report_pk, coalesce(decision, 'reviewed') AS decision, sif_potential AS ai_sif, coalesce(corrected_rule, life_saving_rule) AS human_rule, coalesce(corrected_priority, priority) AS human_priority,
  CASE coalesce(decision, 'reviewed') WHEN 'confirmed' THEN true WHEN 'rejected' THEN false WHEN 'reviewed' THEN sif_potential END AS human_sif
  FROM reviews v LEFT JOIN findings f ON f.report_pk = v.report_pk)
"""


@query("k1_capture_feedback", _CAPTURE_SQL + "SELECT id, report_pk, decision, ai_sif, human_rule, human_priority, human_sif FROM c")
def _(t: Tables):
    return fb.capture(t.reviews, t.findings).select("id", "report_pk", "decision", "ai_sif", "human_rule", "human_priority", "human_sif")


@query("k2_default_decision", views("reviews") + "SELECT coalesce(decision, 'reviewed') AS decision, count(*) AS n FROM reviews GROUP BY 1")
def _(t: Tables):
    return t.reviews.groupBy(F.coalesce("decision", F.lit("reviewed")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


_SCORES_SQL = """s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM m)"""
_SHOWN = "round(p, 3) AS precision, round(r, 3) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 3) ELSE 0 END AS f1, CASE WHEN 4 * p + r > 0 THEN round(5 * p * r / (4 * p + r), 3) ELSE 0 END AS f2"
_ACC = ", CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 3) ELSE 0 END AS accuracy"


@query("k3_agreement", _CAPTURE_SQL + """, m AS (SELECT count_if(human_sif AND coalesce(ai_sif, false)) AS tp, count_if(NOT human_sif AND coalesce(ai_sif, false)) AS fp,
  count_if(human_sif AND NOT coalesce(ai_sif, true)) AS fn, count_if((NOT human_sif AND NOT coalesce(ai_sif, false)) OR (human_sif AND ai_sif IS NULL)) AS tn FROM c WHERE human_sif IS NOT NULL), """
       + _SCORES_SQL + f" SELECT tp, fp, fn, tn, {_SHOWN}{_ACC}, round(round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 3) * 100, 1) AS agreement FROM s")
def _(t: Tables):
    return fb.agreement(fb.capture(t.reviews, t.findings))


@query("f11_feedback_summary", _CAPTURE_SQL + "SELECT decision, count(*) AS n, count(human_sif) AS labelled FROM c GROUP BY 1")
def _(t: Tables):
    return fb.summary(fb.capture(t.reviews, t.findings))


def _labelled_feedback(t: Tables):
    return t.raw("labels").join(t.texts, "doc_id").select(
        "doc_id", "report_text", (F.col("quality") == 1).alias("human_sif"), (F.col("toxic") == 1).alias("ai_sif"))


_FSTOP = ", ".join(q(w) for w in dict.fromkeys(fb.SIGNAL_STOP))
_DOMAIN = ", ".join(q(w) for w in LEX.domain_words)
_GRAMS_SQL = TEXTS + rf""",
w AS (SELECT doc_id, quality = 1 AS human, toxic = 1 AS ai, regexp_extract_all(lower(report_text), '[a-z0-9'']+|[\x{{900}}-\x{{9ff}}]+') AS ws FROM labels JOIN texts USING (doc_id)),
t0 AS (SELECT doc_id, human, ai, i, ws[i] AS w FROM w, unnest(range(1, len(ws) + 1)) u(i)),
t1 AS (SELECT *, w IN ({_DOMAIN}) AS d, w IN ({_FSTOP}) AS f FROM t0),
t2 AS (SELECT *, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(d) OVER o AS d2, lead(d, 2) OVER o AS d3, lead(d, 3) OVER o AS d4,
  lead(f) OVER o AS f2, lead(f, 2) OVER o AS f3, lead(f, 3) OVER o AS f4 FROM t1 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, human, ai, 2 AS words, w || ' ' || w2 AS phrase FROM t2 WHERE (d OR d2) AND NOT (f AND f2)
  UNION SELECT doc_id, human, ai, 3, w || ' ' || w2 || ' ' || w3 FROM t2 WHERE w3 IS NOT NULL AND (d OR d2 OR d3) AND NOT (f AND f2 AND f3)
  UNION SELECT doc_id, human, ai, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM t2 WHERE w4 IS NOT NULL AND (d OR d2 OR d3 OR d4) AND NOT (f AND f2 AND f3 AND f4)),
k AS (SELECT * FROM g WHERE length(phrase) >= 6),
c AS (SELECT phrase, words, count_if(human AND NOT ai) AS missed, count_if(NOT human AND ai) AS wrong, count_if(human = ai) AS agreed FROM k GROUP BY 1, 2)
"""


@query("k4_phrase_counts", _GRAMS_SQL + "SELECT phrase, words, missed, wrong, agreed FROM c")
def _(t: Tables):
    return fb.phrase_counts(_labelled_feedback(t), LEX.domain_words)


@query("k5_candidate_filter", _GRAMS_SQL + "SELECT words, count(DISTINCT phrase) AS phrases FROM k GROUP BY 1")
def _(t: Tables):
    rows = _labelled_feedback(t).select(F.explode_outer(fb.phrases(F.col("report_text"), LEX.domain_words)).alias("p")).filter("p IS NOT NULL")
    return rows.distinct().groupBy(fb.word_count(F.col("p")).alias("words")).agg(F.count(F.lit(1)).alias("phrases"))


_SIGNALS_SQL = _GRAMS_SQL + """, x AS (SELECT phrase, '+' AS direction, missed AS reports, words FROM c WHERE missed > 0 AND agreed = 0 UNION ALL SELECT phrase, '-', wrong, words FROM c WHERE wrong > 0 AND agreed = 0)
SELECT phrase, direction, reports, reports * words AS weight FROM x QUALIFY row_number() OVER (PARTITION BY direction ORDER BY reports DESC, phrase) <= 8"""


@query("k6_signals", _SIGNALS_SQL)
def _(t: Tables):
    return fb.mine_signals(_labelled_feedback(t), LEX.domain_words)


@query("k7_active_signals", _SIGNALS_SQL)
def _(t: Tables):
    mined = fb.mine_signals(_labelled_feedback(t), LEX.domain_words)
    # A run holds eight signals of each direction at most.
    run = mined.agg(F.lit(1).alias("run_id"), F.array_sort(F.collect_list(F.struct("direction", "phrase", "reports", "weight"))).alias("signals"))
    return fb.latest_signals(run)


# ---- F: label metrics -------------------------------------------------------------

_M = "count_if(quality = 1 AND toxic = 1) AS tp, count_if(quality <> 1 AND toxic = 1) AS fp, count_if(quality = 1 AND toxic <> 1) AS fn, count_if(quality <> 1 AND toxic <> 1) AS tn"


def _labels(t: Tables):
    return t.raw("labels").join(t.raw("documents").select("doc_id", "lang", "source"), "doc_id").withColumns(
        {"truth": F.col("quality") == 1, "predicted": F.col("toxic") == 1})


@query("f12_confusion", f"WITH m AS (SELECT {_M} FROM labels), {_SCORES_SQL} SELECT tp, fp, fn, tn, {_SHOWN}{_ACC} FROM s")
def _(t: Tables):
    return me.with_scores(me.confusion(_labels(t), F.col("truth"), F.col("predicted")))


@query("f13_rule_metrics", """WITH e AS (SELECT DISTINCT report_pk AS c, life_saving_rule AS rule FROM """ + "(" + views("findings") + """ SELECT * FROM findings) WHERE sif_potential AND life_saving_rule IS NOT NULL),
d AS (SELECT DISTINCT o_orderkey AS c, c_mktsegment AS rule FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 AND o_orderkey % 3 <> 0),
m AS (SELECT rule, count(e.c) AS support, count_if(e.c IS NOT NULL AND d.c IS NOT NULL) AS tp, count_if(e.c IS NULL) AS fp, count_if(d.c IS NULL) AS fn FROM e FULL JOIN d USING (c, rule) GROUP BY rule), """
       .replace("count(e.c) AS support, count_if(e.c IS NOT NULL AND d.c IS NOT NULL) AS tp, count_if(e.c IS NULL) AS fp, count_if(d.c IS NULL) AS fn FROM e FULL JOIN d USING (c, rule) GROUP BY rule",
                "count_if(ie) AS support, count_if(ie AND idd) AS tp, count_if(idd AND NOT ie) AS fp, count_if(ie AND NOT idd) AS fn FROM (SELECT c, rule, bool_or(s = 'e') AS ie, bool_or(s = 'd') AS idd FROM (SELECT *, 'e' AS s FROM e UNION ALL SELECT *, 'd' FROM d) GROUP BY 1, 2) GROUP BY rule")
       + _SCORES_SQL + f" SELECT rule, support, tp, fp, fn, {_SHOWN} FROM s")
def _(t: Tables):
    expected = t.findings.filter("sif_potential AND life_saving_rule IS NOT NULL").select(F.col("report_pk").alias("case_id"), F.col("life_saving_rule").alias("rule"))
    orders = t.raw("orders").filter("o_totalprice > 300000 AND o_orderkey % 3 <> 0").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return me.rule_metrics(expected, orders.select(F.col("o_orderkey").alias("case_id"), F.col("c_mktsegment").alias("rule")))


@query("f14_language_metrics", f"WITH m AS (SELECT lang, {_M} FROM labels JOIN documents USING (doc_id) GROUP BY 1), {_SCORES_SQL} SELECT lang, tp, fp, fn, tn, {_SHOWN}{_ACC} FROM s")
def _(t: Tables):
    return me.with_scores(me.confusion(_labels(t), F.col("truth"), F.col("predicted"), ["lang"]))


_FOLD_SQL = "f AS (SELECT doc_id, quality, toxic, lang, (row_number() OVER (PARTITION BY quality, lang ORDER BY doc_id) - 1) % 5 AS fold FROM labels JOIN documents USING (doc_id))"


def _folds(t: Tables):
    rows = _labels(t)
    return rows.join(ds.stratified_folds(rows, ["quality", "lang"], "doc_id", 5).select("doc_id", "fold"), "doc_id")


@query("g7_stratified_folds", f"WITH {_FOLD_SQL} SELECT doc_id, fold FROM f")
def _(t: Tables):
    return _folds(t).select("doc_id", "fold")


@query("f15_fold_statistics", f"WITH {_FOLD_SQL}, m AS (SELECT fold, {_M} FROM f GROUP BY 1), {_SCORES_SQL}, a AS (SELECT CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 3) ELSE 0 END AS accuracy FROM s) "
       "SELECT round(avg(accuracy), 3) AS mean, round(stddev_pop(accuracy), 3) AS std, round(min(accuracy), 3) AS min, round(max(accuracy), 3) AS max, "
       "round(avg(accuracy) - 1.96::DOUBLE * stddev_pop(accuracy) / sqrt(count(*)), 3) AS ci95_low, round(avg(accuracy) + 1.96::DOUBLE * stddev_pop(accuracy) / sqrt(count(*)), 3) AS ci95_high FROM a")
def _(t: Tables):
    per = me.with_scores(me.confusion(_folds(t), F.col("truth"), F.col("predicted"), ["fold"]))
    return me.fold_statistics(per, "accuracy")


@query("f16_f2_by_source", f"WITH m AS (SELECT source, {_M} FROM labels JOIN documents USING (doc_id) GROUP BY 1), {_SCORES_SQL} SELECT source, {_SHOWN} FROM s")
def _(t: Tables):
    return me.with_scores(me.confusion(_labels(t), F.col("truth"), F.col("predicted"), ["source"])).select("source", "precision", "recall", "f1", "f2")


@query("m7_threshold_sweep", f"WITH x AS (SELECT quality, round((n_chars % 100) / 100.0::DOUBLE, 2) AS score, t AS threshold FROM labels JOIN documents USING (doc_id), (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE)) v(t)), "
       "m AS (SELECT threshold, count_if(quality = 1 AND score >= threshold) AS tp, count_if(quality <> 1 AND score >= threshold) AS fp, count_if(quality = 1 AND score < threshold) AS fn, count_if(quality <> 1 AND score < threshold) AS tn FROM x GROUP BY 1), "
       + _SCORES_SQL + f" SELECT threshold, tp, fp, fn, tn, {_SHOWN}{_ACC} FROM s")
def _(t: Tables):
    scored = t.raw("labels").join(t.raw("documents"), "doc_id").select("quality", F.round((F.col("n_chars") % 100) / F.lit(100.0), 2).alias("score"))
    return me.threshold_sweep(scored, "quality", "score", [0.3, 0.4, 0.5, 0.6])


@query("f17_quality_profile", """WITH x AS (SELECT source, text, lang, length(text) AS c, row_number() OVER (PARTITION BY source ORDER BY length(text)) - 1 AS rk, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE length(trim(text)) > 0)
SELECT d.source, d.raw_rows, d.with_text, d.missing_lang, x.median_chars, x.mean_chars, x.p90_chars, x.max_chars FROM
 (SELECT source, count(*) AS raw_rows, count_if(length(trim(text)) > 0) AS with_text, count_if(length(trim(text)) > 0 AND coalesce(trim(lang), '') = '') AS missing_lang FROM documents GROUP BY 1) d
 LEFT JOIN (SELECT source, max(CASE WHEN rk = n // 2 THEN c END) AS median_chars, round(avg(c), 0) AS mean_chars, max(CASE WHEN rk = CAST(floor(n * 0.9::DOUBLE) AS BIGINT) THEN c END) AS p90_chars, max(c) AS max_chars FROM x GROUP BY 1) x USING (source)""")
def _(t: Tables):
    return ds.quality_profile(t.raw("documents"), "source", "text", ["lang"])


@query("f18_source_statistics", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS ids, count(*) - count(DISTINCT l_orderkey) AS repeated FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12")
def _(t: Tables):
    stats = t.raw("lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("ids"))
    return stats.withColumn("repeated", F.col("n") - F.col("ids")).orderBy(F.desc("n"), "l_returnflag").limit(12)


@query("f20_rebuilt_texts", "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS description, count(*) AS line_count FROM conversations GROUP BY 1")
def _(t: Tables):
    return ds.rebuild_text(t.raw("conversations"), "conv_id", "turn", F.col("text"), " ").select("conv_id", F.md5("description").alias("description"), "line_count")


@query("f20_rebuild_statistics", "SELECT sum(n)::BIGINT AS line_rows, count(*) AS documents, count_if(n > 1) AS multi_line, count_if(n = 1) AS single_line, count_if(NOT t) AS zero_text, max(n) AS max_lines FROM (SELECT count(*) AS n, bool_or(trim(text) <> '') AS t FROM conversations GROUP BY conv_id)")
def _(t: Tables):
    return ds.rebuild_statistics(t.raw("conversations"), "conv_id", "text")


# ---- G / L: dataset building --------------------------------------------------------

_SPLIT_SQL = """i AS (SELECT o_custkey, arg_max(o_totalprice > 350000, o_orderkey) AS stratum FROM orders GROUP BY 1),
b AS (SELECT o_custkey, (row_number() OVER (PARTITION BY stratum ORDER BY o_custkey) - 1) % 10 AS b FROM i),
s AS (SELECT o_orderkey, o_custkey, o_totalprice > 350000 AS sif, CASE WHEN b <= 5 THEN 'train' WHEN b <= 7 THEN 'validation' ELSE 'test' END AS split FROM orders JOIN b USING (o_custkey))"""


def _grouped(t: Tables):
    rows = t.raw("orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") > 350000).alias("sif"))
    return ds.grouped_split(rows, "o_custkey", "sif", "o_orderkey")


@query("g8_grouped_split", f"WITH {_SPLIT_SQL} SELECT DISTINCT o_custkey, split FROM s")
def _(t: Tables):
    return _grouped(t).select("o_custkey", "split").distinct()


@query("l11_split_rows", f"WITH {_SPLIT_SQL} SELECT o_orderkey, split FROM s")
def _(t: Tables):
    return _grouped(t).select("o_orderkey", "split")


@query("f19_split_statistics", f"WITH {_SPLIT_SQL} SELECT split, count(*) AS n, count_if(sif) AS sif FROM s GROUP BY 1")
def _(t: Tables):
    return _grouped(t).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("sif").alias("sif"))


@query("g9_fraction_split", """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '42'), doc_id) - 1 AS p, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN p < round(n * 0.6::DOUBLE) THEN 'training' WHEN p < round(n * 0.6::DOUBLE) + round(n * 0.2::DOUBLE) THEN 'validation' ELSE 'testing' END AS split FROM r""")
def _(t: Tables):
    return ds.fraction_split(t.raw("labels"), "quality", "doc_id")


@query("g10_priority_dedupe", "WITH f AS (SELECT doc_id, source, " + FP_SQL.format("text") + """ AS fp, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS rk FROM documents)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY rk, doc_id) AS rn FROM f) WHERE rn = 1""")
def _(t: Tables):
    lang = F.col("lang")
    rank = F.when(lang == "en", 0).when(lang == "fr", 1).when(lang == "de", 2).otherwise(3)
    return dd.dedupe_by_priority(t.raw("documents"), "text", rank, "doc_id").select("doc_id", "source")


@query("l6_sample_per_source", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '42'), o_orderkey) AS rn FROM orders) WHERE rn <= 1500")
def _(t: Tables):
    return ds.sample_per_group(t.raw("orders"), "o_orderpriority", "o_orderkey", 1500).select("o_orderkey", "o_orderpriority")


@query("l7_reservoir", "SELECT event_id FROM events ORDER BY md5(event_id || '42'), event_id LIMIT 1000")
def _(t: Tables):
    return ds.reservoir(t.raw("events").select("event_id"), "event_id", 1000)


@query("l8_balanced_sample", "SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '42'), doc_id) AS rn FROM labels) WHERE rn <= 150")
def _(t: Tables):
    return ds.sample_per_group(t.raw("labels"), "quality", "doc_id", 150).select("doc_id", "quality")


@query("l9_exact_dedupe", r"SELECT count(*) AS total, count(DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS kept FROM documents")
def _(t: Tables):
    keys = t.raw("documents").select(tx.description_hash(F.col("text")).alias("h"))
    return keys.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("h").alias("kept"))


@query("l3_abstract_rows", f"SELECT 'OSHA-ABS-' || conv_id AS report_id, 'Fatality' AS actual_severity, {collapsed('joined')} AS description, 'osha_abstract' AS source_name FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id)")
def _(t: Tables):
    lines = t.raw("conversations").select(F.col("conv_id").cast("string").alias("SUMMARY_NR"), F.col("turn").cast("string").alias("LINE_NR"), F.col("text").alias("ABSTRACT_TEXT"))
    return ds.map_abstract_lines(lines).select("report_id", "actual_severity", "description", "source_name")


@query("l1_mine_accidents", """SELECT 'MSHA-' || o_custkey || '-' || strftime(o_orderdate, '%d/%m/%Y') || '-' || o_orderkey AS report_id, o_custkey || '|' || strftime(o_orderdate, '%d/%m/%Y') || '|' || o_orderkey AS incident_id,
  'MSHA mine accident' AS report_type, CASE WHEN o_orderkey % 4 <> 0 THEN 'Operator ' || o_custkey ELSE 'Owner ' || o_custkey END AS site_name, strftime(o_orderdate, '%Y-%m-%d') AS date_reported,
  o_orderpriority AS activity, o_orderstatus || ' ' || o_orderkey AS description, 'DAYS AWAY' AS actual_severity, 'UG ' || o_orderstatus AS location_detail, 'msha' AS source_name FROM orders""")
def _(t: Tables):
    raw = t.raw("orders").select(F.col("o_custkey").alias("MINE_ID"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("AI_DT"), F.col("o_orderkey").alias("DOCUMENT_NO"),
                                 F.col("o_orderpriority").alias("AI_ACTY_DESC"), F.concat("o_orderstatus", F.lit("  \t"), "o_orderkey").alias("AI_NARR"),
                                 F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("Operator "), "o_custkey")).alias("OPERATOR_NAME"), F.concat(F.lit("Owner "), "o_custkey").alias("CONTROLLER_NAME"),
                                 F.lit(" DAYS AWAY ").alias("INJ_DEGR_DESC"), F.concat(F.lit("UG "), "o_orderstatus").alias("UG_LOCATION"))
    return ds.map_mine_accidents(raw)


@query("l2_incident_summaries", "SELECT 'OSHA-SUM-' || event_id AS report_id, CASE WHEN event_type = 'error' THEN 'Fatality' ELSE '' END AS actual_severity, strftime(ts, '%Y-%m-%d') AS date_reported, " + collapsed("props") + " AS description, 'OSHA incident summary' AS report_type, 'osha_summary' AS source_name FROM events")
def _(t: Tables):
    raw = t.raw("events").select(F.col("event_id").alias("SUMMARY_NR"), F.col("ts").cast("string").alias("EVENT_DATE"), F.col("props").alias("EVENT_DESC"),
                                 F.when(F.col("event_type") == "error", "x").alias("FATALITY"))
    return ds.map_incident_summaries(raw).select("report_id", "actual_severity", "date_reported", "description", "report_type", "source_name")


@query("l4_offshore_incidents", """SELECT 'BSEE-' || l_orderkey || '.' || l_linenumber AS report_id, CASE WHEN l_linenumber = 7 THEN 'Fatality' WHEN l_quantity > 25 THEN 'Injury' ELSE '' END AS actual_severity,
  concat_ws(' / ', CASE WHEN l_returnflag = 'R' THEN 'Drilling' END, CASE WHEN l_linestatus = 'O' THEN 'Pipeline' END) AS activity, l_returnflag AS description, 'bsee' AS source_name FROM lineitem""")
def _(t: Tables):
    yes = lambda c: F.when(c, "Y").otherwise("N")
    raw = t.raw("lineitem").select(
        F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("SN_EV_MASTERS"),
        F.when(F.col("l_linenumber") == 7, 1).alias("Operator Fatalities"), F.when(F.col("l_quantity") > 25, "1.0").otherwise("none").alias("Contractor Number of Other Injuries"),
        yes(F.col("l_returnflag") == "R").alias("Drilling"), yes(F.col("l_linestatus") == "O").alias("Pipeline"), F.col("l_returnflag").alias("Incident Summary"))
    return ds.map_offshore_incidents(raw).select("report_id", "actual_severity", "activity", "description", "source_name")


@query("l5_origin_columns", """SELECT doc_id, CASE WHEN contains(lower(text), 'near miss') OR contains(lower(text), 'near-miss') OR doc_id % 6 = 0 THEN 'Near miss' ELSE '' END AS report_type,
  CASE WHEN coalesce(lang, '') <> '' THEN 'original' ELSE 'unknown' END AS lang_origin, CASE WHEN doc_id % 2 = 0 THEN 'original' ELSE 'unknown' END AS site_origin FROM documents""")
def _(t: Tables):
    rows = t.raw("documents").withColumns({"site": F.when(F.col("doc_id") % 2 == 0, F.col("source")), "degree": F.when(F.col("doc_id") % 6 == 0, "Accident only")})
    return ds.with_origins(rows, ["lang", "site"]).select("doc_id", ds.near_miss_type(F.col("degree"), F.col("text")).alias("report_type"), "lang_origin", "site_origin")


@query("l10_flat_outputs")
def _(t: Tables):
    flat = ds.flat_outputs(na.analyze(t.texts).filter("processing_status = 'analyzed'"))
    return flat.select("doc_id", "equipment_text", "barrier_text", "lsr", "sif_label", "precursor", "sif_probability", "short_summary")


@query("l12_text_variants")
def _(t: Tables):
    seeds = t.texts.select("doc_id", F.col("source").alias("rule"), "report_text").filter(F.trim("report_text") != "")
    return ds.text_variants(seeds, "report_text", "doc_id", "rule", 3).select("doc_id", "rule", "variant", F.md5("variant_text").alias("variant_text"))


@query("l13_label_balance", "SELECT doc_id, CASE WHEN doc_id % 10 < 3 THEN 'Yes' ELSE 'No' END AS sif_potential FROM documents")
def _(t: Tables):
    return t.raw("documents").select("doc_id", F.when(F.col("doc_id") % 10 < 3, "Yes").otherwise("No").alias("sif_potential"))
