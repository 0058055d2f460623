"""Queries on stored reports: registry, joins, aggregates, trends, rankings, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazardlake.operators import analytics as an
from hazardlake.operators import dedupe as dd
from hazardlake.operators import registry as rg
from hazardlake.plans.catalog import query, views
from hazardlake.sources.tables import RULES, Tables

_RULES_SQL = ", ".join(f"({n}, '{r}')" for n, r in enumerate(RULES))


def _joined_list(column: str):
    return F.concat_ws("|", column).alias(column)


# ---- A / D: scans and registry --------------------------------------------

@query("a6_table_scan", views("reports") + "SELECT id, report_id, site, date, processing_status FROM reports WHERE site = 'NATION_3' OR id % 1000 = 1")
def _(t: Tables):
    return t.reports.filter((F.col("site") == "NATION_3") | (F.col("id") % 1000 == 1)).select(
        "id", "report_id", "site", "date", "processing_status")


@query("d1_registry_filter", views("reports", "findings") + """
SELECT id, report_id, site, priority, life_saving_rule FROM reports JOIN findings ON id = report_pk
WHERE contains(lower(activity), 'urgent') AND contains(lower(report_text), 'order 1') AND source = 'upload:BUILDING'
  AND priority = 'HIGH' AND sif_potential""")
def _(t: Tables):
    hits = rg.filter_registry(t.reports, t.findings, activity="Urgent", q="order 1", source="upload:BUILDING", priority="high", sif=True)
    return hits.select("id", "report_id", "site", "priority", "life_saving_rule")


@query("d2_barrier_filter", views("reports", "analyses") + """
SELECT id, report_id, array_to_string(barrier_failure, '|') AS barrier_failure FROM reports JOIN analyses ON id = report_pk
WHERE len(list_filter(barrier_failure, lambda x: contains(lower(x), 'brand#1'))) > 0""")
def _(t: Tables):
    return rg.filter_registry(t.reports, t.analyses, barrier="BRAND#1").select("id", "report_id", _joined_list("barrier_failure"))


@query("d3_status_pending", views("reports", "reviews") + "SELECT id, report_id FROM reports r WHERE NOT EXISTS (SELECT 1 FROM reviews v WHERE v.report_pk = r.id)")
def _(t: Tables):
    return rg.filter_status(t.reports, t.reviews, "pending").select("id", "report_id")


@query("d3_status_confirmed", views("reports", "reviews") + """
SELECT id, report_id FROM reports JOIN (SELECT report_pk, arg_max(coalesce(decision, '-'), id) AS d FROM reviews GROUP BY 1) l ON l.report_pk = reports.id
WHERE d = 'confirmed'""")
def _(t: Tables):
    return rg.filter_status(t.reports, t.reviews, "confirmed").select("id", "report_id")


@query("d4_full_field_search", views("reports", "findings") + """
SELECT id, report_id FROM reports JOIN findings ON id = report_pk
WHERE contains(lower(concat_ws(' ', report_text, report_id, source_id, site, analysis_activity, report_type, life_saving_rule, hazard)), 'hazard p')""")
def _(t: Tables):
    joined = rg.with_analysis(t.reports, t.findings)
    columns = ["report_text", "report_id", "source_id", "site", "analysis_activity", "report_type", "life_saving_rule", "hazard"]
    return rg.search_fields(joined, "Hazard P", columns).select("id", "report_id")


@query("d5_client_filters", views("reports", "findings", "reviews") + """,
l AS (SELECT report_pk, arg_max(coalesce(decision, '-'), id) AS d FROM reviews GROUP BY 1)
SELECT id, coalesce(nullif(f.analysis_activity, ''), r.activity) AS effective_activity, d AS review_status
FROM reports r JOIN findings f ON r.id = f.report_pk JOIN l ON l.report_pk = r.id
WHERE report_type = 'Near miss' AND d IN ('confirmed', 'reviewed', 'edited')
  AND coalesce(nullif(f.analysis_activity, ''), r.activity) = '5-LOW'""")
def _(t: Tables):
    rows = rg.review_status(rg.with_analysis(t.reports, t.findings), t.reviews)
    effective = F.coalesce(F.nullif("analysis_activity", F.lit("")), "activity")
    return rows.withColumn("effective_activity", effective).filter(
        (F.col("report_type") == "Near miss") & F.col("review_status").isin(rg.VERIFIED)
        & (F.col("effective_activity") == "5-LOW")).select("id", "effective_activity", "review_status")


_STATUS_SQL = """,
l AS (SELECT report_pk, max(id) AS rid, arg_max(coalesce(decision, '-'), id) AS d FROM reviews GROUP BY 1),
s AS (SELECT r.*, f.sif_potential, f.priority, f.report_pk AS fpk, CASE WHEN l.rid IS NULL THEN 'pending' ELSE nullif(l.d, '-') END AS review_status
  FROM reports r LEFT JOIN findings f ON r.id = f.report_pk LEFT JOIN l ON l.report_pk = r.id)
"""


@query("d6_named_views", views("reports", "findings", "reviews") + _STATUS_SQL + """
SELECT 'all' AS view_name, count(*) AS n FROM s UNION ALL SELECT 'sif', count(*) FROM s WHERE sif_potential
UNION ALL SELECT 'high', count(*) FROM s WHERE priority = 'HIGH'
UNION ALL SELECT 'pending', count(*) FROM s WHERE review_status = 'pending' AND processing_status = 'analyzed'
UNION ALL SELECT 'verified', count(*) FROM s WHERE review_status IN ('confirmed', 'reviewed', 'edited')
UNION ALL SELECT 'rejected', count(*) FROM s WHERE review_status = 'rejected'""")
def _(t: Tables):
    rows = rg.review_status(rg.with_analysis(t.reports, t.findings, "left"), t.reviews)
    return rg.view_counts(rows)


@query("d5_duplicates_only", views("reports", "findings", "reviews") + _STATUS_SQL + """, k AS (SELECT id, trim(regexp_replace(lower(site || ' ' || activity), '[^a-z0-9]+', ' ', 'g')) AS fp FROM s WHERE review_status = 'rejected'),
d AS (SELECT id, min(id) OVER (PARTITION BY fp) AS first_id FROM k WHERE length(fp) >= 8) SELECT id, first_id FROM d WHERE id <> first_id""")
def _(t: Tables):
    # reports of one view whose text another one has already
    rows = rg.view(rg.review_status(rg.with_analysis(t.reports, t.findings, "left"), t.reviews), "rejected").withColumn("said", F.concat(F.col("site"), F.lit(" "), F.col("activity")))
    return dd.duplicate_groups(rows, "said", "id").filter(F.col("id") != F.col("first_id")).select("id", "first_id")


@query("d7_facets", views("reports", "findings", "barrier_rows") + """
SELECT 'rule' AS facet, life_saving_rule AS value FROM findings WHERE life_saving_rule IS NOT NULL GROUP BY 2
UNION ALL SELECT 'hazard', hazard FROM findings WHERE hazard IS NOT NULL GROUP BY 2
UNION ALL SELECT 'barrier', barrier FROM barrier_rows GROUP BY 2
UNION ALL SELECT 'report_type', report_type FROM reports WHERE report_type IS NOT NULL GROUP BY 2
UNION ALL SELECT 'source', source FROM reports GROUP BY 2
UNION ALL SELECT 'site', site FROM reports WHERE site IS NOT NULL GROUP BY 2
UNION ALL SELECT 'activity', activity FROM reports GROUP BY 2""")
def _(t: Tables):
    of_reports = rg.facet_values(t.reports, ["report_type", "source", "site", "activity"])
    of_findings = rg.facet_values(t.findings.select(F.col("life_saving_rule").alias("rule"), "hazard"), ["rule", "hazard"])
    barriers = t.barrier_rows.select(F.lit("barrier").alias("facet"), F.col("barrier").alias("value")).distinct()
    return of_reports.unionByName(of_findings).unionByName(barriers)


@query("d8_export_projection", views("reports", "findings", "reviews") + _STATUS_SQL + """
SELECT s.report_id AS "Report ID", coalesce(CAST(s.date AS VARCHAR), '') AS "Date", coalesce(s.site, '') AS "Site",
  CASE WHEN s.sif_potential IS NULL THEN '' WHEN s.sif_potential THEN 'Yes' ELSE 'No' END AS "SIF",
  coalesce(s.priority, '') AS "Priority", coalesce(s.review_status, '') AS "Status",
  CASE WHEN f.confidence IS NULL THEN '' ELSE printf('%.2f', f.confidence) END AS "Confidence",
  CASE WHEN f.analysis_activity IS NOT NULL AND f.analysis_activity <> s.activity THEN 'Y' ELSE 'N' END AS "Modified (Y/N)"
FROM s LEFT JOIN findings f ON f.report_pk = s.id""")
def _(t: Tables):
    rows = rg.review_status(rg.with_analysis(t.reports, t.findings, "left"), t.reviews)
    changed = F.col("analysis_activity").isNotNull() & (F.col("analysis_activity") != F.col("activity"))
    modified = F.filter(F.array(F.struct(F.lit("activity").alias("field"), changed.alias("changed"))), lambda m: m["changed"])
    shaped = rows.withColumn("modified", F.when(F.size(modified) > 0, "Y").otherwise("N"))
    names = {"report_id": "Report ID", "date": "Date", "site": "Site", "sif_potential": "SIF", "priority": "Priority",
             "review_status": "Status", "confidence": "Confidence", "modified": "Modified (Y/N)"}
    out = rg.export_rows(shaped, list(names))
    return out.select(*[F.col(c).alias(n) for c, n in names.items()])


@query("d9_review_queue", views("reports", "findings", "reviews") + _STATUS_SQL + """
SELECT id, date, priority, sif_potential, (CASE priority WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END) * 100
  + CASE WHEN sif_potential THEN 0 ELSE 10 END AS queue_rank
FROM s WHERE fpk IS NOT NULL AND processing_status = 'analyzed' AND review_status = 'pending'
ORDER BY queue_rank, date DESC NULLS LAST, id""")
def _(t: Tables):
    queue = rg.review_queue(rg.review_status(rg.with_analysis(t.reports, t.findings), t.reviews))
    return queue.orderBy("queue_rank", F.desc_nulls_last("date"), "id").select(
        "id", "date", "priority", "sif_potential", "queue_rank")


@query("d10_field_coverage", views("reports", "analyses") + """
, w AS (SELECT r.*, f.analysis_activity, f.hazard, f.priority, f.life_saving_rule, f.sif_potential, f.confidence, f.barrier_failure FROM reports r LEFT JOIN analyses f ON r.id = f.report_pk),
u AS (
  SELECT id, 'date' AS field, CAST(date AS VARCHAR) AS given, NULL AS inferred FROM w
  UNION ALL SELECT id, 'site', site, NULL FROM w UNION ALL SELECT id, 'activity', activity, analysis_activity FROM w
  UNION ALL SELECT id, 'report_type', report_type, NULL FROM w UNION ALL SELECT id, 'source_id', source_id, NULL FROM w
  UNION ALL SELECT id, 'hazard', CASE WHEN id % 13 = 0 THEN 'Hazard of the file' END, hazard FROM w UNION ALL SELECT id, 'priority', NULL, priority FROM w
  UNION ALL SELECT id, 'rule', NULL, life_saving_rule FROM w UNION ALL SELECT id, 'barrier_failure', NULL, array_to_string(barrier_failure, ', ') FROM w
  UNION ALL SELECT id, 'location', NULL, CASE WHEN id % 2 = 0 THEN 'bay ' || id % 9 END FROM w
  UNION ALL SELECT id, 'equipment', CASE WHEN id % 17 = 0 THEN 'crane, hoist' END, CASE WHEN id % 3 = 0 THEN 'pump, valve' ELSE '' END FROM w
  UNION ALL SELECT id, 'consequence', NULL, NULL FROM w UNION ALL SELECT id, 'sif', NULL, CASE WHEN sif_potential THEN 'Yes (flagged)' WHEN NOT sif_potential THEN 'No' END FROM w
  UNION ALL SELECT id, 'confidence', NULL, CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '%' FROM w UNION ALL SELECT id, 'languages', NULL, 'en, hi' FROM w)
SELECT id, field, coalesce(nullif(given, ''), nullif(inferred, '')) AS value,
  CASE WHEN nullif(given, '') IS NOT NULL THEN 'file' WHEN nullif(inferred, '') IS NOT NULL THEN 'ai' ELSE 'none' END AS origin FROM u""")
def _(t: Tables):
    k = F.col("id")
    rows = rg.with_analysis(t.reports, t.analyses, "left")
    change = lambda test, field, *used: F.when(test, F.struct(F.lit(field).alias("field"), F.array(*map(F.lit, used)).alias("used")))
    return rg.field_coverage(rows.withColumns({
        "location": F.when(k % 2 == 0, F.concat(F.lit("bay "), (k % 9).cast("string"))), "languages": F.array(F.lit("en"), F.lit("hi")),
        "equipment": F.when(k % 3 == 0, F.array(F.lit("pump"), F.lit("valve"))).otherwise(F.array().cast("array<string>")),
        "modified_fields": F.array_compact(F.array(change(k % 13 == 0, "hazard", "Hazard of the file"), change(k % 17 == 0, "equipment", "crane", "hoist")))}))


@query("d11_report_detail", views("reports", "findings", "reviews") + _STATUS_SQL + """
SELECT id, report_id, priority, sif_potential, review_status, d IS NOT NULL AS has_review FROM s LEFT JOIN l ON l.report_pk = s.id
WHERE report_id = 'RPT-0042'""")
def _(t: Tables):
    one = t.reports.filter(F.col("report_id") == "RPT-0042")
    shown = rg.review_status(rg.with_analysis(one, t.findings, "left"), t.reviews)
    return shown.select("id", "report_id", "priority", "sif_potential", "review_status",
                        (F.coalesce(F.col("review_status"), F.lit("-")) != "pending").alias("has_review"))


@query("d14_human_label", views("reviews", "findings") + """
SELECT v.id, CASE decision WHEN 'confirmed' THEN true WHEN 'rejected' THEN false WHEN 'reviewed' THEN sif_potential END AS human_sif
FROM reviews v JOIN findings f ON v.report_pk = f.report_pk""")
def _(t: Tables):
    rows = t.reviews.join(t.findings, "report_pk")
    return rows.select("id", rg.human_sif(F.col("decision"), F.col("sif_potential")).alias("human_sif"))


@query("d15_kpi_rows", views("reports", "findings") + """,
k AS (SELECT count(*) AS total, count_if(sif_potential) AS sif, count_if(priority = 'HIGH') AS high FROM reports LEFT JOIN findings ON id = report_pk),
u AS (SELECT 'Total reports' AS metric, total AS value FROM k UNION ALL SELECT 'SIF potential', sif FROM k UNION ALL SELECT 'High priority', high FROM k)
SELECT metric, value, round(100.0::DOUBLE * value / max(value) OVER (), 1) AS bar FROM u""")
def _(t: Tables):
    kpi = an.overview(t.reports, t.findings)
    pairs = [("Total reports", "total_reports"), ("SIF potential", "sif_reports"), ("High priority", "high_reports")]
    rows = kpi.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in pairs])).alias("p"))
    top = F.max("value").over(Window.partitionBy())  # three rows
    return rows.select("p.metric", "p.value").withColumn("bar", F.round(F.lit(100.0) * F.col("value") / top, 1))


@query("d17_data_note", views("reports", "findings") + """,
k AS (SELECT count(*) AS total, count_if(is_demo) AS demo FROM reports)
SELECT total AS total_reports, demo || ' demo reports among ' || total || '.' AS note FROM k""")
def _(t: Tables):
    kpi = an.overview(t.reports, t.findings)
    return kpi.select("total_reports", an.data_note(F.col("total_reports"), F.col("demo_reports")).alias("note"))


# ---- E: joins --------------------------------------------------------------

@query("e1_inner_join", views("reports", "findings") + "SELECT id, report_id, priority, confidence FROM reports JOIN findings ON id = report_pk")
def _(t: Tables):
    return rg.with_analysis(t.reports, t.findings).select("id", "report_id", "priority", "confidence")


@query("e2_outer_join", views("reports", "findings") + "SELECT id, processing_status, priority, sif_potential FROM reports LEFT JOIN findings ON id = report_pk")
def _(t: Tables):
    return rg.with_analysis(t.reports, t.findings, "left").select("id", "processing_status", "priority", "sif_potential")


@query("e3_anti_join", views("reports", "reviews") + "SELECT site, count(*) AS unreviewed FROM reports WHERE id NOT IN (SELECT report_pk FROM reviews) GROUP BY site")
def _(t: Tables):
    return rg.filter_status(t.reports, t.reviews, "pending").groupBy("site").agg(F.count(F.lit(1)).alias("unreviewed"))


@query("e4_latest_review", views("reviews") + """
SELECT report_pk, id AS review_id, reviewer, decision, comments FROM (
  SELECT *, row_number() OVER (PARTITION BY report_pk ORDER BY id DESC) AS rn FROM reviews) WHERE rn = 1""")
def _(t: Tables):
    return rg.latest_review(t.reviews).select("report_pk", "review_id", "reviewer", "decision", "comments")


@query("e6_reports_with_decision", views("reports", "reviews") + """
SELECT count(DISTINCT r.id) AS verified_reports FROM reports r JOIN reviews v ON v.report_pk = r.id WHERE v.decision IN ('confirmed', 'reviewed', 'edited')""")
def _(t: Tables):
    decided = t.reviews.filter(F.col("decision").isin(rg.VERIFIED)).select(F.col("report_pk").alias("id"))
    return t.reports.join(decided, "id", "left_semi").agg(F.count(F.lit(1)).alias("verified_reports"))


@query("e7_feedback_reports", views("reports", "reviews", "findings") + """
SELECT v.id, r.report_id, v.decision, f.sif_potential AS ai_sif FROM reviews v JOIN reports r ON r.id = v.report_pk LEFT JOIN findings f ON f.report_pk = v.report_pk""")
def _(t: Tables):
    named = t.reviews.join(t.reports.select(F.col("id").alias("report_pk"), "report_id"), "report_pk")
    return named.join(t.findings.select("report_pk", F.col("sif_potential").alias("ai_sif")), "report_pk", "left").select(
        "id", "report_id", "decision", "ai_sif")


@query("e8_summary_abstract_join", """
WITH s AS (SELECT event_id AS sid, event_type || ' event' AS event FROM events),
a AS (SELECT conv_id AS sid, string_agg(trim(text), ' ' ORDER BY turn) AS abstract FROM conversations GROUP BY 1)
SELECT sid, CASE WHEN abstract IS NOT NULL AND NOT contains(lower(abstract), lower(event)) THEN length(event || ' ' || abstract)
  ELSE length(coalesce(abstract, event)) END AS description_length FROM s LEFT JOIN a USING (sid)""")
def _(t: Tables):
    from hazardlake.operators.datasets import join_abstracts, rebuild_text
    summaries = t.raw("events").select(F.col("event_id").alias("sid"), F.concat("event_type", F.lit(" event")).alias("event"))
    abstracts = rebuild_text(t.raw("conversations"), "conv_id", "turn", F.trim("text"), " ").select(
        F.col("conv_id").alias("sid"), F.col("description").alias("abstract"))
    return join_abstracts(summaries, abstracts, "sid", "event", "abstract").select(
        "sid", F.length("description").alias("description_length"))


# ---- F: aggregates ---------------------------------------------------------

@query("f1_overview", views("reports", "findings") + """
SELECT count(*) AS total_reports, count_if(sif_potential) AS sif_reports, count_if(priority = 'HIGH') AS high_reports,
  count_if(is_demo) AS demo_reports, max(created_at) AS latest_created, round(100.0::DOUBLE * count_if(sif_potential) / count(*), 1) AS sif_density
FROM reports LEFT JOIN findings ON id = report_pk""")
def _(t: Tables):
    return an.overview(t.reports, t.findings)


@query("f2_top_rule", views("findings") + "SELECT life_saving_rule, count(*) AS n FROM findings WHERE life_saving_rule IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(t: Tables):
    return an.mode(t.findings, "life_saving_rule")


@query("f3_top_barrier", views("barrier_rows") + "SELECT barrier, count(*) AS n FROM barrier_rows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(t: Tables):
    return an.mode(t.barrier_rows, "barrier")


@query("f4_rule_distribution", views("findings") + f""",
spine(rule_order, rule) AS (VALUES {_RULES_SQL}),
c AS (SELECT life_saving_rule AS rule, count(*) AS n, count_if(sif_potential) AS sif FROM findings GROUP BY 1)
SELECT rule_order, rule, coalesce(n, 0) AS report_count, coalesce(sif, 0) AS sif_count,
  round(100.0::DOUBLE * coalesce(sif, 0) / sum(coalesce(sif, 0)) OVER (), 1) AS percentage FROM spine LEFT JOIN c USING (rule)""")
def _(t: Tables):
    return an.rule_distribution(t.findings, RULES)


def _top_sql(source: str, group: str, value: str, name: str) -> str:
    return f"""{name} AS (SELECT {group}, string_agg({value}, '|' ORDER BY n DESC, {value}) AS {name} FROM (
  SELECT {group}, {value}, count(*) AS n, row_number() OVER (PARTITION BY {group} ORDER BY count(*) DESC, {value}) AS rn
  FROM {source} WHERE {value} IS NOT NULL GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1)"""


@query("f5_site_risk", views("reports", "findings") + """,
x AS (SELECT site, hazard, life_saving_rule, priority FROM reports JOIN findings ON id = report_pk WHERE sif_potential AND site IS NOT NULL),
""" + _top_sql("x", "site", "hazard", "main_hazards") + ",\n" + _top_sql("x", "site", "life_saving_rule", "main_rules") + """
SELECT site, n, high, coalesce(main_hazards, '') AS main_hazards, coalesce(main_rules, '') AS main_rules
FROM (SELECT site, count(*) AS n, count_if(priority = 'HIGH') AS high FROM x GROUP BY 1) LEFT JOIN main_hazards USING (site) LEFT JOIN main_rules USING (site)""")
def _(t: Tables):
    return an.site_risk(t.reports, t.findings).select("site", "n", "high", _joined_list("main_hazards"), _joined_list("main_rules"))


@query("f6_activity_risk", views("findings", "barrier_rows") + """,
x AS (SELECT report_pk, coalesce(nullif(analysis_activity, ''), 'Not specified') AS activity, hazard, life_saving_rule, priority FROM findings WHERE sif_potential),
y AS (SELECT activity, barrier FROM x JOIN barrier_rows USING (report_pk)),
""" + _top_sql("x", "activity", "hazard", "main_hazards") + ",\n" + _top_sql("y", "activity", "barrier", "main_barriers") + ",\n"
       + _top_sql("x", "activity", "life_saving_rule", "main_rules") + """
SELECT activity, n, n_high, n_medium, n_low, main_hazards, main_barriers, main_rules FROM (
  SELECT activity, count(*) AS n, count_if(priority = 'HIGH') AS n_high, count_if(priority = 'MEDIUM') AS n_medium, count_if(priority = 'LOW') AS n_low FROM x GROUP BY 1)
LEFT JOIN main_hazards USING (activity) LEFT JOIN main_barriers USING (activity) LEFT JOIN main_rules USING (activity)""")
def _(t: Tables):
    out = an.activity_risk(t.findings, t.barrier_rows)
    return out.select("activity", "n", "n_high", "n_medium", "n_low", *[_joined_list(c) for c in ("main_hazards", "main_barriers", "main_rules")])


@query("f6_priority_map", views("findings") + """
SELECT activity, string_agg(level || '=' || n, ',' ORDER BY level) AS priority_distribution FROM (
  SELECT coalesce(nullif(analysis_activity, ''), 'Not specified') AS activity, coalesce(priority, 'LOW') AS level, count(*) AS n
  FROM findings WHERE sif_potential GROUP BY 1, 2) GROUP BY 1""")
def _(t: Tables):
    pairs = F.transform(F.array_sort(F.map_entries("priority_distribution")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return an.priority_map(t.findings).select("activity", F.concat_ws(",", pairs).alias("priority_distribution"))


@query("f7_barrier_analysis", views("reports", "findings", "barrier_rows") + """,
x AS (SELECT barrier, site, analysis_activity, life_saving_rule, report_pk FROM barrier_rows JOIN findings USING (report_pk) JOIN reports ON id = report_pk),
""" + _top_sql("x", "barrier", "site", "sites") + ",\n" + _top_sql("x", "barrier", "analysis_activity", "activities") + ",\n"
       + _top_sql("x", "barrier", "life_saving_rule", "rules") + """,
e AS (SELECT barrier, string_agg(CAST(report_pk AS VARCHAR), '|' ORDER BY report_pk) AS examples FROM (
  SELECT barrier, report_pk, row_number() OVER (PARTITION BY barrier ORDER BY report_pk) AS rn FROM x) WHERE rn <= 3 GROUP BY 1)
SELECT barrier, n, sites, activities, rules, examples FROM (SELECT barrier, count(*) AS n FROM x GROUP BY 1)
LEFT JOIN sites USING (barrier) LEFT JOIN activities USING (barrier) LEFT JOIN rules USING (barrier) LEFT JOIN e USING (barrier)""")
def _(t: Tables):
    out = an.barrier_analysis(t.reports, t.findings, t.barrier_rows)
    return out.select("barrier", "n", *[_joined_list(c) for c in ("sites", "activities", "rules")],
                      F.concat_ws("|", F.transform("examples", lambda e: e.cast("string"))).alias("examples"))


_PATTERN_SQL = views("findings", "barrier_rows") + """,
k AS (
  SELECT 'rule + activity' AS kind, life_saving_rule AS a, analysis_activity AS b, report_pk FROM findings
    WHERE sif_potential AND life_saving_rule IS NOT NULL AND analysis_activity IS NOT NULL
  UNION ALL SELECT 'rule + barrier', life_saving_rule, barrier, report_pk FROM findings JOIN barrier_rows USING (report_pk)
    WHERE sif_potential AND life_saving_rule IS NOT NULL
  UNION ALL SELECT 'hazard + activity', hazard, analysis_activity, report_pk FROM findings
    WHERE sif_potential AND hazard IS NOT NULL AND analysis_activity IS NOT NULL)
"""


@query("f8_patterns", _PATTERN_SQL + """,
top AS (SELECT kind, a, b, count(*) AS n FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 2 ORDER BY n DESC, kind, a, b LIMIT 20),
e AS (SELECT kind, a, b, string_agg(CAST(report_pk AS VARCHAR), '|' ORDER BY report_pk) AS examples FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, a, b ORDER BY report_pk) AS rn FROM k) WHERE rn <= 3 GROUP BY 1, 2, 3)
SELECT kind, a, b, n, examples, CASE WHEN kind = 'rule + barrier' THEN a || ' with ' || lower(b) || ' failures' ELSE a || ' during ' || lower(b) END AS title,
  CASE WHEN kind = 'rule + barrier' THEN a || ' precursors repeatedly involve failed ' || lower(b) || ' controls.'
    ELSE a || ' precursors recur during ' || lower(b) || ' activities.' END AS detail
FROM top LEFT JOIN e USING (kind, a, b)""")
def patterns_query(t: Tables):
    out = an.patterns(t.findings, t.barrier_rows)
    return out.select("kind", "a", "b", "n", F.concat_ws("|", F.transform("examples", lambda e: e.cast("string"))).alias("examples"), "title", "detail")


@query("f9_quick_counts", views("reports", "findings", "reviews") + """,
d AS (SELECT report_pk, bool_or(decision IN ('confirmed', 'reviewed', 'edited')) AS v, bool_or(decision = 'rejected') AS r FROM reviews GROUP BY 1)
SELECT count(*) AS total, count_if(processing_status = 'analyzed' AND d.report_pk IS NULL) AS pending, count_if(d.v) AS verified,
  count_if(d.r) AS rejected, count_if(processing_status = 'failed') AS failed FROM reports LEFT JOIN d ON d.report_pk = reports.id""")
def _(t: Tables):
    decision = F.col("decision")
    # One row per reviewed report, combined map-side.
    seen = t.reviews.groupBy("report_pk").agg(F.max(decision.isin(rg.VERIFIED)).alias("v"), F.max(decision == "rejected").alias("r"))
    joined = t.reports.select("id", "processing_status").join(seen, F.col("id") == F.col("report_pk"), "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((F.col("processing_status") == "analyzed") & F.col("report_pk").isNull()).alias("pending"),
        F.count_if("v").alias("verified"), F.count_if("r").alias("rejected"),
        F.count_if(F.col("processing_status") == "failed").alias("failed"))


@query("f10_status_counts", views("reports", "findings", "reviews") + _STATUS_SQL + """
SELECT coalesce(review_status, 'none') AS review_status, count(*) AS n, count_if(sif_potential) AS sif FROM s GROUP BY 1""")
def _(t: Tables):
    rows = rg.review_status(rg.with_analysis(t.reports, t.findings, "left"), t.reviews)
    return rows.groupBy(F.coalesce("review_status", F.lit("none")).alias("review_status")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("sif_potential").alias("sif"))


@query("f21_top_site_share", views("reports", "findings") + """,
x AS (SELECT site, count(*) AS n FROM reports JOIN findings ON id = report_pk WHERE sif_potential AND site IS NOT NULL GROUP BY 1)
SELECT site, n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM x), 0) AS share, (SELECT round(100.0::DOUBLE * count_if(priority = 'HIGH') / count(*), 0) FROM reports LEFT JOIN findings ON id = report_pk) AS high_share
FROM x ORDER BY n DESC, site LIMIT 1""")
def _(t: Tables):
    sites = rg.with_analysis(t.reports, t.findings).filter("sif_potential AND site IS NOT NULL").groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    # max over (n, smaller site first) and the total share one aggregate over the per-site rows.
    best = sites.agg(F.sum("n").alias("total"), F.max("n").alias("n"),
                     F.min(F.struct((-F.col("n")).alias("k"), "site")).alias("top"))
    high = an.overview(t.reports, t.findings).select(F.round(F.lit(100.0) * F.col("high_reports") / F.col("total_reports"), 0).alias("high_share"))  # one row
    return best.crossJoin(high).select(F.col("top.site").alias("site"), "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 0).alias("share"), "high_share")


# ---- G: windows and trends -------------------------------------------------

_TREND_SQL = views("reports", "findings") + """,
d AS (SELECT coalesce(date, CAST(created_at AS DATE)) AS day, sif_potential FROM reports LEFT JOIN findings ON id = report_pk),
c AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS n, count_if(sif_potential) AS sif FROM d GROUP BY 1),
s AS (SELECT 7 - b AS week_index, CAST((SELECT max(day) FROM d) - CAST(b * 7 AS INTEGER) AS DATE) AS label_day FROM range(0, 8) r(b)),
t AS (SELECT CAST(week_index AS INTEGER) AS week_index, CAST(date_trunc('week', label_day) AS DATE) AS week, strftime(label_day, '%d %b') AS period,
  coalesce(n, 0) AS report_count, coalesce(sif, 0) AS sif_count FROM s LEFT JOIN c ON c.week = CAST(date_trunc('week', label_day) AS DATE))
"""


@query("g1_weekly_trend", _TREND_SQL + "SELECT * FROM t")
def _(t: Tables):
    return an.weekly_trend(t.reports, t.findings)


@query("g2_density_trend", _TREND_SQL + """
SELECT week_index, week, CASE WHEN report_count > 0 THEN round(1000.0::DOUBLE * sif_count / report_count) / 10 ELSE 0 END AS density FROM t WHERE week_index > 3""")
def _(t: Tables):
    return an.density_trend(an.weekly_trend(t.reports, t.findings))


@query("g3_week_delta", _TREND_SQL + """
SELECT week_index, CASE WHEN lag(report_count) OVER w > 0 THEN round(100.0::DOUBLE * (report_count - lag(report_count) OVER w) / lag(report_count) OVER w, 0) END AS count_delta,
  CASE WHEN lag(sif_count) OVER w > 0 THEN round(100.0::DOUBLE * (sif_count - lag(sif_count) OVER w) / lag(sif_count) OVER w, 0) END AS sif_delta
FROM t WINDOW w AS (ORDER BY week_index)""")
def _(t: Tables):
    return an.week_delta(an.weekly_trend(t.reports, t.findings))


@query("g5_top3_hazards_per_site", views("reports", "findings") + """,
x AS (SELECT site, life_saving_rule FROM reports JOIN findings ON id = report_pk WHERE site IS NOT NULL),
""" + _top_sql("x", "site", "life_saving_rule", "top_rules") + " SELECT * FROM top_rules")
def _(t: Tables):
    rows = rg.with_analysis(t.reports, t.findings).filter("site IS NOT NULL")
    return an.top_values(rows, "site", "life_saving_rule").select("site", F.concat_ws("|", "values").alias("top_rules"))


@query("g6_first_examples", views("reports") + """
SELECT source, string_agg(CAST(id AS VARCHAR), '|' ORDER BY id) AS examples FROM (
  SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM reports) WHERE rn <= 3 GROUP BY 1""")
def _(t: Tables):
    return an.first_ids(t.reports, ["source"]).select("source", F.concat_ws("|", F.transform("examples", lambda e: e.cast("string"))).alias("examples"))


# ---- H: sorts and limits ---------------------------------------------------

@query("h1_newest_first", views("reports") + "SELECT id, date FROM reports ORDER BY date DESC NULLS LAST, id DESC LIMIT 500")
def _(t: Tables):
    return rg.newest_first(t.reports, 500).select("id", "date")


@query("h2_recent_high", views("reports", "findings") + "SELECT id, report_id, date FROM reports JOIN findings ON id = report_pk WHERE priority = 'HIGH' ORDER BY date DESC NULLS LAST, id DESC LIMIT 10")
def _(t: Tables):
    return rg.newest_first(rg.filter_registry(t.reports, t.findings, priority="HIGH"), 10).select("id", "report_id", "date")


@query("h3_natural_sort", views("reports", "findings") + """
SELECT id, source_id FROM reports LEFT JOIN findings ON id = report_pk
ORDER BY CASE priority WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, lower(regexp_extract(source_id, '^(.*?)(\\d*)$', 1)),
  CAST(regexp_extract(source_id, '(\\d+)$', 1) AS BIGINT), id""")
def _(t: Tables):
    rows = rg.with_analysis(t.reports, t.findings, "left")
    stem, number = rg.natural_key(F.col("source_id"))
    return rows.orderBy(rg.priority_rank(F.col("priority")).desc(), stem, number, "id").select("id", "source_id")


@query("h4_page", views("reports") + "SELECT id, report_id FROM reports WHERE id < 10000 ORDER BY id DESC LIMIT 50")
def _(t: Tables):
    # Keyset page: continue below the last id seen instead of skipping rows.
    return t.reports.filter(F.col("id") < 10000).orderBy(F.desc("id")).limit(50).select("id", "report_id")


@query("h5_top_sources", views("reports") + "SELECT source, count(*) AS n, max(created_at) AS latest FROM reports GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t: Tables):
    return t.reports.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("latest")).orderBy(F.desc("n"), "source").limit(10)


@query("h6_latest_row", views("reports") + "SELECT id, report_id FROM reports ORDER BY id DESC LIMIT 1")
def _(t: Tables):
    return t.reports.agg(F.max(F.struct("id", "report_id")).alias("m")).select("m.id", "m.report_id")


# ---- I: set operations -----------------------------------------------------

@query("i1_source_union", """
SELECT 'orders' AS source_name, CAST(o_orderkey AS VARCHAR) AS incident_id, o_orderpriority AS activity, NULL AS description_len FROM orders
UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), NULL, length(props) FROM events
UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), NULL, length(text) FROM documents""")
def _(t: Tables):
    orders = t.raw("orders").select(F.lit("orders").alias("source_name"), F.col("o_orderkey").cast("string").alias("incident_id"), F.col("o_orderpriority").alias("activity"))
    events = t.raw("events").select(F.lit("events").alias("source_name"), F.col("event_id").cast("string").alias("incident_id"), F.length("props").alias("description_len"))
    docs = t.raw("documents").select(F.lit("documents").alias("source_name"), F.col("doc_id").cast("string").alias("incident_id"), F.length("text").alias("description_len"))
    return orders.unionByName(events, allowMissingColumns=True).unionByName(docs, allowMissingColumns=True)


@query("i2_pattern_key_union", _PATTERN_SQL + "SELECT kind, count(*) AS n, count(DISTINCT report_pk) AS reports FROM k GROUP BY 1")
def _(t: Tables):
    return an.pattern_keys(t.findings, t.barrier_rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("report_pk").alias("reports"))


@query("i3_ordered_distinct", views("texts") + """
SELECT doc_id, len(list_distinct(string_split(lower(report_text), ' '))) AS distinct_words FROM texts""")
def _(t: Tables):
    return t.texts.select("doc_id", F.size(F.array_distinct(F.split(F.lower("report_text"), " "))).alias("distinct_words"))


@query("i5_group_difference", views("reports", "reviews") + "SELECT DISTINCT source_id FROM reports WHERE source_id NOT IN (SELECT r.source_id FROM reports r JOIN reviews v ON v.report_pk = r.id)")
def _(t: Tables):
    reviewed = t.reports.join(t.reviews.select(F.col("report_pk").alias("id")), "id", "left_semi").select("source_id")
    return t.reports.select("source_id").distinct().join(reviewed, "source_id", "left_anti")
