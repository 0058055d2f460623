"""Queries behind pages and exports: the whole export table, detail pages, shares of a sample."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hazardlake.operators import datasets as ds
from hazardlake.operators import registry as rg
from hazardlake.operators import similarity as sm
from hazardlake.operators.normalise import apply_overrides
from hazardlake.plans.catalog import query, views
from hazardlake.plans.dashboards import _STATUS_SQL
from hazardlake.plans.labels import _PAIRS_SQL, _asked, _similar_input
from hazardlake.session import shared_folder
from hazardlake.sources import files
from hazardlake.sources.tables import Tables


@query("d8_export_table", views("reports", "analyses", "reviews") + _STATUS_SQL + """
SELECT s.report_id AS "Report ID", coalesce(s.source_id, '') AS "Actual ID (file)", substr(s.source, 8) AS "Source File",
  CASE WHEN processing_status = 'failed' THEN 'Analysis failed' ELSE coalesce(CASE s.review_status WHEN 'pending' THEN 'Pending review' WHEN 'confirmed' THEN 'Confirmed' WHEN 'rejected' THEN 'Rejected'
    WHEN 'edited' THEN 'Edited' WHEN 'reviewed' THEN 'Reviewed' END, '') END AS "Status",
  CASE WHEN f.analysis_activity <> '' AND s.activity <> '' AND f.analysis_activity <> s.activity AND s.id % 3 = 0 THEN 'Y' WHEN f.hazard <> '' AND s.id % 13 = 0 THEN 'Y' ELSE 'N' END AS "Modified (Y/N)",
  coalesce(s.date::VARCHAR, '') AS "Date", coalesce(s.report_type, '') AS "Type", coalesce(s.site, '') AS "Site", coalesce(s.activity, f.analysis_activity, '') AS "Activity",
  CASE WHEN f.sif_potential THEN 'Yes' ELSE 'No' END AS "SIF-potential", coalesce(round(f.confidence * 100)::INT::VARCHAR, '') AS "Confidence (%)", coalesce(f.priority, '') AS "Priority",
  coalesce(f.life_saving_rule, '') AS "Life-Saving Rule", coalesce(array_to_string(f.barrier_failure, ' | '), '') AS "Barrier Failure",
  CASE WHEN s.id % 13 = 0 THEN 'Hazard of the file' ELSE coalesce(f.hazard, '') END AS "Hazard", s.report_text AS "Report Text" FROM s LEFT JOIN analyses f ON f.report_pk = s.id""")
def _(t: Tables):
    k = F.col("id")
    rows = rg.review_status(rg.with_analysis(t.reports, t.analyses, "left"), t.reviews)
    given = rows.withColumns({"file_activity": F.when(k % 3 == 0, F.col("activity")), "file_hazard": F.when(k % 13 == 0, "Hazard of the file")})
    return rg.export_table(apply_overrides(given, [("activity", "file_activity", "analysis_activity"), ("hazard", "file_hazard", "hazard")]))


@query("d11_detail_pages", _PAIRS_SQL + ", " + views("reviews").removeprefix("WITH ") + """,
last AS (SELECT report_pk, arg_max(coalesce(decision, '-'), id) AS d, arg_max(reviewer, id) AS reviewer, arg_max(reviewed_at, id) AS reviewed_at FROM reviews GROUP BY 1),
m AS (SELECT query_id, match_id, place, round(least(score, 0.99::DOUBLE) + 1e-9::DOUBLE, 2) AS similarity FROM top)
SELECT query_id, place, match_id, similarity, source AS site, nullif(d, '-') AS decision, reviewer, reviewed_at, CASE WHEN place = 0 AND similarity >= 0.88::DOUBLE THEN match_id END AS duplicate_of
FROM m JOIN documents ON doc_id = match_id LEFT JOIN last ON report_pk = match_id""")
def _(t: Tables):
    rows = _similar_input(t)
    near = sm.with_shared_concepts(sm.similar_reports(_asked(rows), rows), rows).select("query_id", "match_id", "place", "similarity")
    reports = t.raw("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("site"))
    return rg.detail_pages(_asked(rows), near, reports, t.reviews)


@query("l6_share_sample", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '42'), o_orderkey) AS rn FROM orders)
SELECT o_orderkey, o_orderpriority FROM o WHERE rn <= CASE o_orderpriority WHEN '1-URGENT' THEN 1000000000 WHEN '2-HIGH' THEN 450 WHEN '3-MEDIUM' THEN 247 WHEN '4-NOT SPECIFIED' THEN 136 ELSE 0 END""")
def _(t: Tables):
    caps = ds.share_caps(["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], 1000, whole=["1-URGENT"])
    return ds.sample_shares(t.raw("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", caps)


@query("a9_export_union", """SELECT n_nationkey::VARCHAR AS "key", n_name AS name, n_regionkey::VARCHAR AS region, '' AS balance FROM nation
UNION ALL SELECT s_suppkey::VARCHAR, s_name, '', printf('%.2f', s_acctbal) FROM supplier""")
def _(t: Tables):
    path = f"{shared_folder(t.spark)}/export-{uuid.uuid4().hex}"
    nations = t.raw("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    suppliers = t.raw("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    files.write_export_union([nations, suppliers], path)
    read = t.spark.read.option("header", "true").option("escape", '"').option("lineSep", "\r\n").csv(path)
    return read.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip(files.BOM)) for c in read.columns])


@query("f18_source_table", views("texts") + """, x AS (SELECT source, doc_id, report_text, md5(report_text) AS k FROM texts)
SELECT source, count(*) AS n, count_if(trim(report_text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) = '') AS empty_texts, count(DISTINCT k) AS different_texts FROM x GROUP BY 1""")
def _(t: Tables):
    return ds.source_statistics(t.texts, "source", "report_text")


@query("f18_top_degrees", "SELECT p_type AS degree, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, degree LIMIT 12")
def _(t: Tables):
    return ds.top_values(t.raw("part"), "p_type", 12).withColumnRenamed("value", "degree")
