"""Queries on corpora: data dictionaries and texts made from templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardlake.operators import corpora as co
from hazardlake.plans.catalog import query
from hazardlake.plans.texts import BLANKS_SQL, FP_SQL
from hazardlake.sources.tables import Tables


def _dictionary_sql(table: str, columns: list[tuple[str, str]]) -> str:
    cells = {"text": "nullif(trim({c}, " + BLANKS_SQL + "), '')", "number": "{c}::DECIMAL(38,6)::VARCHAR", "whole number": "{c}::VARCHAR", "time": "{c}::VARCHAR"}
    each = " UNION ALL ".join(f"SELECT {n} AS place, '{c}' AS col, '{kind}' AS type, {cells[kind].replace('{c}', c)} AS v FROM {table}" for n, (c, kind) in enumerate(columns))
    return f"""WITH cells AS ({each}), seen AS (SELECT place, v, md5(v) AS d, count(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY ALL),
near AS (SELECT place, v, d FROM seen QUALIFY row_number() OVER (PARTITION BY place ORDER BY d) <= 3), listed AS (SELECT place, string_agg(v, ' | ' ORDER BY d) AS samples FROM near GROUP BY 1),
per AS (SELECT place, sum(n)::BIGINT AS present, count(*) AS "distinct" FROM seen GROUP BY 1), names AS (SELECT place, any_value(col) AS col, any_value(type) AS type, count(*) AS rows FROM cells GROUP BY 1)
SELECT place, col AS "column", type, rows, coalesce(present, 0) AS present, round(coalesce(present, 0) / rows, 4) AS share, coalesce("distinct", 0) AS "distinct", true AS sketch_near, coalesce(samples, '') AS samples
FROM names LEFT JOIN per USING (place) LEFT JOIN listed USING (place)"""


def _dictionary(t: Tables, table: str):
    near = F.abs(F.col("sketch") - F.col("distinct")) <= 1 + F.col("distinct") * 0.2
    return co.data_dictionary(t.raw(table)).withColumns({"sketch_near": near, "samples": F.concat_ws(" | ", "samples")}).drop("sketch")


@query("l14_documents_dictionary", _dictionary_sql("documents", [("doc_id", "whole number"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "whole number")]))
def _(t: Tables):
    return _dictionary(t, "documents")


@query("l14_orders_dictionary", _dictionary_sql("orders", [("o_orderkey", "whole number"), ("o_custkey", "whole number"), ("o_orderstatus", "text"), ("o_totalprice", "number"), ("o_orderdate", "time"), ("o_orderpriority", "text")]))
def _(t: Tables):
    return _dictionary(t, "orders")


_TEMPLATE_SQL = f"""WITH templates AS (SELECT label, template, row_number() OVER (PARTITION BY label ORDER BY template) - 1 AS position, count(*) OVER (PARTITION BY label) AS size
  FROM (SELECT DISTINCT CASE WHEN role = 'user' THEN 'Yes' ELSE 'No' END AS label, text AS template FROM conversations WHERE trim(text, {BLANKS_SQL}) <> '')),
wanted(label, n) AS (SELECT 'Yes', 3 * count(*) // 10 FROM documents UNION ALL SELECT 'No', 7 * count(*) // 10 FROM documents),
made AS (SELECT label, i, 'RPT-' || label[1] || lpad((i + 1)::VARCHAR, greatest(4, length((i + 1)::VARCHAR))::INT, '0') AS report_id, 'Site ' || chr((65 + i % 5)::INT) AS site,
  CASE WHEN label = 'Yes' THEN CASE WHEN i % 2 = 0 THEN 'Unsafe Act' ELSE 'Near Miss' END WHEN i % 2 = 0 THEN 'Unsafe Condition' ELSE 'Routine Observation' END AS event_type FROM (SELECT label, unnest(range(n)) AS i FROM wanted)),
corpus AS (SELECT report_id, made.label, site, event_type, template, report_id || ', ' || site || ': ' || template AS description FROM made JOIN templates ON made.label = templates.label AND position = i % size)
"""


def _corpus(t: Tables):
    n = t.raw("documents").count()
    templates = t.raw("conversations").select(F.when(F.col("role") == "user", "Yes").otherwise("No").alias("label"), F.col("text").alias("template"))
    return co.template_corpus(templates, {"Yes": 3 * n // 10, "No": 7 * n // 10})


@query("l13_template_corpus", _TEMPLATE_SQL + "SELECT * FROM corpus")
def _(t: Tables):
    return _corpus(t)


@query("l13_unique_texts", _TEMPLATE_SQL + ", given AS (SELECT 'DOC-' || doc_id AS report_id, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS label, NULL AS template, text AS description, 0 AS made FROM documents JOIN labels USING (doc_id)), "
       + "both_ AS (SELECT *, " + FP_SQL.format("description") + " AS fp FROM (SELECT * FROM given UNION ALL SELECT report_id, label, template, description, 1 FROM corpus)) "
       + "SELECT report_id, label, template, md5(description) AS description, md5(fp) AS fingerprint FROM both_ WHERE fp <> '' QUALIFY row_number() OVER (PARTITION BY fp ORDER BY made, report_id) = 1")
def _(t: Tables):
    given = t.raw("documents").join(t.raw("labels"), "doc_id").select(F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("report_id"), F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("label"), F.col("text").alias("description"))
    return co.with_given_texts(_corpus(t), given).withColumns({"description": F.md5("description"), "fingerprint": F.md5("fingerprint")})
