"""Report-shaped views over order, customer, line-item, event and document tables.

They let every operator run on relational data of any size; the matching SQL text
of each view is used by the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Opening sentence of a document's report text, chosen by its id.
SENTENCES = [
    "Technician opened the flange without isolating the feed line.",
    "Routine walk around the office, everything was tidy.",
    "The lockout tag was missing on breaker 7 while the electrician worked.",
    "Two welders started hot work with no fire watch near fuel drums, sparks reached the floor.",
    "LOTO was applied and the gas test passed before entry.",
    "Rigger stood under the suspended load while the crane moved; no banksman was posted.",
    "Worker bina harness scaffold par kaam kar raha tha aur guardrail nahi laga tha.",
    "Driver was reversing the tanker in the yard without a spotter and nearly hit the pedestrian.",
    "Entered the vessel, gas testing was not done and the standby man left the manhole.",
    "H2S alarm sounded in the pump room, one gas detector not worn.",
    "Machine guard was removed and the interlock bypassed on the conveyor.",
    "Excavation deeper than two metres, no shoring and the permit to work had expired.",
    "No incidents, no damage; the scaffold was inspected and the guardrails were in place.",
    "गैस टेस्ट नहीं हुआ और बिना परमिट काम शुरू किया।",
    "গ্যাস টেস্ট ছাড়া ট্যাংকে ঢোকা হয়েছে, অ্যাটেন্ডেন্ট ছিল না।",
    "হাৰ্নেছ নিপিন্ধাকৈ ওপৰত কাম কৰা হৈছিল।",
    "Permit chara kaj kora hoyni bola hoyeche, harness chara kora hoy.",
    "Loose cable on the walkway was reported and cleared.",
    "Ladder fell from the roof, fall protection was defective, the area was blocked.",
    "Guardrails were painted last week near the loading bay.",
]
RULES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NEVER USED"]
DECISIONS = {"view": "confirmed", "error": "rejected", "signup": "edited", "click": "reviewed"}


class Tables:
    """Lazily read views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def reports(self) -> DataFrame:
        """id, report_id, report_text, report_type, date, site, activity, is_demo, source, source_id, status, created_at."""
        key = F.col("o_orderkey")
        # The key columns come from bounded dimensions; sizes decide the join at run time.
        return (
            self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("id"), F.format_string("RPT-%04d", key + 1).alias("report_id"),
                F.concat_ws(" ", F.lit("Order"), key.cast("string"), F.lit("of"), "c_name", F.lit("at"), "n_name")
                .alias("report_text"),
                F.when(key % 3 == 0, "Near miss").when(key % 3 == 1, "Unsafe act").alias("report_type"),
                F.when(key % 20 != 0, F.col("o_orderdate").cast("date")).alias("date"),
                F.when(key % 31 != 0, F.col("n_name")).alias("site"), F.col("o_orderpriority").alias("activity"),
                (key % 7 == 0).alias("is_demo"), F.concat(F.lit("upload:"), "c_mktsegment").alias("source"),
                F.col("c_name").alias("source_id"),
                F.when(key % 97 == 0, "failed").otherwise("analyzed").alias("processing_status"),
                F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 5 as int))").alias("created_at")))

    REPORTS_SQL = """reports AS (
      SELECT o_orderkey AS id, 'RPT-' || lpad(CAST(o_orderkey + 1 AS VARCHAR), CAST(greatest(4, length(CAST(o_orderkey + 1 AS VARCHAR))) AS INTEGER), '0') AS report_id,
        'Order ' || o_orderkey || ' of ' || c_name || ' at ' || n_name AS report_text,
        CASE WHEN o_orderkey % 3 = 0 THEN 'Near miss' WHEN o_orderkey % 3 = 1 THEN 'Unsafe act' END AS report_type,
        CASE WHEN o_orderkey % 20 <> 0 THEN CAST(o_orderdate AS DATE) END AS date,
        CASE WHEN o_orderkey % 31 <> 0 THEN n_name END AS site, o_orderpriority AS activity,
        o_orderkey % 7 = 0 AS is_demo, 'upload:' || c_mktsegment AS source, c_name AS source_id,
        CASE WHEN o_orderkey % 97 = 0 THEN 'failed' ELSE 'analyzed' END AS processing_status,
        o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) AS created_at
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

    @cached_property
    def findings(self) -> DataFrame:
        """The analyses without their barrier lists (no line items needed)."""
        key = F.col("o_orderkey")
        return (
            self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .filter(key % 97 != 0)
            .select(
                key.alias("report_pk"), (F.col("o_totalprice") > 350000).alias("sif_potential"),
                F.when(F.col("o_totalprice") >= 450000, "HIGH").when(F.col("o_totalprice") >= 250000, "MEDIUM")
                .otherwise("LOW").alias("priority"),
                F.when(key % 41 != 0, F.concat(F.lit("Hazard "), "o_orderstatus")).alias("hazard"),
                F.when(key % 53 != 0, F.col("c_mktsegment")).alias("life_saving_rule"),
                F.when(key % 29 != 0, F.col("o_orderpriority")).alias("analysis_activity"),
                F.round(F.lit(0.55) + (key % 40) / F.lit(100.0), 2).alias("confidence")))

    FINDINGS_SQL = """findings AS (
      SELECT o_orderkey AS report_pk, o_totalprice > 350000 AS sif_potential,
        CASE WHEN o_totalprice >= 450000 THEN 'HIGH' WHEN o_totalprice >= 250000 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
        CASE WHEN o_orderkey % 41 <> 0 THEN 'Hazard ' || o_orderstatus END AS hazard,
        CASE WHEN o_orderkey % 53 <> 0 THEN c_mktsegment END AS life_saving_rule,
        CASE WHEN o_orderkey % 29 <> 0 THEN o_orderpriority END AS analysis_activity,
        round(0.55::DOUBLE + (o_orderkey % 40) / 100.0::DOUBLE, 2) AS confidence
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 97 <> 0)"""

    @cached_property
    def barrier_rows(self) -> DataFrame:
        """(report_pk, barrier), one row per failed barrier of a report."""
        return (self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
                .filter(F.col("l_orderkey") % 97 != 0)
                .select(F.col("l_orderkey").alias("report_pk"), F.col("p_brand").alias("barrier")).distinct())

    BARRIERS_SQL = """barrier_rows AS (
      SELECT DISTINCT l_orderkey AS report_pk, p_brand AS barrier
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 97 <> 0)"""

    @cached_property
    def analyses(self) -> DataFrame:
        """Findings with their sorted barrier list (null where a report has none)."""
        lists = self.barrier_rows.groupBy("report_pk").agg(F.array_sort(F.collect_set("barrier")).alias("barrier_failure"))
        return self.findings.join(lists, "report_pk", "left")

    ANALYSES_SQL = FINDINGS_SQL + ",\n" + BARRIERS_SQL + """,
    analyses AS (SELECT f.*, b.barrier_failure FROM findings f LEFT JOIN (
      SELECT report_pk, list(barrier ORDER BY barrier) AS barrier_failure FROM barrier_rows GROUP BY report_pk) b
      USING (report_pk))"""

    @cached_property
    def reviews(self) -> DataFrame:
        """id, report_pk, reviewer, decision, comments, reviewed_at; some reports have several, half have none."""
        half = self.raw("orders").agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
        kind = F.col("event_type")
        decision = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in DECISIONS.items()])
        return (self.raw("events").crossJoin(F.broadcast(half))  # one row
                .select(F.col("event_id").alias("id"), (F.col("event_id") * 7 % F.col("half")).alias("report_pk"),
                        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("reviewer"),
                        decision.alias("decision"),
                        F.when(F.col("event_id") % 4 == 0, F.col("props")).alias("comments"),
                        F.when(F.col("event_id") % 6 == 0, F.lit("Hot Work Safety")).alias("corrected_rule"),
                        F.when(F.col("event_id") % 10 == 0, F.lit("HIGH")).alias("corrected_priority"),
                        F.col("ts").alias("reviewed_at")))

    REVIEWS_SQL = """reviews AS (
      SELECT event_id AS id, event_id * 7 % (SELECT count(*) // 2 FROM orders) AS report_pk,
        'user ' || user_id AS reviewer,
        CASE event_type WHEN 'view' THEN 'confirmed' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'edited'
          WHEN 'click' THEN 'reviewed' END AS decision,
        CASE WHEN event_id % 4 = 0 THEN props END AS comments, CASE WHEN event_id % 6 = 0 THEN 'Hot Work Safety' END AS corrected_rule,
        CASE WHEN event_id % 10 = 0 THEN 'HIGH' END AS corrected_priority, ts AS reviewed_at
      FROM events)"""

    @cached_property
    def texts(self) -> DataFrame:
        """doc_id, report_text (whole document behind an opening sentence), lang, source, date; some texts are blank."""
        opening = F.get(F.from_json(F.lit(_json(SENTENCES)), "array<string>"), (F.col("doc_id") % len(SENTENCES)).cast("int"))
        text = F.when(F.col("doc_id") % 40 == 17, F.lit("   ")).otherwise(F.concat(opening, F.lit(" "), F.col("text")))
        return self.raw("documents").select(
            "doc_id", text.alias("report_text"), "lang", "source",
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).alias("date"))

    TEXTS_SQL = """texts AS (
      SELECT doc_id, CASE WHEN doc_id % 40 = 17 THEN '   ' ELSE
          ([""" + ", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES) + """])[CAST(doc_id % """ + str(
        len(SENTENCES)) + """ AS INTEGER) + 1] || ' ' || text END AS report_text,
        lang, source, DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS date
      FROM documents)"""


def _json(value) -> str:
    import json
    return json.dumps(value, ensure_ascii=False)
