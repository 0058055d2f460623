"""Queries on model training, imports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.operators import datasets as ds
from hazardlake.operators import learning as ml
from hazardlake.operators import metrics as me
from hazardlake.operators.terms import TermSets
from hazardlake.plans.catalog import query, views
from hazardlake.plans.imports import import_reports
from hazardlake.session import shared_folder
from hazardlake.plans.texts import LEX, _RULESETS_SQL, clean_texts
from hazardlake.functions import spans
from hazardlake.sources import files
from hazardlake.sources.tables import Tables
from hazardlake.streaming import arrivals


def _cases(t: Tables) -> DataFrame:
    """Labelled documents, joined and cleaned once: folds and fits read the written table."""
    rows = t.raw("labels").join(t.raw("documents").select("doc_id", "text", "source", "lang"), "doc_id")
    made, path = ml.labelled(rows, "text", F.col("quality")), f"{_scratch(t)}/cases"
    # texts from few files are spread, since every fit works on the partitions of this table
    cores = t.spark.sparkContext.defaultParallelism
    (made if made.rdd.getNumPartitions() >= cores else made.repartition(cores)).write.parquet(path)
    return t.spark.read.schema(made.schema).parquet(path)


def _folded(t: Tables, k: int) -> DataFrame:
    rows = _cases(t)
    return rows.join(ds.stratified_folds(rows, ["label"], "doc_id", k).select("doc_id", "fold"), "doc_id")


@query("m1_term_features")
def _(t: Tables):
    rows = _cases(t).withColumn("words", F.size(F.regexp_extract_all("clean", F.lit(ml.TERM), F.lit(0))))
    made = TermSets(rows, [F.lit(True)], 5_000, ["doc_id", "words"]).features(0)
    # words and pairs of neighbours
    return made.select("doc_id", F.greatest(2 * F.col("words") - 1, F.lit(0)).alias("terms"), F.size(F.filter(F.unwrap_udt("features")["values"], lambda x: x > 0)).alias("used"))


@query("m2_m3_model_comparison")
def _(t: Tables):
    return ml.cross_validate(_folded(t, 5), 5, ["logistic", "bayes", "svm", "tree"])


@query("m4_discriminant")
def _(t: Tables):
    rows = _folded(t, 5)
    scored = ml.discriminant_scores(rows, F.col("fold") != 0, components=10, vocabulary=200)
    return me.with_scores(me.confusion(scored.filter(F.col("fold") == 0), F.col("label") == 1, F.col("prediction") == 1))


@query("m5_grouped_folds")
def _(t: Tables):
    return ml.cross_validate(ml.grouped_folds(_cases(t), "source", 5), 5, ["logistic"])


@query("m5_repeated_folds")
def _(t: Tables):
    # three repeats of five folds, each repeat with a split of its own
    runs = [ml.cross_validate(ml.repeated_folds(_cases(t), "doc_id", 5, n), 5, ["logistic"]).withColumn("repeat", F.lit(n)) for n in (1, 2, 3)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("m7_model_sweep")
def _(t: Tables):
    rows = _folded(t, 5)
    return me.threshold_sweep(ml.probabilities(rows.filter("fold <> 0"), rows.filter("fold = 0")), "label", "score", [0.3, 0.4, 0.5, 0.6])


@query("m5_learning_curve")
def _(t: Tables):
    return ml.learning_curve(_folded(t, 5), "doc_id", [0.25, 0.5, 0.75, 1.0], vocabulary=5_000)


@query("m6_best_model")
def _(t: Tables):
    per = ml.cross_validate(_folded(t, 5), 5, ["logistic", "bayes"])
    means = per.groupBy("model").agg(F.avg("f2").alias("f2"), F.avg("recall").alias("recall"))
    return means.agg(F.max_by("model", F.struct("f2", "recall")).alias("best_model"), F.count(F.lit(1)).alias("models"))


@query("m8_m9_imputation")
def _(t: Tables):
    rows = _cases(t).withColumn("activity", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    return ml.fill_field(rows, "activity", 20, ["doc_id"]).select("doc_id", "activity", "ml_filled", "model_tag")


@query("m10_held_out_test")
def _(t: Tables):
    rows = _cases(t)
    split = ds.fraction_split(rows, "label", "doc_id").select("doc_id", "split")
    joined = rows.join(split, "doc_id")
    return ml.one_shot_test(joined.filter("split = 'training'"), joined.filter("split = 'testing'"))


@query("a4_import_rows")
def _(t: Tables):
    # Foreign column names; the header decides the mapping.
    rows = t.texts.select(F.col("doc_id").alias("Sl No"), F.col("date").cast("string").alias("Date of Occurrence"), F.col("source").alias("Place of Occurrence"),
                          F.col("report_text").alias("Detailed description of event"))
    done = import_reports(rows, source="register.csv", row_no=F.col("Sl No").cast("long"))
    return done.select("source_id", "import_state", "date", "site", "sif_potential", "priority", "life_saving_rule", "source")


def _scratch(t: Tables) -> str:
    """A new folder in the shared place the cluster names."""
    return f"{shared_folder(t.spark)}/scratch-{uuid.uuid4().hex}"


@query("n4_weekly_stream", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS report_count, count_if(value > 50) AS sif_count FROM events GROUP BY 1")
def _(t: Tables):
    schema = t.raw("events").schema
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return _drain(t, arrivals.weekly_stream(rows.withColumns({"sif": F.col("value") > 50, "ts": F.col("ts").cast("timestamp")}), "ts", "sif"), "week")


@query("n6_review_state", "SELECT user_id AS report_pk, arg_max(event_type, event_id) AS decision, max(event_id) AS review_id FROM events GROUP BY 1")
def _(t: Tables):
    rows = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    reviews = rows.select(F.col("event_id").alias("id"), F.col("user_id").alias("report_pk"), F.col("event_type").alias("decision"))
    return _drain(t, arrivals.review_state_stream(reviews), "report_pk")


def _drain(t: Tables, out: DataFrame, key: str) -> DataFrame:
    """Run a stream over what is there; each batch writes the rows that changed, and the last one of a key holds."""
    folder = _scratch(t)
    step = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    run = (out.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{folder}/ckpt")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    changed = t.spark.read.parquet(f"{folder}/out")
    return changed.groupBy(key).agg(F.max_by(F.struct(*[c for c in out.columns if c != key]), "batch").alias("now")).select(key, "now.*")


# ---- A: files written from the tables and read back ---------------------------

@query("a1_csv_scan", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, md5(trim(text)) AS text FROM conversations")
def _(t: Tables):
    path = f"{_scratch(t)}/csv"
    rows = t.raw("conversations").select(*[F.col(c).cast("string") for c in ("conv_id", "turn", "role", "text")])
    rows.write.csv(path, header=True, escape='"')
    return files.read_delimited(t.spark, path).select("conv_id", "turn", "role", F.md5(F.trim("text")).alias("text"))


@query("a5_chunk_scan", "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey) AS keys, true AS named FROM orders GROUP BY 1")
def _(t: Tables):
    path = f"{_scratch(t)}/chunks"
    t.raw("orders").select("o_orderkey", "o_orderstatus").filter("o_orderkey % 3 <> 0").repartition(4).write.csv(path, header=True)
    # other files have the columns the other way round
    t.raw("orders").select("o_orderstatus", "o_orderkey").filter("o_orderkey % 3 = 0").repartition(2).write.mode("append").csv(path, header=True)
    read = files.read_chunks(t.spark, path)
    return read.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"), F.min(F.col("source_file").endswith(".csv")).alias("named"))


@query("a8_append_store", views("reports") + "SELECT source, 2 * count(*) AS n FROM reports GROUP BY 1")
def _(t: Tables):
    path = f"{_scratch(t)}/store"
    for _n in range(2):
        files.append_reports(t.reports.select("id", "report_text", "source"), path)
    return t.spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("a9_export", views("findings") + "SELECT CAST(report_pk AS VARCHAR) AS report_pk, CASE WHEN sif_potential THEN 'Yes' ELSE 'No' END AS sif_potential, printf('%.2f', confidence) AS confidence, coalesce(hazard, '') AS hazard FROM findings")
def _(t: Tables):
    path = f"{_scratch(t)}/export"
    files.write_export(t.findings, ["report_pk", "sif_potential", "confidence", "hazard"], path)
    return files.read_delimited(t.spark, path, multiline=False).select("report_pk", "sif_potential", "confidence", F.coalesce("hazard", F.lit("")).alias("hazard"))


@query("a10_split_sink", "SELECT CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    path = f"{_scratch(t)}/splits"
    k = F.col("o_orderkey") % 10
    split = F.when(k < 6, "train").when(k < 8, "validation").otherwise("test")
    files.write_splits(t.raw("orders").select(split.alias("split"), F.col("o_orderkey").alias("report_id"), "o_orderstatus"), ["report_id", "o_orderstatus"], path)
    return t.spark.read.option("header", "true").csv(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("a11_phase_cache", views("findings") + "SELECT report_pk, priority FROM findings")
def _(t: Tables):
    return files.phase_cache(t.findings, f"{_scratch(t)}/phase").select("report_pk", "priority")


@query("a12_flexible_columns", "SELECT doc_id, CAST(quality AS VARCHAR) AS case_label, length(text) AS chars FROM labels JOIN documents USING (doc_id)")
def _(t: Tables):
    rows = t.raw("labels").join(t.raw("documents"), "doc_id").withColumnRenamed("quality", "target")
    return files.labelled_columns(rows).select("doc_id", "case_label", F.length("case_text").alias("chars"))


# ---- evaluation of the rule engine ---------------------------------------------

def _verdicts(t: Tables) -> DataFrame:
    text, low = F.col("clean_text"), F.col("low_text")
    hit = (F.size(spans.english_matches(text, low, LEX)) > 0) | (F.size(spans.foreign_matches(text, low, LEX)) > 0)
    truth = t.raw("labels").select("doc_id", (F.col("quality") == 1).alias("truth"))
    # texts without a label are never matched
    asked = t.texts.join(truth.select("doc_id"), "doc_id", "left_semi")
    rows = clean_texts(t, asked).filter("low_text IS NOT NULL").select("doc_id", "lang", hit.alias("predicted"))
    return rows.join(truth, "doc_id")


_VERDICT_SQL = _RULESETS_SQL + """, v AS (SELECT l.doc_id, low.lang, quality = 1 AS truth, l.doc_id IN (SELECT doc_id FROM e UNION SELECT doc_id FROM f) AS predicted
  FROM labels l JOIN low USING (doc_id) WHERE low_text IS NOT NULL)
"""


@query("m11_engine_evaluation", _VERDICT_SQL + """, m AS (SELECT lang, count_if(truth AND predicted) AS tp, count_if(NOT truth AND predicted) AS fp, count_if(truth AND NOT predicted) AS fn,
  count_if(NOT truth AND NOT predicted) AS tn FROM v GROUP BY 1) SELECT lang, tp, fp, fn, tn FROM m""")
def _(t: Tables):
    return me.confusion(_verdicts(t), F.col("truth"), F.col("predicted"), ["lang"]).select("lang", "tp", "fp", "fn", "tn")


@query("m6_rule_engine_folds", _RULESETS_SQL + """, cases AS (SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS fold FROM labels JOIN documents USING (doc_id)
  WHERE length(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))) >= 8),
j AS (SELECT fold::INT AS fold, quality = 1 AS truth, c.doc_id IN (SELECT doc_id FROM e UNION SELECT doc_id FROM f) AS predicted FROM cases c JOIN low USING (doc_id) WHERE low_text IS NOT NULL)
SELECT 'rules' AS model, fold, count_if(truth AND predicted) AS tp, count_if(NOT truth AND predicted) AS fp, count_if(truth AND NOT predicted) AS fn, count_if(NOT truth AND NOT predicted) AS tn FROM j GROUP BY fold""")
def _(t: Tables):
    # the engine on the folds that the models are compared on
    rows = _folded(t, 5).select("doc_id", "fold").join(_verdicts(t), "doc_id")
    return me.confusion(rows, F.col("truth"), F.col("predicted"), ["fold"]).select(F.lit("rules").alias("model"), "fold", "tp", "fp", "fn", "tn")


@query("d12_wrong_cases", _VERDICT_SQL + "SELECT doc_id, lang, truth, predicted FROM v WHERE truth <> predicted AND lang = 'en'")
def _(t: Tables):
    return _verdicts(t).filter((F.col("truth") != F.col("predicted")) & (F.col("lang") == "en")).select("doc_id", "lang", "truth", "predicted")
