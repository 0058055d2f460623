import tempfile

from pyspark.sql import functions as F

from hazardlake.plans.imports import import_reports
from hazardlake.sources import files
from hazardlake.streaming import arrivals


def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(text, name):
    path = f"{scratch()}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_delimited_and_json(spark):
    csv = put('﻿Report_id,Description,Site_name\nA1,"No permit, welding\nstarted",Rig\n ,,\nA2,All fine,Yard\n', "in.csv")
    got = files.read_any(spark, csv)
    assert got.columns == ["Report_id", "Description", "Site_name"] and got.count() == 2
    tsv = put("Report_id\tDescription\nA1\tno harness used\n", "in.txt")
    assert files.read_any(spark, tsv).columns == ["Report_id", "Description"]
    rows = put('{"rows": [{"Description": "x", "Spot": "y"}, {"Description": "z", "Spot": "w"}]}', "in.json")
    assert files.read_any(spark, rows).count() == 2
    total, mapping, shown = files.preview(got)
    assert total == 2 and mapping["text"] == "Description" and shown.count() == 2


def test_import_end_to_end(spark):
    rows = files.from_rows(spark, [
        {"Report_id": "A1", "Description": "Welder worked without permit near fuel drums", "Site_name": "Rig 1", "Hazard": "Fire"},
        {"Report_id": "A2", "Description": "welder worked WITHOUT permit near fuel drums.", "Site_name": "Rig 1", "Hazard": None},
        {"Report_id": "A3", "Description": "", "Site_name": "Rig 1", "Hazard": None}])
    got = {r["source_id"]: r for r in import_reports(rows.coalesce(1), source="a.csv").collect()}
    assert [got[k]["import_state"] for k in ("A1", "A2", "A3")] == ["new", "duplicate", "empty"]
    assert got["A1"]["hazard"] == "Fire" and got["A1"]["modified_fields"][0]["changed"]
    assert got["A1"]["sif_potential"] and got["A2"]["sif_potential"] is None and got["A1"]["source"] == "upload:a.csv"


def test_sinks(spark):
    df = spark.createDataFrame([("R1", True, 0.5, ["a", "b"], "train"), ("R2", None, None, None, "test")],
                               "report_id string, sif boolean, c double, tags array<string>, split string")
    out = scratch() + "/export"
    files.write_export(df, ["report_id", "sif", "c", "tags"], out)
    back = {r["report_id"]: r for r in spark.read.csv(out, header=True, lineSep="\r\n").collect()}
    assert (back["R1"]["sif"], back["R1"]["c"], back["R1"]["tags"]) == ("Yes", "0.50", "a | b")
    files.write_splits(df.withColumn("tags", F.lit("")), ["report_id", "c"], scratch() + "/splits")
    store = scratch() + "/store"
    files.append_reports(df.select(F.col("report_id").alias("report_text"), F.lit("s").alias("source")), store)
    files.append_reports(df.select(F.col("report_id").alias("report_text"), F.lit("s").alias("source")), store)
    assert spark.read.parquet(store).count() == 4


def test_export_of_unlike_rows(spark):
    path = scratch() + "/union"
    first = spark.createDataFrame([("a", True, ["x", "y"])], "name string, sif boolean, tags array<string>")
    second = spark.createDataFrame([(1.5, "b, \"c\"")], "score double, name string")
    files.write_export_union([first, second.limit(1)], path)
    raw = [p.read_bytes() for p in sorted(__import__("pathlib").Path(path).glob("*.csv")) if p.stat().st_size]
    assert all(b.startswith("\ufeffname,sif,tags,score\r\n".encode()) for b in raw)
    read = files.read_delimited(spark, path, multiline=False)
    assert read.columns[0] == "name" and sorted(r["name"] for r in read.collect()) == ["a", 'b, "c"']


def test_import_stream_never_stores_a_report_twice(spark):
    landing, base = scratch(), scratch()
    store, counters, ckpt = f"{base}/store", f"{base}/counters", f"{base}/ckpt"
    schema = "Report_id string, Description string"
    read_store = lambda: spark.read.parquet(store) if _exists(store) else None
    for texts in (["no harness on the roof", "all fine here"], ["No harness on the roof!", "guard removed from the mill"]):
        spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], schema).coalesce(1).write.mode("append").parquet(landing)
        rows = arrivals.landing_stream(spark, landing, spark.createDataFrame([], schema).schema)
        arrivals.import_stream(rows, store, counters, ckpt, read_store).awaitTermination()
    assert spark.read.parquet(store).count() == 3
    assert spark.read.parquet(counters).agg(F.sum("duplicates")).first()[0] == 1


def _exists(path):
    import os
    return os.path.isdir(path)
