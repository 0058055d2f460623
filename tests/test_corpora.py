from pyspark.sql import functions as F

from hazardlake.operators import corpora as co


def test_dictionary_of_any_column(spark):
    df = spark.createDataFrame([(1, " a ", None, [1, 2], True, 1.5), (2, "a", " ", None, None, 1.5), (3, None, "", [1, 2], False, None)], "n int, t string, blank string, l array<int>, b boolean, `odd.name` double")
    got = {r["column"]: r for r in co.data_dictionary(df).collect()}
    assert [got[c]["type"] for c in df.columns] == ["whole number", "text", "text", "list", "yes or no", "number"]
    assert [(got[c]["present"], got[c]["distinct"], got[c]["sketch"]) for c in df.columns] == [(3, 3, 3), (2, 1, 1), (0, 0, 0), (2, 1, 1), (2, 2, 2), (2, 1, 1)]
    assert got["t"]["samples"] == ["a"] and got["blank"]["samples"] == [] and got["l"]["samples"] == ["[1,2]"] and got["t"]["share"] == 0.6667 and got["odd.name"]["samples"] == ["1.500000"]
    many = spark.range(1000).withColumn("hot", F.when(F.col("id") < 900, "x").otherwise(F.col("id").cast("string")))
    first, second = (sorted(map(str, co.data_dictionary(f).collect())) for f in (many, many.repartition(13)))
    assert first == second
    empty = co.data_dictionary(df.limit(0)).collect()
    assert {(r["rows"], r["present"], r["share"]) for r in empty} == {(0, 0, 0.0)}


def test_templates_are_used_equally(spark):
    templates = spark.createDataFrame([("Yes", "b"), ("Yes", "a"), ("Yes", "a"), ("No", "c"), ("No", " "), ("No", None), ("Other", "d")], "label string, template string")
    made = co.template_corpus(templates, {"Yes": 5, "No": 3, "None": 4})
    assert [tuple(r) for r in made.groupBy("label", "template").count().orderBy("label", "template").collect()] == [("No", "c", 3), ("Yes", "a", 3), ("Yes", "b", 2)]
    assert sorted(r["report_id"] for r in made.collect()) == ["RPT-N0001", "RPT-N0002", "RPT-N0003", *(f"RPT-Y000{n}" for n in range(1, 6))]
    given = spark.createDataFrame([("G1", "Yes", "rpt n0001 SITE a c"), ("G2", "No", "own words"), ("G3", "No", "Own words!"), ("G4", "No", None)], "report_id string, label string, description string")
    kept = {r["report_id"] for r in co.with_given_texts(made, given).collect()}
    assert "G1" in kept and "RPT-N0001" not in kept and "G2" in kept and "G3" not in kept and "G4" not in kept and len(kept) == 2 + 7
