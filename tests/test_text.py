import datetime
import random
import time

from pyspark.sql import functions as F

from hazardlake.functions import text as tx
from hazardlake.operators import normalise as nm
from hazardlake.operators.mapping import auto_mapping, location_detail, resolve_mapping


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_dates(spark):
    day = datetime.date(2026, 6, 5)
    for shown in ["2026-06-05", "2026/6/5", "05/06/2026", "5-6-2026", "05.06.2026", "2026.06.05", "5 Jun 2026", "05 June 2026", "Jun 5 2026",
                  "June 5, 2026", "5-Jun-2026", "5 Jun, 2026", "20260605", "2026-06-05T10:00:00", "2026-06-05 08:00", "logged 2026.6.5 late"]:
        assert one(spark, shown, tx.parse_date) == day, shown
    assert one(spark, "06/25/2026", tx.parse_date) == datetime.date(2026, 6, 25)
    for nothing in ["", "n/a", "NaN", "soon", "31/31/2026", None]:
        assert one(spark, nothing, tx.parse_date) is None, nothing


def test_cells(spark):
    assert one(spark, "\t x \n", tx.cell) == "x"
    assert one(spark, None, tx.cell) == ""
    assert one(spark, " N/A ", tx.cell_or_default) == ""
    assert one(spark, "Not  reported", tx.clean_cell) == "Not reported"
    assert one(spark, "not reported", tx.clean_cell) == ""
    assert one(spark, "a, b;;c | d", tx.list_cell) == ["a", "b", "c", "d"]
    assert one(spark, " ; ,", tx.list_cell) is None
    assert one(spark, "Gas-Test: गैस!!", tx.fingerprint) == "gas test गैस"
    assert one(spark, "  ", tx.analysis_text) is None
    assert one(spark, "LOTO for the BA set", tx.model_text) == "lockout tagout for the breathing apparatus set"
    assert len(one(spark, "x" * 60_000, tx.analysis_text)) == 60_000


def test_joined_text_and_site(spark):
    df = spark.createDataFrame([("Spill.", "Oil on deck"), ("Same", "Same"), ("", "Body"), ("Head", "")], "t string, b string")
    got = [r[0] for r in df.select(nm.joined_text(F.col("t"), F.col("b"))).collect()]
    assert got == ["Spill. Oil on deck", "Same", "Body", "Head."]
    sites = spark.createDataFrame([("Rig 4", "deck B"), ("Rig 4", "NIL"), ("", "deck B")], "s string, d string")
    assert [r[0] for r in sites.select(nm.merged_site(F.col("s"), F.col("d"))).collect()] == ["Rig 4 · deck B", "Rig 4", None]


def test_header_mapping():
    register = ["Sl No", "Date of Occurrence", "Place of Occurrence", "Nature of Job", "Type of report", "Detailed description of event"]
    chosen = auto_mapping(register)
    assert chosen["text"] == "Detailed description of event"
    assert chosen["date"] == "Date of Occurrence"
    assert chosen["report_type"] == "Type of report"
    export = ["Report_id", "Report_type", "Site_name", "Location_detail", "Activity", "Hazard_category", "Description"]
    found = resolve_mapping(export)
    assert (found["report_id"], found["site"], found["text"], found["hazard"]) == ("Report_id", "Site_name", "Description", "Hazard_category")
    off = resolve_mapping(export, {"hazard": "__none__", "site": "Activity", "text": "missing", "activity": None})
    assert off["hazard"] is None and off["site"] == "Activity" and off["text"] == "Description" and off["activity"] is None
    assert location_detail(["Site_name", "Location_detail", "Specific location"], {"location": "Location_detail"}) == "Specific location"


def test_rule_estimate(spark):
    df = spark.createDataFrame([("Residual pressure", ""), ("", "Crane work"), ("dust", "sweeping"), (None, None)], "h string, a string")
    assert [r[0] for r in df.select(nm.estimate_rule(F.col("h"), F.col("a"))).collect()] == ["Energy Isolation", "Safe Mechanical Lifting", None, None]


def test_runs_of_blanks_and_acronyms_are_replaced_as_before(spark):
    from hazardlake.functions import text as tx
    rows = [("  a b\t c\n\nd e   f ",), ("PTW and LOTO, ba-ba ptws",), ("x--y  z!",), ("\t",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    spelled = F.btrim(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), tx.SPACE + "+", " "))
    for short, full in tx.ACRONYMS:
        spelled = F.regexp_replace(spelled, rf"\b{short}\b", full)
    plain = [F.btrim(F.regexp_replace("t", tx.SPACE + "+", " ")), spelled, F.btrim(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), r"[^a-z0-9\x{900}-\x{9ff}]+", " "))]
    mine = [tx.collapse(F.col("t")), tx.model_text(F.col("t")), tx.fingerprint(F.col("t"))]
    for r in df.select(F.array(*mine).alias("mine"), F.array(*plain).alias("plain")).collect():
        assert r["mine"] == r["plain"]


def test_a_field_is_filled_by_the_words_of_its_rows(spark):
    from hazardlake.operators import learning as ml
    rows = [(n, ("crane lifted load " if n % 2 else "welder sparks fire ") + f"n{n}", None if n % 5 == 0 else "lift" if n % 2 else "weld") for n in range(60)]
    df = spark.createDataFrame(rows, "id long, clean string, activity string").withColumn("label", F.lit(0.0))
    made = {r["id"]: r for r in ml.fill_field(df, "activity", 5, ["id"]).collect()}
    assert len(made) == 60 and all(made[n]["activity"] == ("lift" if n % 2 else "weld") and made[n]["ml_filled"] == (n % 5 == 0) for n in range(60))


def test_cleaning_equals_the_plain_patterns_at_less_cost(spark):
    rng = random.Random(3)
    marks = [*map(chr, range(0x180)), *map(chr, range(0x8fa, 0xa05)), *"\u1680\u2000\u200a\u200b\u2028\u202f\u205f\u3000\U0001f600"]
    blanks = list(" \t\n\xa0\u3000\x1c") + ["  ", "a", "B", "7"]
    odd = ["".join(rng.choice(marks if rng.random() < 0.4 else blanks) for _ in range(rng.randrange(30))) for _ in range(3_000)]
    plain = {tx.collapse: lambda c: F.btrim(F.regexp_replace(c, tx.SPACE + "+", " ")),
             tx.fingerprint: lambda c: F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9\x{900}-\x{9ff}]+", " "))}
    former = {tx.collapse: rf"{tx.SPACE}{{2,}}|[{tx.SPACE}&&[^ ]]", tx.fingerprint: r"[^a-z0-9\x{900}-\x{9ff}]{2,}|[^a-z0-9\x{900}-\x{9ff} ]"}
    texts = spark.createDataFrame([(t,) for t in odd], "v string")
    words = spark.range(8).select(F.repeat(F.lit("The fitter opened valve 7, without isolating the pump. "), 20_000).alias("v")).localCheckpoint()

    def seconds(made):
        taken = []
        for _ in range(4):
            start = time.perf_counter()
            words.select(F.length(made)).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        return min(taken)

    for fn, simple in plain.items():
        assert texts.filter(~fn(F.col("v")).eqNullSafe(simple(F.col("v")))).count() == 0
        assert seconds(fn(F.col("v"))) < 0.7 * seconds(F.btrim(F.regexp_replace(F.lower("v"), former[fn], " ")))
