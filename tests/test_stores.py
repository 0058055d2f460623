import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardlake.lexicon import Lexicon
from hazardlake.operators import isolation as iso
from hazardlake.operators.analysis import analyze
from hazardlake.operators.versions import AnalysisStore, reanalyse
from hazardlake.plans.imports import import_reports, import_summary

TEXTS = [(1, "No fire watch while welding near the drums."), (2, "No harness on the scaffold."), (3, "All quiet, tidy office."), (4, None), (None, "No harness again.")]
ONLY_TIDY = Lexicon(indicator_phrases={"Hot Work Safety": [("tidy office", False)]})


@pytest.fixture
def store(spark, tmp_path):
    reports = spark.createDataFrame(TEXTS, "report_id long, report_text string")
    made = AnalysisStore(spark, f"file://{tmp_path}/store")
    assert made.commit(0, analyze(reports).select("report_id", "sif_potential", "life_saving_rule"))
    return made, reports


def shown(frame):
    return {r["report_id"]: (r["version"], r["sif_potential"]) for r in frame.collect()}


def test_replaced_untouched_and_pending(spark, store):
    made, reports = store
    reviews = spark.createDataFrame([(10, 1, "confirmed"), (11, 2, "rejected"), (12, 3, "edited"), (13, None, "edited")], "id long, report_id long, decision string")
    wanted = spark.createDataFrame([(2,), (3,), (99,), (3,)], "report_id long")
    assert reanalyse(made, 1, reports, wanted, reviews, ONLY_TIDY, columns=["report_id", "sif_potential", "life_saving_rule", "model"])
    assert shown(made.current()) == {1: (0, True), 2: (1, False), 3: (1, True), 4: (0, None), None: (0, True)}
    assert sorted(r["id"] for r in made.reviews(reviews).collect()) == [10, 13]
    later = reviews.unionByName(spark.createDataFrame([(20, 2, "confirmed")], reviews.schema))
    assert {r["report_id"]: (r["n_reviews"], r["review_state"]) for r in made.states(later).collect()} == {1: (1, "reviewed"), 2: (1, "reviewed"), 3: (0, "pending"), 4: (0, "pending"), None: (0, "pending")}
    # a repeat does nothing, and reviews that came in since stay
    assert not reanalyse(made, 1, reports, wanted, later, ONLY_TIDY)
    assert sorted(r["id"] for r in made.reviews(later).collect()) == [10, 13, 20]
    # a later version replaces the earlier one for its reports only
    assert reanalyse(made, 2, reports, spark.createDataFrame([(3,)], "report_id long"), None, columns=["report_id", "sif_potential"])
    assert shown(made.current())[3] == (2, False) and shown(made.current())[2] == (1, False)
    smaller = made.compacted(made.folder + "-compact")
    assert smaller.committed() == [2] and sorted(map(str, (r["report_id"] for r in smaller.current().collect()))) == sorted(map(str, shown(made.current())))
    assert sorted(r["id"] for r in smaller.reviews(later).collect()) == [10, 13, 20]


def test_a_broken_run_is_invisible_and_can_be_repeated(spark, store):
    made, reports = store
    analyze(reports.limit(2)).select("report_id", F.lit(None).cast("boolean").alias("sif_potential")).write.parquet(f"{made.folder}/analyses/version=1")
    assert made.committed() == [0] and {v for v, _ in shown(made.current()).values()} == {0}
    assert reanalyse(made, 1, reports, reports.filter("report_id = 3"), None, ONLY_TIDY, columns=["report_id", "sif_potential"])
    assert shown(made.current()) == {1: (0, True), 2: (0, True), 3: (1, True), 4: (0, None), None: (0, True)}


def test_empty_store(spark, tmp_path):
    made = AnalysisStore(spark, f"file://{tmp_path}/none")
    assert made.committed() == []
    with pytest.raises(ValueError):
        made.current()


CELLS = [("2024-02-30", " ; ", "{\"a\": 1}", "5"), ("", "", "", ""), ("n/a", "x;y", "{\"a\": ", "five"), (None, None, None, None), ("03/04/2024", "|", "[1]", "1e3"), ("soon", "a", "{}", " 7 ")]


def test_attempts(spark):
    df = spark.createDataFrame(CELLS, "d string, l string, m string, n string")
    tries = {"d": iso.attempt_date, "l": iso.attempt_list, "m": iso.attempt_map, "n": iso.attempt_number}
    got = df.select(*[c for name, attempt in tries.items() for c in (attempt(F.col(name)).value.alias(f"{name}_value"), attempt(F.col(name)).error.isNotNull().alias(f"{name}_bad"))]).collect()
    assert [r["d_bad"] for r in got] == [True, False, False, False, False, True]
    assert [r["l_bad"] for r in got] == [True, False, False, False, True, False]
    assert [r["m_bad"] for r in got] == [False, False, True, False, True, False]
    assert [r["n_bad"] for r in got] == [False, False, True, False, False, False]
    assert got[0]["m_value"] == {"a": "1"} and got[5]["m_value"] == {} and got[2]["m_value"] is None and got[4]["n_value"] == 1000.0 and got[5]["n_value"] == 7.0


def test_isolated_step(spark):
    def step(texts: pd.Series):
        if texts.str.contains("bad").any():
            raise ValueError("cannot read " + texts.iloc[0])
        return texts.str.len()

    rows = spark.createDataFrame([("fine",), ("bad one",), ("well",), ("bad " + "x" * 900,)], "t string").coalesce(1)
    got = [(r["s"]["value"], r["s"]["error"]) for r in rows.select(iso.isolated(step, "long")("t").alias("s")).collect()]
    assert got[0] == (4, None) and got[1] == (None, "ValueError: cannot read bad one") and got[2] == (4, None)
    assert len(got[3][1]) == iso.MESSAGE_LENGTH


REGISTER = [(1, "No harness on the scaffold", "31/02/2024", "guard", "x"), (2, "no HARNESS on the scaffold!", "01/02/2024", "guard", "2"), (3, "No harness on the scaffold", "01/02/2024", ";", "3"),
            (4, "Tidy office with a broken � sign", "", "", "4"), (5, " ", "32/01/2024", ";", "z"), (6, "Another tidy office", "2024-01-05", "a;b", "6")]


def test_bad_rows_fail_alone(spark):
    table = spark.createDataFrame(REGISTER, "`Sl No` long, Description string, `Date of Occurrence` string, `Barrier Failure` string, weight string")
    strict = import_reports(table, row_no=F.col("`Sl No`"), fatal=None, extra={"weight": iso.attempt_number})
    got = {r["row_no"]: (r["import_state"], r["processing_status"], r["duplicate_of"]) for r in strict.collect()}
    # row 1 fails, so row 2 is the first of its text; row 3 repeats row 2 and is no failure of its own
    assert got == {1: ("new", "failed", None), 2: ("new", "analyzed", None), 3: ("duplicate", "failed", "2"), 4: ("new", "failed", None), 5: ("empty", "failed", None), 6: ("new", "analyzed", None)}
    counters, failures, duplicates = import_summary(strict)
    c = counters.first()
    assert (c["processed"], c["imported"], c["failed"], c["duplicates"], c["skipped_empty"], c["first_row"]) == (6, 2, 2, 1, 1, 2)
    assert [(r["row_no"], r["error"]) for r in failures.collect()] == [(4, "normalise: report_text: undecodable characters"), (1, "normalise: date: no known date format, or no such day")]
    assert [tuple(r) for r in duplicates.collect()] == [(3, "2")]
    assert {(r["field"], r["rows"]) for r in iso.failures_by_kind(strict).collect()} == {("date", 2), ("weight", 2), ("barrier_failure", 2), ("report_text", 1)}
    failed = strict.filter("row_no = 1").first()
    assert failed["sif_potential"] is None and failed["report_text"] is not None and len(failed["errors"]) == 2
    # by default a bad cell is named and the row is analysed without it
    loose = {r["row_no"]: (r["import_state"], r["processing_status"], len(r["errors"]), r["date"]) for r in import_reports(table, row_no=F.col("`Sl No`")).collect()}
    assert loose[1] == ("new", "analyzed", 1, None) and loose[2][0] == "duplicate" and loose[4][1] == "analyzed" and loose[5][0] == "empty"
    assert import_reports(table.limit(0), row_no=F.col("`Sl No`")).count() == 0
