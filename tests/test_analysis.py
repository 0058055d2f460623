import pytest
from pyspark.sql import functions as F

from hazardlake.lexicon import DEFAULT
from hazardlake.operators.analysis import analyze, apply_signals, suggested_actions

CASES = {
    1: "The fitter opened the valve without isolating the pump. No incidents were reported.",
    2: "LOTO was applied and the gas test passed before entry.",
    3: "Worker bina harness upar gaya, scaffold lacked guardrails",
    4: "Guardrails were painted and nobody was hurt.",
    5: "स्कैफोल्ड पर बिना हार्नेस काम किया गया।",
    6: "   ",
    7: "The vessel was depressurized, the meter was read.",
    8: "Banksman was missing while the crane lifted the skid. The fire watch stood by.",
    9: "No guardrails at the open edge, and the harness was damaged.",
}


@pytest.fixture(scope="module")
def done(spark):
    df = spark.createDataFrame(list(CASES.items()), "id int, report_text string")
    return {r["id"]: r for r in analyze(df).collect()}


def test_positive_and_negative_verdicts(done):
    assert {i: r["sif_potential"] for i, r in done.items()} == {
        1: True, 2: False, 3: True, 4: False, 5: True, 6: None, 7: False, 8: True, 9: True}


def test_evidence_spans(done):
    assert done[1]["evidence"] == ["without isolating"]
    assert set(done[3]["evidence"]) == {"bina harness", "lacked guardrails"}
    assert done[5]["evidence"] == ["बिना हार्नेस"]
    m = done[1]["matches"][0]
    assert done[1]["clean_text"][m["start"]:m["end"]] == "without isolating"
    for row in done.values():
        for m in row["matches"] or []:
            assert m["phrase"].lower() in row["clean_text"].lower()


def test_one_rule_keeps_no_overlapping_spans(done):
    for row in done.values():
        spans = sorted((m["rule"], m["start"], m["end"]) for m in row["matches"] or [])
        for (r1, _, e1), (r2, s2, _) in zip(spans, spans[1:]):
            assert r1 != r2 or e1 <= s2


def test_scores(done):
    assert done[1]["life_saving_rule"] == "Energy Isolation"
    assert done[1]["confidence"] == 0.83 and done[2]["confidence"] == 0.55
    assert done[3]["priority"] == "HIGH" and done[2]["priority"] == "LOW"
    assert done[3]["priority_factors"].asDict() == {"indicators": 2, "severity": 2, "exposure": 1, "barrier_failure": 1}


def test_conditions(done):
    status = {c["condition"]: c["status"] for c in done[3]["rule_conditions"]}
    assert status["Edge protection / guardrails in place"] == "breached"
    assert status["Secure, stable access (ladder / scaffold) used"] == "not_verifiable"
    kept = {c["condition"]: c["status"] for c in done[2]["rule_conditions"]}
    assert kept["Atmosphere / gas testing performed before entry"] == "in_place"
    assert done[5]["rule_conditions"][-1]["evidence"] == ["बिना हार्नेस"]


def test_all_evidence_and_actions_are_kept(spark):
    filler = " The shift then went on as planned and the team cleaned the whole area until the evening. "
    text = filler.join(f"{words} at the scaffold." for words in ("Work at height without harness", "Crew with no harness", "Rigger not wearing harness", "Then lacked guardrails", "Without fall protection", "No lifeline", "Without lanyard", "No guardrails", "Missing guardrails"))
    row = analyze(spark.createDataFrame([(1, text)], "id int, report_text string")).first()
    phrases = {m["phrase"] for m in row["matches"] if m["rule"] == row["life_saving_rule"]}
    kept = {q for c in row["rule_conditions"] if c["status"] == "breached" for q in c["evidence"]}
    assert phrases <= kept
    assert max(len(c["evidence"]) for c in row["rule_conditions"]) > 3
    barriers = ["Fall Protection", "Scaffolding / Guardrails", "Barricading", "Permit"]
    made = spark.range(1).select(suggested_actions(F.lit(True), F.lit("Working at Height"), F.array(*map(F.lit, barriers)), F.lit("HIGH"), DEFAULT).alias("a")).first()["a"]
    want = [f"Check on site and restore: {b.lower()};" for b in barriers]
    assert [w for w in want if any(a.startswith(w) for a in made)] == want and made[-1].startswith("Site visit") and len(made) == 7


def test_languages_and_failed_rows(done):
    assert done[5]["languages"] == ["hi"] and done[1]["languages"] == ["en"]
    assert done[6]["processing_status"] == "failed" and done[6]["life_saving_rule"] is None


def test_wording(done):
    assert done[1]["explanation"].startswith("Reported: “The fitter opened the valve without isolating the pump.”")
    assert done[2]["suggested_actions"] == ["No precursor found: keep the report on file, nothing else to do."]
    assert [line.split(":")[0] for line in done[1]["summary"].split("\n")] == ["Event", "Risk", "Next", "Not met"]


def test_wording_is_whole(spark):
    sentence = "The fitter opened the valve without isolating the pump " + "and went on " * 60 + "until noon."
    row = analyze(spark.createDataFrame([(sentence,)], "report_text string")).select("explanation").first()
    assert sentence in row["explanation"] and len(sentence) > 400
    words = ["gate one", "gate two", "gate three", "gate four", "gate five"]
    df = spark.createDataFrame([(", ".join(words), False, 0.5, "LOW")], "clean_text string, sif_potential boolean, confidence double, priority string").withColumns(
        {"evidence": F.array().cast("array<string>"), "uncertainty_note": F.lit(None).cast("string"), "model": F.lit("rules-v1")})
    learned = apply_signals(df, [{"phrase": w, "direction": "+", "weight": 1} for w in words], 9).first()
    assert learned["evidence"] == words and all(w in learned["uncertainty_note"] for w in words)


def test_result_does_not_depend_on_partitioning(spark, done):
    df = spark.createDataFrame(list(CASES.items()), "id int, report_text string").repartition(5)
    again = {r["id"]: (r["priority"], r["evidence"]) for r in analyze(df).select("id", "priority", "evidence").collect()}
    assert again == {i: (r["priority"], r["evidence"]) for i, r in done.items()}


def test_filter_above_analysis(spark):
    df = spark.createDataFrame(list(CASES.items()), "id int, report_text string")
    assert sorted(r[0] for r in analyze(df).filter("sif_potential").select("id").collect()) == [1, 3, 5, 8, 9]


def test_signals_never_flip_a_verdict(spark):
    df = spark.createDataFrame([("calm day, fire watch was there", False, 0.5, "LOW"), ("fire watch gone", True, 0.9, "HIGH")],
                               "clean_text string, sif_potential boolean, confidence double, priority string")
    df = df.withColumns({"evidence": F.array().cast("array<string>"), "uncertainty_note": F.lit(None).cast("string"), "model": F.lit("rules-v1")})
    a, b = apply_signals(df, [{"phrase": "fire watch", "direction": "+", "weight": 4}], 9).collect()
    assert (a["sif_potential"], a["confidence"], a["priority"], a["model"]) == (False, 0.55, "MEDIUM", "rules-v1+tuned")
    assert (b["confidence"], b["evidence"]) == (0.99, ["fire watch"])


def test_lexicon_groups_cover_every_phrase():
    grouped = [e["p"] for g in DEFAULT.indicator_groups for e in g["entries"]]
    assert sorted(grouped) == sorted(i["p"] for i in DEFAULT.indicators)
    assert all(g["anchor"] in e["p"] for g in DEFAULT.indicator_groups + DEFAULT.foreign_groups for e in g["entries"])
