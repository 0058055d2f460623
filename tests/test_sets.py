import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hazardlake.operators import datasets as ds
from hazardlake.operators import dedupe as dd
from hazardlake.operators import similarity as sm
from hazardlake.operators.ranking import group_positions, nearest_ranks


def test_positions_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [(("hot" if rng.random() < 0.8 else f"g{rng.randrange(4)}"), i) for i in rng.sample(range(10_000), 2_000)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(7)
    got = {(r["g"], r["k"]): r["position"] for r in group_positions(df, ["g"], ["k"]).collect()}
    for name in {g for g, _ in rows}:
        for n, k in enumerate(sorted(k for g, k in rows if g == name)):
            assert got[(name, k)] == n


def test_nearest_ranks(spark):
    rng = random.Random(6)
    rows = [("a" if rng.random() < 0.5 else "b", rng.randrange(50)) for _ in range(501)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r["g"]: r["mid"] for r in nearest_ranks(df, "g", "v", {"mid": F.floor(F.col("n") / 2)}).collect()}
    for name in "ab":
        values = sorted(v for g, v in rows if g == name)
        assert got[name] == values[len(values) // 2]


def test_import_guard(spark):
    store = spark.createDataFrame([(1, "RPT-0001", "Oil spill!"), (2, "RPT-0002", "oil SPILL")], "id int, report_id string, report_text string")
    batch = spark.createDataFrame([(1, "oil   spill"), (2, "New one"), (3, "new ONE."), (4, " "), (5, "Other")], "row_no int, report_text string")
    got = {r["row_no"]: (r["import_state"], r["duplicate_of"]) for r in dd.import_guard(batch, store).collect()}
    assert got == {1: ("duplicate", "RPT-0001"), 2: ("new", None), 3: ("duplicate", "2"), 4: ("empty", None), 5: ("new", None)}
    kept = dd.import_guard(batch, store).filter("import_state = 'new'").select("row_no", "report_text")
    assert dd.import_guard(kept, store).filter("import_state <> 'new'").count() == 0


def test_splits_are_disjoint_and_even(spark):
    rows = spark.range(1_000).select(F.col("id"), (F.col("id") % 137).alias("incident"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    split = ds.grouped_split(rows, "incident", "label", "id")
    assert split.count() == 1_000
    assert split.groupBy("incident").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    folds = ds.stratified_folds(rows, ["label"], "id", 5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert max(sizes) - min(sizes) <= 1
    parts = {r["split"] for r in ds.fraction_split(rows.limit(3), "label", "id").collect()}
    assert "testing" in parts or len(parts) == 1


def test_sampling_ignores_partitioning(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 2)
    first = {r["id"] for r in ds.sample_per_group(df, "g", "id", 40).collect()}
    assert first == {r["id"] for r in ds.sample_per_group(df.repartition(11), "g", "id", 40).collect()} and len(first) == 80


def _score(q, p):
    mine, other = set(q[1].split()), set(p[1].split())
    if not mine or not other:
        return 0
    s = 0.5 * len(mine & other) / len(mine | other) + 0.18 * (p[2] is not None and p[2] == q[2]) + 0.12 * bool(set(p[5]) & set(q[5]))
    return s + 0.08 * (p[3] == q[3]) + 0.12 * (p[4] is not None and q[4] is not None and p[4].lower() == q[4].lower())


REPORT = "id long, report_text string, rule string, hazard string, activity string, barriers array<string>"


def _reports(n, words, most, seed=11):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, most))), rng.choice(["r1", "r2", None]), rng.choice(["h1", "h2"]),
             rng.choice(["Lift", "lift", "Dig", None]), rng.sample(["b1", "b2", "b3"], rng.randrange(3))) for i in range(n)]


WORDS = ["valve", "pump", "crane", "permit", "ladder", "harness", "gas", "leak", "guard", "tank"]


def test_similarity_against_brute_force(spark):
    rows = _reports(60, WORDS, 7)
    df = spark.createDataFrame(rows, REPORT)
    got = {}
    for r in sm.similar_reports(df, df, k=4, block_rows=7).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["match_id"], round(r["score"], 9)))
    for q in rows:
        scored = [(p[0], round(s, 9)) for p in rows if p[0] != q[0] and (s := _score(q, p)) >= 0.16 - 1e-12]
        assert got.get(q[0], []) == sorted(scored, key=lambda x: (-x[1], x[0]))[:4]


def test_the_oldest_of_many_reports_is_found(spark):
    rows = [(0, "unique twin words here", "r", "h", "a", ["b"])] + _reports(3000, WORDS, 7)[1:] + [(3000, "unique twin words here", "r", "h", "a", ["b"])]
    df = spark.createDataFrame(rows, REPORT)
    found = sm.similar_reports(df.filter("id = 3000"), df, k=1)
    assert [(r["query_id"], r["match_id"]) for r in found.collect()] == [(3000, 0)]
    assert {(r["query_id"], r["match_id"]) for r in sm.near_duplicates(df).filter("query_id in (0, 3000)").collect()} == {(3000, 0), (0, 3000)}


def test_near_duplicates_against_brute_force(spark):
    rows = _reports(150, WORDS[:5], 6, 3) + [(200 + i, "same old words again", "r1", "h1", "Dig", ["b1"]) for i in range(4)]
    got = {r["query_id"]: r["match_id"] for r in sm.near_duplicates(spark.createDataFrame(rows, REPORT)).collect()}
    want = {}
    for q in rows:
        score, other = min((-round(_score(q, p), 9), p[0]) for p in rows if p[0] != q[0])
        if round(min(-score, 0.99) + 1e-9, 2) >= 0.88:
            want[q[0]] = other
    assert want and got == want


def test_variants_are_new_and_distinct(spark):
    seeds = spark.createDataFrame([(1, "Pump 12 leaked. The worker left."), (2, "Crane 3 swung. The technician ran."), (3, "Tank 9 was hot. It was shut.")],
                                  "id int, text string").withColumn("rule", F.lit("r"))
    made = ds.text_variants(seeds, "text", "id", "rule", 5).collect()
    texts = [r["variant_text"] for r in made]
    assert made and len(set(texts)) == len(texts) and not set(texts) & {r["text"] for r in seeds.collect()}


def test_variants_are_made_where_the_partner_has_arrived(spark):
    whole = "The pump {0} leaked in area {0}. The tanker left the tank. Then? It was shut {1}."
    rows = [(n, whole.format(n, n), "ab"[n % 2] if n % 7 else None) for n in range(60)]
    seeds = spark.createDataFrame([*rows, (60, "Only one sentence here", "a"), (61, None, "b")], "id int, text string, rule string")
    made = ds.text_variants(seeds, "text", "id", "rule", 4)
    got = {r["variant_text"] for r in made.collect()}
    assert got & {f"The compressor {n} leaked in zone {n}. The tanker left the vessel. Then? It was shut {n}." for n in range(60)}
    assert got & {whole.format(n, m) for n in range(60) for m in range(60) if n != m}
    # a text travels once, not once for each variant
    lines = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(n for n, line in enumerate(lines) if "Generate explode" in line)
    below = lines[at].index("Generate")
    inside = [line for line in lines[at + 1:] if len(line) - len(line.lstrip(" :+-")) > below]
    assert any("Join LeftOuter" in line for line in inside[:8])


def test_nothing_is_cut(spark):
    from hazardlake.operators import feedback as fb
    from hazardlake.operators import registry as rg
    from hazardlake.plans.imports import import_reports
    dated = spark.range(15_000).withColumn("date", F.lit("2024-01-01").cast("date"))
    assert rg.newest_first(dated, 12_000).count() == 12_000
    tail = "calm weather here. " * 4_000 + "The lockout tag was missing on breaker 7 while the electrician worked."
    done = import_reports(spark.createDataFrame([(tail, "S" * 300)], "Description string, Site string"), source="a" * 200).first()
    assert done["report_text"] == tail and done["site"] == "S" * 300 and len(done["source"]) == 207 and done["sif_potential"]
    reviews = spark.createDataFrame([(1, 7, "confirmed", "Hot Work Safety", None), (2, 7, None, None, "LOW")], "id long, report_pk long, decision string, corrected_rule string, corrected_priority string")
    findings = spark.createDataFrame([(7, True, "Line of Fire", "HIGH")], "report_pk long, sif_potential boolean, life_saving_rule string, priority string")
    assert [(r["human_rule"], r["human_priority"]) for r in fb.capture(reviews, findings).orderBy("id").collect()] == [("Hot Work Safety", "HIGH"), ("Line of Fire", "LOW")]


def test_signals_of_both_directions(spark):
    from hazardlake.operators import feedback as fb
    rows = [(True, False, " ".join(f"valve leak{i} tank" for i in range(30)))] + [(False, True, "pump guard fine")]
    mined = fb.mine_signals(spark.createDataFrame(rows, "human_sif boolean, ai_sif boolean, report_text string"), ["valve", "pump"], k=5).collect()
    assert sorted(r["direction"] for r in mined)[:5] == ["+"] * 5 and {"pump guard"} <= {r["phrase"] for r in mined if r["direction"] == "-"}


def test_import_numbers_hold_in_many_partitions(spark):
    from hazardlake.plans.imports import import_reports
    rows = spark.range(600).select(F.concat(F.lit("Worker slipped near pump "), (F.col("id") % 200).cast("string")).alias("Description")).repartition(200)
    states = import_reports(rows).groupBy("import_state").count().collect()
    assert {r["import_state"]: r["count"] for r in states} == {"new": 200, "duplicate": 400}


def test_model_queries_use_all_folds_and_the_whole_vocabulary(spark, folder, monkeypatch):
    import __spark_entry__
    from hazardlake.operators import learning
    asked = []
    monkeypatch.setattr(learning, "cross_validate", lambda df, folds, models, **more: asked.append((folds, len(models), more)) or df.select("fold").limit(1))
    for name in ("m2_m3_model_comparison", "m5_repeated_folds"):
        __spark_entry__.queries()[name](spark, folder)
    assert asked == [(5, 4, {})] + [(5, 1, {})] * 3


def test_shares_of_the_rest():
    assert ds.share_caps(["a", "b", "c"], 1000, whole=["w"]) == {"w": None, "a": 450, "b": 247, "c": 136}
    assert ds.share_caps(["a", "b"], 1) == {"a": 1, "b": 1}


def test_sample_shares(spark):
    rows = spark.range(100).select(F.col("id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("g"))
    taken = ds.sample_shares(rows, "g", "id", {"a": 7, "b": None})
    assert {r["g"]: r["count"] for r in taken.groupBy("g").count().collect()} == {"a": 7, "b": 25}
    assert sorted(map(str, taken.collect())) == sorted(map(str, ds.sample_shares(rows.repartition(9), "g", "id", {"a": 7, "b": None}).collect()))


def test_near_sets_are_found_without_reading_texts_again(spark):
    rng = random.Random(5)
    words = [f"w{n:03d}" for n in range(400)]
    sets = [set(rng.sample(words, rng.randrange(3, 90))) for _ in range(60)]
    sets += [set(rng.sample(sorted(s), max(1, int(len(s) * rng.choice([0.7, 0.76, 0.9]))))) | set(rng.sample(words, rng.randrange(4))) for s in sets]
    rows = [(n, " ".join(sorted(s)), "r1" if n % 3 else "r2", "h", "a", ["b"]) for n, s in enumerate(sets)]
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[2] == b[2] and 4 * len(set(a[1].split()) & set(b[1].split())) >= 3 * len(set(a[1].split()) | set(b[1].split()))}
    df = spark.createDataFrame(rows, REPORT)
    table = df.select("id", F.unhex(F.sha2("report_text", 256)).alias("set"), F.col("report_text").alias("tokens"), F.col("rule").alias("block"))
    told = {bytes(r["set"]): r["tokens"] for r in table.collect()}
    found = [tuple(sorted((told[bytes(r["a"])], told[bytes(r["b"])]))) for r in sm._token_pairs(table, 0.75).collect()]
    assert want and len(found) == len(set(found)) and set(found) == want
    assert "regexp_extract_all" not in sm.near_duplicates(df)._jdf.queryExecution().toString()


def test_similar_reports_of_bounded_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sm, "FIRST_ROWS", 40)
    rng = random.Random(8)
    words = [f"w{n:03d}" for n in range(120)]
    rows = [(n, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))), rng.choice(["r1", "r2", "r3", "r4", None]), rng.choice(["h1", "h2"]),
             rng.choice(["Lift", "Dig", None]), rng.sample([f"b{n}" for n in range(80)], rng.randrange(12))) for n in range(400)]
    rows += [(400 + n, r[1] + " w000", rng.choice(["r1", "r2", None]), *r[3:]) for n, r in enumerate(rows[:200])]
    df = spark.createDataFrame(rows, REPORT)
    found = sm.similar_reports(df, df, k=3, block_rows=150)
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["match_id"], round(r["score"], 9)))
    scored = {q[0]: sorted(((p[0], round(s, 9)) for p in rows if p[0] != q[0] and (s := _score(q, p)) >= 0.16 - 1e-12), key=lambda x: (-x[1], x[0]))[:3] for q in rows}
    assert {i: got.get(i, []) for i in scored} == scored


def test_near_sets_in_small_pieces_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(sm, "PAIRS", 5)
    rng = random.Random(9)
    words = [f"w{n:02d}" for n in range(25)]
    made = [sorted(rng.sample(words, rng.randrange(1, 14))) for _ in range(120)]
    made += [sorted({*s[1:], rng.choice(words)}) for s in made] + made[:40]
    rows = [(n, " ".join(s), f"r{n % 2}") for n, s in enumerate(made)]
    want = {tuple(sorted((a[1], b[1]))) for a in rows for b in rows if a[1] != b[1] and a[2] == b[2] and 4 * len(set(a[1].split()) & set(b[1].split())) >= 3 * len(set(a[1].split()) | set(b[1].split()))}
    table = spark.createDataFrame(rows, "id long, tokens string, block string").withColumn("set", F.unhex(F.sha2("tokens", 256))).select("id", "set", "tokens", "block")
    told = {bytes(r["set"]): r["tokens"] for r in table.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        pairs = sm._token_pairs(table, 0.75)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = [tuple(sorted((told[bytes(r["a"])], told[bytes(r["b"])]))) for r in pairs.collect()]
    assert want and len(found) == len(set(found)) and set(found) == want
    plan = pairs._jdf.queryExecution().toString()  # what reads the pairs twice must not search them twice
    assert "MapInArrow" not in plan and "Exchange" not in plan


def test_odd_counts_leave_out_no_close_pair():
    rng = random.Random(3)
    code = lambda: rng.randrange(-2**63, 2**63)
    a = [[code() for _ in range(n)] for n in (1, 31, 32, 33, 100, 700)]
    b = [[*s[:len(s) - len(s) // 8], *(code() for _ in range(len(s) // 9))] for s in a]
    close = [(x, y) for x, y in zip(a, b, strict=True) if len({*x} & {*y}) >= 0.75 * len({*x} | {*y})]
    far = [(a[5], [code() for _ in a[5]]), (a[4], a[4][:70] + [code() for _ in range(30)])]
    sides = []
    for lists in zip(*close, *far, strict=True):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.int64()))], names=["s1", "s2", "codes"])
        sides.append(next(sm._odd_counts(iter([batch]))))
    (x, y) = sides
    assert len({len(v) for v in x.column("marks").to_pylist()}) > 3 and any(len(p) != len(q) for p, q in zip(x.column("marks").to_pylist(), y.column("marks").to_pylist(), strict=True))
    both = pa.RecordBatch.from_arrays([*x.columns[:2], *y.columns[:2], x.column("n"), y.column("n"), x.column("marks"), y.column("marks")], names=["a_s1", "a_s2", "b_s1", "b_s2", "a_n", "b_n", "x", "y"])
    kept = next(sm._possible(0.75)(iter([both]))).column("a_s1").to_pylist()
    assert len(close) == 6 and kept == list(range(6))


def test_search_scores_a_query_within_its_group_and_loses_no_match(monkeypatch):
    rng = random.Random(12)
    words = [rng.randrange(-2**62, 2**62) for _ in range(3_000)]
    rows = []
    for _ in range(70):
        base = rng.sample(words, rng.randrange(20, 60))
        of = [rng.choice([0, 11, 12, 13, 14]), rng.choice([21, 22]), rng.choice([0, 31, 32, 33, 34, 35, 36])]
        for _ in range(9):
            own = list(dict.fromkeys(base[:len(base) - rng.randrange(12)] + rng.sample(words, rng.randrange(9))))
            now = [v if rng.random() < 0.7 else rng.choice([0, v + 1]) for v in of]
            rows.append((len(rows), own, *now, rng.sample(range(40, 60), 2)))

    def score(q, p):
        common = len({*q[1]} & {*p[1]})
        return 0.5 * common / (len(q[1]) + len(p[1]) - common) + sum(w for w, i in ((0.18, 2), (0.08, 3), (0.12, 4)) if q[i] and q[i] == p[i]) + 0.12 * bool({*q[5]} & {*p[5]})

    def table(some):
        lists = lambda i: pa.array([r[i] for r in some], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in some]), lists(1), *[pa.array([r[i] for r in some]) for i in (2, 3, 4)], lists(5)], names=["id", "codes", *sm._VALUES, "barriers"])

    asked = table(rows[::3])
    block = {c: asked.column(c).to_numpy() for c in ("id", *sm._VALUES)}
    for sizes, items in (("n", "codes"), ("n_barriers", "barriers")):
        block[sizes], block[items] = sm._lists(asked.column(items))
    scored = []
    keep = sm._Search._keep
    monkeypatch.setattr(sm._Search, "_keep", lambda self, own, r, q, shared: scored.append(len(r)) or keep(self, own, r, q, shared))
    monkeypatch.setattr(sm, "PAIRS", 5_000)
    monkeypatch.setattr(sm, "HELD", 10_000)
    first = sm._Search(block, 4, np.full(len(block["id"]), 0.16), grouped=True)
    first.add(table(rows))
    assert sum(scored) < 0.2 * len(rows) * len(block["id"])
    second = sm._Search(block, 4, first.least.copy())
    assert {*second.kind.tolist()} == {sm.BOTH, sm.BY_RULE, sm.BY_ACTIVITY, sm.EVERY}
    scored.clear()
    for start in range(0, len(rows), 100):
        second.add(table(rows[start:start + 100]))
    assert sum(scored) < 0.4 * len(rows) * len(block["id"])
    got = {}
    for q, i, s in zip(*second.best, strict=True):
        got.setdefault(int(block["id"][q]), []).append((int(i), round(float(s), 9)))
    for q in rows[::3]:
        want = sorted(((p[0], round(s, 9)) for p in rows if p[0] != q[0] and (s := score(q, p)) >= 0.16), key=lambda x: (-x[1], x[0]))[:4]
        assert got[q[0]] == want
