"""Dataset building: text reconstruction, sampling, splits, profiles."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.functions import text as tx
from hazardlake.functions.columns import fence, let
from hazardlake.operators.ranking import group_positions, nearest_ranks


def rebuild_text(lines: DataFrame, key: str, line_no: str, text: Column, glue: str) -> DataFrame:
    """Lines of one document joined in line order; a document is bounded by its own lines."""
    rows = lines.select(key, F.struct(F.col(line_no).alias("n"), text.alias("t")).alias("line"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return grouped.select(key, F.concat_ws(glue, F.transform("lines", lambda x: x["t"])).alias("description"),
                          F.size("lines").alias("line_count"))


def join_abstracts(summaries: DataFrame, abstracts: DataFrame, key: str, event: str, abstract: str) -> DataFrame:
    """Event line and abstract joined into one description, the event left out where the abstract holds it."""
    e, a = F.coalesce(event, F.lit("")), F.coalesce(abstract, F.lit(""))
    both = (e != "") & (a != "") & ~F.lower(a).contains(F.lower(e))
    text = F.when(both, F.concat(e, F.lit(" "), a)).when(a != "", a).otherwise(e)
    return summaries.join(abstracts, key, "left").withColumn("description", text)


# ---- source mapping --------------------------------------------------------

INPUTS = ["report_id", "incident_id", "report_type", "site_name", "activity", "date_reported", "description",
          "actual_severity", "location_detail", "source_name"]
# Y-flag columns that name the operation and the cause.
OPERATIONS = ["Production", "Drilling", "Workover", "Completion", "Motor Vessel", "Pipeline", "Helicopter", "Exploration",
              "Development Production"]
CAUSES = ["Equipment Failure", "Human Error", "Slip Trip and Fall", "Weather", "External Damage", "Leak"]
SOURCE_RANK = {"osha_abstract": 0, "msha": 1, "bsee": 2, "osha_summary": 3}
MIN_LENGTH = 15


def _given(df: DataFrame, name: str) -> Column:
    return tx.cell_or_default(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def _iso(value: Column) -> Column:
    return F.coalesce(tx.parse_date(value).cast("string"), F.lit(""))


def _narrative(value: Column) -> Column:
    return tx.collapse(F.coalesce(value, F.lit("")))


def map_mine_accidents(df: DataFrame) -> DataFrame:
    """Mine accident rows; the incident is mine, day and document together."""
    g = lambda n: _given(df, n)
    incident = F.concat_ws("|", g("MINE_ID"), g("AI_DT"), F.coalesce(F.nullif(g("DOCUMENT_NO"), F.lit("")), F.lit("nd")))
    return df.select(
        F.concat(F.lit("MSHA-"), F.replace(incident, F.lit("|"), F.lit("-"))).alias("report_id"), incident.alias("incident_id"),
        F.lit("MSHA mine accident").alias("report_type"),
        F.coalesce(F.nullif(g("OPERATOR_NAME"), F.lit("")), g("CONTROLLER_NAME")).alias("site_name"),
        g("AI_ACTY_DESC").alias("activity"), _iso(g("AI_DT")).alias("date_reported"),
        _narrative(F.col("AI_NARR")).alias("description"), g("INJ_DEGR_DESC").alias("actual_severity"),
        g("UG_LOCATION").alias("location_detail"), F.lit("msha").alias("source_name"))


def map_incident_summaries(df: DataFrame) -> DataFrame:
    g = lambda n: _given(df, n)
    key = F.concat(F.lit("OSHA-SUM-"), g("SUMMARY_NR"))
    blank = F.lit("")
    return df.select(
        key.alias("report_id"), key.alias("incident_id"), F.lit("OSHA incident summary").alias("report_type"),
        blank.alias("site_name"), blank.alias("activity"), _iso(g("EVENT_DATE")).alias("date_reported"),
        _narrative(F.col("EVENT_DESC")).alias("description"),
        F.when(F.upper(g("FATALITY")) == "X", "Fatality").otherwise("").alias("actual_severity"),
        blank.alias("location_detail"), F.lit("osha_summary").alias("source_name"))


def map_abstract_lines(df: DataFrame) -> DataFrame:
    """Line-split abstracts rebuilt to one row per incident."""
    lines = df.select(_given(df, "SUMMARY_NR").alias("nr"), F.coalesce(F.col("LINE_NR").try_cast("int"), F.lit(0)).alias("line"),
                      F.coalesce("ABSTRACT_TEXT", F.lit("")).alias("text")).filter(F.col("nr") != "")
    whole = rebuild_text(lines, "nr", "line", F.col("text"), " ")
    key, blank = F.concat(F.lit("OSHA-ABS-"), "nr"), F.lit("")
    return whole.select(
        key.alias("report_id"), key.alias("incident_id"), F.lit("OSHA fatality narrative").alias("report_type"),
        blank.alias("site_name"), blank.alias("activity"), blank.alias("date_reported"), _narrative(F.col("description")).alias("description"),
        F.lit("Fatality").alias("actual_severity"), blank.alias("location_detail"), F.lit("osha_abstract").alias("source_name"))


def _count(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string").try_cast("double").cast("int"), F.lit(0))


def map_offshore_incidents(df: DataFrame) -> DataFrame:
    """Offshore incidents: severity from the casualty columns, activity and causes from the flag columns."""
    g = lambda n: _given(df, n)
    total = lambda names: sum((_count(df, n) for n in names), F.lit(0))
    deaths = total([n for n in df.columns if n in ("Operator Fatalities", "Contractor Fatalities")])
    injuries = total([n for n in df.columns if "Injuries" in n])
    flagged = lambda names: [F.when(F.upper(g(n)) == "Y", F.lit(n)) for n in names if n in df.columns]
    place = F.coalesce(F.nullif(g("Structure Name"), F.lit("")), F.trim(F.concat_ws(" ", g("Area Name"), g("Block"))))
    key = F.concat(F.lit("BSEE-"), g("SN_EV_MASTERS"))
    return df.filter(g("SN_EV_MASTERS") != "").select(
        key.alias("report_id"), key.alias("incident_id"), F.lit("BSEE offshore incident").alias("report_type"),
        g("Operator Name").alias("site_name"),
        F.concat_ws(" / ", *flagged(OPERATIONS), F.nullif(g("Other Operation"), F.lit(""))).alias("activity"),
        _iso(g("Date")).alias("date_reported"), _narrative(F.col("`Incident Summary`")).alias("description"),
        F.when(deaths > 0, "Fatality").when(injuries > 0, "Injury").otherwise("").alias("actual_severity"),
        place.alias("location_detail"), F.lit("bsee").alias("source_name"),
        F.concat_ws(" / ", *flagged(CAUSES)).alias("causes"))


def with_origins(df: DataFrame, fields: list[str]) -> DataFrame:
    """``<field>_origin``: original where the source gave a value, else unknown."""
    return df.withColumns({f"{f}_origin": F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", "original").otherwise("unknown")
                           for f in fields})


def near_miss_type(degree: Column, description: Column) -> Column:
    """Near miss where the degree says accident only, or the text says near miss."""
    low = F.lower(F.coalesce(description, F.lit("")))
    hit = F.upper(F.coalesce(degree, F.lit(""))).contains("ACCIDENT ONLY") | low.contains("near miss") | low.contains("near-miss")
    return F.when(hit, "Near miss").otherwise("")


def flat_outputs(analysed: DataFrame) -> DataFrame:
    """Analysis columns as flat text for a dataset file."""
    joined = lambda c: F.concat_ws("; ", c)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return analysed.select(
        "*", joined("equipment").alias("equipment_text"), joined("barrier_failure").alias("barrier_text"), text("life_saving_rule").alias("lsr"),
        F.when(F.col("sif_potential"), "1").otherwise("0").alias("sif_label"), text("potential_consequence").alias("potential_severity"),
        joined("evidence").alias("precursor"), text("confidence").alias("sif_probability"), text("explanation").alias("reason"),
        joined("suggested_actions").alias("suggested_immediate_action"), F.coalesce("summary", F.lit("")).alias("short_summary"))


# ---- sampling and splits -----------------------------------------------------

def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def sample_per_group(df: DataFrame, group: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per group, chosen by hash: the same rows on any cluster and partitioning."""
    placed = group_positions(df.select(group, key, hash_order(F.col(key), seed).alias("_h")), [group], ["_h", key])
    return df.join(placed.filter(F.col("position") < cap).select(key), key, "left_semi")


def share_caps(groups: Sequence[str], target: int, share: float = 0.45, whole: Collection[str] = ()) -> dict[str, int | None]:
    """Rows to take of each group, in the given order: a share of what is left of the target, one at least; None takes all."""
    caps: dict[str, int | None] = {g: None for g in whole}
    for group in groups:
        if group not in caps:
            caps[group] = max(1, int(target * share))
            target -= caps[group]
    return caps


def sample_shares(df: DataFrame, group: str, key: str, caps: Mapping[str, int | None], seed: int = 42) -> DataFrame:
    """At most each group's own number of rows, chosen by hash; groups without an entry give none."""
    placed = group_positions(df.select(group, key, hash_order(F.col(key), seed).alias("_h")), [group], ["_h", key])
    fits = F.coalesce(*[F.when(F.col(group) == g, F.lit(True) if cap is None else F.col("position") < cap) for g, cap in caps.items()], F.lit(False))
    return df.join(placed.filter(fits).select(key), key, "left_semi")


def reservoir(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows with the smallest hash; a top-k, so each task forwards k rows at most."""
    return df.withColumn("_h", hash_order(F.col(key), seed)).orderBy("_h", key).limit(k).drop("_h")


def stratified_folds(df: DataFrame, strata: list[str], key: str, k: int) -> DataFrame:
    """Round-robin folds inside each stratum."""
    placed = group_positions(df.select(key, *strata), strata, [key])
    return placed.withColumn("fold", (F.col("position") % k).cast("int")).drop("position")


def grouped_split(rows: DataFrame, incident: str, label: str, order: str) -> DataFrame:
    """60/20/20 split by incident; an incident's stratum is the label of its last row."""
    incidents = rows.groupBy(incident).agg(F.max_by(label, order).alias("stratum"))
    placed = group_positions(incidents, ["stratum"], [incident])
    bucket = F.col("position") % 10
    name = F.when(bucket <= 5, "train").when(bucket <= 7, "validation").otherwise("test")
    return rows.join(placed.select(incident, name.alias("split")), incident)


def fraction_split(rows: DataFrame, label: str, key: str, seed: int = 42, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Shares of each label in hash order; three or more rows always leave one for testing."""
    placed = group_positions(rows.select(label, key, hash_order(F.col(key), seed).alias("_h")), [label], ["_h", key])
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))  # one row per label
    n = F.col("n")
    t0, v0 = F.round(n * train).cast("long"), F.round(n * validation).cast("long")
    v1 = F.when(t0 + v0 > n, F.greatest(F.lit(0), n - t0)).otherwise(v0)
    short = (n >= 3) & (n - t0 - v1 == 0)
    v2 = F.when(short & (v1 > 0), v1 - 1).otherwise(v1)
    t2 = F.when(short & (v1 == 0), t0 - 1).otherwise(t0)
    p = F.col("position")
    cuts = sizes.select(label, t2.alias("_t"), v2.alias("_v"))
    return placed.join(cuts, label).select(key, label, F.when(p < F.col("_t"), "training").when(
        p < F.col("_t") + F.col("_v"), "validation").otherwise("testing").alias("split"))


# ---- profiles ----------------------------------------------------------------

def quality_profile(df: DataFrame, group: str, text: str, fields: list[str]) -> DataFrame:
    """Per source: rows, texts, exact median and p90 length by rank, and missing fields among rows with text."""
    full = F.length(F.trim(text)) > 0
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(full).alias("with_text"),
                                   *[F.count_if(full & empty(c)).alias(f"missing_{c}") for c in fields])
    lengths = df.filter(full).select(group, F.length(text).cast("long").alias("chars"))
    ranks = nearest_ranks(lengths, group, "chars", {"median_chars": F.floor(F.col("n") / 2), "p90_chars": F.floor(F.col("n") * 0.9)})
    shaped = ranks.select(group, "median_chars", F.round(F.col("_total") / F.col("n"), 0).alias("mean_chars"), "p90_chars",
                          F.col("max_value").alias("max_chars"))
    return counts.join(shaped, group, "left")


def rebuild_statistics(lines: DataFrame, key: str, text: str) -> DataFrame:
    """Counts of a line-split text table, from one aggregate per key."""
    per = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.trim(F.col(text)) != "").alias("has_text"))
    return per.agg(F.sum("n").alias("line_rows"), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") > 1).alias("multi_line"),
                   F.count_if(F.col("n") == 1).alias("single_line"), F.count_if(~F.col("has_text")).alias("zero_text"), F.max("n").alias("max_lines"))


# ---- variants ------------------------------------------------------------------

# Words that may stand for each other, and clauses that may be appended.
SWAPS = [("worker", "operator"), ("technician", "mechanic"), ("tank", "vessel"), ("crane", "hoist"), ("pump", "compressor"), ("area", "zone")]
CLAUSES = ["The shift supervisor was informed.", "Work was stopped until the area was checked.", "A toolbox talk followed.",
           "The weather was clear at the time."]


def text_variants(seeds: DataFrame, text: str, key: str, rule: str, per_seed: int, seed: int = 42) -> DataFrame:
    """Variants of each text by hash-chosen edits: numbers moved, words swapped, a clause added, or the second half
    taken from the next text of the same rule.  Equal fingerprints and copies of a seed are dropped."""
    pick = F.pmod(F.xxhash64(F.col(key), "variant", F.lit(seed)), F.lit(4))
    choice = F.pmod(F.xxhash64("variant", F.col(key), F.lit(seed + 1)), F.lit(len(CLAUSES))).cast("int")
    bump = F.transform(F.split(text, r"(?<=\d)(?!\d)|(?<!\d)(?=\d)"), lambda w: F.when(
        w.rlike(r"^\d{1,9}$"), (w.try_cast("long") + 1 + F.col("variant")).cast("string")).otherwise(w))
    swapped = F.col(text)
    for a, b in SWAPS:  # the word first, its boundaries only where it stands
        swapped = F.regexp_replace(swapped, rf"{a}(?<=\b{a})\b", b)
    sentences = F.split(text, r"(?<=[.!?])\s+")
    half = lambda own: F.ceil(F.size(own) / 2).cast("int")
    front, back = lambda own: F.slice(own, F.lit(1), half(own)), lambda own: F.slice(own, half(own) + 1, F.size(own))
    own_key = lambda c: F.sha2(tx.fingerprint(c), 256)
    # The partner of a text is the next one of its rule in hash order, found without one big sort per rule. Keys meet first; then
    # a partner sends its second half once, and a text is multiplied where that has arrived.
    places = group_positions(seeds.select(rule, key, hash_order(F.col(key), seed).alias("_h")), [rule], ["_h", key])
    pairs = places.select(key, rule, "position").join(places.select(rule, (F.col("position") - 1).alias("position"), F.col(key).alias("_mate")), [rule, "position"])
    tails = seeds.select(F.col(key).alias("_mate"), let(sentences, back).alias("_tail"))
    met = seeds.select(key, rule, text).join(pairs.select(key, "_mate").join(tails, "_mate").select(key, "_tail"), key, "left")
    many = met.withColumn("_seed", fence(own_key(F.col(text)))).withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(per_seed))))
    crossed = let(sentences, lambda own: F.concat_ws(" ", front(own), F.coalesce("_tail", back(own))))
    edited = (F.when(pick == 0, F.array_join(bump, "")).when(pick == 1, swapped)
              .when(pick == 2, F.concat(F.col(text), F.lit(" "), F.get(F.array(*[F.lit(c) for c in CLAUSES]), choice))).otherwise(crossed))
    made = many.select(key, rule, "variant", "_seed", fence(edited).alias("variant_text"))
    # a copy of its own seed stays here; its group would be dropped below
    keyed = made.withColumn("_key", fence(own_key(F.col("variant_text")))).filter(F.col("_key") != F.col("_seed"))
    originals = seeds.select(own_key(F.col(text)).alias("_key")).distinct()
    first = keyed.groupBy("_key").agg(F.min(F.struct(key, "variant", rule, "variant_text")).alias("v"))
    return first.join(originals, "_key", "left_anti").select(f"v.{key}", f"v.{rule}", "v.variant", "v.variant_text")


def source_statistics(df: DataFrame, source: str, text: str) -> DataFrame:
    """Rows, empty texts and different texts of each source; texts travel as digests, counted before they meet."""
    digests = df.select(source, F.md5(text).alias("_k"), (F.coalesce(tx.strip(F.col(text)), F.lit("")) == "").alias("_empty"))
    per_text = digests.groupBy(source, "_k").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_empty").alias("_blank"))
    return per_text.groupBy(source).agg(F.sum("_n").alias("n"), F.sum("_blank").alias("empty_texts"), F.count("_k").alias("different_texts"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, by falling count, then value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)
