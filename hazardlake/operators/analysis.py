"""Report analysis: scoring, classification, extraction, explanation — row-local column expressions and one Arrow function that finds words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.functions import spans
from hazardlake.functions import text as tx
from hazardlake.functions.columns import all_labels, blank_to_null, constant, fence, first_label, has_any, let, word_list
from hazardlake.functions.presence import words_found
from hazardlake.lexicon import DEFAULT, Lexicon
from hazardlake.operators.conditions import breached_labels, rule_conditions, term_positions
from hazardlake.vocab import english, foreign

MODEL_TAG = "rules-v1"
MATCH = ("struct<rule:string,rule_ord:int,phrase:string,start:int,end:int,hazard:string,"
         "consequence:string,barrier:string,negated:boolean>")
FALLBACK_NOTE = "No indicator phrase was found. The rule shown is only the closest one by shared words; a reviewer should confirm it."
NOTHING_TO_DO = "No precursor found: keep the report on file, nothing else to do."


# The functions below take the lowercased text where only its words matter, so that the
# caller lowers each text once; where only their presence does, its ``words_found`` will do.

# ---- predicates and scores -------------------------------------------------

def has_exposure(low: Column) -> Column:
    return has_any(low, english.EXPOSURE_TERMS)


def act_or_condition(low: Column) -> Column:
    return (F.when(has_any(low, english.ACT_ACTORS), F.lit(english.UNSAFE_ACT))
            .when(has_any(low, english.CONDITION_WORDS), F.lit(english.UNSAFE_CONDITION)))


def priority_factors(matches: Column, low: Column) -> Column:
    """Indicators, severity, exposure and barrier failure; all zero without a match."""
    n = F.size(matches)
    grave = F.exists(matches, lambda m: F.lower(m["consequence"]).rlike("fatality|serious injury"))
    failed = F.exists(matches, lambda m: m["negated"]) | has_any(low, english.MISSING_CONTROL_TERMS)
    found = n > 0
    as_int = lambda c: F.when(found & c, F.lit(1)).otherwise(F.lit(0))
    return F.struct(n.alias("indicators"),
                    F.when(~found, F.lit(0)).when(grave, F.lit(2)).otherwise(F.lit(1)).alias("severity"),
                    as_int(has_exposure(low)).alias("exposure"), as_int(failed).alias("barrier_failure"))


def priority_label(factors: Column) -> Column:
    score = (F.least(factors["indicators"], F.lit(3)) + factors["severity"] + factors["exposure"]
             + factors["barrier_failure"])
    return F.when(score >= 5, F.lit("HIGH")).when(score >= 3, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def confidence(factors: Column) -> Column:
    raw = F.least(F.lit(0.97), F.lit(0.62) + F.lit(0.11) * factors["indicators"] + F.lit(0.05) * factors["severity"])
    return F.when(factors["indicators"] == 0, F.lit(0.55)).otherwise(F.round(raw, 2))


# ---- rule classification ---------------------------------------------------

def rule_counts(matches: Column) -> Column:
    """(rule, count) per matched rule, most matched first, then rule order."""
    distinct = F.array_distinct(F.transform(matches, lambda m: F.struct(m["rule_ord"], m["rule"])))
    counted = F.transform(distinct, lambda d: F.struct(
        (-F.size(F.filter(matches, lambda m: m["rule_ord"] == d["rule_ord"]))).alias("k"),
        d["rule_ord"].alias("rule_ord"), d["rule"].alias("rule")))
    return F.transform(F.array_sort(counted), lambda c: F.struct(c["rule"].alias("rule"), (-c["k"]).alias("count")))


def profile_rule(low: Column, lexicon: Lexicon) -> Column:
    """Closest rule by shared profile words, with its low confidence."""
    tokens = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))

    def score(words: Column) -> Column:
        def of_rule(p: Column) -> Column:
            shared = lambda part: F.size(F.array_intersect(words, part))
            return F.struct((-(shared(p["one"]) + 2 * shared(p["two"]) + 3 * shared(p["three"]))).alias("k"),
                            p["r"].alias("r"))
        return F.get(F.array_sort(F.transform(lexicon.profile_column(), of_rule)), F.lit(0))

    vocabulary = sorted({w["token"] for w in lexicon.profile_weights})
    known = F.array_intersect(tokens, F.split(F.lit(" ".join(vocabulary)), " "))
    names = word_list(lexicon.rule_names)
    return let(let(known, score), lambda s: F.struct(
        F.get(names, F.when(s["k"] < 0, s["r"]).otherwise(F.lit(0))).alias("rule"),
        F.when(s["k"] == 0, F.lit(0.10)).otherwise(
            F.round(F.least(F.lit(0.55), F.lit(0.15) + F.lit(0.05) * (-s["k"])), 2)).alias("confidence")))


def primary_rule(matches: Column, low: Column, lexicon: Lexicon) -> Column:
    top = F.get(rule_counts(matches), F.lit(0))
    return let(top, lambda t: F.when(t.isNotNull(), F.struct(
        t["rule"].alias("rule"),
        F.round(F.least(F.lit(0.98), F.lit(0.60) + F.lit(0.12) * t["count"]), 2).alias("confidence")))
        .otherwise(profile_rule(low, lexicon)))


# ---- extraction ------------------------------------------------------------

def activity(low: Column) -> Column:
    table = english.EXPLICIT_ACTIVITIES + list(english.ACTIVITY_TERMS.items())
    return first_label(low, table)


def location(low: Column) -> Column:
    """(label, term) of the first place named, else null."""
    table = constant([{"label": label, "term": term} for term, label in english.LOCATION_TERMS],
                     "array<struct<label:string,term:string>>")
    nothing = F.lit(None).cast("struct<label:string,term:string>")
    return F.aggregate(table, nothing, lambda found, e: F.coalesce(found, F.when(low.contains(e["term"]), e)))


def equipment(text: Column, found: Column) -> Column:
    """English vocabulary first, then the terms of the other languages."""
    return F.array_distinct(F.concat(english_equipment(found), spans.foreign_equipment(text)))


def english_equipment(low: Column) -> Column:
    return all_labels(low, list(english.EQUIPMENT_TERMS.items()))


def hazards(low: Column, matches: Column) -> Column:
    extra = all_labels(low, list(english.EXTRA_HAZARDS.items()))
    return F.array_distinct(F.concat(F.transform(matches, lambda m: m["hazard"]), extra))


def vocabulary_barriers(low: Column, found: Column | None = None) -> Column:
    """Barriers whose term sits beside a failure word in its clause."""
    found = low if found is None else found
    table = constant([{"label": label, "terms": terms} for label, terms in english.BARRIER_TERMS.items()],
                     "array<struct<label:string,terms:array<string>>>")
    failed = lambda term: F.exists(term_positions(low, term),
                                   lambda at: spans.fails_nearby(low, at, F.length(term)))
    return F.transform(F.filter(table, lambda b: F.exists(F.filter(b["terms"], lambda t: found.contains(t)), failed)), lambda b: b["label"])


def barrier_failures(low: Column, matches: Column, found: Column | None = None) -> Column:
    own = F.array_compact(F.transform(matches, lambda m: m["barrier"]))
    return F.array_distinct(F.concat(own, vocabulary_barriers(low, found)))


def languages(text: Column, low: Column) -> Column:
    """Scripts found, then English for Latin letters, then romanised languages with two marker words."""
    devanagari = text.rlike(r"[\x{900}-\x{963}\x{966}-\x{97f}]")
    bengali = text.rlike(r"[\x{980}-\x{9ff}]")
    assamese = text.rlike(r"[\x{9f0}\x{9f1}]")
    latin = text.rlike("[A-Za-z]")
    native = {"hi": devanagari, "bn": bengali & ~assamese, "as": bengali & assamese}
    tokens = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))

    def romanised(key: str, seen: Column) -> Column:
        single = [m for m in foreign.ROMAN_MARKERS[key] if " " not in m]
        hits = F.size(F.array_intersect(seen, word_list(single)))
        for marker in (m for m in foreign.ROMAN_MARKERS[key] if " " in m):
            # Only texts that hold the marker's last word are searched for the whole marker.
            loose = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9 ]", " "), F.lit(" "))
            near = F.array_contains(seen, marker.split()[-1])
            hits = hits + F.when(near, loose.contains(f" {marker} ").cast("int")).otherwise(F.lit(0))
        return F.when(latin & ~native[key.split("-")[0]] & (hits >= 2), F.lit(key))

    return let(tokens, lambda seen: F.array_compact(F.array(
        F.when(native["hi"], F.lit("hi")), F.when(native["as"], F.lit("as")), F.when(native["bn"], F.lit("bn")),
        F.when(latin, F.lit("en")), *[romanised(k, seen) for k in foreign.ROMAN_MARKERS])))


# ---- wording ---------------------------------------------------------------

def sentence_at(text: Column, at: Column) -> Column:
    """The full sentence, with its end mark, that holds a position."""
    stop = r"[^.!?;\n]"
    here = F.substring(text, at + 1, 1)
    on_mark = ~here.rlike(stop)
    start = F.when(on_mark, at + 1).otherwise(at - spans.run_before(text, at, stop))
    end = at + spans.run_after(text, at, stop) + 1
    return F.btrim(spans.piece(text, start, F.greatest(start, end)))


def explanation(c: dict[str, Column]) -> Column:
    """Why the verdict is what it is: the sentence of the first match, what it means, and what was only assumed."""
    first = F.get(c["evidence"], F.lit(0))
    at = (F.position(F.lower(first), c["low"]) - 1).cast("int")
    sentence = let(at, lambda p: F.when(p >= 0, blank_to_null(sentence_at(c["text"], p))))
    breached = breached_labels(c["rule_conditions"])
    assumed = F.concat_ws(
        "; ", F.when(c["fallback"], F.concat(F.lit("the rule, by shared words only ("), F.format_string("%.2f", c["rule_confidence"]), F.lit(")"))),
        F.when(c["activity_inferred"], F.concat(F.lit("the activity, because of the rule "), c["rule"])),
        F.concat(F.lit("the place, from the words “"), c["location_term"], F.lit("”")))
    parts = [
        F.when(F.size(c["evidence"]) > 0, F.concat(F.lit("Reported: “"), F.coalesce(sentence, first), F.lit("”"))),
        F.concat(F.lit("Hazard: "), F.lower(c["hazard"]), F.lit(".")),
        F.concat(F.lit("Life-Saving Rule: "), c["rule"], F.lit(".")),
        F.when(F.size(c["barriers"]) > 0, F.concat(F.lit("Barriers that failed: "), F.concat_ws(", ", c["barriers"]), F.lit("."))),
        F.when(F.size(breached) > 0, F.concat(F.lit("Requirements not met: "), F.concat_ws("; ", breached), F.lit("."))),
        F.when(assumed != "", F.concat(F.lit("Assumed, not written: "), assumed, F.lit("."))),
    ]
    joined = F.concat_ws(" ", *parts)
    return F.when(joined == "", F.lit("Nothing here points to a serious injury.")).otherwise(joined)


def summary(c: dict[str, Column]) -> Column:
    """Event, risk, next step and unmet requirements, a line each; nothing is shortened."""
    first = F.get(c["evidence"], F.lit(0))
    breached = breached_labels(c["rule_conditions"])
    event = F.concat_ws(", ", F.coalesce(c["activity"], F.lit("activity not stated")), F.concat(F.lit("“"), first, F.lit("”")))
    could = F.concat_ws(", ", F.lower(c["consequence"]), F.lower(c["hazard"]), c["rule"])
    risk = F.when(c["sif"], F.when(could == "", F.lit("serious injury possible")).otherwise(could)).otherwise(F.lit("routine, no precursor found"))
    after = F.when(F.size(c["barriers"]) > 0, F.concat(F.lit("restore "), F.concat_ws(", ", c["barriers"]), F.lit(" before this work goes on"))).otherwise(F.lit("none beyond the regular review"))
    lines = [F.concat(F.lit("Event: "), event), F.concat(F.lit("Risk: "), risk), F.concat(F.lit("Next: "), after),
             F.when(F.size(breached) > 0, F.concat(F.lit("Not met: "), F.concat_ws("; ", breached)))]
    return F.concat_ws("\n", *lines)


def suggested_actions(sif: Column, rule: Column, barriers: Column, priority: Column, lexicon: Lexicon) -> Column:
    """Follow-up of the rule, a check of every barrier, a talk with the crew, then the step its priority asks for."""
    follow_up = F.try_element_at(constant({r["name"]: r["follow_up"] for r in lexicon.rules}, "map<string,string>"), rule)
    checks = F.transform(barriers, lambda b: F.concat(F.lit("Check on site and restore: "), F.lower(b), F.lit("; note who did it.")))
    talk = F.concat(F.lit("Go through “"), rule, F.lit("” with the crew and compare the papers with the job."))
    step = F.when(priority == "HIGH", F.lit("Site visit by HSE today.")).when(priority == "MEDIUM", F.lit("HSE review within two days; site on this week's inspection round."))
    listed = F.array_compact(F.concat(F.array(follow_up), checks, F.array(talk, step)))
    return F.when(sif, listed).otherwise(F.array(F.lit(NOTHING_TO_DO)))


# ---- the whole analysis ----------------------------------------------------

ANALYSIS_COLUMNS = [
    "matches", "priority_factors", "hazards", "barrier_failure", "sif_potential", "life_saving_rule",
    "rule_confidence", "confidence", "priority", "hazard", "potential_consequence", "evidence", "equipment",
    "unsafe_type", "languages", "analysis_activity", "location", "rule_conditions", "explanation", "summary",
    "suggested_actions", "uncertainty_note", "model",
]


def searched_words(lexicon: Lexicon) -> list[str]:
    """Every word and phrase whose presence in a text the analysis asks for."""
    tables = [english.EXTRA_HAZARDS, english.BARRIER_TERMS, english.ACTIVITY_TERMS, english.EQUIPMENT_TERMS]
    listed = [english.EXPOSURE_TERMS, english.ACT_ACTORS, english.CONDITION_WORDS, english.MISSING_CONTROL_TERMS, [term for term, _ in english.LOCATION_TERMS],
              [e["p"] for e in lexicon.indicators + lexicon.foreign_phrases], *[words for table in tables for words in table.values()], *[words for _, words in english.EXPLICIT_ACTIVITIES],
              *[c["terms"] + c["breach"] for conditions in lexicon.conditions.values() for c in conditions]]
    return sorted({word for words in listed for word in words})


def _searched(df: DataFrame, text_col: str, lexicon: Lexicon) -> DataFrame:
    """As ``with_matches``, and ``_found``: the searched words that occur."""
    text, low, words = F.col("clean_text"), F.col("low_text"), F.col("_found")
    found = spans.merged_matches(F.col("english_matches"), F.col("foreign_matches"))
    none = F.array().cast(f"array<{MATCH}>")
    return (df.withColumn("clean_text", tx.analysis_text(F.col(text_col)))
            .withColumn("low_text", fence(F.lower(text)))
            .withColumn("_found", fence(words_found(low, searched_words(lexicon))))
            .withColumns({"english_matches": F.coalesce(spans.english_matches(text, low, lexicon, words), none),
                          "foreign_matches": F.coalesce(spans.foreign_matches(text, low, lexicon, words), none)})
            .withColumn("matches", fence(found))
            .drop("english_matches", "foreign_matches"))


def with_matches(df: DataFrame, text_col: str = "report_text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds ``clean_text``, ``low_text`` and the merged ``matches`` array."""
    return _searched(df, text_col, lexicon).drop("_found")


def analyze(df: DataFrame, text_col: str = "report_text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds the structured analysis of each report; rows without text get status ``failed``.

    A narrow plan: every step is an expression on the row, so the input's partitioning is
    kept and nothing is shuffled.  Only the search for the lexicon's words goes through a Python worker.
    """
    text, low, matches, found = F.col("clean_text"), F.col("low_text"), F.col("matches"), F.col("_found")
    rule, factors = F.col("life_saving_rule"), F.col("priority_factors")
    staged = (
        _searched(df, text_col, lexicon)
        .withColumns({
            "priority_factors": priority_factors(matches, found),
            "_rule": primary_rule(matches, low, lexicon),
            "hazards": hazards(found, matches),
            "barrier_failure": barrier_failures(low, matches, found),
            "_stated_activity": activity(found),
            "_location": location(found),
            "sif_potential": F.size(matches) > 0,
            "potential_consequence": F.get(matches, F.lit(0))["consequence"],
            "evidence": F.array_distinct(F.transform(matches, lambda m: m["phrase"])),
            "equipment": equipment(text, found),
            "unsafe_type": act_or_condition(found),
            "languages": languages(text, low),
        })
        .withColumns({
            "life_saving_rule": F.col("_rule.rule"),
            "rule_confidence": F.col("_rule.confidence"),
            "confidence": confidence(factors),
            "priority": priority_label(factors),
            "hazard": F.get("hazards", F.lit(0)),
            "location": F.col("_location.label"),
        })
        .withColumns({
            "analysis_activity": F.coalesce(F.col("_stated_activity"), implied_activity(rule)),
            "rule_conditions": rule_conditions(text, low, rule, matches, lexicon, found),
        })
    )
    fallback = ~F.col("sif_potential") & F.col("life_saving_rule").isNotNull()
    parts = {
        "text": text, "low": low, "evidence": F.col("evidence"), "hazard": F.col("hazard"), "rule": F.col("life_saving_rule"),
        "barriers": F.col("barrier_failure"), "rule_conditions": F.col("rule_conditions"), "fallback": fallback,
        "rule_confidence": F.col("rule_confidence"), "sif": F.col("sif_potential"),
        "activity_inferred": F.col("_stated_activity").isNull() & F.col("analysis_activity").isNotNull(),
        "location_term": F.col("_location.term"), "activity": F.col("analysis_activity"),
        "consequence": F.col("potential_consequence"),
    }
    failed = text.isNull()
    done = staged.withColumns({
        "explanation": explanation(parts),
        "summary": summary(parts),
        "suggested_actions": suggested_actions(F.col("sif_potential"), rule, F.col("barrier_failure"),
                                               F.col("priority"), lexicon),
        "uncertainty_note": F.when(fallback, F.lit(FALLBACK_NOTE)),
        "model": F.lit(MODEL_TAG),
        "processing_status": F.when(failed, F.lit("failed")).otherwise(F.lit("analyzed")),
        "error": F.when(failed, F.lit("Report text is required")),
    }).drop("_rule", "_stated_activity", "_location", "low_text", "_found")
    # A failed row keeps its report but carries no analysis.
    return done.select(*[F.when(~failed, F.col(c)).alias(c) if c in ANALYSIS_COLUMNS else F.col(c) for c in done.columns])


def implied_activity(rule: Column) -> Column:
    return F.try_element_at(constant(english.RULE_TO_ACTIVITY, "map<string,string>"), rule)


def backfill_rule(df: DataFrame, text_col: str = "report_text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Fill a missing rule from the text profile."""
    guess = profile_rule(F.lower(F.coalesce(F.col(text_col), F.lit(""))), lexicon)["rule"]
    return df.withColumn("life_saving_rule", F.when(F.col("life_saving_rule").isNull(), guess)
                         .otherwise(F.col("life_saving_rule")))


# ---- learned signals -------------------------------------------------------

def apply_signals(df: DataFrame, signals: list[dict], feedback_count: int, text_col: str = "clean_text") -> DataFrame:
    """Quote learned phrases as evidence and nudge confidence; the verdict never flips.

    ``signals`` is the published list of the latest run; every phrase that occurs is quoted.
    """
    stream = F.concat(F.lit(" "), F.concat_ws(" ", tx.words(F.col(text_col))), F.lit(" "))
    positive = [s for s in signals if s["direction"] == "+"]
    if not positive:
        return df.withColumn("tuned", F.lit(False)).withColumn("tuned_weight", F.lit(0))
    hits = let(stream, lambda t: F.array_compact(F.array(*[
        F.when(t.contains(f" {s['phrase']} "), F.struct(F.lit(s["phrase"]).alias("phrase"),
                                                       F.lit(int(s["weight"])).alias("weight"))) for s in positive])))
    shown = F.transform("_hits", lambda h: h["phrase"])
    total = F.aggregate("_hits", F.lit(0), lambda a, h: a + h["weight"])
    notes = F.concat(F.lit("Reviewers confirmed such wording before: '"), F.concat_ws("', '", shown), F.lit(f"' (learned from {feedback_count} reviews)"))
    tuned = F.col("tuned")
    raised = F.round(F.least(F.lit(0.99), F.col("confidence") + F.least(F.lit(0.15), F.lit(0.05) + F.col("tuned_weight") * 0.01)), 2)
    return (
        df.withColumn("_hits", hits)
        .withColumn("tuned", F.size("_hits") > 0)
        .withColumn("tuned_weight", total)
        .withColumn("evidence", F.when(tuned, F.array_distinct(F.concat("evidence", shown))).otherwise(F.col("evidence")))
        .withColumn("confidence", F.when(tuned & F.col("sif_potential"), raised)
                    .when(tuned, F.greatest(F.lit(0.55), F.col("confidence"))).otherwise(F.col("confidence")))
        .withColumn("priority", F.when(tuned & ~F.col("sif_potential") & (F.col("priority") == "LOW"), F.lit("MEDIUM"))
                    .otherwise(F.col("priority")))
        .withColumn("uncertainty_note", F.when(tuned, F.concat(
            notes, F.when(F.col("uncertainty_note").isNotNull(), F.concat(F.lit(" ("), F.col("uncertainty_note"), F.lit(")")))
            .otherwise(F.lit("")))).otherwise(F.col("uncertainty_note")))
        .withColumn("model", F.when(tuned & ~F.col("model").contains("+tuned"), F.concat("model", F.lit("+tuned")))
                    .otherwise(F.col("model")))
        .drop("_hits")
    )
