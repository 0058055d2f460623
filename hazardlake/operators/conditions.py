"""Maps a report on the requirements of its rule: breached, in place or not verifiable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlake.functions.columns import let, word_list
from hazardlake.functions.spans import (
    ALNUM, FAILURE_WORDS, clause_window, fails_nearby, positions, sentence_around,
)
from hazardlake.lexicon import Lexicon
from hazardlake.vocab import english

PAIR_REACH = 60
BREACHED, IN_PLACE, NOT_VERIFIABLE = "breached", "in_place", "not_verifiable"
ROW = "struct<condition:string,status:string,evidence:array<string>>"


def _blocked_tail(text: Column, term: Column, at: Column) -> Column:
    tail = F.substring(text, at + F.length(term) + 1, 12)
    hit = F.lit(False)
    for word, endings in english.FOLLOW_BLOCKS.items():
        for ending in endings:
            hit = hit | ((term == word) & tail.startswith(ending))
    return hit


def term_positions(text: Column, term: Column) -> Column:
    """Positions of a control term; a single word must not continue another word."""
    found = positions(text, term, F.length(term))
    glued = lambda at: (at > 0) & F.substring(text, at, 1).rlike(ALNUM)
    single = ~term.contains(" ")
    kept = F.filter(found, lambda at: ~(single & (glued(at) | _blocked_tail(text, term, at))))
    return F.when(text.contains(term), kept).otherwise(F.array().cast("array<int>"))


def _failure_positions(text: Column) -> Column:
    """Sorted distinct starts of every negation or failure word."""
    present = F.filter(word_list(FAILURE_WORDS), lambda w: text.contains(w))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(
        present, lambda w: positions(text, w, F.length(w))))))


def claimed_conditions(phrase: Column, conds: Column) -> Column:
    """Conditions whose control term is the nearest unclaimed one to a failure word of the phrase."""
    def candidates(fails: Column) -> Column:
        def of_condition(c: Column) -> Column:
            def of_term(term: Column) -> Column:
                return F.flatten(F.transform(term_positions(phrase, term), lambda t: F.transform(
                    F.filter(fails, lambda f: F.abs(t - f) <= PAIR_REACH),
                    lambda f: F.struct(F.abs(t - f).alias("gap"), c["ci"].alias("ci"), t.alias("t"), f.alias("f")))))
            return F.flatten(F.transform(c["terms"], of_term))
        return F.array_sort(F.flatten(F.transform(conds, of_condition)))

    nothing = F.struct(F.array().cast("array<int>").alias("conds"), F.array().cast("array<int>").alias("fails"))

    def claim(acc: Column, pair: Column) -> Column:
        taken = F.array_contains(acc["conds"], pair["ci"]) | F.array_contains(acc["fails"], pair["f"])
        return F.when(taken, acc).otherwise(F.struct(F.array_append(acc["conds"], pair["ci"]).alias("conds"),
                                                     F.array_append(acc["fails"], pair["f"]).alias("fails")))

    return let(_failure_positions(phrase), lambda fails: F.aggregate(candidates(fails), nothing, claim)["conds"])


def _first_breach(text: Column, low: Column, found: Column, c: Column) -> Column:
    """Quote of the first literal breach phrase, else null."""
    hits = F.filter(F.transform(F.filter(c["breach"], lambda b: found.contains(b)), lambda b: F.struct(
        b.alias("b"), F.get(term_positions(low, b), F.lit(0)).alias("at"))), lambda h: h["at"].isNotNull())
    return let(F.get(hits, F.lit(0)), lambda h: F.when(
        h["at"].isNotNull(), sentence_around(text, h["at"], F.length(h["b"]))))


def _mentions(low: Column, found: Column, c: Column) -> Column:
    """(term width, position) of every control term, in term order."""
    return F.flatten(F.transform(F.filter(c["terms"], lambda t: found.contains(t)), lambda t: F.transform(
        term_positions(low, t), lambda at: F.struct(at.alias("at"), F.length(t).alias("n")))))


def _scan(text: Column, low: Column, found: Column, c: Column) -> Column:
    """Verdict of one condition from literal phrases first, then from the mention of its control."""
    def verdict(m: Column) -> Column:
        failing = F.when(c["flips"], F.get(F.filter(m, lambda x: fails_nearby(low, x["at"], x["n"])), F.lit(0)))
        marked = (F.size(c["ok"]) == 0) | F.exists(m, lambda x: let(
            clause_window(low, x["at"], x["n"]), lambda w: F.exists(c["ok"], lambda ok: w.contains(ok))))
        first = F.get(m, F.lit(0))
        return let(failing, lambda f: F.when(
            f.isNotNull(), F.struct(F.lit(BREACHED).alias("status"), sentence_around(text, f["at"], f["n"]).alias("quote")))
            .when((F.size(m) > 0) & marked, F.struct(F.lit(IN_PLACE).alias("status"),
                                                     sentence_around(text, first["at"], first["n"]).alias("quote")))
            .otherwise(F.struct(F.lit(NOT_VERIFIABLE).alias("status"), F.lit(None).cast("string").alias("quote"))))

    literal = _first_breach(text, low, found, c)
    return let(literal, lambda q: F.when(
        q.isNotNull(), F.struct(F.lit(BREACHED).alias("status"), q.alias("quote")))
        .otherwise(let(_mentions(low, found, c), verdict)))


def _quotes(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def rule_conditions(text: Column, low: Column, rule: Column, matches: Column, lexicon: Lexicon, found: Column | None = None) -> Column:
    """One row per condition of the rule, plus one for matched phrases no condition explains.

    ``found`` may stand for ``low`` where only the presence of a term counts.
    """
    found = low if found is None else found
    conds_of = lambda name: F.get(
        lexicon.condition_column(),
        (F.array_position(word_list(lexicon.rule_names), name) - 1).cast("int"))

    def with_conds(conds: Column) -> Column:
        own = F.filter(matches, lambda m: m["rule"] == rule)
        attributed = F.transform(own, lambda m: F.struct(
            m["phrase"].alias("phrase"), let(F.lower(m["phrase"]), lambda low: claimed_conditions(low, conds)).alias("claims")))

        def rows(att: Column) -> Column:
            def judge(c: Column) -> Column:
                phrases = F.transform(F.filter(att, lambda a: F.array_contains(a["claims"], c["ci"])),
                                      lambda a: a["phrase"])
                return let(phrases, lambda ph: F.when(F.size(ph) > 0, F.struct(
                    c["condition"].alias("condition"), F.lit(BREACHED).alias("status"), ph.alias("quotes")))
                    .otherwise(let(_scan(text, low, found, c), lambda v: F.struct(
                        c["condition"].alias("condition"), v["status"].alias("status"),
                        F.array(v["quote"]).alias("quotes")))))

            def finish(judged: Column) -> Column:
                quoted = F.filter(F.flatten(F.transform(judged, lambda j: j["quotes"])), lambda q: q.isNotNull())
                stray = F.filter(att, lambda a: (F.size(a["claims"]) == 0)
                                 & ~F.exists(quoted, lambda q: q.contains(a["phrase"])))
                extra = let(stray, lambda s: F.when(F.size(s) > 0, F.array(F.struct(
                    F.concat(rule, F.lit(" — further matched phrases"))
                    .alias("condition"), F.lit(BREACHED).alias("status"),
                    _quotes(F.transform(s, lambda a: a["phrase"])).alias("evidence"))))
                    .otherwise(F.array().cast(f"array<{ROW}>")))
                plain = F.transform(judged, lambda j: F.struct(
                    j["condition"].alias("condition"), j["status"].alias("status"), _quotes(j["quotes"]).alias("evidence")))
                return F.concat(plain, extra)

            return let(F.transform(conds, judge), finish)

        return let(attributed, rows)

    known = let(conds_of(rule), lambda conds: F.when(F.size(conds) > 0, with_conds(conds)))
    return F.coalesce(known, F.array().cast(f"array<{ROW}>"))


def breached_labels(rows: Column) -> Column:
    return F.transform(F.filter(rows, lambda r: r["status"] == BREACHED), lambda r: r["condition"])
