"""Row-local phrase spans: positions, negation windows, evidence bounds, longest-match selection.

All of it is higher-order column expressions over the text of one row, so matching
is a narrow step without a shuffle; which phrases occur at all may be told by ``presence.words_found``.
Offsets count characters from zero; ``end`` is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlake.functions.columns import all_labels, let, one_of
from hazardlake.lexicon import Lexicon
from hazardlake.vocab import english, foreign

WORD = r"[a-z0-9_\-']"
NEGATION_REACH = 60
NEAR = 200
# Characters stripped from evidence, and those that end a foreign token.
EVIDENCE_TRIM = " ,;.:\"'"
FOREIGN_BREAK = " \t\n.,;:!?()[]{}'\"|«»“”‘’—–"

NEGATION = one_of(english.NEGATION_TOKENS)
# A phrase behind one that it begins with never gets its turn.
NULLIFY = one_of([p for i, p in enumerate(english.NULLIFY_PHRASES) if not p.startswith(tuple(english.NULLIFY_PHRASES[:i]))])
# Windows without any of these words are settled by one search; they are most.
NEGATION_OR_NULLIFY = f"(?=[{''.join(sorted({w[0] for w in english.NEGATION_TOKENS + english.NULLIFY_PHRASES}))}])(?:{NEGATION}|{NULLIFY})"
# The nearest token before ends the greedy run; the nearest after ends the lazy one.
# A nullifying phrase is stepped over as a whole, so nothing inside it counts.
_STEP = f"(?>{NULLIFY}|.)"
LAST_NEGATION = f"(?s)^{_STEP}*(?={NEGATION})(?!{NULLIFY})"
FIRST_NEGATION = f"(?s)^{_STEP}*?(?<={NEGATION})"

_SPAN = "struct<shorter:int,r:int,ord:int,start:int,end:int,phrase:string,negated:boolean>"


def piece(text: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end``; bounds outside the text are cut."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(end - low, F.lit(0)))


def positions(text: Column, phrase: Column, width: Column) -> Column:
    """Every non-overlapping position of a literal phrase, from the lengths between its hits."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), phrase, F.lit("\\E")), -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, gap: Column) -> Column:
        here = acc["at"] + F.length(gap)
        return F.struct((here + width).alias("at"), F.array_append(acc["found"], here).alias("found"))

    return let(gaps, lambda g: F.aggregate(F.slice(g, 1, F.size(g) - 1), start, step)["found"])


def run_before(text: Column, at: Column, pattern: str) -> Column:
    """Length of the run of ``pattern`` characters that ends at ``at``; the whole text is looked at only for a long one."""
    run = lambda part: F.length(F.regexp_extract(F.reverse(part), f"^{pattern}*", 0))
    near = run(piece(text, at - NEAR, at))
    return let(near, lambda n: F.when(n < NEAR, n).otherwise(run(F.substring(text, 1, at))))


def run_after(text: Column, at: Column, pattern: str) -> Column:
    run = lambda part: F.length(F.regexp_extract(part, f"^{pattern}*", 0))
    near = run(F.substring(text, at + 1, NEAR))
    return let(near, lambda n: F.when(n < NEAR, n).otherwise(run(F.substring(text, at + 1, F.length(text)))))


def starts_clean(text: Column, entry: Column, at: Column, edge: str) -> Column:
    """Single-word phrases need a boundary before them and no blocking ending after them."""
    before = F.substring(text, at, 1)
    tail = F.substring(text, at + entry["n"] + 1, 12)
    glued = (at > 0) & before.rlike(edge)
    blocked = F.exists(entry["blocks"], lambda b: tail.startswith(b))
    return ~entry["one"] | (~glued & ~blocked)


def occurrences(text: Column, entry: Column, edge: str) -> Column:
    found = positions(text, entry["p"], entry["n"])
    return F.filter(found, lambda at: starts_clean(text, entry, at, edge))


def _window_flags(w: Column) -> Column:
    strip = lambda part: F.regexp_replace(part, NULLIFY, "")
    return (w["left"] & strip(w["before"]).rlike(NEGATION)) | (w["right"] & strip(w["after"]).rlike(NEGATION))


def _span_at(text: Column, low: Column, entry: Column, at: Column) -> Column:
    end = at + entry["n"]

    def build(w: Column) -> Column:
        left = at - run_before(low, at, WORD)
        right = end + run_after(low, end, WORD)
        # No match is as long as nothing, so the left one takes a character of its token along; the right one has it whole.
        run = lambda part, pattern, place: let(F.length(F.regexp_extract(part, pattern, 0)), lambda n: F.when(n > 0, place(n)))
        neg_left = F.when(w["left"], run(w["before"], f"{LAST_NEGATION}.", lambda n: w["from"] + n - 1))
        neg_right = F.when(w["right"], run(w["after"], FIRST_NEGATION, lambda n: end + n))
        bounds = F.struct(F.least(left, neg_left).alias("start"), F.greatest(right, neg_right).alias("end"))
        return F.when(~entry["neg"] | w["negated"], let(bounds, lambda b: F.struct(
            (b["start"] - b["end"]).alias("shorter"), entry["r"].alias("r"), entry["ord"].alias("ord"),
            b["start"].alias("start"), b["end"].alias("end"),
            F.btrim(piece(text, b["start"], b["end"]), F.lit(EVIDENCE_TRIM)).alias("phrase"),
            w["negated"].alias("negated"))))

    start = F.greatest(at - NEGATION_REACH, F.lit(0))
    window = F.struct(start.alias("from"), piece(low, start, at).alias("before"),
                      F.substring(low, end + 1, NEGATION_REACH).alias("after"))
    searched = let(window, lambda w: F.struct(w["from"].alias("from"), w["before"].alias("before"), w["after"].alias("after"),
                                              w["before"].rlike(NEGATION_OR_NULLIFY).alias("left"),
                                              w["after"].rlike(NEGATION_OR_NULLIFY).alias("right")))
    flagged = let(searched, lambda w: F.struct(*[w[name].alias(name) for name in ("from", "before", "after", "left", "right")],
                                               _window_flags(w).alias("negated")))
    return let(flagged, build)


def phrases_in(low: Column, groups: Column) -> Column:
    """Lexicon entries whose phrase occurs in the text, in lexicon order."""
    near = F.filter(groups, lambda g: low.contains(g["anchor"]))
    return F.array_sort(F.flatten(F.transform(near, lambda g: F.filter(g["entries"], lambda e: low.contains(e["p"])))))


def english_candidates(text: Column, low: Column, lexicon: Lexicon, found: Column | None = None) -> Column:
    """All indicator spans that pass the boundary and negation tests, before selection.

    ``found`` may stand for ``low`` where only the presence of a phrase counts.
    """
    hit = phrases_in(low if found is None else found, lexicon.indicator_column())

    def spans(entry: Column) -> Column:
        return F.transform(occurrences(low, entry, WORD), lambda at: _span_at(text, low, entry, at))

    return F.array_compact(F.flatten(F.transform(hit, spans)))


def overlaps(a: Column, b: Column) -> Column:
    return (a["r"] == b["r"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])


def longest_per_rule(candidates: Column) -> Column:
    """Greedy by length within a rule; then by position, longer evidence first."""
    def keep(kept: Column, span: Column) -> Column:
        taken = F.exists(kept, lambda k: overlaps(k, span))
        return F.when(taken, kept).otherwise(F.array_append(kept, span))

    chosen = F.aggregate(F.array_sort(candidates), F.array().cast(f"array<{_SPAN}>"), keep)
    keyed = F.transform(chosen, lambda s: F.struct(s["start"], (-F.length(s["phrase"])).alias("width"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def foreign_candidates(text: Column, low: Column, lexicon: Lexicon, found: Column | None = None) -> Column:
    """First occurrence of each foreign phrase; a later phrase of the same rule on the same spot is skipped."""
    hit = phrases_in(low if found is None else found, lexicon.foreign_column())
    edge = "[^" + "".join("\\" + c if c in "[]{}()|.?'\"" else c for c in FOREIGN_BREAK) + "]"

    def span(entry: Column) -> Column:
        at = (F.position(entry["p"], low) - 1).cast("int")

        def build(p: Column) -> Column:
            end = p + entry["n"]
            shown = piece(text, p - run_before(text, p, edge), end + run_after(text, end, edge))
            return F.struct((-entry["n"]).alias("shorter"), entry["r"].alias("r"), entry["ord"].alias("ord"),
                            p.alias("start"), end.alias("end"), F.btrim(shown).alias("phrase"),
                            F.lit(True).alias("negated"))

        return let(at, build)

    def keep(kept: Column, s: Column) -> Column:
        return F.when(F.exists(kept, lambda k: overlaps(k, s)), kept).otherwise(F.array_append(kept, s))

    chosen = F.aggregate(F.transform(hit, span), F.array().cast(f"array<{_SPAN}>"), keep)
    keyed = F.transform(chosen, lambda s: F.struct(s["start"], (-F.length(s["phrase"])).alias("width"),
                                                   s["ord"], s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def named(spans: Column, lexicon: Lexicon, lang: str | None = None) -> Column:
    """Replace rule numbers by the rule's name, hazard, consequence and first barrier."""
    rules = lexicon.rule_column()
    return let(rules, lambda table: F.transform(spans, lambda s: let(F.get(table, s["r"]), lambda rule: F.struct(
        rule["name"].alias("rule"), s["r"].alias("rule_ord"), s["phrase"].alias("phrase"),
        s["start"].alias("start"), s["end"].alias("end"), rule["hazard"].alias("hazard"),
        rule["consequence"].alias("consequence"), F.get(rule["barriers"], F.lit(0)).alias("barrier"),
        s["negated"].alias("negated"))))) 


def english_matches(text: Column, low: Column, lexicon: Lexicon, found: Column | None = None) -> Column:
    return named(longest_per_rule(english_candidates(text, low, lexicon, found)), lexicon)


def foreign_matches(text: Column, low: Column, lexicon: Lexicon, found: Column | None = None) -> Column:
    return named(foreign_candidates(text, low, lexicon, found), lexicon)


def merged_matches(english_part: Column, foreign_part: Column) -> Column:
    """English spans first, then foreign spans that share no spot with an English span of the same rule."""
    def fresh(f: Column) -> Column:
        return ~F.exists(english_part, lambda e: (e["rule"] == f["rule"]) & (e["start"] < f["end"])
                         & (f["start"] < e["end"]))

    return F.concat(english_part, F.filter(foreign_part, fresh))


# ---- clause-bounded windows ----------------------------------------------

FAILURE_WORDS = sorted(set(english.NEGATION_TOKENS) | set(english.CONTROL_FAILURE_WORDS), key=lambda w: (-len(w), w))
FAILURE = one_of(FAILURE_WORDS)
FOREIGN_FAILURE = "(?<![a-z0-9])" + one_of(english.FOREIGN_NEGATION_TOKENS) + "(?![a-z0-9])"
# Letters and digits of any script: a control term glued to one is part of another word.
ALNUM = r"[\p{L}\p{N}]"
REACH_BEFORE, REACH_AFTER = 45, 30


def clause_window(low: Column, at: Column, width: Column) -> Column:
    """Text around a term, cut at sentence ends and clause connectors, without nullifying phrases."""
    end = at + width
    left = F.regexp_extract(piece(low, at - REACH_BEFORE, at), r"[^.!?;]*$", 0)
    right = F.regexp_extract(F.substring(low, end + 1, REACH_AFTER), r"^[^.!?;]*", 0)
    for connector in english.CLAUSE_CONNECTORS:
        left = F.substring_index(left, connector, -1)
        right = F.substring_index(right, connector, 1)
    return F.regexp_replace(F.concat(left, piece(low, at, end), right), NULLIFY, "")


def fails_nearby(low: Column, at: Column, width: Column) -> Column:
    return let(clause_window(low, at, width), lambda w: w.rlike(FOREIGN_FAILURE) | w.rlike(FAILURE))


def sentence_around(text: Column, at: Column, width: Column, limit: int | None = None) -> Column:
    """The sentence that holds a position, whole or clipped to ``limit`` characters with an ellipsis."""
    start = at - run_before(text, at, r"[^.!?;]")
    end = at + width + run_after(text, at + width, r"[^.!?;]")
    whole = F.btrim(piece(text, start, end))
    return whole if limit is None else let(whole, lambda q: F.when(F.length(q) > limit, F.concat(F.rtrim(F.substring(q, 1, limit - 1)), F.lit("…")))
               .otherwise(q))


def foreign_equipment(text: Column) -> Column:
    """Equipment named in an Indic script; texts without one are settled by a single scan."""
    indic = text.rlike(r"[\x{900}-\x{9ff}]")
    return F.when(indic, all_labels(text, list(foreign.EQUIPMENT_TERMS.items()))).otherwise(F.array().cast("array<string>"))
