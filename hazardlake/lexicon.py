"""The safety lexicon as a parameter of the text operators.

A lexicon holds a few hundred configured phrases, never data; it is turned into
literal columns (for row-local matching) or small DataFrames (for joins).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession

from hazardlake.functions.columns import constant
from hazardlake.vocab import conditions as cond_vocab
from hazardlake.vocab import english, foreign

# Words a report and a rule profile are compared on.
_PROFILE_WORD = re.compile(r"[a-z0-9]+")
# Words and Indic runs used for learned signals.
_SIGNAL_WORD = re.compile(r"[a-z0-9']+|[ऀ-৿]+")


def _anchored(entries: list[dict], shortest: int = 4) -> list[dict]:
    """Group phrases under a small set of shared word beginnings.

    A text without the anchor cannot hold any phrase of its group, so most texts are
    settled by a few dozen substring tests instead of one per phrase.
    """
    left = {i: e["p"] for i, e in enumerate(entries)}
    groups = []
    while left:
        cover: dict[str, list[int]] = {}
        for i, phrase in left.items():
            long_words = [w for w in phrase.split() if len(w) >= shortest] or [phrase]
            pieces = {w[:n] for w in long_words for n in range(min(shortest, len(w)), len(w) + 1)}
            for text in pieces:
                cover.setdefault(text, []).append(i)
        anchor = max(cover, key=lambda t: (len(cover[t]), len(t), t))
        groups.append({"anchor": anchor, "entries": [entries[i] for i in cover[anchor]]})
        for i in cover[anchor]:
            del left[i]
    return groups


@dataclass(frozen=True)
class Lexicon:
    rules: list[dict] = field(default_factory=lambda: english.RULES)
    indicator_phrases: dict[str, list[tuple[str, bool]]] = field(default_factory=lambda: english.INDICATORS)
    conditions: dict[str, list[dict]] = field(default_factory=lambda: cond_vocab.RULE_CONDITIONS)
    phrases: list[tuple[str, dict[str, list[str]]]] = field(default_factory=lambda: foreign.PHRASES)

    @cached_property
    def rule_names(self) -> list[str]:
        return [r["name"] for r in self.rules]

    @cached_property
    def indicators(self) -> list[dict]:
        """One entry per distinct (rule, phrase, negation need), in lexicon order."""
        seen, out = set(), []
        for rule, phrases in self.indicator_phrases.items():
            for phrase, needs in phrases:
                if (rule, phrase, needs) in seen:
                    continue
                seen.add((rule, phrase, needs))
                out.append({
                    "p": phrase, "n": len(phrase), "neg": needs, "ord": len(out),
                    "r": self.rule_names.index(rule), "one": " " not in phrase,
                    "blocks": english.FOLLOW_BLOCKS.get(phrase, []),
                })
        return out

    @cached_property
    def foreign_phrases(self) -> list[dict]:
        out = []
        for lang, per_rule in self.phrases:
            for rule, lines in per_rule.items():
                if rule not in self.rule_names:
                    continue
                for phrase in lines:
                    out.append({"p": phrase, "n": len(phrase), "ord": len(out),
                                "r": self.rule_names.index(rule), "lang": lang})
        return out

    @cached_property
    def profile_weights(self) -> list[dict]:
        """Weight (count capped at three) of each profile word per rule."""
        by_rule = {rule: [phrase for phrase, _ in phrases] for rule, phrases in self.indicator_phrases.items()}
        out = []
        for number, rule in enumerate(self.rules):
            words = [rule["name"], rule["hazard"], rule["consequence"], rule["description"], rule["follow_up"]]
            words += rule["barriers"] + by_rule.get(rule["name"], [])
            counts = Counter(_PROFILE_WORD.findall(" ".join(words).lower()))
            out += [{"r": number, "token": t, "w": min(c, 3)} for t, c in counts.items()]
        return out

    @cached_property
    def domain_words(self) -> list[str]:
        """Words that keep a learned signal about safety."""
        words: dict[str, None] = {}
        sources = [i["p"] for i in self.indicators]
        for table in (english.BARRIER_TERMS, english.EQUIPMENT_TERMS):
            sources += [t for terms in table.values() for t in terms]
        for source in sources:
            words.update(dict.fromkeys(_SIGNAL_WORD.findall(source.lower())))
        return list(words)

    # ---- literal columns -------------------------------------------------

    @cached_property
    def indicator_groups(self) -> list[dict]:
        return _anchored(self.indicators)

    @cached_property
    def foreign_groups(self) -> list[dict]:
        return _anchored(self.foreign_phrases)

    def indicator_column(self) -> Column:
        return constant(self.indicator_groups,
                        "array<struct<anchor:string,entries:array<struct<ord:int,p:string,n:int,neg:boolean,r:int,"
                        "one:boolean,blocks:array<string>>>>>")

    def foreign_column(self) -> Column:
        return constant(self.foreign_groups,
                        "array<struct<anchor:string,entries:array<struct<ord:int,p:string,n:int,r:int,lang:string>>>>")

    def profile_column(self) -> Column:
        """Per rule, the words of its profile grouped by weight."""
        rules = []
        for number in range(len(self.rules)):
            group: dict[int, list[str]] = {1: [], 2: [], 3: []}
            for entry in self.profile_weights:
                if entry["r"] == number:
                    group[entry["w"]].append(entry["token"])
            rules.append({"r": number, "one": group[1], "two": group[2], "three": group[3]})
        return constant(rules, "array<struct<r:int,one:array<string>,two:array<string>,three:array<string>>>")

    def rule_column(self) -> Column:
        return constant(self.rules, "array<struct<name:string,description:string,hazard:string,"
                                    "consequence:string,barriers:array<string>,follow_up:string>>")

    def condition_column(self) -> Column:
        """Per rule (in rule order) its list of conditions."""
        table = []
        for name in self.rule_names:
            entries = []
            for number, c in enumerate(self.conditions.get(name, [])):
                entries.append({"ci": number, "condition": c["condition"], "terms": c["terms"],
                                "breach": c["breach"], "flips": c.get("presence_breach", True),
                                "ok": c.get("ok_markers", [])})
            table.append(entries)
        return constant(table, "array<array<struct<ci:int,condition:string,terms:array<string>,"
                               "breach:array<string>,flips:boolean,ok:array<string>>>>")

    # ---- small frames ----------------------------------------------------

    def phrase_frame(self, spark: SparkSession) -> DataFrame:
        """(lang, rule, phrase, needs_neg, ord) for all languages; a few hundred rows by construction."""
        rows = [("en", self.rule_names[i["r"]], i["p"], i["neg"], i["ord"]) for i in self.indicators]
        rows += [(i["lang"], self.rule_names[i["r"]], i["p"], False, i["ord"]) for i in self.foreign_phrases]
        return spark.createDataFrame(rows, "lang string, rule string, phrase string, needs_neg boolean, ord int")


DEFAULT = Lexicon()
