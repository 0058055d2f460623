"""License notices by phrase and by exact containment join with templates.  DataFrame operations only."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.llm.common import NOT_WORD, free_name

# Fixed values of the task: phrase and label.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Opening sentences of public licenses, with the label a block that contains them gets.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]
CONTAINMENT = 0.8


def template_words(text: str) -> list[str]:
    return re.sub(NOT_WORD + "+", " ", text.lower()).split()


def _plain(text: Column) -> Column:
    """Words of a text, one blank between them.  ``lower`` also changes letters beyond A-Z, but none of these
    becomes ASCII once the two that would (the Kelvin sign and the dotted capital I) are out of the way."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ß")), F.lit("İ"), F.lit("ß"))
    return F.trim(F.regexp_replace(F.lower(safe), NOT_WORD + "+", " "))


def _places(plain: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places, first and last starting word of a phrase that can't overlap itself."""
    fenced = F.concat(F.lit("|"), F.replace(plain, F.lit(" "), F.lit("||")), F.lit("|"))
    pieces = F.split(fenced, re.escape("|" + phrase.replace(" ", "||") + "|"), -1)
    n_in = lambda piece: F.floor((F.length(piece) - F.length(F.replace(piece, F.lit("|"), F.lit("")))) / 2)
    found = F.contains(plain, F.lit(phrase))
    places = F.when(found, F.size(pieces) - 1).otherwise(0)
    start = lambda c: F.when(found & (F.size(pieces) > 1), c)
    return places, start(n_in(F.element_at(pieces, 1))), start(n_words - n_in(F.element_at(pieces, -1)) - len(phrase.split()))


def token_counts(words: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many rows of ``words(words)`` each word of the (fixed, small) vocabulary stands."""
    found = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in found.collect()}


def rivals(templates: Sequence[Sequence[str]], share: float = CONTAINMENT) -> list[list[int]]:
    """For each template those that can't be told from it by the share alone: one of the two holds so much of the other."""
    own = [set(t) for t in templates]
    alike = lambda a, b: len(a & b) >= share * min(len(a), len(b)) - 1e-9
    return [[u for u in range(len(own)) if u != t and own[u] != own[t] and alike(own[t], own[u])] for t in range(len(own))]


def telling_words(templates: Sequence[Sequence[str]], share: float = CONTAINMENT) -> list[set[str]]:
    """Words of each template that a rival lacks; a block must hold them all to be the template's and not the rival's."""
    near = rivals(templates, share)
    return [{w for u in near[t] for w in set(templates[t]) - set(templates[u])} for t in range(len(templates))]


def block_grid(templates: Sequence[Sequence[str]], t: int, share: float = CONTAINMENT) -> tuple[int, int]:
    """Distance and width of a template's blocks, in words: every passage of up to twice the length of the template, or of
    its longest rival, lies whole in one of them."""
    longest = max(len(templates[u]) for u in [t, *rivals(templates, share)[t]])
    step = max(1, longest // 2)
    return step, 2 * longest + step


def _containment(words: Column, templates: Sequence[Sequence[str]], t: int, ordered: Sequence[str], share: float) -> Column:
    """Largest share of template ``t``'s distinct words that one of its blocks holds, 0 where no block is the template's.

    ``ordered``: all templates' words, rarest in the corpus first.  A block is the template's if it holds the share of
    it and all its telling words, and no rival that it also meets has more words in it.
    """
    telling, near = telling_words(templates, share), rivals(templates, share)[t]
    words_of = lambda u: [w for w in ordered if w in set(templates[u])]
    need_of = lambda u: math.ceil(share * len(set(templates[u])) - 1e-9)
    own, need = words_of(t), need_of(t)
    prefix = own[:len(own) - need + 1]
    array = lambda values: F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    step, width = block_grid(templates, t, share)

    def held(block: Column) -> Column:  # the block's words that any template has, rarest first
        return F.array_intersect(array(ordered), block)

    def met(u: int, mine: Column) -> Column:
        """How many words of a template the block holds, 0 if it doesn't meet it."""
        overlap = F.size(F.array_intersect(array(words_of(u)), mine))
        tells = sorted(telling[u])
        told = F.size(F.array_intersect(array(tells), mine)) == len(tells) if tells else F.lit(True)
        return F.when((overlap >= need_of(u)) & told, overlap).otherwise(0)

    def verified(mine: Column) -> Column:
        n = F.size(mine)
        # an overlap of `need` words must show in both prefixes, with enough words left behind the first common one
        first = F.get(F.array_intersect(array(prefix), F.slice(mine, F.lit(1), F.greatest(F.lit(0), n - need + 1))), F.lit(0))
        left = F.least(F.lit(len(own)) - F.array_position(array(own), first), n - F.array_position(mine, first)) + 1
        overlap = met(t, mine)
        best = F.greatest(overlap, *[met(u, mine) for u in near]) if near else overlap
        return F.when((n >= need) & first.isNotNull() & (left >= need) & (overlap > 0) & (overlap == best), overlap / F.lit(float(len(own)))).otherwise(0.0)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / step).cast("int")), lambda k: F.slice(words, k * step + 1, F.lit(width)))
    possible = F.filter(blocks, lambda b: F.arrays_overlap(b, array(prefix)))
    best = F.array_max(F.transform(F.transform(possible, held), verified))
    return F.when(F.arrays_overlap(words, array(prefix)), F.coalesce(best, F.lit(0.0))).otherwise(0.0)


def license_notices(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, share: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row of ``docs(doc_id, text)``.

    Base: places of the fixed phrases.  Beyond these, a document gets a template's label if one of its blocks
    holds at least ``share`` of the template's distinct words (an exact join: words rarer in the corpus come
    first, and the prefix, length and positional filters only leave out what can't reach the share), among them those
    that tell it from rival templates, and no rival fits that block better.  ``score``
    is 1 with a phrase, else the largest share reached, else 0.  One scan counts the template words, one
    finds the notices; texts are never shuffled, and what the driver sees is bounded by the templates.
    Null and wordless texts have no words, no labels (empty strings) and score 0; repeated rows each get a row;
    an empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select("doc_id", _plain(F.col("text")).alias("plain"))
    worded = texts.select("*", F.when(F.col("plain") == "", F.array().cast("array<string>")).otherwise(F.split("plain", " ")).alias("words"))
    names, parts = [label for label, _ in templates], [template_words(text) for _, text in templates]
    vocabulary = sorted({w for words in parts for w in words})
    counts = token_counts(worded, vocabulary) if vocabulary else {}
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    n_words = F.size("words").cast("long")
    bases = [(*_places(F.col("plain"), n_words, phrase), label) for phrase, label in PHRASES]
    shares = F.array(*[F.struct(F.lit(names[t]).alias("label"), _containment(F.col("words"), parts, t, ordered, share).alias("share")) for t in range(len(parts))]) if parts \
        else F.array().cast("array<struct<label:string,share:double>>")
    seen = worded.select("doc_id", n_words.alias("n_words"), F.array(*[F.struct(n.alias("n"), a.alias("first"), b.alias("last"), F.lit(label).alias("label")) for n, a, b, label in bases]).alias("base"),
                         shares.alias("shares"))
    base = F.filter("base", lambda b: b["n"] > 0)
    reached = F.filter("shares", lambda s: s["share"] > 0)
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    total = F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"])
    return seen.select(
        "doc_id", "n_words", total.alias("n_base"), F.array_min(F.transform(base, lambda b: b["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["last"])).cast("long").alias("last_word"),
        join(F.transform(base, lambda b: b["label"])).alias("base_labels"),
        join(F.concat(F.transform(base, lambda b: b["label"]), F.transform(reached, lambda s: s["label"]))).alias("labels"),
        F.when(total > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(reached, lambda s: s["share"])), F.lit(0.0))).alias("score"))


def with_license(docs: DataFrame, column: str = "license") -> DataFrame:
    """``docs`` with one more column of comma-joined labels, named ``column`` (underscores follow if that is taken)."""
    marked = license_notices(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text"))
    return marked.select("doc_id.*", F.col("labels").alias(free_name(docs.columns, column)))
