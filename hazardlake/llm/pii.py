"""Personal data: fixed patterns as seeds, and identifiers of other forms found by the contexts that seeds share."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import bounded_batches, field, stage

# Kinds in the order of the result; the last is the method's own.
KINDS = ["email", "ip", "card", "phone", "secret"]
ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE = 3, 3, 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # behind a digit the match would have begun earlier
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_EDGE = frozenset(" \t\n\x0b\x0c\r\"'<>()[]{},;=|")
_LOOSE = ".!?:*$%&#"
_HEX = re.compile(r"[0-9A-Fa-f]{32,}")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` of the fixed patterns, by kind and place."""
    found = [(0, *s) for s in _emails(text)]
    if not _HINT.search(text):
        return found
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
    for kind, pattern, least, most in ((2, _CARD, 13, 19), (3, _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0]) if kind == 3 or len(m[0]) < 1000 else ""  # longer than any card
            if least <= len(digits) <= most and (kind == 3 or _luhn(digits)):
                found.append((kind, *m.span()))
    return found


def _contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: one to three words before it, the word behind it; digits are all alike."""
    before = re.sub(r"[0-9]", "0", text[max(0, start - 64):start].lower()).split()[-3:]
    after = re.sub(r"[0-9]", "0", text[end:end + 48].lower()).split()[:1]
    return [f"L{n}:" + " ".join(before[-n:]) for n in range(1, len(before) + 1)] + [f"R:{w}" for w in after]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Words with a digit or an at sign, six characters or more, that no base span touches."""
    found, done, covered, k = [], 0, sorted((s, e) for _, s, e in taken), 0
    m = _HINT.search(text)
    while m:
        start, end = m.start(), m.end()
        while start > done and text[start - 1] not in _EDGE:
            start -= 1
        while end < len(text) and text[end] not in _EDGE:
            end += 1
        done = end
        while start < end and text[start] in _LOOSE:
            start += 1
        while end > start and text[end - 1] in _LOOSE:
            end -= 1
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        if end - start >= 6 and not any(s < end and e > start for s, e in covered[k:k + 4]):
            found.append((start, end))
        m = _HINT.search(text, done)
    return found


def _fits(word: str) -> list[int]:
    """Kinds a word may be by its form."""
    digits = sum(c.isascii() and c.isdigit() for c in word)
    return [k for k, ok in enumerate(("@" in word, word.count(".") >= 2 and digits >= 4, digits >= 12, 7 <= digits <= 15 and digits >= len(word) - 5, len(word) >= 16 and digits >= 2)) if ok]


def _scan(docs: DataFrame) -> DataFrame:
    """Of each row: base counts and spans, and every identifier-like place with its contexts; seeds have a kind, the rest the kinds that fit."""
    bounded_batches(docs.sparkSession)
    span, long = "struct<kind:int,start:bigint,stop:bigint>", T.LongType()
    place = "array<struct<seed:int,fits:array<int>,start:bigint,stop:bigint,word:string,contexts:array<string>>>"
    schema = T.StructType([field(docs, "doc_id"), T.StructField("row", long), *(T.StructField(f"n_{k}", long) for k in KINDS[:4]), T.StructField("base_sha256", T.StringType()),
                           T.StructField("base", T._parse_datatype_string(f"array<{span}>")), T.StructField("places", T._parse_datatype_string(place))])
    arrow_span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
    arrow_place = pa.struct([("seed", pa.int32()), ("fits", pa.list_(pa.int32())), ("start", pa.int64()), ("stop", pa.int64()), ("word", pa.string()), ("contexts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                places = []
                for kind, s, e in base:
                    places.append({"seed": kind, "fits": [kind], "start": s, "stop": e, "word": text[s:e].lower(), "contexts": _contexts(text, s, e)})
                for s, e in candidates(text, base):
                    word = text[s:e]
                    if fits := _fits(word):
                        seed = 4 if _HEX.fullmatch(word) else None
                        places.append({"seed": seed, "fits": [4] if seed else fits, "start": s, "stop": e, "word": word.lower(), "contexts": _contexts(text, s, e)})
                counts = [sum(k == n for k, _, _ in base) for n in range(4)]
                named = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base)
                out.append((row, *counts, hashlib.sha256(named.encode()).hexdigest(), [{"kind": k, "start": s, "stop": e} for k, s, e in base], places))
                row += 1
            kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(arrow_span), pa.list_(arrow_place)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def score_graph(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, support: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(pattern, kind)`` of the patterns that can be trusted, from ``edges(pattern, word)`` and ``seeds(word, kind)``.

    A pattern's confidence in a kind is the mean score of its words, one doubtful word added; a word's score is 1 for a seed,
    else the best confidence of its patterns so far.  Sums are combined before the shuffle, and scores are joined on
    one row for each word or pattern, so a pattern that is everywhere is split by the adaptive skew join.
    """
    edges = stage(edges.distinct())
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    edges = stage(edges.join(sizes, "pattern"))
    words = stage(seeds.select("word", "kind", F.lit(1.0).alias("score")).distinct())
    trusted = None
    for _ in range(rounds):
        told = edges.join(words, "word").groupBy("pattern", "kind").agg((F.sum("score") / (F.max("n") + 1)).alias("confidence"))
        trusted = stage(told.filter(F.col("confidence") >= confidence))
        heard = edges.join(trusted, "pattern").groupBy("word", "kind").agg(F.max("confidence").alias("score"))
        words = stage(heard.join(seeds.select("word").distinct(), "word", "left_anti").unionByName(seeds.select("word", "kind", F.lit(1.0).alias("score")).distinct()))
    return trusted.select("pattern", "kind", "confidence")


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row of ``docs(doc_id, text)``.

    Base spans come from the fixed patterns and always stay.  They, and long hexadecimal words, are the seeds: the
    words around them become patterns, the graph of patterns and words is scored in rounds, and identifier-like words that a
    trusted pattern introduces, of a form its kind may have, are added to ``spans``.  Texts are read once and never
    shuffled; places, a few for each text, are.  Null and empty texts have no spans (empty string); repeated rows each
    get a row; an empty table gives an empty result; other columns are ignored.
    """
    rows = stage(_scan(docs))
    places = rows.select("row", F.explode("places").alias("p")).select("row", "p.*")
    trusted = score_graph(places.select(F.explode("contexts").alias("pattern"), "word"), places.filter("seed is not null").select("word", F.col("seed").alias("kind")))
    # Seeds of the method's own kind are spans only where a trusted pattern stands, as any other find.
    open_places = places.filter("seed is null or seed = 4").select("row", "start", "stop", "fits", F.explode("contexts").alias("pattern"))
    found = (open_places.join(trusted, "pattern").filter(F.array_contains("fits", F.col("kind"))).groupBy("row", "start", "stop")
             .agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind")))
    more = found.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:bigint,stop:bigint>>"))))
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    return rows.drop("places").join(more, "row", "left").select("doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256", F.array_join(F.transform(spans, name), ",").alias("spans"))
