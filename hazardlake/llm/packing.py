"""Packing documents into fixed windows: repeat counts of length combinations by non-negative least squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import bounded_batches, field, stage
from hazardlake.llm.tokens import token_ids, vocabulary

WINDOW, END_ID = 2048, 1
# Remainders that fit no combination may be cut at multiples of this, and anywhere behind the last multiple.
BLOCK = 256


def combinations(histogram: np.ndarray) -> np.ndarray:
    """Rows of two or three lengths that occur and fill the window exactly; a third length of 0 marks a pair."""
    window = len(histogram)
    have = np.flatnonzero(histogram)
    a, b = np.meshgrid(have, have, indexing="ij")
    c = window - a - b
    fits = (a <= b) & (c >= 0) & ((c == 0) | (b <= c))
    a, b, c = a[fits], b[fits], c[fits]
    real = (c == 0) | (histogram[np.minimum(c, window - 1)] > 0)
    return np.stack([a[real], b[real], c[real]], axis=1)


def repeat_counts(histogram: np.ndarray, combos: np.ndarray, rounds: int = 80) -> np.ndarray:
    """How often to take each combination: min ||A x - h||, x >= 0, by accelerated projected gradients, then rounded
    so that no length is used up beyond its count."""
    window = len(histogram)
    if not len(combos):
        return np.zeros(0, np.int64)
    real = combos > 0
    weight = histogram.astype(float).copy()
    weight[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(combos[:, j], np.where(real[:, j], x, 0.0), window) for j in range(3))

    def pull(r: np.ndarray) -> np.ndarray:
        return sum(np.where(real[:, j], r[combos[:, j]], 0.0) for j in range(3))

    probe = np.ones(len(combos))
    for _ in range(8):  # the largest eigenvalue bounds the step
        probe = pull(used(probe))
        top = np.linalg.norm(probe)
        probe /= top
    x = ahead = np.zeros(len(combos))
    pace = 1.0
    for _ in range(rounds):
        new = np.maximum(0, ahead - pull(used(ahead) - weight) / (1.05 * top))
        later = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead, x, pace = new + (pace - 1) / later * (new - x), new, later
    left = histogram.astype(np.int64).copy()
    taken = np.zeros(len(combos), np.int64)
    # whole counts of the solution, largest first, then whatever still fits
    for wish in (np.floor(x), None):
        order = np.argsort(-(x if wish is not None else np.where(real, left[combos], left.max()).min(axis=1)), kind="stable")
        for k in order:
            lengths, need = np.unique(combos[k][real[k]], return_counts=True)
            room = int((left[lengths] // need).min())
            n = room if wish is None else min(room, int(wish[k]))
            if n > 0:
                left[lengths] -= n * need
                taken[k] += n
    return taken


@dataclass
class Plan:
    """Where the remainder of the given length and rank goes; sequences are numbered from ``first``."""

    starts: list[np.ndarray]  # for each length: first ranks of its slots, ascending
    sequence: list[np.ndarray]
    offset: list[np.ndarray]
    allotted: np.ndarray
    n_sequences: int
    blocks_before: np.ndarray  # of residual remainders of smaller length
    tails_before: np.ndarray
    n_blocks: int


def make_plan(histogram: np.ndarray) -> Plan:
    window = len(histogram)
    combos = combinations(histogram)
    taken = repeat_counts(histogram, combos)
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(window)]
    allotted, sequence = np.zeros(window, np.int64), 0
    for combo, n in zip(combos[taken > 0].tolist(), taken[taken > 0].tolist(), strict=True):
        offset = 0
        for length in combo:
            if length:
                slots[length].append((int(allotted[length]), sequence, offset))
                allotted[length] += n
                offset += length
        sequence += n
    lengths = np.arange(window)
    left = histogram - allotted
    blocks, tails = left * (lengths // BLOCK), left * (lengths % BLOCK)
    column = lambda i: [np.array([s[i] for s in own], np.int64) for own in slots]
    return Plan(column(0), column(1), column(2), allotted, sequence, np.cumsum(blocks) - blocks, np.cumsum(tails) - tails, int(blocks.sum()))


def place(plan: Plan, window: int, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """Pieces ``(start, length, sequence, offset)`` of a remainder; block and tail pieces share one stream that fills window after window."""
    if rank < plan.allotted[length]:
        slot = int(np.searchsorted(plan.starts[length], rank, side="right")) - 1
        return [(0, length, int(plan.sequence[length][slot]) + rank - int(plan.starts[length][slot]), int(plan.offset[length][slot]))]
    rank -= int(plan.allotted[length])
    blocks, tail = divmod(length, BLOCK)
    at = BLOCK * (int(plan.blocks_before[length]) + rank * blocks)
    cuts = [(BLOCK * b, BLOCK, at + BLOCK * b) for b in range(blocks)]
    at = BLOCK * plan.n_blocks + int(plan.tails_before[length]) + rank * tail
    start = BLOCK * blocks
    while tail:
        fits = min(tail, window - at % window)
        cuts.append((start, fits, at))
        start, at, tail = start + fits, at + fits, tail - fits
    return [(s, n, plan.n_sequences + at // window, at % window) for s, n, at in cuts]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(docs: DataFrame, window: int) -> DataFrame:
    """What placing needs of each document: length, check sums of every piece it may be cut into, the few ids behind the
    last block, its rank among the remainders of its length in this part, and the full windows before it in this part."""
    bounded_batches(docs.sparkSession)
    long, ints = T.LongType(), T.ArrayType(T.LongType())
    schema = T.StructType([field(docs, "doc_id")] + [T.StructField(n, t) for n, t in [("part", long), ("n", long), ("rest", long), ("rank", long), ("full_before", long), ("full_crc", ints),
                                                                                     ("rest_crc", long), ("block_crc", ints), ("tail", T.BinaryType())]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files = TaskContext.get().partitionId(), vocabulary()
        ranks, full_before = np.zeros(window, np.int64), 0
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = np.append(token_ids(text or "", files), np.uint32(END_ID))
                n_full, rest = divmod(len(ids), window)
                last = ids[n_full * window:]
                blocks = rest // BLOCK
                rows.append((part, len(ids), rest, int(ranks[rest]), full_before, [_crc(ids[k * window:(k + 1) * window]) for k in range(n_full)], _crc(last),
                             [_crc(last[k * BLOCK:(k + 1) * BLOCK]) for k in range(blocks)], last[blocks * BLOCK:].astype("<u2").tobytes()))
                ranks[rest] += 1
                full_before += n_full
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def packed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: the pieces of all ``docs(doc_id, text)``.

    A document's ids and the end id are cut into full windows and a remainder.  Remainders are placed by length: pairs and
    triples of lengths that fill a window exactly are enumerated, their repeat counts solved against the histogram
    by non-negative least squares and rounded; what is left is packed greedily, cut at blocks and at window ends.  Only the
    very last sequence is padded.  Texts are read once; ranks come from counts of each written part and prefix sums over
    the parts, so no length and no source meets in one task, and the driver sees one histogram.
    Null and empty texts are the end id alone; repeated rows are packed each; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = stage(_tokenised(docs, window))
    sizes = stage(rows.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("full_crc")).alias("full")))
    histogram = np.zeros(window, np.int64)
    for r in sizes.filter("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[r["rest"]] = r["n"]
    plan = make_plan(histogram)
    by_part = {r["part"]: r["full"] for r in sizes.groupBy("part").agg(F.sum("full").alias("full")).orderBy("part").collect()}
    full_of = dict(zip(by_part, np.cumsum([0, *by_part.values()]).tolist(), strict=False))
    n_full = sum(by_part.values())
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    ranked = rows.join(sizes.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before")).hint("merge"), ["part", "rest"])
    columns = ["doc_id", "part", "n", "rest", "rank", "full_before", "full_crc", "rest_crc", "block_crc", "tail", "rank_before"]
    long = T.LongType()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out = [], []
            for k, (part, n, rest, rank, full_before, full_crc, rest_crc, block_crc, tail, rank_before) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                whole = [(i * window, window, crc, n, full_of[part] + full_before + i, 0) for i, crc in enumerate(full_crc)]
                cuts = place(plan, window, rest, rank + rank_before) if rest else []
                pieces = []
                for start, length, sequence, offset in cuts:
                    if length == rest:
                        crc = rest_crc
                    elif start < len(block_crc) * BLOCK:
                        crc = block_crc[start // BLOCK]
                    else:
                        own = start - len(block_crc) * BLOCK
                        crc = _crc(np.frombuffer(tail, "<u2")[own:own + length])
                    pieces.append((n - rest + start, length, crc, n, n_full + sequence, offset))
                out += chain(whole, pieces)
                owner += [k] * (len(whole) + len(pieces))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array([r[k] for r in out], pa.int64()) for k in range(6)]], names=["doc_id", *names])

    return ranked.select(columns).mapInArrow(run, T.StructType([field(docs, "doc_id")] + [T.StructField(n, long) for n in names]))
