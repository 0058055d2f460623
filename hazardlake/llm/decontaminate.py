"""Benchmark leaks by suffix arrays of the documents: every benchmark suffix is searched in every shard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import bounded_batches, field, filter_batches, stage, words

WINDOW = 10
# Benchmark text sent to every executor at a time; a larger benchmark is searched block after block.
BLOCK_BYTES = 8 << 20


@dataclass
class Tests:
    """Benchmark items as word numbers: ``flat`` holds the items one after the other, each closed by -1."""

    vocabulary: dict[bytes, int]
    names: list[str]
    flat: np.ndarray
    start: np.ndarray  # of each suffix in flat
    item: np.ndarray
    left: np.ndarray  # words of the suffix
    need: np.ndarray  # words of the item's windows

    @property
    def shortest(self) -> int:
        return int(self.need.min(initial=WINDOW))


def encode_tests(items: list[tuple[object, bytes | None]], window: int = WINDOW) -> Tests:
    vocabulary: dict[bytes, int] = {}
    names: list[str] = []
    flat, start, item, left, need = [], [], [], [], []
    for name, data in items:
        tokens = words(data)
        if not tokens:
            continue
        for at in range(len(tokens)):
            start.append(len(flat) + at)
            item.append(len(names))
            left.append(len(tokens) - at)
            need.append(min(window, len(tokens)))
        flat += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in tokens] + [-1]
        names.append("null" if name is None else str(name))
    arrays = (np.array(x, np.int64) for x in (flat, start, item, left, need))
    return Tests(vocabulary, names, *arrays)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of nonzero words in the order of their next ``depth`` words, by prefix doubling; zero ends a suffix."""
    at = np.flatnonzero(text)
    rank = text.astype(np.int64)
    reach = 1
    while reach < depth and len(at):
        after = np.zeros_like(rank)
        after[:-reach or None] = rank[reach:] if reach < len(rank) else 0
        _, new = np.unique(rank[at] * (rank.max() + 1) + after[at], return_inverse=True)
        rank[at] = new + 1
        if new.max() + 1 == len(at):
            break
        reach *= 2
    return at[np.argsort(rank[at], kind="stable")]


def _bound(values, low: np.ndarray, high: np.ndarray, wish: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every wish inside its own range [low, high)."""
    low, high = low.copy(), high.copy()
    while (live := low < high).any():
        middle = (low + high) // 2
        seen = values(middle)
        up = live & ((seen <= wish) if right else (seen < wish))
        low, high = np.where(up, middle + 1, low), np.where(live & ~up, middle, high)
    return low


@dataclass
class Matches:
    ranges: list[tuple[int, int, int, list[int]]]  # of the suffix array: low, high, words of the window, items
    longest: list[tuple[int, int, int, int]]  # low, high, length, item: the longest match of each suffix of a window's length or more


def search(text: np.ndarray, order: np.ndarray, tests: Tests) -> Matches:
    """Narrow the range of every benchmark suffix word by word; ``text`` ends with zeros to the longest item's length."""
    mine = np.flatnonzero(tests.left >= tests.need)
    low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(order), np.int64)
    found: dict[tuple[int, int, int], list[int]] = {}
    longest: list[tuple[int, int, int, int]] = []
    depth = 0
    while len(mine):
        wish = tests.flat[tests.start[mine] + depth]
        values = lambda k, d=depth: text[order[np.minimum(k, len(order) - 1)] + d]
        new_low = _bound(values, low, high, wish, False)
        new_high = _bound(values, new_low, high, wish, True)
        live = new_low < new_high
        for k in np.flatnonzero(~live & (tests.need[mine] <= depth)):  # went on as far as this
            longest.append((int(low[k]), int(high[k]), depth, int(tests.item[mine[k]])))
        mine, low, high, depth = mine[live], new_low[live], new_high[live], depth + 1
        for k in np.flatnonzero(tests.need[mine] == depth):
            found.setdefault((int(low[k]), int(high[k]), depth), []).append(int(tests.item[mine[k]]))
        keep = tests.left[mine] > depth
        longest += [(int(a), int(b), depth, int(tests.item[m])) for a, b, m in zip(low[~keep], high[~keep], mine[~keep], strict=True)]
        mine, low, high = mine[keep], low[keep], high[keep]
    return Matches([(a, b, n, sorted(set(items))) for (a, b, n), items in found.items()], longest)


@dataclass
class Found:
    n_words: int
    hit: np.ndarray  # of each word
    items: set[str]
    longest: int
    longest_item: str | None
    longest_at: int | None


def scan(texts: list[bytes | None], tests: Tests) -> list[Found]:
    """What the shard made of these documents has of the tests."""
    docs = [words(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))  # a zero follows each document
    number = tests.vocabulary.get
    all_words = np.zeros(int(first[-1]) + 1, np.int64)
    for at, tokens in zip(first, docs, strict=False):
        all_words[at:at + len(tokens)] = [number(w, 0) for w in tokens]
    result = [Found(int(n), np.zeros(int(n), bool), set(), 0, None, None) for n in sizes]
    if not tests.names:
        return result
    # A window needs as many benchmark words in a row: only such runs go into the suffix array.
    known = np.concatenate(([0], (all_words > 0).view(np.int8), [0]))
    begin, end = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
    long = end - begin >= tests.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return result
    depth = int(tests.left.max())
    where = np.concatenate([np.append(np.arange(a, b), -1) for a, b in zip(begin, end, strict=True)] + [np.full(depth, -1)])
    text = np.where(where >= 0, all_words[where], 0)
    order = suffix_array(text, depth)
    matches = search(text, order, tests)
    marks = np.zeros(len(all_words) + 1, np.int64)
    for low, high, n, items in matches.ranges:
        at = where[order[low:high]]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + n, -1)
        names = {tests.names[i] for i in items}
        for d in np.unique(np.searchsorted(first, at, side="right") - 1):
            result[d].items |= names
    best = np.zeros((3, len(docs)), np.int64)
    # shorter ones first, later ones replace them
    for low, high, n, item in sorted(set(matches.longest), key=lambda m: (m[2], tests.names[m[3]])):
        at = where[order[low:high]]
        owners = np.searchsorted(first, at, side="right") - 1
        best[0][owners], best[1][owners] = n, item
        best[2][owners[::-1]] = (at - first[owners])[::-1]
    for d in np.flatnonzero(best[0]):
        result[d].longest, result[d].longest_item, result[d].longest_at = int(best[0][d]), tests.names[best[1][d]], int(best[2][d])
    covered = np.cumsum(marks)[:-1] > 0
    for f, at in zip(result, first, strict=False):
        f.hit = covered[at:at + f.n_words]
    return result


def _block_count(benchmark: DataFrame, block_bytes: int) -> int:
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)))).first()[0]
    return max(1, math.ceil((size or 0) / block_bytes))


def _blocks(benchmark: DataFrame, window: int, n: int) -> Iterator[Tests]:
    """The items in ``n`` blocks, one at a time on the driver; copies of a text are dealt by their ids, so no block takes them all."""
    share = benchmark.select("item_id", F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64("text", "item_id"), F.lit(n)).alias("b"))
    for b in range(n):
        yield encode_tests([(r["item_id"], r["text"]) for r in share.filter(F.col("b") == b).distinct().collect()], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_item, longest_at)`` for every row of ``docs(doc_id, text)``.

    A window is ``window`` consecutive words of an item (an item of fewer words is one window); a document word
    inside any occurrence is hit.  Each Arrow batch of documents is a shard with a suffix array of its own; every
    benchmark suffix is searched in it, which also yields the longest verbatim match and its first word.
    Documents are never shuffled or grouped.  The benchmark is sent out in blocks of bounded size; the rows found by one pass
    are written before the block after the next is read, so the driver holds two blocks however large the benchmark is.
    Null and wordless texts have no hits; rows of one item_id are one item, a null id is named ``null``; an
    empty benchmark finds nothing; repeated rows each get a row; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    n = _block_count(benchmark, block_bytes)
    frame = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"),
                        F.lit(0).cast("long").alias("longest"), F.lit(None).cast("string").alias("longest_item"), F.lit(None).cast("long").alias("longest_at"))
    for k, tests in enumerate(_blocks(benchmark, window, n)):
        frame = _pass(stage(frame) if k else frame, tests, k + 1 == n)
    return frame


def _pass(frame: DataFrame, tests: Tests, last: bool) -> DataFrame:
    long, text = T.LongType(), T.StringType()
    made = [("n_words", long), ("n_hit", long), ("n_items", long), ("items_sha256", text), ("contaminated", T.BooleanType())] if last else []
    kept = ["doc_id"] + ([] if last else ["text", "hit", "items"])
    schema = T.StructType([field(frame, c) for c in kept] + [T.StructField(n, t) for n, t in made] + [field(frame, c) for c in ("longest", "longest_item", "longest_at")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {name: batch.column(name).to_pylist() for name in ("text", "hit", "items", "longest", "longest_item", "longest_at")}
            found = scan(rows["text"], tests)
            out: dict[str, list] = {name: [] for name in schema.names if name != "doc_id"}
            for k, f in enumerate(found):
                hit = f.hit if rows["hit"][k] is None else f.hit | np.unpackbits(np.frombuffer(rows["hit"][k], np.uint8), count=f.n_words).astype(bool)
                items = sorted(f.items | set(rows["items"][k]))
                best = max((rows["longest"][k], rows["longest_item"][k], rows["longest_at"][k]), (f.longest, f.longest_item, f.longest_at), key=lambda b: b[0])
                values = {"text": rows["text"][k], "hit": np.packbits(hit).tobytes(), "items": items, "n_words": f.n_words, "n_hit": int(hit.sum()), "n_items": len(items),
                          "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(), "contaminated": bool(hit.any()),
                          "longest": best[0], "longest_item": best[1], "longest_at": best[2]}
                for name in out:
                    out[name].append(values[name])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(out[s.name], pa.binary() if isinstance(s.dataType, T.BinaryType) else
                                             pa.list_(pa.string()) if s.name == "items" else pa.int64() if s.dataType == long else pa.bool_() if s.name == "contaminated" else pa.string())
                                             for s in schema if s.name != "doc_id"]], names=schema.names)

    return frame.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, all columns kept and in place; one pass a block, as above."""
    bounded_batches(docs.sparkSession)
    for k, tests in enumerate(_blocks(benchmark, window, _block_count(benchmark, block_bytes))):
        def run(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = pa.array([not f.items for f in scan(batch.column(batch.num_columns - 1).to_pylist(), tests)], pa.bool_())
                yield batch.select(range(batch.num_columns - 1)).filter(keep)

        docs = filter_batches(stage(docs) if k else docs, run)
    return docs
