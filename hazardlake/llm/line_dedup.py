"""Repeated lines: exact reference counts, fronted by sharded cuckoo filters; documents come and go."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import bounded_batches, by_place, field, free_name, stage

MIN_LENGTH, LIMIT = 20, 3
KEYS_PER_SHARD = 1 << 16
# Lines of one shard are probed by so many tasks at most, so one frequent line doesn't fill a single task.
SALTS = 64
_BLANK = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """Set of 16-byte keys with deletion: 16-bit fingerprints, four to a bucket, two buckets for each key.

    No false negatives; a false positive about once in 8 000 lookups.  ``add`` and ``remove`` take keys that are
    new and present, as the exact counts tell.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 0, data: bytes | None = None):
        buckets = 1 << max(0, math.ceil(math.log2(max(1, capacity / (0.9 * self.SLOTS)))))
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if data is None else np.frombuffer(data, np.uint16).reshape(-1, self.SLOTS).copy()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys given as rows of two 64-bit numbers."""
        top = np.uint64(len(self.table) - 1)
        prints = (keys[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = keys[:, 0] & top
        return prints, first, self._other(first, prints)

    def _other(self, bucket, prints):
        with np.errstate(over="ignore"):
            return bucket ^ (np.asarray(prints, np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7) & np.uint64(len(self.table) - 1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def add(self, keys: np.ndarray) -> bool:
        """False if the table is full; it must then be built anew, larger, from the exact counts."""
        random = np.random.default_rng(len(keys))
        for mark, *buckets in zip(*self._places(keys), strict=True):
            for bucket in buckets:
                if len(free := np.flatnonzero(self.table[bucket] == 0)):
                    self.table[bucket, free[0]] = mark
                    break
            else:
                bucket = buckets[0]
                for _ in range(self.KICKS):
                    slot = random.integers(self.SLOTS)
                    mark, self.table[bucket, slot] = self.table[bucket, slot], mark
                    bucket = self._other(bucket, mark)
                    if len(free := np.flatnonzero(self.table[bucket] == 0)):
                        self.table[bucket, free[0]] = mark
                        break
                else:
                    return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        for mark, *buckets in zip(*self._places(keys), strict=True):
            for bucket in buckets:
                if len(held := np.flatnonzero(self.table[bucket] == mark)):
                    self.table[bucket, held[0]] = 0
                    break


def numbers(keys: list[bytes] | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def line_key(line: bytes, least: int = MIN_LENGTH) -> bytes | None:
    """16-byte digest of the stripped, ASCII-lower-cased line, or None if it has fewer than ``least`` code points."""
    plain = line.strip(_BLANK).lower()
    if len(plain) < least or len(plain) < 4 * least and len(plain.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(plain, digest_size=16).digest()


def document_keys(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """``(doc_id, keys)``: the distinct keys of each row's lines."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sorted({k for line in (t or b"").split(b"\n") if (k := line_key(line, least))}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.binary()))], names=["doc_id", "keys"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, T.StructType([field(docs, "doc_id"), T.StructField("keys", T.ArrayType(T.BinaryType()))]))


@dataclass(frozen=True)
class LineState:
    """``holders(doc_id, keys)`` of every document held, the exact ``counts(key, refs, owner)`` of every line key,
    and one filter for each shard of the keys that are at the limit: ``filters(shard, bits)``.  All are written tables."""

    holders: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    limit: int


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _counts(holders: DataFrame) -> DataFrame:
    """Reference count and largest doc_id of each key; summed before the shuffle, so a frequent line is one row of each task."""
    return holders.select("doc_id", F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("owner"))


def _built(frequent: DataFrame, shards: int) -> DataFrame:
    """A filter for each shard of the keys, twice as large as needed so that it can grow."""
    def build(part: pd.DataFrame) -> pd.DataFrame:
        size = 2 * len(part)
        while not (made := CuckooFilter(size)).add(numbers(part["key"])):
            size *= 2
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "bits": [made.table.tobytes()]})

    return frequent.select(_shard(F.col("key"), shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard int, bits binary")


def _frequent(counts: DataFrame, limit: int) -> DataFrame:
    return counts.filter(F.col("refs") >= limit)


def new_state(docs: DataFrame, limit: int = LIMIT, least: int = MIN_LENGTH, keys_per_shard: int = KEYS_PER_SHARD) -> LineState:
    """The state that holds all of ``docs(doc_id, text)``; each row counts as a document."""
    holders = stage(document_keys(docs, least))
    # Only keys at the limit are looked up again; the counts of the others are derived from the holders when they are needed.
    counts = stage(_frequent(_counts(holders), limit))
    shards = max(1, math.ceil(counts.count() / keys_per_shard))
    return LineState(holders, counts, stage(_built(counts, shards)), shards, limit)


def _changed(state: LineState, holders: DataFrame, touched: DataFrame) -> LineState:
    """Recount the touched keys only, and carry what crosses the limit over to the filters."""
    keys = stage(touched.select(F.explode("keys").alias("key")).distinct())
    held = holders.select("doc_id", F.explode("keys").alias("key")).join(keys, "key", "left_semi")
    recounted = stage(_frequent(held.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("owner")), state.limit))
    before = state.counts.join(keys, "key", "left_semi").select("key", F.lit(True).alias("was"))
    after = recounted.select("key", F.lit(True).alias("now"))
    crossed = before.join(after, "key", "full").filter("was is null or now is null").select(_shard(F.col("key"), state.shards).alias("shard"), "key", F.col("now").isNotNull().alias("added"))
    counts = stage(state.counts.join(keys, "key", "left_anti").unionByName(recounted))

    def update(have: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        both = CuckooFilter(2 * len(change)) if have.empty else CuckooFilter(data=have["bits"].iloc[0])
        added, gone = change[change["added"]]["key"], change[~change["added"]]["key"]
        both.remove(numbers(gone))
        full = not both.add(numbers(added))
        shard = (change if have.empty else have)["shard"].iloc[0]
        return pd.DataFrame({"shard": [int(shard)], "bits": [None if full else both.table.tobytes()]})

    updated = stage(state.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(update, "shard int, bits binary"))
    full = updated.filter("bits is null").select("shard")
    again = _built(counts.withColumn("shard", _shard(F.col("key"), state.shards)).join(full, "shard", "left_semi"), state.shards)
    return replace(state, holders=holders, counts=counts, filters=stage(updated.filter("bits is not null").union(again)))


def add_documents(state: LineState, docs: DataFrame, least: int = MIN_LENGTH) -> LineState:
    fresh = stage(document_keys(docs, least))
    return _changed(state, stage(state.holders.unionByName(fresh)), fresh)


def delete_documents(state: LineState, doc_ids: DataFrame) -> LineState:
    """Take the documents with these ``doc_id`` out again: the state is then as if they had never been added."""
    gone = stage(state.holders.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi"))
    return _changed(state, stage(state.holders.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")), gone)


def suspects(state: LineState, holders: DataFrame) -> DataFrame:
    """``(doc_id, key)`` of the lines that a shard's filter lets through; a filter streams ahead of the lines of its shard."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    ahead = state.filters.select("shard", salts.alias("salt"), F.lit(0).alias("kind"), F.col("bits").alias("key"), F.lit(None).cast(holders.schema["doc_id"].dataType).alias("doc_id"))
    lines = holders.select("doc_id", F.explode("keys").alias("key")).select(
        _shard(F.col("key"), state.shards).alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), "key", "doc_id")
    dealt = ahead.union(lines).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bits = None, None
        for batch in batches:
            shard_of, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            keys, passed = batch.column("key"), np.zeros(batch.num_rows, bool)
            # stretches of rows under one filter: a filter row opens one, and so does a shard that has none
            opens = np.flatnonzero((kind == 0) | (np.diff(shard_of, prepend=-1 if shard is None else shard) != 0))
            bounds = [0, *opens[opens > 0], batch.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if kind[a] == 0:
                    shard, bits = shard_of[a], CuckooFilter(data=keys[int(a)].as_py())
                    a += 1
                elif shard_of[a] != shard:
                    shard, bits = shard_of[a], None
                if bits is not None and a < b:
                    passed[a:b] = bits.has(numbers(keys.slice(int(a), int(b - a)).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), keys], names=["doc_id", "key"]).filter(pa.array(passed))

    return dealt.mapInArrow(probe, T.StructType([field(holders, "doc_id"), T.StructField("key", T.BinaryType())]))


def repeated_lines(state: LineState, holders: DataFrame) -> DataFrame:
    """``(doc_id, dropped)``: the keys each document loses, that is those at the limit which a larger doc_id owns."""
    sure = suspects(state, holders).join(state.counts, "key").filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
    return sure.groupBy("doc_id").agg(F.collect_set("key").alias("dropped"))


def _with_dropped(docs: DataFrame, state: LineState) -> DataFrame:
    """``docs`` and, behind its columns, the keys of the lines to drop; documents without doc_id are joined to each other."""
    lost = repeated_lines(state, state.holders)
    return docs.alias("d").join(lost.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")), "left").select("d.*", F.col("l.dropped").alias(free_name(docs.columns, "lost_keys")))


def _cut(text: bytes | None, dropped: list[bytes] | None, least: int) -> tuple[list[bytes], int]:
    """Lines that stay, and how many there were."""
    lines = (text or b"").split(b"\n")
    gone = set(dropped or ())
    return ([line for line in lines if line_key(line, least) not in gone] if gone else lines), len(lines)


def line_report(docs: DataFrame, limit: int = LIMIT, least: int = MIN_LENGTH) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` for every row of ``docs(doc_id, text)``.

    Line keys of at least ``least`` code points that ``limit`` or more rows hold are dropped, except in the largest
    doc_id that holds them.  Null and empty texts are one empty line; each of several rows with one doc_id counts,
    and all rows with the largest doc_id keep the line; a null doc_id is smaller than any other.  An empty table
    gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    state = new_state(docs, limit, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [_cut(t, d, least) for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in cut], pa.int64()), pa.array([n - len(kept) for kept, n in cut], pa.int64()),
                                              pa.array([hashlib.sha256(b"\n".join(kept)).hexdigest() for kept, _ in cut], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    long = T.LongType()
    return _with_dropped(docs, state).mapInArrow(run, T.StructType([field(docs, "doc_id"), T.StructField("n_lines", long), T.StructField("n_dropped", long), T.StructField("kept_sha256", T.StringType())]))


def drop_repeated_lines(docs: DataFrame, limit: int = LIMIT, least: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with the repeated lines cut out of ``text``; all rows and columns stay, and a text without such a line, null too, is as it was."""
    state = new_state(docs, limit, least)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kind = batch.column(at).to_pylist(), batch.schema.field(at).type
            kept = [b"\n".join(_cut(t.encode(), d, least)[0]).decode() if t is not None and d else t for t, d in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(kept, kind)
            yield pa.RecordBatch.from_arrays(columns, names=plain.names)

    plain = by_place(docs).schema
    return by_place(_with_dropped(docs, state)).mapInArrow(run, plain).toDF(*docs.columns)
