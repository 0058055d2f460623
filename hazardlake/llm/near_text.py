"""Near duplicates by the share of common word shingles: SimHash under covering masks and MinHash bands propose pairs, their whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import bounded_batches, by_place, field, stage
from hazardlake.llm.components import components

WIDTH, SIMILARITY, BANDS, ROWS, SEED, PIVOTS = 5, 0.8, 20, 4, 42, 2
_BLOCK = 1 << 12
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one UTF-8 text; fewer words than ``width`` are one shingle."""
    tokens = data.lower().split() if data else []
    if len(tokens) < width:
        parts, total = [b" ".join(tokens)] if tokens else [], min(len(tokens), 1)
    else:
        parts, total = map(b" ".join, zip(*(tokens[i:] for i in range(width)), strict=False)), len(tokens) - width + 1
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, total))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key per band, over the least products of the hashes with fixed odd factors; no shingles give equal keys."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), _BLOCK):
        np.minimum(least, (found[start:start + _BLOCK] * _FACTORS[:, None]).min(axis=1), out=least)
    return np.fromiter((xxhash.xxh64_intdigest(b.tobytes(), SEED) for b in least.reshape(BANDS, ROWS)), np.uint64, BANDS).view(np.int64)


def set_print(found: np.ndarray) -> np.uint64:
    """64-bit SimHash of a shingle set: a bit is 1 if set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(found), _BLOCK):
        counts += np.unpackbits(found[start:start + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(found), bitorder="little").view(np.uint64)[0]


def _node(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sketches(docs: DataFrame, width: int, covering: Sequence[int] = ()) -> DataFrame:
    """``(doc_id, node, n, fp, keys)`` of every row: a digest of its shingle set, the set's size and SimHash, its band keys and its
    SimHash under each covering mask."""
    bounded_batches(docs.sparkSession)
    cover = np.array(covering, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            prints = [set_print(s) for s in sets]
            keys = [np.concatenate((band_keys(s), (p & cover).view(np.int64))) for s, p in zip(sets, prints, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(_node, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "node", "n", "fp", "keys"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, T.StructType(
        [field(docs, "doc_id"), T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]))


def with_node(docs: DataFrame, width: int, name: str) -> DataFrame:
    """``docs`` with the digest of each row's shingle set as last column."""
    plain = by_place(docs).withColumn("node", F.col(f"c{docs.columns.index('text')}").cast("binary"))
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [_node(shingles(t, width)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(nodes, pa.binary())], names=names)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns, name)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``(node, hashes)`` once per distinct shingle set of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "node binary, hashes binary").dropDuplicates(["node"])


def _held(sets: DataFrame) -> DataFrame:
    """``(node, held)``: how many shingles of each set occur in another one too."""
    numbered = stage(sets.select("node", F.monotonically_increasing_id().alias("id"), F.col("hashes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(hashes.as_buffer(), np.int64)
                for start in range(0, len(found), 1 << 16):
                    part = found[start:start + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), pa.array(part)], names=["id", "h"])

    single = numbered.select("id", "hashes").mapInArrow(run, "id long, h long").groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1")
    alone = single.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    size = (F.octet_length("hashes") / 8).cast("long")
    return numbered.select("node", "id", size.alias("size")).join(alone, "id", "left").select("node", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("held"))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``(a, b)`` whose shingle sets have at least this Jaccard similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    # The set of b first: rows then carry its bytes, by which a pivot with many partners is seen and split.
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def near_groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, covering: Sequence[int] = (), radius: int = 0) -> DataFrame:
    """``(node, low, root)`` of every distinct shingle set: its smallest doc_id, and the group over links of this similarity.

    Sets whose SimHash differ in at most ``radius`` bits are candidates; they agree under one of the ``covering`` masks.  So are sets that
    share a MinHash band key, since most pairs of this similarity lie more bits apart.  Two rounds compare each bucket with one of its members, first the one
    with the least text of its own, so a large group of near copies is tied without listing its pairs; pairs of
    a bucket that are still in different groups are then all compared.  Pairs that can't reach the similarity by
    their sizes and the shingles no other candidate has are passed over.  The set without a shingle has nothing in common with another one.
    """
    rows = sketches(docs, width, covering)
    nodes = stage(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    keyed = nodes.filter("n > 0").select("node", "n", "fp", F.posexplode("keys").alias("t", "k"))
    shared = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("t", "k")
    met = stage(keyed.join(shared, ["t", "k"]))
    named = nodes.join(met.select("node").distinct(), "node", "left_semi").select("low").distinct()
    sets = stage(_sets(docs.join(named, docs["doc_id"].eqNullSafe(named["low"]), "left_semi"), width).join(met.select("node").distinct(), "node", "left_semi"))
    met = stage(met.join(_held(sets), "node").filter(F.col("held") >= F.lit(similarity) * F.col("n") - 1e-9))
    # No pair has more in common than either one holds together with any other set.
    near = F.least("p.held", "m.held") * (1 + similarity) >= F.lit(similarity) * (F.col("p.n") + F.col("m.n")) - 1e-9
    near = near & ((F.col("m.t") < BANDS) | (F.bit_count(F.col("m.fp").bitwiseXOR(F.col("p.fp"))) <= radius))
    roots = None
    for turn in range(PIVOTS + 1):
        here = met.withColumn("root", F.col("node")) if roots is None else met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        order = F.struct((-F.col("held") / F.col("n") if turn == 0 else F.xxhash64("node", F.lit(turn))).alias("o"), "node", "n", "held", "fp", "root")
        mixed = here.groupBy("t", "k").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min(order).alias("p")).filter("r <> s")
        if turn < PIVOTS:
            pivots = mixed.select("t", "k", "p.node", "p.n", "p.held", "p.fp", "p.root")
        else:
            pivots = here = stage(here.join(mixed.select("t", "k"), ["t", "k"], "left_semi"))
        meet = here.alias("m").join(pivots.alias("p"), (F.col("m.t") == F.col("p.t")) & (F.col("m.k") == F.col("p.k"))).filter((F.col("m.root") != F.col("p.root")) & near)
        pairs = stage(meet.select(F.least("m.node", "p.node").alias("a"), F.greatest("m.node", "p.node").alias("b")).distinct())
        if pairs.isEmpty():
            if turn == PIVOTS or mixed.isEmpty():
                break
            continue
        found = stage(_alike(pairs, sets, similarity))
        roots = stage(components(found if roots is None else found.union(roots)))
    if roots is None:
        return nodes.select("node", "low", F.col("node").alias("root"))
    return nodes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
