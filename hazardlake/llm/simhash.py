"""Near duplicates by 64-bit SimHash, found through covering masks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm import near_text
from hazardlake.llm.common import bounded_batches, field, free_name, stage
from hazardlake.llm.components import components

BITS, RADIUS, WIDTH, SEED = 64, 2, 3, 42
_BLOCK = 1 << 16


def masks(radius: int = RADIUS) -> list[int]:
    """Bit masks such that any two fingerprints within ``radius`` agree under at least one of them.

    Bit i gets a nonzero vector of radius+1 bits; the mask of a nonzero vector v has the bits whose vector has
    an odd product with v.  The at most ``radius`` differing bits span less than the whole space, so some v is
    orthogonal to all of their vectors, and its mask leaves every differing bit out.
    """
    size = 1 << (radius + 1)
    return [sum(1 << i for i in range(BITS) if (((i % (size - 1)) + 1) & v).bit_count() % 2) for v in range(1, size)]


def fingerprint(data: bytes | None, width: int = WIDTH) -> int:
    """SimHash of one UTF-8 text; no words give zero."""
    tokens = data.lower().split() if data else []
    if not tokens:
        return 0
    if len(tokens) < width:
        shingles, total = iter([b" ".join(tokens)]), 1
    else:
        shingles, total = map(b" ".join, zip(*(tokens[i:] for i in range(width)), strict=False)), len(tokens) - width + 1
    counts = np.zeros(BITS, np.int64)
    for start in range(0, total, _BLOCK):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, _BLOCK), repeat(SEED)), np.uint64, min(_BLOCK, total - start))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)`` of every row; fp holds the 64 bits as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, T.StructType([field(docs, "doc_id"), T.StructField("fp", T.LongType())]))


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value)


def links(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints ``fp`` which chains of steps of at most two bits connect.

    A fingerprint is looked up under every covering mask.  One that is alone in all its buckets has no link.
    The others take their neighbours at one bit, over the bits that a shared bucket leaves open: two
    fingerprints within two bits that meet in a bucket have such a neighbour (or one of themselves) in common,
    and any two with a common one are within two bits.  A neighbour has at most 65 owners, so the owners are
    tied to the smallest one without listing pairs, however full the bucket is.
    """
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(_long(m)).alias("k")) for i, m in enumerate(masks())])).alias("b")).select("fp", "b.t", "b.k")
    shared = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", "k")
    open_bits = F.element_at(F.array(*[_long(~m & ((1 << 64) - 1)) for m in masks()]), F.col("t") + 1)
    met = keyed.join(shared, ["t", "k"], "left_semi").groupBy("fp").agg(F.bit_or(open_bits).alias("free"))
    one = F.lit(1).cast("long")
    flips = F.transform(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.call_function("getbit", F.col("free"), b) == 1),
                        lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, b)))
    near = met.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("z"))
    owners = near.groupBy("z").agg(F.collect_set("fp").alias("own")).filter(F.size("own") > 1)
    return owners.select(F.array_min("own").alias("a"), F.explode("own").alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the smallest doc_id reachable over links of at most two differing bits.  Null and
    wordless texts have fingerprint zero and are linked like any other; rows of equal fingerprint are always
    together; repeated rows each get a row; a null doc_id never names a component unless nothing else does
    (then it is null).  An empty table gives an empty result; other columns are ignored.
    """
    rows = stage(fingerprints(docs))
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = stage(components(links(distinct.select("fp"))))
    placed = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, width: int = near_text.WIDTH, similarity: float = near_text.SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group, the one with the smallest doc_id, all columns kept and in place.

    Candidates are fingerprints within ``RADIUS`` bits, found by the covering masks, and sets that meet in a MinHash band; of
    them, pairs whose sets of word shingles have at least this Jaccard similarity tie a group.  Rows
    that share a doc_id are told apart by their shingle sets: each stays if its own group needs it; of those alike in
    both, the one with the least text stays.  Rows without doc_id can't be named and stay.
    """
    groups = near_text.near_groups(docs, width, similarity, masks(), RADIUS).filter("low is not null")
    named = stage(groups.groupBy("root").agg(F.min(F.struct("low", "node")).alias("r")).select(F.col("r.low").alias("id"), F.col("r.node").alias("node")))
    repeated = stage(docs.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"))
    single = docs.join(repeated, docs["doc_id"] == repeated["id"], "left_anti")
    single = single.join(named, single["doc_id"] == named["id"], "left_semi")
    node, row = free_name(docs.columns, "node"), free_name(docs.columns, "row")
    told = near_text.with_node(docs.join(repeated, docs["doc_id"] == repeated["id"], "left_semi"), width, node)
    told = told.join(named, (told["doc_id"] == named["id"]) & (told[node] == named["node"]), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)
    first = told.groupBy("doc_id", node).agg(F.min_by(whole, F.struct(F.col("text").isNotNull(), "text")).alias(row)).select(f"`{row}`.*")
    return single.unionAll(first).unionAll(docs.filter(F.col("doc_id").isNull()))
