"""Toxicity by compression distance: two zstandard dictionaries, learned from labelled text, compared window by window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import bounded_batches, field, filter_batches, stage

WINDOW, STEP, THRESHOLD = 64, 48, 0.3
# Bounds of the fitted sample: rows of each class, and bytes of all their texts together; texts of any length are taken whole.
MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 2_000, 8_000, 48 << 20
TOXIC_BYTES, ORDINARY_BYTES, HARD_BYTES, PIECE, GRAM, ROUNDS = 1_024, 16_384, 8_192, 256, 5, 3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a missing id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def _compressor(content: bytes):
    settings = zs.ZstdCompressionParameters(window_log=18, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=8, strategy=zs.STRATEGY_LAZY2,
                                            write_content_size=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
    dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zs.ZstdCompressor(compression_params=settings, dict_data=dictionary).compress


def _windows(data: bytes) -> list[bytes]:
    return [data[i:i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STEP)), STEP)]


@dataclass
class Model:
    """Dictionary contents, and the weights of a logistic curve over what the windows gain."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    rate: float

    def scorer(self):
        if not len(self.weights):
            return lambda data: self.rate
        gain = _gains(self.toxic, self.ordinary)

        def score(data: bytes) -> float:
            z = self.weights[0] + ((_features(gain(data)) - self.centre) / self.scale) @ self.weights[1:]
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _gains(toxic: bytes, ordinary: bytes):
    """Bytes each window of a text saves when the toxic dictionary stands beside the ordinary one; plain prose saves none."""
    plain, both = _compressor(ordinary), _compressor(toxic + ordinary)
    return lambda data: np.array([len(plain(w)) - len(both(w)) for w in _windows(data)])


def _features(gains: np.ndarray) -> np.ndarray:
    """Largest gains, how many windows pass each of several sizes, and the number of windows."""
    top = np.maximum(np.sort(gains)[::-1][:3], 0)
    top = np.pad(top, (0, 3 - len(top)))
    many = [min(10, int((gains >= t).sum())) for t in (2, 3)]
    return np.array([min(10, top[0]), *(top[0] >= t for t in (2, 3, 4, 5)), top[1] >= 2, top[1] >= 3, top[2] >= 2, *many, np.log(len(gains))], float)


def _grams(data: bytes) -> np.ndarray:
    letters = np.frombuffer(data, np.uint8).astype(np.uint64)
    codes = np.zeros(max(0, len(letters) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        codes = codes * np.uint64(256) + letters[i:i + len(codes)]
    return codes


def _telling(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Letter groups that no ordinary text has and several toxic ones share."""
    known = np.unique(np.concatenate([np.unique(_grams(t)) for t in ordinary]))
    codes, texts = np.unique(np.concatenate([np.unique(_grams(t)) for t in toxic]), return_counts=True)
    return np.setdiff1d(codes[texts >= max(2, len(toxic) // 500)], known, assume_unique=True)


def _stretches(data: bytes, telling: np.ndarray) -> bytes:
    """The stretches of a text that telling letter groups cover, a blank between them."""
    codes = _grams(data)
    if not len(telling) or not len(codes):
        return b""
    fresh = np.flatnonzero(telling[np.minimum(np.searchsorted(telling, codes), len(telling) - 1)] == codes)
    cover = np.zeros(len(data) + 1, np.int64)
    np.add.at(cover, fresh, 1)
    np.add.at(cover, fresh + GRAM, -1)
    edges = np.flatnonzero(np.diff((np.cumsum(cover) > 0).view(np.int8), prepend=np.int8(0)))
    return b" ".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=False))


def _dictionary(size: int, samples: list[bytes], segment: int, unit: int) -> bytes:
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zs.train_dictionary(size, samples, k=segment, d=unit, level=3).as_bytes()
    except (zs.ZstdError, ValueError):  # too few samples to train on: take them as they are
        return b" ".join(samples)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = 0.01 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
    return w


def fit(toxic: list[bytes], ordinary: list[bytes], rate: float) -> Model:
    """Train the dictionaries and calibrate the curve; ``rate`` is the share of toxic rows among all that may be learned from."""
    toxic, ordinary = [t.lower() for t in toxic], [t.lower() for t in ordinary]
    if not toxic or not ordinary:
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), rate if toxic else 0.0)
    learn, judge = ordinary[::2], ordinary[1::2] or ordinary
    # Toxic texts are mostly plain prose: only what they share and ordinary ones lack is worth a dictionary.
    telling = _telling(toxic, learn)
    bad = _dictionary(TOXIC_BYTES, [_stretches(t, telling) for t in toxic], 16, 6) or b" "
    plain = _dictionary(ORDINARY_BYTES, [t[i:i + PIECE] for t in learn for i in range(0, len(t), PIECE)], 64, 8) or b" "
    # Ordinary windows that the toxic dictionary still helps go into the ordinary one, so that they cancel out: evenly spread
    # ones, since a dictionary that takes them all swallows the toxic words of mislabelled texts.
    for k in range(ROUNDS):
        gain = _gains(bad, plain)
        hard = [w for t in learn[k::ROUNDS] for w, g in zip(_windows(t), gain(t), strict=True) if g >= 2]
        plain = b"".join(hard[::-(-len(hard) * WINDOW // HARD_BYTES) or 1]) + plain
    gain = _gains(bad, plain)
    x = np.array([_features(gain(t)) for t in toxic + judge])
    y = np.array([1.0] * len(toxic) + [0.0] * len(judge))
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    return Model(bad, plain, _logistic((x - centre) / scale, y, weight), centre, scale, rate)


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on labelled rows outside the held-out fold: at most so many of each class, by the hash of their id, and at most
    ``max_bytes`` of text, in the same order; a text that no longer fits is passed over, the others are taken whole.
    A doc_id labelled both ways counts as toxic; null labels and ids are left out; of rows with one id the least text is read."""
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    part = lambda test, n: known.filter(test).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = part("toxic > 0", max_toxic).unionAll(part("toxic <= 0", max_ordinary))
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")  # as many ids as the bounds say
    rows = stage(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    left, fitting = max_bytes, []
    for r in rows.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["size"] <= left:
            left -= r["size"]
            fitting.append((r["doc_id"],))
    taken = docs.sparkSession.createDataFrame(fitting, T.StructType([field(rows, "doc_id")]))
    found = rows.join(F.broadcast(taken), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return fit([bytes(r["text"]) for r in found if r["toxic"] > 0], [bytes(r["text"]) for r in found if r["toxic"] <= 0], share)


def _scoring(spark: SparkSession, model: Model, made):
    """A batch function that scores the text bytes in the last column and lets ``made`` build the output from batch and scores."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield made(batch, np.array([score((t or b"").lower()) for t in batch.column(batch.num_columns - 1).to_pylist()], float))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``, learned from ``labels(doc_id, toxic)``.

    Whole texts are scored in windows of 64 bytes; nothing but the text enters a score.  Null and empty texts get the score of
    a text that gains nothing; without toxic labels every score is 0, without ordinary ones the toxic share; repeated rows
    each get a row, a missing doc_id counts as held out; an empty table gives an empty result; other columns are ignored.
    """
    names = ["doc_id", "held_out", "score", "predicted"]
    run = _scoring(docs.sparkSession, train(docs, labels), lambda batch, s: pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=names))
    schema = T.StructType([field(docs, "doc_id"), *(T.StructField(n, t) for n, t in zip(names[1:], (T.BooleanType(), T.DoubleType(), T.IntegerType()), strict=True))])
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score below the threshold, all columns kept and in place."""
    return filter_batches(docs, _scoring(docs.sparkSession, train(docs, labels), lambda batch, s: batch.select(range(batch.num_columns - 1)).filter(pa.array(s < threshold))))
