"""Hard negatives by a vertical scan with branch and bound over dimensions (BOND)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import bounded_batches, field, stage
from hazardlake.llm.vectors import finite_rows, whole_numbers

SCALE, TOP, LEAST_PERCENT = 256, 5, 80
BLOCK_ROWS, GROUP_ANCHORS, BAND_BLOCKS, STEP = 4096, 2048, 64, 8
NO_SCORE = -(2 ** 63)  # below every score; among ids it stands for null

_BLOCK = T.StructType([T.StructField(n, t) for n, t in [
    ("size", T.IntegerType()), ("block", T.LongType()), ("n", T.IntegerType()), ("kind", T.StringType()), ("columns", T.ArrayType(T.BinaryType())),
    ("labels", T.BinaryType()), ("ids", T.BinaryType())]])


def vertical_blocks(rows: DataFrame, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The usable ``rows(vec_id, label, embedding)`` as blocks: one fragment of whole numbers for each dimension, beside labels and ids.

    A block is numbered by its task and its place there, so a row is known by (block, place) whatever its id.
    """
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}  # by length: vectors, labels, ids that wait for a full block

        def block(size: int) -> pa.RecordBatch:
            nonlocal made
            x, labels, ids = (np.concatenate([h[k] for h in held[size]]) for k in range(3))
            held[size] = []
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(x).max(initial=0) <= np.iinfo(k).max)
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([(part << 32) + made - 1]), pa.array([len(x)], pa.int32()), pa.array([kind]),
                                               pa.array([[c.tobytes() for c in x.T.astype(kind)]], pa.list_(pa.binary())), pa.array([labels.tobytes()]), pa.array([ids.tobytes()])], names=_BLOCK.names)

        for batch in batches:
            places, lengths, values = finite_rows(batch.column(2))
            x, at = whole_numbers(values, scale), np.cumsum(lengths) - lengths
            labels = batch.column(1).take(pa.array(places)).to_numpy(zero_copy_only=False)
            ids = batch.column(0).take(pa.array(places)).fill_null(NO_SCORE).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                for start in range(0, len(own), block_rows):
                    some = own[start:start + block_rows]
                    held.setdefault(size, []).append((x[at[some][:, None] + np.arange(size)], labels[some], ids[some]))
                    if sum(len(h[1]) for h in held[size]) >= block_rows:
                        yield block(size)
        for size in held:
            if held[size]:
                yield block(size)

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").filter("label IS NOT NULL").mapInArrow(run, _BLOCK)


class Block:
    """One vertical block in memory."""

    def __init__(self, row: dict):
        self.n, self.key = row["n"], row["block"]
        self.columns = [np.frombuffer(c, row["kind"]).astype(np.int64) for c in row["columns"]]
        self.labels, self.ids = np.frombuffer(row["labels"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.low = np.array([c.min() for c in self.columns])
        self.high = np.array([c.max() for c in self.columns])
        room = sum(max(abs(int(a)), abs(int(b))) ** 2 for a, b in zip(self.low, self.high, strict=True))
        if room >= 2 ** 62:
            raise ValueError("vectors are too large for inner products in 64 bits")


def scan(block: Block, vector: np.ndarray, alive: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places of the block that ``keep`` lets live to the last dimension, and their exact scores.

    Dimensions are read in falling order of the vector's magnitude.  After every ``step`` of them each living row's score
    lies between its sum so far plus the least and the most that the dimensions still unread can add in this block;
    ``keep(least, most)`` says which rows can still matter.  ``alive`` is the bitmap to start with.
    """
    order = np.argsort(-np.abs(vector), kind="stable")
    ends = vector * block.low, vector * block.high
    least, most = np.minimum(*ends)[order], np.maximum(*ends)[order]
    left_least, left_most = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in (least, most))
    places = np.flatnonzero(alive)
    sums = np.zeros(len(places), np.int64)
    for at in range(0, len(order), step):
        dense = len(places) == block.n
        for d in order[at:at + step]:
            if vector[d]:
                sums += vector[d] * (block.columns[d] if dense else block.columns[d][places])
        done = min(at + step, len(order))
        stay = keep(sums + left_least[done], sums + left_most[done])
        if not stay.all():
            places, sums = places[stay], sums[stay]
        if not len(places):
            break
    return places, sums


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by falling score, then smaller id; a row without an id comes last."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    order = np.lexsort((np.where(ids[near] == NO_SCORE, np.iinfo(np.int64).max, ids[near]), -scores[near]))
    return near[order[:k]]


class Nearest:
    """The first k rows of an anchor's own label seen so far."""

    def __init__(self, anchor: dict, k: int = TOP):
        self.a, self.k = anchor, k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def see(self, block: Block) -> None:
        alive = block.labels == self.a["label"]
        if block.key == self.a["block"]:
            alive[self.a["place"]] = False
        floor = self.scores[-1] if len(self.scores) == self.k else NO_SCORE

        def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            bar = max(floor, np.partition(least, len(least) - self.k)[len(least) - self.k]) if len(least) >= self.k else floor
            return most >= bar

        places, scores = scan(block, self.a["vector"], alive, keep)
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, block.ids[places]])
        own = _best(scores, ids, self.k)
        self.scores, self.ids = scores[own], ids[own]

    def rows(self) -> Iterator[tuple]:
        for s, i in zip(self.scores.tolist(), self.ids.tolist(), strict=True):
            yield self.a["block"], self.a["place"], self.a["vec_id"], None, i, s


class Windows:
    """The first k rows of other labels seen so far, in each score window [share of it, positive score] of an anchor."""

    def __init__(self, anchor: dict, k: int = TOP, least_percent: int = LEAST_PERCENT):
        self.a, self.k = anchor, k
        # one window for each different positive score; scores below zero leave an empty one
        self.spans = [(-(-least_percent * p // 100), p) for p in sorted(set(anchor["scores"])) if -(-least_percent * p // 100) <= p]
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.spans]

    def see(self, block: Block) -> None:
        if not self.spans:
            return
        floors = [f[0][-1] if len(f[0]) == self.k else low for (low, _), f in zip(self.spans, self.found, strict=True)]

        def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            stay = np.zeros(len(least), bool)
            for (low, high), floor in zip(self.spans, floors, strict=True):
                sure = least[(most <= high) & (least >= low)]  # rows certain to lie in the window
                bar = max(floor, np.partition(sure, len(sure) - self.k)[len(sure) - self.k]) if len(sure) >= self.k else floor
                stay |= (most >= bar) & (least <= high)
            return stay

        places, scores = scan(block, self.a["vector"], block.labels != self.a["label"], keep)
        ids = block.ids[places]
        for w, (low, high) in enumerate(self.spans):
            inside = (scores >= low) & (scores <= high)
            if inside.any():
                s, i = np.concatenate([self.found[w][0], scores[inside]]), np.concatenate([self.found[w][1], ids[inside]])
                own = _best(s, i, self.k)
                self.found[w] = s[own], i[own]

    def rows(self) -> Iterator[tuple]:
        for (_, high), (scores, ids) in zip(self.spans, self.found, strict=True):
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                yield self.a["block"], self.a["place"], self.a["vec_id"], high, i, s


_FOUND = "block long, place int, vec_id long, window long, other_id long, score long"
_ANCHORS = "group long, anchors array<struct<block:long,place:int,vec_id:long,label:long,vector:array<long>,scores:array<long>>>"


def anchors(blocks: DataFrame, every: int) -> DataFrame:
    """``(block, place, vec_id, label, vector)`` of the rows whose id ``every`` divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block(row)
                at = np.flatnonzero((own.ids != NO_SCORE) & (own.ids % every == 0))
                vectors = np.stack([c[at] for c in own.columns], axis=1) if len(at) else np.zeros((0, 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), own.key)), pa.array(at.astype(np.int32)), pa.array(own.ids[at]), pa.array(own.labels[at]),
                                                  pa.array(list(vectors), pa.list_(pa.int64()))], names=["block", "place", "vec_id", "label", "vector"])

    return blocks.mapInArrow(run, "block long, place int, vec_id long, label long, vector array<long>")


def grouped(found: DataFrame, n_bands: int, size: int = GROUP_ANCHORS) -> DataFrame:
    """Anchors in groups of bounded size, each once for every band of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size).to_struct_array()
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)], names=["group", "anchors"])
                made += 1

    packed = found.select("block", "place", "vec_id", "label", "vector", "scores").mapInArrow(run, _ANCHORS)
    return packed.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(n_bands - 1))))


def scanned(groups: DataFrame, blocks: DataFrame, n_bands: int, search: Callable[[dict], Nearest | Windows]) -> DataFrame:
    """What ``search`` finds for each anchor in each band.  Groups are the streamed side of the join, the blocks of a band
    the buffered one, so a task holds one group and one block; rows go out when the group changes.  Should the join deliver
    a group in several runs, each run is a partial result like that of another band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, searches = None, []

        def out() -> Iterator[pa.RecordBatch]:
            rows = [r for s in searches for r in s.rows()]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["block", "place", "vec_id", "window", "other_id", "score"]
            if rows:
                columns = [pa.array([None if v == NO_SCORE and k == 4 else v for v in c], kinds[k]) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                key = row.column("group")[0].as_py()
                if key != group:
                    yield from out()
                    group = key
                    searches = [search(a | {"vector": np.array(a["vector"], np.int64)}) for a in row.column("anchors")[0].as_py()]
                block = Block(row.select(_BLOCK.names).to_pylist()[0])
                for s in searches:
                    s.see(block)
        yield from out()

    # the number of bands is given, so that small tables aren't put back into one task
    narrow = blocks.select("band", *_BLOCK.names).repartition(n_bands, "band")
    return groups.repartition(n_bands, "band").join(narrow.hint("merge"), "band").select("group", "anchors", *_BLOCK.names).mapInArrow(run, _FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key by falling score, then smaller id; tasks drop their own surplus before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = 100, k: int = TOP, scale: int = SCALE, least_percent: int = LEAST_PERCENT, n_bands: int | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``rows(vec_id, label, embedding)``.

    Anchors are the rows whose ``vec_id`` is divisible by ``every``; all usable rows are searched for each.  An anchor's
    positives are its first ``k`` other rows of its label by falling integer inner product, then smaller id; for each, the
    first ``k`` rows of other labels whose score lies within ``least_percent`` of the positive's and the positive's itself.

    Rows with a null label, or with a null, empty or not wholly finite vector, take no part, nor do vectors of another
    length than the most frequent one (the longer of two equally frequent).  A null id is no anchor and comes last among
    equal scores.  Rows are told apart by their place, not their id: of repeated rows each is searched, and each anchor
    among them has results of its own; another row with the anchor's id can be its positive.  A positive with no row in
    its window, such as every one with a negative score, has no result rows.  An empty table gives an empty result; other
    columns are ignored.

    Two scans: the first finds positives, the second resolves the windows.  Blocks of rows meet groups of anchors
    by bands: a group is sent once to each band, a block to its band only.
    """
    spark = rows.sparkSession
    id_type = field(rows, "vec_id").dataType
    all_blocks = stage(vertical_blocks(rows, scale))
    common = all_blocks.groupBy("size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).orderBy(F.desc("n"), F.desc("size")).first()
    size, n_blocks = (common["size"], common["blocks"]) if common else (0, 0)
    bands = n_bands or max(1, min(n_blocks, max(2 * spark.sparkContext.defaultParallelism, n_blocks // BAND_BLOCKS)))
    blocks = all_blocks.filter(F.col("size") == size).withColumn("band", F.pmod(F.xxhash64("block"), F.lit(bands)).cast("int"))
    own = stage(anchors(blocks.drop("band"), every))
    tasks = max(1, -(-own.count() // GROUP_ANCHORS))

    def groups(frame: DataFrame) -> DataFrame:
        return grouped(frame.repartition(tasks, "block", "place"), bands)

    near = scanned(groups(own.withColumn("scores", F.array().cast("array<long>"))), blocks, bands, lambda a: Nearest(a, k))
    key = ["block", "place"]
    positives = stage(_first(near.drop("window"), key, k))
    windowed = own.join(positives.groupBy(*key).agg(F.collect_set("score").alias("scores")).hint("merge"), key)  # k scores at most
    hard = scanned(groups(windowed), blocks, bands, lambda a: Windows(a, k, least_percent))
    chosen = _first(hard, [*key, "window"], k)
    pairs = positives.select(*key, F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(chosen.withColumnRenamed("window", "positive_score").hint("merge"), [*key, "positive_score"]).select(
        F.col("vec_id").cast(id_type).alias("anchor_id"), F.col("positive_id").cast(id_type).alias("positive_id"), "rank", F.col("other_id").cast(id_type).alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame, step: int = 7, labels: int = 10) -> DataFrame:
    """The contract's rows: where ``step`` divides the id, the label moves on by one."""
    moved = F.when(F.col("vec_id") % step == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), "embedding")
