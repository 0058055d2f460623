"""Similar reports: exact scores of stated reports against all others, and the repeats of every report."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.functions.columns import fence
from hazardlake.functions.text import similarity_tokens
from hazardlake.session import shared_folder

MIN_SCORE, DUPLICATE_SCORE = 0.16, 0.88
# Queries sent to the tasks at a time.
QUERY_BLOCK = 4_096
# Reports that give the first k-th best scores, and those of a query's group that raise them; pairs that a task holds at a time.
FIRST_ROWS, GROUP_ROWS, PAIRS = 5_000, 100_000, 2_000_000
# Queries that need less overlap than this with reports outside their group get a larger one.
WEAK = 0.25
# Groups of queries: of one rule and activity, of one rule, of one activity, all.  Hashes whose odd counts bound a pair's overlap.
BOTH, BY_RULE, BY_ACTIVITY, EVERY = range(4)
ODD = 1_024
# Cells of reports by tokens that a task holds at a time.
HELD = 1 << 25
# Rows and tokens that decide in which order tokens are tried; hashes whose odd counts tell sets apart.
ORDER_ROWS, ORDER_TOKENS, BITS = 20_000, 500_000, 256
_MARKS = [f"m{k}" for k in range(BITS // 64)]
# Weight of token overlap, rule, barrier, hazard and activity.
W_TOKENS, W_RULE, W_BARRIER, W_HAZARD, W_ACTIVITY = 0.50, 0.18, 0.12, 0.08, 0.12
_VALUES = ("rule", "hazard", "activity")


def comparable(df: DataFrame) -> DataFrame:
    """id, tokens, rule, hazard, activity (lowercased) and barriers of each report."""
    return df.select("id", similarity_tokens(F.col("report_text")).alias("tokens"), "rule", "hazard",
                     F.lower("activity").alias("activity"),
                     F.coalesce("barriers", F.array().cast("array<string>")).alias("barriers"))


def _coded(df: DataFrame) -> DataFrame:
    """``comparable`` with 64-bit codes for tokens and values; a missing or empty value is 0.  Reports without a token are left out."""
    rows = comparable(df).filter(F.size("tokens") > 0)
    one = lambda c: F.when(F.col(c) != "", F.xxhash64(c)).otherwise(F.lit(0).cast("long")).alias(c)
    return rows.select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("codes"), *[one(c) for c in _VALUES],
                       F.transform(F.array_distinct(F.array_compact("barriers")), lambda b: F.xxhash64(b)).alias("barriers"))


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and items of a column of lists."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()


def _found(among: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in the sorted ``among``, and whether it does."""
    if not len(among):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return at, among[at] == values


class _Postings:
    """For each key the owners that have it."""

    def __init__(self, keys: np.ndarray, owners: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.sizes = np.unique(keys[order], return_index=True, return_counts=True)
        self.owners = owners[order]
        self.places = pd.Index(self.keys)

    def meet(self, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row and an owner for each key they share."""
        at = self.places.get_indexer(keys)
        at, rows = at[at >= 0], rows[at >= 0]
        many = self.sizes[at]
        places = np.repeat(self.starts[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(rows, many), self.owners[places]


def _odd(sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each row of codes and ``ODD`` hashes whether an odd number of codes falls on it, 64 in a number."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(row * ODD + (codes & (ODD - 1)), minlength=len(sizes) * ODD).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, ODD), axis=1).view(np.uint64)


class _Search:
    """The k best reports of each query of a block, among those given so far.

    A query is scored against all reports of its group by inverted lists; its group are the reports of its rule and activity,
    where it has both.  A report outside of it has at most the other weights, so its token overlap must make up for the rest of the
    k-th best score: it is compared with the queries that share one of their rarest ``n - ceil(j n) + 1`` tokens with it, where j is the
    least Jaccard that could still count, and whose odd counts leave that overlap possible.  Queries whose k-th
    best score is low get a larger group, at last all reports.  ``grouped`` leaves out what is outside the groups.
    """

    def __init__(self, block: dict[str, np.ndarray], k: int, least: np.ndarray, grouped: bool = False):
        self.k, self.least, self.block, self.grouped = k, least, block, grouped
        self.id, self.n, self.size = block["id"], block["n"], len(block["id"])
        self.tokens, token = np.unique(block["codes"], return_inverse=True)
        self.token_places = pd.Index(self.tokens)
        owner, held = np.repeat(np.arange(self.size), self.n), np.bincount(token)
        order = np.lexsort((token, held[token], owner))  # rarest first
        self.token, self.owner = token[order], owner
        self.starts = np.cumsum(self.n) - self.n
        self.place = np.arange(len(owner)) - self.starts[owner]
        self.barriers = np.unique(block["barriers"])
        self.marks = self._marks(block["n_barriers"], block["barriers"])
        self.odd = _odd(self.n, block["codes"])
        self.rules, self.activities = (np.unique(block[c][block[c] != 0]) for c in ("rule", "activity"))
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.given = 0
        self._index()

    def _marks(self, sizes: np.ndarray, barriers: np.ndarray) -> np.ndarray:
        """A bit for each barrier of the block that a row has, 62 in a number."""
        marks = np.zeros((max(1, -(-len(self.barriers) // 62)), len(sizes)), np.int64)
        at, there = _found(self.barriers, barriers)
        rows, at = np.repeat(np.arange(len(sizes)), sizes)[there], at[there]
        np.bitwise_or.at(marks, (at // 62, rows), np.int64(1) << (at % 62))
        return marks

    def _groups(self, rows: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind of group the number of a row's group, and whether it has one."""
        rule, ruled = _found(self.rules, rows["rule"])
        activity, active = _found(self.activities, rows["activity"])
        every = np.zeros(len(rule), np.int64)
        return [(4 * (rule * max(1, len(self.activities)) + activity) + BOTH, ruled & active), (4 * rule + BY_RULE, ruled), (4 * activity + BY_ACTIVITY, active), (every + EVERY, every == 0)]

    def _index(self) -> None:
        self.indexed = self.least.copy()
        needed = lambda others: (self.least - others) / W_TOKENS - 1e-9
        ruled, active = self.block["rule"] != 0, self.block["activity"] != 0
        # of the same rule and another activity; of another rule, or of another activity where the query has no rule
        near, apart = needed(W_RULE + W_BARRIER + W_HAZARD), needed(W_BARRIER + W_HAZARD + np.where(ruled & active, W_ACTIVITY, 0.0))
        sure = lambda least: (least >= WEAK) | self.grouped
        self.kind = np.select([ruled & active & sure(near), ruled & sure(apart), active & ~ruled & sure(apart)], [BOTH, BY_RULE, BY_ACTIVITY], EVERY)
        of_kind = self._groups(self.block)
        number = np.choose(self.kind, [g for g, _ in of_kind])
        self.groups, group = np.unique(number, return_inverse=True)
        member = np.argsort(group, kind="stable")
        self.member, self.width = member, np.bincount(group, minlength=len(self.groups))
        self.first = np.cumsum(self.width) - self.width
        self.local = np.empty(self.size, np.int64)
        self.local[member] = np.arange(self.size) - self.first[group[member]]
        inside = (self.kind != EVERY)[self.owner] if self.grouped else np.ones(len(self.owner), bool)
        self.by_group = _Postings((group[self.owner] * len(self.tokens) + self.token)[inside], self.owner[inside])
        if self.grouped:
            return
        tried = lambda least, of: (self.place < np.where(~of | (least > 1), 0, self.n - np.ceil(least * self.n - 1e-9) + 1)[self.owner])
        rare = tried(apart, self.kind != EVERY)
        self.by_rare = _Postings(self.token[rare], self.owner[rare])
        rare = tried(near, self.kind == BOTH)
        rule = _found(self.rules, self.block["rule"])[0]
        self.by_rule = _Postings((rule[self.owner] * len(self.tokens) + self.token)[rare], self.owner[rare])

    def add(self, batch: pa.RecordBatch) -> None:
        sizes, codes = _lists(batch.column("codes"))
        n_barriers, barriers = _lists(batch.column("barriers"))
        given = {c: batch.column(c).to_numpy() for c in ("id", *_VALUES)} | {"n": sizes}
        marks, ends = self._marks(n_barriers, barriers), np.cumsum(sizes)
        per = sum(self.width[self.groups % 4 == kind].max(initial=0) for kind in range(4)) + self.size // 4
        step = max(1, int(PAIRS // max(1, per)))
        for start in range(0, len(sizes), step):
            part = slice(start, start + step)
            own = {c: v[part] for c, v in given.items()} | {"marks": marks[:, part]}
            own["codes"] = codes[ends[start] - sizes[start]:ends[min(start + step, len(sizes)) - 1]]
            at = self.token_places.get_indexer(own["codes"])
            row = np.repeat(np.arange(len(own["n"])), own["n"])[at >= 0]
            self._chunk(own, row, at[at >= 0])
            self.given += 1
            # the k-th best scores rise fast at first
            if self.given & (self.given - 1) == 0 and not self.grouped and (self.least - self.indexed).mean() > 0.01:
                self._index()

    def _weights(self, own: dict, row: np.ndarray, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        same = lambda c: (own[c][row] == self.block[c][q]) & (own[c][row] != 0)
        shared = np.zeros(len(row), bool)
        for mine, theirs in zip(own["marks"], self.marks, strict=True):
            shared |= (mine[row] & theirs[q]) != 0
        for test, weight in ((same("rule"), W_RULE), (shared, W_BARRIER), (same("hazard"), W_HAZARD), (same("activity"), W_ACTIVITY)):
            score = score + np.where(test, weight, 0.0)
        return score

    def _chunk(self, own: dict, row: np.ndarray, token: np.ndarray) -> None:
        count, terms = len(own["n"]), len(self.tokens)
        for kind, (number, there) in enumerate(self._groups(own)):
            group, known = _found(self.groups, number)
            rows = np.flatnonzero(there & known) if kind != EVERY or not self.grouped else np.zeros(0, np.int64)
            width = np.zeros(count, np.int64)
            width[rows] = self.width[group[rows]]
            first = np.cumsum(width) - width
            inside = width[row] > 0
            r, q = self.by_group.meet(row[inside], group[row[inside]] * terms + token[inside])
            shared = np.bincount(first[r] + self.local[q], minlength=width.sum())
            r = np.repeat(np.arange(count), width)
            q = self.member[self.first[group[r]] + np.arange(len(r)) - first[r]]
            self._keep(own, r, q, shared)
        if self.grouped:
            return
        met = np.zeros(count * self.size, bool)
        r, q = self.by_rare.meet(row, token)
        met[r * self.size + q] = True
        rule, ruled = _found(self.rules, own["rule"])
        inside = ruled[row]
        r, q = self.by_rule.meet(row[inside], rule[row[inside]] * terms + token[inside])
        met[r * self.size + q] = True
        r, q = np.divmod(np.flatnonzero(met), self.size)
        same = {c: (own[c][r] == self.block[c][q]) & (own[c][r] != 0) for c in ("rule", "activity")}
        grouped = np.choose(self.kind[q], [same["rule"] & same["activity"], same["rule"], same["activity"], True])
        r, q = r[~grouped], q[~grouped]
        n, m = own["n"][r], self.n[q]
        others = self._weights(own, r, q, np.zeros(len(r)))
        left = np.flatnonzero(others + W_TOKENS * (np.minimum(n, m) / np.maximum(n, m)) >= self.least[q] - 1e-9)
        if len(left):
            r, q, n, m, others = (v[left] for v in (r, q, n, m, others))
            asked, at = np.unique(r, return_inverse=True)
            ends = np.cumsum(own["n"])
            odd = _odd(own["n"][asked], np.concatenate([own["codes"][ends[i] - own["n"][i]:ends[i]] for i in asked]))
            differ = np.zeros(len(r), np.int64)
            for word in range(ODD // 64):
                differ += np.bitwise_count(odd[at, word] ^ self.odd[q, word])
            most = (n + m - differ) // 2  # tokens in common
            left = others + W_TOKENS * (most / (n + m - most)) >= self.least[q] - 1e-9
            r, q = r[left], q[left]
        else:
            r, q = r[left], q[left]
        of, at = np.unique(r, return_inverse=True)
        number = np.full(count, -1)
        number[of] = np.arange(len(of))
        many = max(1, HELD // max(1, terms))
        for start in range(0, len(of), many):  # reports come in order
            held = np.zeros(min(many, len(of) - start) * terms, bool)
            low, high = np.searchsorted(row, of[start]), np.searchsorted(row, of[min(start + many, len(of)) - 1], side="right")
            mine = np.flatnonzero(number[row[low:high]] >= 0) + low
            held[(number[row[mine]] - start) * terms + token[mine]] = True
            low, high = np.searchsorted(at, [start, start + many])
            for k in range(low, high, 20_000):
                part = slice(k, min(k + 20_000, high))
                rs, qs = r[part], q[part]
                m = self.n[qs]
                pair = np.repeat(np.arange(len(qs)), m)
                places = np.repeat(self.starts[qs] - np.cumsum(m) + m, m) + np.arange(m.sum())
                hit = held[(at[part][pair] - start) * terms + self.token[places]]
                self._keep(own, rs, qs, np.bincount(pair[hit], minlength=len(qs)))

    def _keep(self, own: dict, r: np.ndarray, q: np.ndarray, shared: np.ndarray) -> None:
        score = self._weights(own, r, q, W_TOKENS * (shared / (own["n"][r] + self.n[q] - shared)))
        kept = np.flatnonzero((score >= self.least[q]) & (own["id"][r] != self.id[q]))
        if not len(kept):
            return
        q, ids, score = (np.concatenate(v) for v in zip(self.best, (q[kept], own["id"][r[kept]], score[kept]), strict=True))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last])
        self.best = tuple(v[rank < self.k] for v in (q, ids, score))


def similar_reports(queries: DataFrame, reports: DataFrame, k: int = 5, min_score: float = MIN_SCORE, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """The k best matches of each query among all other reports.

    Texts are cut into tokens once.  The queries go to the tasks in blocks of about ``block_rows`` as inverted lists, and the
    reports stream past them where they lie: no pair rows are made, and each task sends at most k rows per query to the
    final choice.  The k-th best scores among some reports, chosen by hash, come first; with them most pairs are left out by
    their bounds (``_Search``), none that could be among the k best.  Tokens are compared by 64-bit codes.  Meant for a stated set
    of queries; the repeats of every report are found by ``near_duplicates``.
    """
    spark = queries.sparkSession
    folder = f"{shared_folder(spark)}/similar-{uuid.uuid4().hex}"

    def written(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    pool, asked = written(_coded(reports), "reports"), written(_coded(queries), "queries")
    blocks = max(1, -(-asked.count() // block_rows))
    size = pool.count()
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))

    def search(shared, grouped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, least = shared.value
            found = _Search(block, k, least.copy(), grouped)
            for batch in batches:
                if batch.num_rows:
                    found.add(batch)
            q, ids, score = found.best
            yield pa.RecordBatch.from_arrays([pa.array(found.id[q]), pa.array(ids), pa.array(score)], names=["query_id", "match_id", "score"])
        return run

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    ranked = lambda found: found.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < k)
    found = None
    for b in range(blocks):
        rows = asked.filter(F.col("block") == b).select("id", "codes", *_VALUES, "barriers").toArrow()  # about block_rows rows
        block = {c: rows.column(c).to_numpy() for c in ("id", *_VALUES)}
        for sizes, items in (("n", "codes"), ("n_barriers", "barriers")):
            block[sizes], block[items] = _lists(rows.column(items))
        least = np.full(len(block["id"]), float(min_score))
        look = lambda frame, value, grouped=False: frame.mapInArrow(search(spark.sparkContext.broadcast(value), grouped), "query_id long, match_id long, score double")
        by_id = np.argsort(block["id"])
        for some, grouped in ((FIRST_ROWS, False), (GROUP_ROWS, True)):
            if size >= 4 * FIRST_ROWS and len(least):
                drawn = pool.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, size // some))) == 0).coalesce(spark.sparkContext.defaultParallelism)
                first = ranked(look(drawn, (block, least), grouped)).filter(F.col("place") == k - 1).select("query_id", "score").toArrow()
                at = by_id[np.searchsorted(block["id"][by_id], first.column("query_id").to_numpy())]
                least[at] = np.maximum(least[at], first.column("score").to_numpy())
        part = look(pool, (block, least))
        found = part if found is None else found.union(part)
    return ranked(found).select("query_id", "match_id", "place", "score")


def _token_order(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes of tokens and how many of about ``ORDER_ROWS`` rows, chosen by hash, hold them; tokens left out are the rarest.

    Any one order of the tokens finds the same pairs, so a bounded sample only decides how few are tried.
    """
    every = max(1, sets.count() // ORDER_ROWS)
    drawn = sets.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(F.explode(_codes(F.col("tokens"))).alias("code"))
    held = drawn.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "code").limit(ORDER_TOKENS).toArrow()
    code, n = (held.column(c).to_numpy() for c in ("code", "n"))
    first = np.argsort(code)
    return code[first], n[first]


def _codes(tokens: Column) -> Column:
    return F.transform(F.split(tokens, " "), lambda t: F.xxhash64(t))


def _rarest(order: tuple[np.ndarray, np.ndarray], least: float):
    """Rows of a set's rarest tokens, ``n - ceil(least n) + 1`` of them: ``key`` (token and block), place among the set's tokens, and
    for ``BITS`` hashes whether an odd number of the set's tokens falls on it.  Copies of a set in a batch are one."""
    known, often = order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([batch.column(c).to_numpy() for c in ("s1", "s2", "block")])
            batch = batch.take(pa.array(np.sort(np.unique(own, axis=1, return_index=True)[1])))
            lists = batch.column("codes")
            n = np.diff(lists.offsets.to_numpy())
            code, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), n)
            at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
            held = np.where(known[at] == code, often[at], 0) if len(known) else np.zeros(len(code), np.int64)
            odd = np.bincount(row * BITS + (code & (BITS - 1)), minlength=batch.num_rows * BITS).astype(np.uint8) & 1
            marks = np.packbits(odd.reshape(-1, BITS), axis=1).view(np.int64)
            ranked = np.lexsort((code, held, row))
            place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
            kept = place < np.repeat(n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, n)
            code, row, place = code[ranked][kept], row[kept], place[kept]
            key = code * np.int64(31) + batch.column("block").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key, *(batch.column(c).to_numpy()[row] for c in ("s1", "s2")), n[row].astype(np.int32), place.astype(np.int32), *marks[row].T)],
                                             names=["key", "s1", "s2", "n", "place", *_MARKS])

    return run


def _meeting(least: float):
    """Pairs ``(a, b)`` of the sets of one key that sizes, places and odd counts leave possible; rows come ordered by key and set, and
    ``PAIRS`` pairs are held at a time."""
    def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, (rows["key"][1:] != rows["key"][:-1]) | (rows["s1"][1:] != rows["s1"][:-1]) | (rows["s2"][1:] != rows["s2"][:-1])))
        rows = {c: v[first] for c, v in rows.items()}  # copies of a set are one
        key = rows["key"]
        after = np.searchsorted(key, key, side="right") - np.arange(len(key)) - 1 if len(key) else key  # larger sets of the key
        ends = np.cumsum(after)
        start = 0
        while start < len(key):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
            x = np.repeat(np.arange(start, stop), after[start:stop])
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after[start:stop]) - after[start:stop], after[start:stop])
            n, m = rows["n"][x].astype(np.int64), rows["n"][y].astype(np.int64)
            kept = np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9
            x, y, n, m = x[kept], y[kept], n[kept], m[kept]
            kept = np.minimum(n - rows["place"][x], m - rows["place"][y]) >= least / (1 + least) * (n + m) - 1e-6
            x, y, n, m = x[kept], y[kept], n[kept], m[kept]
            other = sum(np.bitwise_count(rows[c][x].view(np.uint64) ^ rows[c][y].view(np.uint64)).astype(np.int64) for c in _MARKS)
            kept = other <= (1 - least) / (1 + least) * (n + m) + 1e-6
            found = np.unique(np.array([rows[c][w[kept]] for w in (x, y) for c in ("s1", "s2")]), axis=1)
            if found.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["a_s1", "a_s2", "b_s1", "b_s2"])
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            last = np.searchsorted(now["key"], now["key"][-1])  # its key may go on
            if last or held and held[-1]["key"][-1] != now["key"][0]:
                done = [*held, {c: v[:last] for c, v in now.items()}]
                yield from pairs({c: np.concatenate([h[c] for h in done]) for c in now})
                held = []
            held.append({c: v[last:] for c, v in now.items()})
        if held:
            yield from pairs({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    return run


def _odd_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of each set, and for at least twice as many hashes as it has tokens whether an odd number of them falls on it."""
    for batch in batches:
        n, code = _lists(batch.column("codes"))
        marks = []
        for own in np.split(code, np.cumsum(n)[:-1]):
            bits = 1 << max(6, int(2 * len(own) - 1).bit_length())
            marks.append(np.packbits(np.bincount(own & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("s1"), batch.column("s2"), pa.array(n.astype(np.int64)), pa.array(marks, pa.binary())], names=["s1", "s2", "n", "marks"])


def _possible(least: float):
    """The pairs whose odd counts leave the similarity possible; the longer list is folded to the length of the other one."""
    def differ(x: np.ndarray, y: np.ndarray) -> int:
        x, y = sorted((x, y), key=len)
        while len(y) > len(x):
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
        return int(np.bitwise_count(x ^ y).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda c: [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)]  # noqa: E731, B023
            most = (1 - least) / (1 + least) * (batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()) + 1e-6
            yield batch.select(range(4)).filter(pa.array([differ(x, y) <= m for x, y, m in zip(read("x"), read("y"), most, strict=True)], pa.bool_()))

    return run


def _token_pairs(rows: DataFrame, least: float, folder: str | None = None) -> DataFrame:
    """``(a, b, jaccard)`` of the different token sets with a Jaccard of at least ``least`` that rows ``(id, set, tokens, block)`` of one block have.

    Tokens are ordered by rarity, and two sets that close must share one of their rarest ``n - ceil(least n) + 1``.  Of those that do,
    a pair stays if its sizes, the places of the shared token and the odd counts leave the similarity possible; sets that differ
    in d tokens differ in at most d odd counts.  What stays is compared token by token.  The rare tokens are shuffled once; the pairs they
    leave, what is told of their sets, and the result are written under ``folder``.
    """
    spark = rows.sparkSession
    folder = folder or f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"

    def written(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    halves = [F.conv(F.substring(F.hex("set"), start, 15), 16, 10).cast("long").alias(f"s{k}") for k, start in ((1, 1), (2, 16))]
    plain = rows.select(*halves, F.xxhash64("block").alias("block"), _codes(F.col("tokens")).alias("codes"))
    rare = plain.mapInArrow(_rarest(_token_order(rows), least), "key long, s1 long, s2 long, n int, place int, " + ", ".join(f"{m} long" for m in _MARKS))
    dealt = rare.repartition("key").sortWithinPartitions("key", "s1", "s2")
    half = ["a_s1", "a_s2", "b_s1", "b_s2"]
    met = written(dealt.mapInArrow(_meeting(least), "a_s1 long, a_s2 long, b_s1 long, b_s2 long").distinct(), "met")

    def asked(pairs: DataFrame, name: str) -> DataFrame:
        one = lambda x: F.struct(F.col(f"{x}_s1").alias("s1"), F.col(f"{x}_s2").alias("s2")).alias("half")
        return written(pairs.select(one("a")).union(pairs.select(one("b"))).distinct().select("half.*"), name)

    # Long sets need more odd counts than the shuffled rows hold; a pair's tokens are fetched only if these leave it, too.
    marked = written(plain.join(asked(met, "met-sets"), ["s1", "s2"], "left_semi").select("s1", "s2", "codes").mapInArrow(_odd_counts, "s1 long, s2 long, n long, marks binary").dropDuplicates(["s1", "s2"]), "marks")
    marks = lambda x, as_name: marked.select(F.col("s1").alias(f"{x}_s1"), F.col("s2").alias(f"{x}_s2"), F.col("n").alias(f"{x}_n"), F.col("marks").alias(as_name))
    left = met.join(marks("a", "x"), ["a_s1", "a_s2"]).join(marks("b", "y"), ["b_s1", "b_s2"]).select(*half, "a_n", "b_n", "x", "y")
    near = written(left.mapInArrow(_possible(least), met.schema), "near")
    told = written(rows.select("set", "tokens", *halves).join(asked(near, "near-sets"), ["s1", "s2"], "left_semi").dropDuplicates(["s1", "s2"]), "told")
    tokens = lambda x: told.select(F.col("s1").alias(f"{x}_s1"), F.col("s2").alias(f"{x}_s2"), F.col("set").alias(x), F.split("tokens", " ").alias(f"t{x}"))
    shared = F.size(F.array_intersect("ta", "tb"))
    close = near.join(tokens("a"), ["a_s1", "a_s2"]).join(tokens("b"), ["b_s1", "b_s2"])
    return written(close.select("a", "b", fence(shared / (F.size("ta") + F.size("tb") - shared)).alias("jaccard")).filter(F.col("jaccard") >= least - 1e-9), "close")


def near_duplicates(reports: DataFrame) -> DataFrame:
    """``(query_id, match_id, score)``: the best match of every report, if it is close enough to be the same report.

    All other weights together leave 0.375 of the least score to the tokens, so only token sets with a Jaccard of 0.75
    or more count.  Reports equal in everything that is scored are one profile with its two smallest ids; profiles
    are compared, not copies, so a group of copies of any size stays linear.
    """
    features = ["set", "rule", "hazard", "activity", "barriers"]
    spark = reports.sparkSession
    made = comparable(reports).filter(F.size("tokens") > 0).select("id", F.array_join(F.array_sort("tokens"), " ").alias("tokens"), *[F.coalesce(c, F.lit("")).alias(c) for c in features[1:-1]],
                                                                   F.array_join(F.array_sort(F.array_distinct("barriers")), "\n").alias("barriers"))
    # texts are cut into tokens once; without a common rule the other weights stay below the least score
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    made.filter(F.col("rule") != "").withColumn("set", F.unhex(F.sha2("tokens", 256))).write.parquet(path)
    rows = spark.read.parquet(path)
    plain = rows.select("id", *features)
    profiles = plain.groupBy(*features).agg(F.min("id").alias("first"))
    second = plain.join(profiles, features).filter("id <> first").groupBy("first").agg(F.min("id").alias("second"))
    profiles = profiles.join(second, "first", "left")
    pairs = _token_pairs(rows.select("id", "set", "tokens", F.col("rule").alias("block")), (DUPLICATE_SCORE - 0.005 - W_RULE - W_BARRIER - W_HAZARD - W_ACTIVITY) / W_TOKENS)
    ways = pairs.union(pairs.select("b", "a", "jaccard")).union(plain.select("set", "set", F.lit(1.0)).distinct())
    side = lambda x, key: profiles.select(F.col("set").alias(key), "rule", *[F.col(c).alias(f"{x}_{c}") for c in [*features[2:], "first", "second"]])
    same = lambda c: (F.col(f"p_{c}") == F.col(f"q_{c}")) & (F.col(f"p_{c}") != "")
    lists = lambda x: F.split(f"{x}_barriers", "\n")
    add = lambda test, weight: F.when(test, F.lit(weight)).otherwise(0.0)
    score = (F.lit(W_TOKENS) * F.col("jaccard") + F.lit(W_RULE) + add((F.col("p_barriers") != "") & (F.col("q_barriers") != "") & F.arrays_overlap(lists("p"), lists("q")), W_BARRIER)
             + add(same("hazard"), W_HAZARD) + add(same("activity"), W_ACTIVITY))
    scored = ways.join(side("p", "a"), "a").join(side("q", "b"), ["b", "rule"]).withColumn("score", score).filter(F.round(F.least("score", F.lit(0.99)) + 1e-9, 2) >= DUPLICATE_SCORE)
    option = lambda i: F.struct((-F.col("score")).alias("worse"), i.alias("id"))
    itself = F.col("p_first") == F.col("q_first")
    best = scored.groupBy(F.col("p_first").alias("first")).agg(
        F.min(F.when(~itself, option(F.col("q_first")))).alias("other"), F.min(F.when(itself & F.col("p_second").isNotNull(), option(F.col("p_second")))).alias("by_first"),
        F.min(F.when(itself, option(F.col("p_first")))).alias("by_copy"))
    chosen = F.least("other", F.when(F.col("id") == F.col("first"), F.col("by_first")).otherwise(F.col("by_copy")))
    told = plain.join(profiles.select(*features, "first"), features).select("id", "first").join(best, "first").withColumn("m", chosen).filter("m is not null")
    return told.select(F.col("id").alias("query_id"), F.col("m.id").alias("match_id"), (-F.col("m.worse")).alias("score"))


def with_shared_concepts(matches: DataFrame, reports: DataFrame) -> DataFrame:
    """Shown similarity and the concepts both sides carry."""
    side = lambda p: reports.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "rule", "hazard", "activity", "barriers")])
    both = matches.join(side("q"), F.col("query_id") == F.col("q_id")).join(side("m"), F.col("match_id") == F.col("m_id"))
    same = lambda c: F.when(F.lower(f"q_{c}") == F.lower(f"m_{c}"), F.col(f"m_{c}"))
    return both.select("query_id", "match_id", "place", F.round(F.least(F.col("score"), F.lit(0.99)) + 1e-9, 2).alias("similarity"),
                       same("rule").alias("common_rule"), same("hazard").alias("common_hazard"), same("activity").alias("common_activity"),
                       F.array_sort(F.array_intersect("q_barriers", "m_barriers")).alias("common_barriers"))
