import os
import random
import time
from collections import Counter

import duckdb
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazardlake.llm import exact_dedup, near_text, simhash
from hazardlake.llm.components import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    counts = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        counts.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(prints):
    """doc -> smallest doc over links of two bits, by union and find over all pairs."""
    top = {d: d for d in prints}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: find(d) for d in ids}


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
def test_masks_cover_the_radius(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    assert any(a & m == b & m for m in simhash.masks())


@given(st.text(alphabet="aB cÉ\t\n1-", max_size=60))
@settings(max_examples=200)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_blocks_of_shingles(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_links_find_every_chain(spark):
    random.seed(3)
    prints = {random.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:6]:  # chains and dense balls
        for _ in range(25):
            base ^= 1 << random.randrange(64)
            if random.random() < 0.5:
                base ^= 1 << random.randrange(64)
            prints.add(base)
    prints |= {0, 1, 3, 7, 2**63, 2**64 - 1}
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = components(simhash.links(frame)).collect()
    want = plain_components({signed(p): p for p in prints})
    assert {r["node"]: r["root"] for r in found} == {k: v for k, v in want.items() if list(want.values()).count(v) > 1}


def test_near_duplicates_against_brute_force(documents):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents).collect()}
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in documents.collect()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == plain_components(prints)


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] == 2} == {1}
    kept = simhash.keep_representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 3, 5, 7, 8]
    assert simhash.near_duplicates(no_docs).count() == simhash.keep_representatives(no_docs).count() == 0


def test_representatives_of_rows_with_one_id(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(30))
    rows = [(1, text("a"), "x"), (1, text("b"), "y"), (2, text("c"), "z"), (2, text("a"), "v"), (3, text("b") + " ", "u"), (4, text("d"), "s"), (4, text("d"), "s"), (4, text("d") + "\n", "t"), (None, text("a"), "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = sorted((r["doc_id"], r["node"]) for r in simhash.keep_representatives(docs).collect() if r["doc_id"])
    assert kept == [(1, "x"), (1, "y"), (2, "z"), (4, "s")]
    assert simhash.keep_representatives(docs).filter("doc_id is null").count() == 1


def plain_jaccard_groups(texts):
    """doc -> smallest doc over links of 5-word Jaccard 0.8, over all pairs; and the linked pairs."""
    sets = {d: {tuple(t.lower().split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t in texts.items()}
    low, pairs = {d: d for d in sets}, []
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                pairs.append((a, b))
    for _ in pairs:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
        if all(low[a] == low[b] for a, b in pairs):
            break
    return low, pairs


def test_representatives_at_the_stated_similarity(spark):
    import corpus_pipeline
    random.seed(8)
    texts, base = {}, None
    for d in range(240):
        if d % 6 == 0:
            base = [f"w{random.randrange(5000)}" for _ in range(random.choice((40, 300, 1000)))]
        words = list(base)
        for _ in range(d % 6 * len(base) // 150):
            words[random.randrange(len(words))] = f"x{random.randrange(5000)}"
        texts[d] = " ".join(words)
    low, pairs = plain_jaccard_groups(texts)
    docs = spark.createDataFrame([(d, t, "kept") for d, t in texts.items()], "doc_id long, text string, source string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert len(pairs) > 100 and len(set(low.values())) < 200
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(low.values()))


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50), (52, 51)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in [e for e in edges if None not in e and e[0] != e[1]] * 60:
        low = min(want.get(a, a), want.get(b, b))
        want[a] = want[b] = low
    assert got == want


def exact_by_hand(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((d, t or ""))
    return {key: (min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0], len(g)) for key, g in groups.items()}


def test_exact_odd_rows(spark, odd_docs, no_docs, tmp_path):
    path = f"{tmp_path}/docs.parquet"
    odd_docs.write.parquet(path)
    rows = exact_dedup.exact_duplicates(spark, path).collect()
    want = exact_by_hand([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert len(rows) == odd_docs.count() and sum(r["kept"] for r in rows) == len(want)
    assert {(r["keep_id"], r["group_size"]) for r in rows} == set(want.values())
    no_docs.write.parquet(f"{tmp_path}/none.parquet")
    assert exact_dedup.exact_duplicates(spark, f"{tmp_path}/none.parquet").count() == 0


def test_full_texts_decide_when_digests_collide(spark, documents, tmp_path):
    path = f"{tmp_path}/docs.parquet"
    documents.limit(120).write.parquet(path)
    weak = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1))  # noqa: E731  sixteen digests for all
    got = exact_dedup.exact_duplicates(spark, path, digest=weak).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    sure = exact_dedup.exact_duplicates(spark, path).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sure.collect()))


def test_state_goes_on_with_new_files(spark, documents, tmp_path):
    path, folder = f"{tmp_path}/docs.parquet", f"file://{tmp_path}/state"
    documents.limit(100).coalesce(1).write.parquet(path)
    assert exact_dedup.streamed_groups(spark, path, folder=folder).agg(F.sum("group_size")).first()[0] == 100
    documents.limit(100).coalesce(1).write.mode("append").parquet(path)
    again = exact_dedup.streamed_groups(spark, path, folder=folder)
    assert again.agg(F.sum("group_size"), F.min("group_size")).first()[0] == 200
    assert again.filter("group_size < 2").isEmpty()


def test_old_files_are_read_on_resume(spark, tmp_path):
    path, folder = f"{tmp_path}/docs.parquet", f"file://{tmp_path}/state"
    def add(rows, age=0):
        before = set(os.listdir(path)) if os.path.isdir(path) else set()
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        for name in set(os.listdir(path)) - before:
            os.utime(f"{path}/{name}", (time.time() - age, time.time() - age))
    add([(1, "one text"), (2, "two texts")])
    exact_dedup.streamed_groups(spark, path, folder=folder).count()
    add([(3, "two  texts"), (4, "three texts")], age=40 * 86400)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(spark, path, folder=folder).collect()}
    assert got == {1: (1, 1), 2: (3, 2), 3: (3, 2), 4: (4, 1)}


def test_registered_sql(spark, folder):
    from hazardlake.llm.queries import QUERIES, SQL
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in SQL.items():
        relation = con.sql(sql)
        columns = sorted(relation.columns)
        at = [relation.columns.index(c) for c in columns]
        got = QUERIES[name](spark, folder)
        assert sorted(got.columns) == columns
        shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
        assert sorted([shown(r[c]) for c in columns] for r in got.collect()) == sorted([shown(r[i]) for i in at] for r in relation.fetchall()), name


def test_near_duplicate_stage_searches_by_covering_masks(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(600)]
    docs = [(n, " ".join([*base[:599 - n], *(f"x{n}y{i}" for i in range(n)), base[599]])) for n in range(6)]
    found = {r["doc_id"]: r for r in near_text.sketches(spark.createDataFrame(docs, "doc_id long, text string"), 5, simhash.masks()).collect()}
    for n, text in docs:
        hashes = {xxhash.xxh64_intdigest(" ".join(text.split()[i:i + 5]).encode(), 42) for i in range(596)}
        assert found[n]["fp"] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    close = [(a, b) for a in found for b in found if a < b and ((found[a]["fp"] ^ found[b]["fp"]) % 2**64).bit_count() <= simhash.RADIUS]
    assert close
    for a, b in close:
        assert any(x == y for x, y in zip(found[a]["keys"][near_text.BANDS:], found[b]["keys"][near_text.BANDS:], strict=True))


def test_pairs_of_the_masks_alone_are_tied(spark):
    # bands would need four equal least hashes: a similarity of 0.3 seldom has them, two bits are then the only tie
    bands = lambda text: near_text.band_keys(near_text.shingles(text.encode(), 5))
    other = next(t for t in (f"a b c d e {w}" for w in "ghijklmnop") if not (bands(t) == bands("a b c d e f")).any())
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, other), (3, "q r s t u v")], "doc_id long, text string")
    prints = {r["doc_id"]: r["fp"] for r in near_text.sketches(docs, 5).collect()}
    radius = ((prints[1] ^ prints[2]) % 2**64).bit_count()
    tied = {r["low"]: r["root"] for r in near_text.near_groups(docs, 5, 0.3, [0], radius).collect()}
    assert tied[1] == tied[2] != tied[3]
    apart = {r["low"]: r["root"] for r in near_text.near_groups(docs, 5, 0.3, [0], radius - 1).collect()}
    assert len(set(apart.values())) == 3


def test_text_that_meets_the_empty_one_under_a_mask(spark):
    # two shingles seldom have a bit in common: under some mask the print of such a text is zero, as that of the empty text
    rng = random.Random(1)
    texts = (" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(6)) for _ in range(100_000))
    text = next(t for t in texts if any(int(near_text.set_print(near_text.shingles(t.encode(), 5))) & m == 0 for m in simhash.masks()))
    docs = spark.createDataFrame([(1, ""), (2, text), (3, " "), (4, text.upper()), (5, "another " + text), (6, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_representatives(docs).collect()) == [1, 2, 5]
