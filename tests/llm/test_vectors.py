import math
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hazardlake.llm import arrow_files, hard_negatives, whitening


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls everywhere, non-finite entries, repeated rows and ids, a ragged and an empty vector, extra columns with names the operators use."""
    nan, inf = float("nan"), float("inf")
    rows = [(100, [0.5, -0.25, 0.1], 1), (100, [0.5, -0.25, 0.1], 1), (100, [0.1, 0.9, -0.3], 2), (200, [0.4, 0.2, 0.2], 3), (7, [0.5, -0.2, 0.1], 9), (8, [0.5, -0.25, 0.1], 1), (9, [0.5, -0.25, 0.1], 2),
            (10, None, 1), (11, [], 1), (12, [0.1, None, 0.2], 1), (13, [nan, 0.0, 0.0], 1), (14, [inf, 0.0, 0.0], 1), (15, [0.45, -0.25, 0.1], None), (None, [0.45, -0.25, 0.1], 2),
            (None, [0.45, -0.25, 0.1], 2), (16, [0.3, 0.3], 1), (17, [0.3, -0.3, 0.2], 2), (18, [0.2, 0.1, 0.0], 1), (300, [-0.5, 0.25, -0.1], 4), (19, [0.45, -0.24, 0.1], 3), (20, [-0.5, 0.25, -0.1], 4)]
    schema = "vec_id long, embedding array<float>, label int, band int, block long, place int, score long, component int, n long, `odd.name` string"
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], schema)


def usable(rows, size):
    return [r for r in rows if r["embedding"] is not None and len(r["embedding"]) == size and all(x is not None and math.isfinite(x) for x in r["embedding"])]


# --- whitening

def symmetric(kind, n, rng):
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {"spread": rng.standard_normal(n), "falling": 10.0 ** -np.arange(n), "equal": np.ones(n), "clusters": rng.integers(0, 3, n).astype(float), "flat": np.arange(n) * 1e-13 + 5}[kind]
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["spread", "falling", "equal", "clusters", "flat"]), st.integers(1, 24), st.integers(0, 10**6))
def test_components_are_eigenvectors(kind, n, seed):
    a = symmetric(kind, n, np.random.default_rng(seed))
    values, vectors = whitening.components(a)
    norm = np.linalg.norm(a)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * norm
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() <= 1e-13
    assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-13 * norm


@pytest.mark.parametrize("a", [np.diag([-1.0, 0.0, 1.0]), np.zeros((4, 4)), np.ones((5, 5)), np.diag(np.arange(9.0)), np.zeros((0, 0))])
def test_components_of_plain_matrices(a):
    values, vectors = whitening.components(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1] if len(a) else [], atol=1e-13) and np.allclose(a @ vectors, vectors * values, atol=1e-13)


def test_polar_factor_is_the_sign_of_a_symmetric_matrix():
    a = symmetric("spread", 12, np.random.default_rng(5))
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.polar_factor(a) - vectors * np.sign(values) @ vectors.T).max() < 1e-12


def held_to_numpy(frame, rows, count=32):
    size = len(rows[0]["embedding"])
    x = np.floor(64 * np.array([r["embedding"] for r in rows], float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    got = frame.collect()
    shown = min(count, size)
    assert len(got) == n * shown and {r["n"] for r in got} == {n}
    rank = int((values > size * np.finfo(float).eps * values[0]).sum())
    by_row = {}
    for r in got:
        by_row.setdefault(r["component"], []).append(r)
    for c in range(1, shown + 1):
        own = by_row[c]
        assert abs(own[0]["explained"] - max(0, values[c - 1]) / values.sum()) <= 1e-4 * max(values[c - 1] / values.sum(), 1e-12)
        if c > rank:
            assert all(r["whitened"] is None for r in own)
            continue
        plain = (x - sums / n) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        assert np.allclose(sorted(abs(r["whitened"]) for r in own), sorted(abs(plain)), atol=1e-6)
    assert sorted(int(r["deviation"]) for r in by_row[1]) == sorted(sum(int(n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x)
    assert all(r["identity_error"] <= 1e-4 for r in got)


def test_whitening_by_hand(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    held_to_numpy(whitening.whitened(vectors), usable(vectors.collect(), 64))


def test_whitening_of_odd_rows(spark, odd_vectors):
    frame = whitening.whitened(odd_vectors)
    rows = usable(odd_vectors.collect(), 3)
    held_to_numpy(frame, rows)
    assert sorted([r["vec_id"] for r in frame.collect() if r["component"] == 1], key=str) == sorted([r["vec_id"] for r in rows], key=str)
    assert whitening.whitened(odd_vectors.limit(0)).count() == whitening.whitened(odd_vectors.filter("embedding IS NULL")).count() == 0
    same = spark.createDataFrame([(k, [0.5, 0.25]) for k in range(4)], "vec_id long, embedding array<float>")
    assert {(r["whitened"], int(r["deviation"]), r["identity_error"], r["explained"]) for r in whitening.whitened(same).collect()} == {(None, 0, None, 0.0)}


def test_deviations_beyond_a_long():
    w = whitening.Whitener(2**31, (2**40, -2**41), np.eye(2), np.ones(2), np.eye(2))
    x = np.array([[1000.0, -2000.0]])
    assert w.deviations(x) == [(2**31 * 64000 - 2**40) ** 2 + (2**31 * -128000 + 2**41) ** 2]


# --- hard negatives

def mined_by_hand(rows, k=5):
    own = [(n, r["vec_id"], r["label"], [math.floor(256 * x) for x in r["embedding"]]) for n, r in enumerate(rows) if r["label"] is not None]
    out = []
    by_id = lambda i: float("inf") if i is None else i
    for n, anchor, label, a in own:
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a, b, strict=True)), by_id(i), m, lab) for m, i, lab, b in own if m != n))
        for score, i, *_ in [s for s in scored if s[3] == label][:k]:
            fits = [s for s in scored if s[3] != label and 80 * -score <= 100 * -s[0] <= 100 * -score][:k]
            out += [(anchor, i, rank, f[1], -score, -f[0]) for rank, f in enumerate(fits, 1)]
    return sorted(tuple(None if v == float("inf") else v for v in r) for r in sorted(out))


def as_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("n_bands", [None, 1, 5])
def test_hard_negatives_by_hand(spark, odd_vectors, n_bands):
    rows = hard_negatives.relabelled(odd_vectors)
    assert as_rows(hard_negatives.hard_negatives(rows, n_bands=n_bands)) == sorted(mined_by_hand(usable(rows.collect(), 3)), key=str)
    assert hard_negatives.hard_negatives(rows.limit(0)).count() == 0


def test_hard_negatives_with_a_third_of_equal_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), ([0.1] * 12 if i % 3 == 0 else rng.normal(0.05, 0.1, 12).tolist()), int(rng.integers(0, 4))) for i in rng.permutation(700)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = hard_negatives.hard_negatives(frame, n_bands=3)
    assert as_rows(got) == sorted(mined_by_hand(frame.collect()), key=str) and got.count() > 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 40))
def test_scan_keeps_bounds(seed, n, size):
    """Every row that survives has its exact score, and bounds never cut a row whose score meets the bar."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-50, 50, (n, size))
    block = hard_negatives.Block({"n": n, "block": 0, "kind": "<i2", "columns": [c.astype("<i2").tobytes() for c in x.T], "labels": np.zeros(n, np.int64).tobytes(), "ids": np.arange(n).tobytes()})
    vector = rng.integers(-50, 50, size)
    bar = int(np.median(x @ vector))

    def keep(least, most):
        assert (least <= most).all()
        return most >= bar

    places, scores = hard_negatives.scan(block, vector, np.ones(n, bool), keep, step=3)
    assert dict(zip(places.tolist(), scores.tolist(), strict=True)) == {k: s for k, s in enumerate((x @ vector).tolist()) if s >= bar}


# --- token files

@pytest.fixture(scope="module")
def plain_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(arrow_files.vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = list("aB'stvedlm .,!0123\t\n\x00\x1c\x85\xa0\xad ́̇İßéÉΣςσaͅ가각ᄀ　ﬁक़Å�😀१Ⅷ½²_ŸĿŉ") + ["<|endoftext|>", "<|startoftext|>", "'Ll", "<|", " "]


def test_word_ids_are_the_library_ids(plain_tokenizer):
    encoder = arrow_files.WordEncoder(arrow_files.vocabulary(), "<u2")
    pick = random.Random(4)
    texts = ["".join(pick.choices(ODD, k=pick.randint(0, 14))) for _ in range(4000)] + ["".join(pick.choices([chr(c) for c in range(32, 0x250)] + ["'s", " "], k=12)) for _ in range(4000)] + ["x" * 5000, "é" * 999]
    for text in texts:
        assert np.frombuffer(encoder.ids(text.encode()), "<u2").tolist() == ids_of(plain_tokenizer, text), repr(text)
    assert encoder.ids(None) == encoder.ids(b"") == b""


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_word_ids_of_any_text(plain_tokenizer, text):
    assert np.frombuffer(arrow_files.word_encoder(arrow_files.vocabulary(), "<u2").ids(text.encode()), "<u2").tolist() == ids_of(plain_tokenizer, text)


def read_by_hand(tokenizer, rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = np.array([*ids_of(tokenizer, text), 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), 1))
        start += len(ids)
    return out


@pytest.mark.parametrize("layout", [{}, {"sequence": 16, "batch_sequences": 3}])
def test_documents_come_back(spark, odd_docs, no_docs, documents, plain_tokenizer, layout):
    for docs in (odd_docs.coalesce(1), documents.coalesce(1)):
        rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))  # stable, as the operator is
        got = sorted((tuple(r)[:5] for r in arrow_files.token_sequences(docs, **layout).collect()), key=lambda r: r[1])
        assert got == read_by_hand(plain_tokenizer, rows)
    assert arrow_files.token_sequences(no_docs, **layout).count() == 0


def test_random_access_without_copies(spark, documents, plain_tokenizer, tmp_path):
    written = arrow_files.write_sequences(documents, f"file://{tmp_path}/out", sequence=32, batch_sequences=4)
    flat = {}
    for r in sorted(written.documents(spark).collect(), key=lambda r: (r["part"], r["position"])):
        text = documents.filter(f"doc_id = {r['doc_id']}").first()["text"] if len(flat) < 3 else None
        flat.setdefault(r["file"], []).append((r["doc_id"], r["position"], r["n_tokens"], text))
    name, docs = next(iter(flat.items()))
    file = arrow_files.SequenceFile(f"file://{tmp_path}/out/sequences/{name}")
    total = sum(d[2] for d in docs)
    assert len(file) == -(-total // 32)
    ids = np.concatenate([file[k][0] for k in range(len(file))])
    masks = np.concatenate([file[k][1].to_numpy(zero_copy_only=False) for k in range(len(file))])
    assert masks.sum() == total and masks[:total].all() and not ids[total:].any()
    for _, position, n, text in docs:
        own = np.concatenate(list(file.pieces(position, n)))
        assert (own == ids[position:position + n]).all() and own[-1] == arrow_files.END_ID
        if text is not None:
            assert own.tolist() == [*ids_of(plain_tokenizer, text), 1]
    assert not file[0][0].flags.owndata  # a view of the mapped file
    assert file[0][0].ctypes.data - file[1][0].ctypes.data == -32 * 2
    assert sum(map(len, file.pieces(total - 1, 50))) == 1 and not list(file.pieces(total, 5))
    with pytest.raises(IndexError):
        file[len(file)]
    file.close()
    assert {f for f in os.listdir(f"{tmp_path}/out/sequences")} == set(flat)
