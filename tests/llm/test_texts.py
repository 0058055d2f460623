import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hazardlake.llm import decontaminate, licenses, line_dedup, packing, pii, token_scan, tokens, toxicity, url_filter


# --- line deduplication

def lines_by_hand(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held.setdefault(k, []).append(d)
    owner = {k: max((d for d in ds if d is not None), default=None) for k, ds in held.items() if len(ds) >= 3}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in owner and owner[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(odd_docs, no_docs, documents):
    for docs in (odd_docs, documents):
        assert sorted(map(tuple, line_dedup.line_report(docs).collect()), key=str) == lines_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    cut = line_dedup.drop_repeated_lines(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    assert [r["text"] for r in cut.collect() if r["doc_id"] in (3, 4)] == [r["text"] for r in odd_docs.collect() if r["doc_id"] in (3, 4)]
    assert line_dedup.line_report(no_docs).count() == line_dedup.drop_repeated_lines(no_docs).count() == 0


def test_lines_are_reversible(spark, documents):
    first, second = documents.filter("doc_id % 3 <> 0"), documents.filter("doc_id % 3 = 0")
    start = line_dedup.new_state(first, keys_per_shard=8)
    grown = line_dedup.add_documents(start, second)
    back = line_dedup.delete_documents(grown, second)
    rows = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    counts = lambda s: rows(s.counts.select("key", "refs", "owner"))
    whole = line_dedup.new_state(documents)
    assert counts(back) == counts(start) and counts(grown) == counts(whole)
    dropped = lambda s: sorted((d, tuple(sorted(map(bytes, k)))) for d, k in map(tuple, line_dedup.repeated_lines(s, s.holders).collect()))
    assert dropped(grown) == dropped(whole) and dropped(back) == dropped(start)


def test_cuckoo_filter():
    random = np.random.default_rng(1)
    keys = random.integers(0, 2**63, (4000, 2)).astype(np.uint64)
    held = line_dedup.CuckooFilter(4000)
    assert held.add(keys) and held.has(keys).all()
    others = random.integers(0, 2**63, (20000, 2)).astype(np.uint64)
    assert held.has(others).mean() < 0.001
    held.remove(keys[:2000])
    assert held.has(keys[2000:]).all() and held.has(keys[:2000]).mean() < 0.01
    assert (line_dedup.CuckooFilter(data=held.table.tobytes()).table == held.table).all()
    assert not line_dedup.CuckooFilter(4).add(keys[:100])


# --- benchmark leaks

def leaks_by_hand(text, items, window=10):
    words = lambda t: re.findall("[^\x00-/:-`{-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, names = words(text), set(), set()
    for name, item in items:
        other = words(item)
        n = min(window, len(other))
        for i in range(len(other) - n + 1) if n else ():
            for j in range(len(own) - n + 1):
                if own[j:j + n] == other[i:i + n]:
                    hit |= set(range(j, j + n))
                    names.add(str(name))
    return len(own), len(hit), sorted(names)


@given(st.lists(st.lists(st.sampled_from("a b c É d".split()), max_size=30).map(" ".join), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("a b c É".split()), max_size=8).map(" ".join), max_size=4))
@settings(max_examples=150, deadline=None)
def test_leaks_against_brute_force(texts, items):
    named = list(enumerate(items))
    found = decontaminate.scan([t.encode() for t in texts], decontaminate.encode_tests([(n, t.encode()) for n, t in named], 3))
    for text, f in zip(texts, found, strict=True):
        assert (f.n_words, int(f.hit.sum()), sorted(f.items)) == leaks_by_hand(text, named, 3)


def test_longest_match():
    tests = decontaminate.encode_tests([(7, b"one two three four five six seven")], 3)
    (f,) = decontaminate.scan([b"x two three four five y one two three"], tests)
    assert (f.longest, f.longest_item, f.longest_at) == (4, "7", 1)


def test_leaks_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "once upon a time there was a fox"), (2, None), (None, "Without an ID"), (3, "..."), (4, "alpha beta gamma delta epsilon alpha beta gamma delta epsilon alpha")], "item_id long, text string")
    rows = decontaminate.contamination(odd_docs, items).collect()
    small = decontaminate.contamination(odd_docs, items, block_bytes=20).collect()  # several blocks
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"])
    assert sorted(map(key, rows)) == sorted(map(key, small)) and len(rows) == odd_docs.count()
    assert {r["doc_id"] for r in rows if r["contaminated"]} == {1, 2, 5, None}
    copies = spark.createDataFrame([(i, "once upon a time there was a fox") for i in range(40)], items.schema)
    sizes = [len(t.names) for t in decontaminate._blocks(copies, 10, decontaminate._block_count(copies, 200))]
    assert max(sizes) < max(2, sum(sizes) / 2)  # copies of a text lie in several blocks
    kept = decontaminate.decontaminate(odd_docs, items, block_bytes=20)
    assert kept.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "6", "7", "8", "None"]
    assert decontaminate.contamination(no_docs, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(odd_docs, items.limit(0)).collect())


# --- licenses, urls

def test_licenses_odd_rows(spark, odd_docs, no_docs):
    assert licenses.license_notices(odd_docs).count() == odd_docs.count() and licenses.license_notices(no_docs).count() == 0
    filler = " ".join(f"w{i}" for i in range(300))
    wrapped = licenses.TEMPLATES[2][1].replace(" ", "\n")
    docs = spark.createDataFrame([(1, f"{filler} {wrapped} {filler}"), (2, "CC-BY-NC cc by nc"), (3, "under the MIT license, Under The mit LICENSE"), (4, filler), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_notices(docs).collect()}
    assert got[1]["labels"] == "bsd" and got[1]["base_labels"] == "" and got[1]["score"] == 1.0
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["labels"]) == (2, 0, 3, "cc-by-nc")
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (2, 0, 4)
    assert (got[4]["labels"], got[4]["score"], got[5]["n_words"]) == ("", 0.0, 0)
    named = licenses.with_license(docs.withColumnRenamed("doc_id", "license").withColumn("other", licenses.F.lit(1)))
    assert named.columns == ["license", "text", "other", "license_"]


def test_kelvin_sign_is_no_k(spark):
    docs = spark.createDataFrame([(1, "under the MIT license K İ"), (2, "cc by nK")], "doc_id long, text string")
    assert [r["n_words"] for r in licenses.license_notices(docs).orderBy("doc_id").collect()] == [6, 3]


def test_urls(spark):
    page = lambda i, url, html=None: (i, url, html, "x", "y")
    to = '<head><link href="{}" rel=canonical></head>'.format
    pages = spark.createDataFrame([
        page(1, "http://a.example.org/es/x"), page(2, "http://free.net/a", to("https://A.example.org/es/x?q=1")), page(3, "https://free.net/b", to("//free.net/a")),
        page(4, "http://good.org/x", to("http://free.net/a")), page(5, "http://lone.net/a", '<META HTTP-EQUIV="Refresh" CONTENT="0; URL=http://shop.com/de/1">'), page(6, "http://shop.com/fr/1"),
        page(7, None, to("http://shop.com/de/1")), page(8, "no url"), page(9, "http://example.org/en/12"), page(9, "http://example.org/en/12"), page(10, "HTTP://X.ORG"), page(None, "http://x.org/"),
        page(11, "http://rel.net/a", to("/b")), page(12, "http://rel.net/b", to("http://shop.com/de/9"))], "page_id long, url string, html string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert [got[i][3] for i in (2, 3, 4)] == ["allow"] * 3  # good.org is allowed by rule, and so are its aliases without a rule
    assert got[5][2:] == (None, "block") and got[6][2:] == ("com/fr/", "allow") and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9][2:] == ("example.org/en/1", "block") and got[10] == ("x.org", "", None, "allow") and got[None][2] == "org/"
    assert got[11][3] == got[12][3] == "block"
    assert url_filter.url_verdicts(pages).count() == 14 and url_filter.url_verdicts(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.url_verdicts(pages.drop("html")).filter("page_id in (2, 5)").collect()} == {"allow"}


@pytest.mark.parametrize("pad", [" ", ".", "("])
def test_phone_with_long_padding(pad):
    text = "call +1" + pad * 1200 + "23456789 now"
    assert [x for x in pii.base_spans(text) if x[0] == 3] == [(3, 5, text.index(" now"))]


def test_relative_link_targets(spark):
    from urllib.parse import urljoin
    bases = ["https://a.net/x/y/z.html?q=1", "http://B.net", "http://b.net/", "https://a.net/x/y/"]
    targets = ["page.html", "../de/1", "../../../up", "./", "..", "a/./b/../c", "?p=2", "#top", "/root", "//c.net/d", "http://d.net/e", "x?u=/../v"]
    place = lambda u: (u.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower(), "/" + u.split("://")[1].split("?")[0].split("#")[0].partition("/")[2])
    rows = [(b, f"<link rel='alternate canonical' href='{t}'>" if n % 2 else f"<meta http-equiv=refresh content=\"0; url={t}\">") for b in bases for n, t in enumerate(targets)]
    got = [(r["from_url"], place(r["to_url"])) for r in url_filter.link_edges(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert sorted(got) == sorted((b, place(urljoin(b, t))) for b in bases for t in targets)
    assert url_filter.link_edges(spark.createDataFrame([("http://a.net/", "<link rel='canonical' href='mailto:x'><link rel='alternate' href='canonical'>")], "url string, html string")).isEmpty()
    pages = spark.createDataFrame([(1, "http://x.example.net/a/b", "<link rel='canonical' href='../c'>"), (2, "http://x.example.net/c", "<link rel='prev canonical' href='http://x.com/de/1'>"), (3, "http://x.example.net/d", "")],
                                  "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages).collect()} == {1: "block", 2: "block", 3: "allow"}


# --- toxicity

def test_toxicity_learns(spark, odd_docs, no_docs):
    random = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(random.choice(["th", "er", "an", "in", "ou", "st"], 3)) for _ in range(n))
    rows = []
    for i in range(1200):
        text, toxic = prose(60), i % 4 == 0
        if toxic:
            words = text.split()
            for at in random.integers(0, 60, 4):
                words[at] = str(random.choice(["wretched", "vermin", "cretinous"]))
            text = " ".join(words)
        rows.append((i, text, int(toxic)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], 9) for r in rows], "doc_id long, toxic int, lang int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert {d for d, r in got.items() if r["held_out"]} == {d for d in got if zlib.crc32(str(d).encode()) % 4 == 2}
    test = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(p == y for p, y in test) / len(test) > 0.95
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()} == {d: r["score"] for d, r in got.items()}
    kept = toxicity.drop_toxic(docs, labels)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if not r["predicted"]}
    assert toxicity.toxicity(odd_docs, labels).count() == odd_docs.count() and toxicity.toxicity(no_docs, labels).count() == 0
    assert toxicity.drop_toxic(odd_docs, labels).columns == odd_docs.columns
    assert {r["score"] for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()} == {0.0}
    few = labels.filter("doc_id < 9").union(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema))
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(docs.limit(20), few).collect())


def test_toxicity_fits_on_whole_texts(spark, monkeypatch):
    """Telling words stand behind 20 000 bytes of prose; the byte bound passes over the texts that no longer fit, whole."""
    random = np.random.default_rng(6)
    prose = lambda n: " ".join("".join(random.choice(["th", "er", "an", "in", "ou", "st"], 3)) for _ in range(n))
    rows = [(i, prose(3000) + (" wretched vermin cretinous" if i % 2 else " gentle meadow sunshine"), i % 2) for i in range(120)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    test = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert len(rows[0][1]) > 20_000 and sum(p == y for p, y in test) / len(test) > 0.9
    model = toxicity.train(docs, labels)
    score = model.scorer()
    assert all(score(t.lower().encode()) == got[i]["score"] for i, t, _ in rows[:10])
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary, rate: seen.append((toxic, ordinary)))
    toxicity.train(docs, labels, max_bytes=100_000)
    texts = {t.encode() for _, t, _ in rows}
    assert 0 < sum(map(len, seen[0][0] + seen[0][1])) <= 100_000 and set(seen[0][0] + seen[0][1]) <= texts


def test_toxicity_gains_by_plain_compression():
    """Window by window: what the ordinary dictionary alone needs, less what both need together, compressed afresh."""
    import zstandard as zs
    model = toxicity.fit([b"plain talk wretched vermin"] * 20, [b"plain talk gentle meadow"] * 20, 0.5)
    data = b"some talk of a wretched vermin and then a gentle meadow, on and on and on " * 3

    def size(content, part):
        settings = zs.ZstdCompressionParameters(window_log=18, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=8, strategy=zs.STRATEGY_LAZY2,
                                                write_content_size=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
        return len(zs.ZstdCompressor(compression_params=settings, dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)).compress(part))

    parts = [data[i:i + 64] for i in range(0, len(data) - 16, 48)]
    assert b"".join(p[:48] for p in parts) + parts[-1][48:] == data
    expected = [size(model.ordinary, p) - size(model.toxic + model.ordinary, p) for p in parts]
    assert toxicity._gains(model.toxic, model.ordinary)(data).tolist() == expected


# --- personal data

def base_by_hand(text):
    text = text or ""
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


@given(st.text(alphabet="a1@.-+ (0é2", max_size=40))
@settings(max_examples=500)
def test_base_spans(text):
    assert pii.base_spans(text) == base_by_hand(text)


@pytest.mark.parametrize("text", ["4111 1111-1111 1111 x 4111111111111112", "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.256 01.002.3.4", "a@b@c.d.e x@y.z@q.r.s", "+1 (476) 555-6291, +12345678 +1 234 567 890 123 456", "0" * 5000 + ".1.1.1", "a" * 20000 + "@" + "b" * 20000 + ".c"])
def test_base_spans_of(text):
    assert pii.base_spans(text) == base_by_hand(text) if len(text) < 5000 else pii.base_spans(text) is not None


def test_contexts_find_unseen_identifiers(spark, odd_docs, no_docs):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(12)]
    docs = spark.createDataFrame([(i, f"some words {i} then api token = \"{h}\" and more") for i, h in enumerate(hexes)]
                                 + [(50, 'here the api token = "zq81-unusual-form-77-of-key" stands'), (51, "plain v1.2345678-release text"), (51, "plain v1.2345678-release text"), (52, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    assert got[50] == "secret:22:49" and got[51] == got[52] == "" and got[0].startswith("secret:")
    rows = pii.personal_data(odd_docs).collect()
    assert len(rows) == odd_docs.count() and pii.personal_data(no_docs).count() == 0
    assert [r["spans"] for r in rows if r["doc_id"] == 7] == ["email:5:22"]


def test_base_of_documents(documents):
    for r in pii.personal_data(documents).join(documents, "doc_id").collect():
        base = base_by_hand(r["text"])
        named = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(b[0] == n for b in base) for n in range(4)]
        assert set(named) <= set(r["spans"].split(",")) | {""} or not named


# --- tokens and packing

@pytest.fixture(scope="module")
def by_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: one.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(by_tokenizer, documents):
    files = tokens.vocabulary()
    for text in ["", " ", "a\n\n b  c", "naïve Ⅷ ½ ²³ 中文 🙂🙂", "x<|endoftext|>y", "'S 'll can't", "  　 x"] + [r["text"] for r in documents.limit(50).collect()]:
        assert tokens.token_ids(text, files).tolist() == by_tokenizer(text)


def check_pieces(rows, texts, ids_of, window):
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        short += at < window
    assert short <= 1
    for d, text in texts:
        ids = np.array([*ids_of(text), 1], "<u4")
        mine, at = sorted(pieces[d], key=lambda r: r["start"]), 0
        for r in mine:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing(documents, by_tokenizer):
    check_pieces(packing.packed(documents).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()], by_tokenizer, 2048)


def test_packing_odd_rows(odd_docs, no_docs, by_tokenizer):
    rows = packing.packed(odd_docs).collect()
    assert sum(r["length"] for r in rows) == sum(len(by_tokenizer(r["text"])) + 1 for r in odd_docs.collect())
    assert packing.packed(no_docs).count() == 0


@given(st.lists(st.integers(0, 9), min_size=64, max_size=64))
@settings(max_examples=60, deadline=None)
def test_combinations_never_take_too_many(counts):
    histogram = np.array([0, *counts[1:]])
    combos = packing.combinations(histogram)
    taken = packing.repeat_counts(histogram, combos)
    used = np.zeros(64, int)
    for combo, n in zip(combos, taken, strict=True):
        assert combo.sum() == 64 and n >= 0
        for length in combo:
            used[length] += n * (length > 0)
    assert (used[1:] <= histogram[1:]).all()


def test_token_scan_stitches_blocks(spark, tmp_path):
    folder = f"file://{tmp_path}/flat"
    (tmp_path / "flat").mkdir()
    random = np.random.default_rng(2)
    want = []
    for name in ("a.bin", "b.bin", "c.bin", "d.bin"):
        ids = random.integers(0, 6, {"a.bin": 5001, "b.bin": 64, "c.bin": 0, "d.bin": 3}[name]).astype("<u2")
        if name == "d.bin":
            ids[:] = 5
        (tmp_path / "flat" / name).write_bytes(ids.tobytes())
        start = 0
        for k, end in enumerate([*np.flatnonzero(ids == 5), None]):
            if end is not None or start < len(ids):
                want.append((name, k, start, (len(ids) if end is None else int(end)) - start, end is not None))
            start = len(ids) if end is None else int(end) + 1
    for block in (2, 64, 1 << 20):
        got = token_scan.document_lengths(token_scan.scan_blocks(spark, folder, end_id=5, block_bytes=block)).select("file", "position", "start", "n_tokens", "ended")
        assert sorted(map(tuple, got.collect())) == sorted(want), block


def test_token_counts(documents, odd_docs, no_docs, by_tokenizer):
    got = {r["doc_id"]: r["n_tokens"] for r in token_scan.token_counts(documents).collect()}
    assert got == {r["doc_id"]: len(by_tokenizer(r["text"])) for r in documents.collect()}
    assert token_scan.token_counts(odd_docs).count() == odd_docs.count() and token_scan.token_counts(no_docs).count() == 0


def test_task_functions_need_no_package(tmp_path):
    """An executor without this package can run what the tasks are made of."""
    import subprocess
    import sys

    from pyspark import cloudpickle
    tests = decontaminate.encode_tests([(1, b"one two three")], 3)
    model = toxicity.fit([b"bad words here"] * 9, [b"plain words there"] * 9, 0.5)
    plan = packing.make_plan(np.array([0] + [3] * 63))
    scan, place, spans, key = decontaminate.scan, packing.place, pii.base_spans, line_dedup.line_key
    work = lambda: (scan([b"x one two three"], tests)[0].n_words, 0 <= model.scorer()(b"abc") <= 1, place(plan, 64, 5, 0)[0][1], spans("a@b.c"), key(b"x" * 30) is not None)
    (tmp_path / "work").write_bytes(cloudpickle.dumps(work))
    code = f"import pickle, sys; sys.modules['hazardlake'] = None; print(pickle.load(open('{tmp_path}/work', 'rb'))())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert done.stdout.strip() == "(4, True, 5, [(0, 0, 5)], True)", done.stderr[-500:]
