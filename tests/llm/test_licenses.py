import random
import re
from itertools import permutations

import duckdb
import pytest

from hazardlake.llm import licenses, oracles

SENTENCES = dict(licenses.TEMPLATES)


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def labels_by_hand(text, share=0.8):
    """Every block of every template, compared with sets; rivals and telling words worked out anew."""
    own = {label: words_of(s) for label, s in SENTENCES.items()}
    sets = {label: set(w) for label, w in own.items()}
    near = {a: [b for b in sets if a != b and len(sets[a] & sets[b]) >= share * min(len(sets[a]), len(sets[b])) - 1e-9] for a in sets}
    telling = {a: {w for b in near[a] for w in sets[a] - sets[b]} for a in sets}
    fits = lambda a, block: len(sets[a] & block) >= share * len(sets[a]) - 1e-9 and telling[a] <= block
    words, found = words_of(text), set()
    for a in sets:
        size = max(len(own[b]) for b in [a, *near[a]])
        step = max(1, size // 2)
        for start in range(0, len(words), step):
            block = set(words[start:start + 2 * size + step])
            if fits(a, block) and not any(fits(b, block) and len(sets[b] & block) > len(sets[a] & block) for b in near[a]):
                found.add(a)
    return found


def labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: set(filter(None, r["labels"].split(","))) - set(filter(None, r["base_labels"].split(","))) for r in licenses.license_notices(docs).collect()}


FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt".split()


def filler(n, pick):
    return " ".join(pick.choices(FILLER, k=n))


def test_each_template_is_itself_only(spark):
    pick = random.Random(1)
    names = list(SENTENCES)
    texts = [SENTENCES[n] for n in names] + [f"{filler(k, pick)} {SENTENCES[n]} {filler(40, pick)}" for n in names for k in (7, 23)]
    got = labels(spark, texts)
    for k, name in enumerate(names + [n for n in names for _ in (7, 23)]):
        assert got[k] - {"apache-2"} <= {name} and (name in got[k] or name == "apache-2"), (name, got[k])


def test_every_pair_apart_and_close(spark):
    pick = random.Random(2)
    pairs = list(permutations(SENTENCES, 2))
    apart = [f"{SENTENCES[a]} {filler(150, pick)} {SENTENCES[b]}" for a, b in pairs]
    close = [f"{SENTENCES[a]} {SENTENCES[b]}" for a, b in pairs]
    got = labels(spark, apart + close)
    for k, (a, b) in enumerate(pairs):
        base = {"apache-2"} & {a, b}
        assert got[k] | base == {a, b}, (a, b, got[k])
    for k, text in enumerate(apart + close):
        assert got[k] | {"apache-2"} == labels_by_hand(text) | {"apache-2"}


def test_inserted_words_off_the_grid(spark):
    """Passages of up to twice a template's length are found wherever they start."""
    pick = random.Random(3)
    texts = []
    for name in ("bsd", "isc", "cc-by-nc"):
        words = words_of(SENTENCES[name])
        for lead in range(0, 60, 3):
            longer = list(words)
            while len(longer) < 2 * len(words) - 2:
                longer.insert(pick.randrange(1, len(longer)), pick.choice(FILLER))
            texts.append((name, f"{filler(lead, pick)} {' '.join(longer)} {filler(30, pick)}"))
    got = labels(spark, [t for _, t in texts])
    for k, (name, text) in enumerate(texts):
        assert got[k] == {name} == labels_by_hand(text)


def test_changed_and_dropped_words(spark):
    pick = random.Random(4)
    texts = []
    for name in SENTENCES:
        for drop in (1, 2, 3, 5, 8):
            words = words_of(SENTENCES[name])
            for _ in range(min(drop, len(words) - 1)):
                words[pick.randrange(len(words))] = pick.choice(FILLER)
            texts.append(f"{filler(pick.randrange(20), pick)} {' '.join(words)} {filler(pick.randrange(20), pick)}")
    got = labels(spark, texts)
    assert all(got[k] | {"apache-2"} == labels_by_hand(t) | {"apache-2"} for k, t in enumerate(texts))


@pytest.mark.parametrize("part", ["cc", "gnu"])
def test_sql_agrees(spark, part):
    pick = random.Random(5)
    family = ["cc-by", "cc-by-sa", "cc-by-nc"] if part == "cc" else ["gpl", "lgpl", "gpl-3"]
    texts = [f"{SENTENCES[a]} {filler(n, pick)} {SENTENCES[b]}" for a in family for b in family for n in (0, 5, 60)] + [None, "", "cc by nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    columns = ["doc_id", "n_words", "n_base", "labels", "base_labels", "score"]
    want = {r[0]: r for r in con.sql(f"SELECT {', '.join(columns)} FROM ({oracles.SQL['op2_licenses']})").fetchall()}
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in licenses.license_notices(docs).collect()}
    assert got == want
