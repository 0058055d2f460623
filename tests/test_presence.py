import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardlake.functions import spans
from hazardlake.functions.columns import any_of
from hazardlake.functions.presence import BLOCK, word_finder, words_found
from hazardlake.lexicon import DEFAULT
from hazardlake.operators.analysis import searched_words, with_matches
from hazardlake.vocab import english


def test_found_words_are_those_the_text_contains(spark):
    rng = random.Random(5)
    some = lambda longest: "".join(rng.choice("abcé ग") for _ in range(rng.randint(1, longest)))
    for n in range(200):
        words = [some(7) for _ in range(rng.randint(1, 25))]
        texts = [rng.choice([None, "", some(3), some(60)]) for _ in range(rng.randint(0, 20))]
        want = [None if t is None else "\n".join(sorted({w for w in words if w in t})) for t in texts]
        assert word_finder(words)(pa.array(["before", *texts], pa.string()).slice(1)).to_pylist() == want
    for at in range(BLOCK - 8, BLOCK + 2):  # a word that lies across two blocks, or ends in the next text
        split = ["x" * at + "harn", "ess"], ["x" * at + "harness", "é"]
        assert [word_finder(["harness"])(pa.array(t)).to_pylist() for t in split] == [["", ""], ["harness", ""]]
    with pytest.raises(ValueError):
        word_finder(["a", ""])
    rows = spark.createDataFrame([("no harness, scaffold",), ("",), (None,)], "v string").select(words_found(F.col("v"), ["harness", "no harness", "ladder"]))
    assert [r[0] for r in rows.collect()] == ["harness\nno harness", "", None]


def test_texts_are_searched_once_for_all_words(spark):
    made = with_matches(spark.range(1).select(F.lit("text").alias("report_text"), "id"))
    plan = made.select("matches")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("arrowevalpython") == 1 and "contains(low_text" not in plan and "contains(_found" in plan
    words = set(searched_words(DEFAULT))
    assert words >= {e["p"] for e in DEFAULT.indicators + DEFAULT.foreign_phrases} | set(english.EXPOSURE_TERMS) | set(english.MISSING_CONTROL_TERMS)


def test_negations_and_runs_as_by_the_plain_patterns(spark):
    rng = random.Random(9)
    parts = [*english.NEGATION_TOKENS, *english.NULLIFY_PHRASES, *spans.FAILURE_WORDS, *english.FOREIGN_NEGATION_TOKENS, " ", "s", "no", "wit", "hout ", "\n", "é", "a-b"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(6_000)]
    negation, nullify = any_of(english.NEGATION_TOKENS), any_of(english.NULLIFY_PHRASES)
    step = f"(?:(?>{nullify})|(?!{nullify}).)"
    plain = {spans.LAST_NEGATION: f"(?s)^{step}*(?={negation})(?!{nullify})", spans.FIRST_NEGATION: f"(?s)^{step}*?(?<={negation})",
             spans.FAILURE: any_of(spans.FAILURE_WORDS), spans.FOREIGN_FAILURE: "(?<![a-z0-9])" + any_of(english.FOREIGN_NEGATION_TOKENS) + "(?![a-z0-9])"}
    v = F.col("v")
    near = v.rlike(spans.NEGATION_OR_NULLIFY)
    df = spark.createDataFrame([(t,) for t in odd], "v string")
    wrong = [F.count_if(v.rlike(new) != v.rlike(old)) for new, old in plain.items()]
    wrong += [F.count_if(F.regexp_extract(v, new, 0) != F.regexp_extract(v, plain[new], 0)) for new in (spans.LAST_NEGATION, spans.FIRST_NEGATION)]
    wrong += [F.count_if(F.regexp_replace(v, spans.NULLIFY, "") != F.regexp_replace(v, nullify, "")),
              F.count_if(~near & (F.regexp_replace(v, nullify, "").rlike(negation) | v.rlike(nullify) | v.rlike(plain[spans.LAST_NEGATION]) | v.rlike(plain[spans.FIRST_NEGATION])))]
    assert set(df.select(*wrong).first()) == {0} and 0 < df.filter(near).count() < len(odd)
    edges = [0, 1, 3, spans.NEAR - 1, spans.NEAR, spans.NEAR + 1, 3 * spans.NEAR]
    runs = spark.createDataFrame([(head + "." + "w" * a + "w" * b + "." + tail, len(head) + 1 + a, a, b) for a in edges for b in edges for head in ("", "é" * 7) for tail in ("", "xé")]
                                 + [("w" * (a + b), a, a, b) for a in edges for b in edges], "v string, at int, a int, b int")
    assert runs.filter((spans.run_before(v, F.col("at"), "[^.]") != F.col("a")) | (spans.run_after(v, F.col("at"), "[^.]") != F.col("b"))).count() == 0
