import pytest


LONG = "alpha beta gamma delta epsilon " * 4000
SHARED = "this very line is shared by at least three documents"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns whose names the operators use themselves."""
    rows = [(1, "Hello World, once upon a time there was a fox\n" + SHARED), (2, "Hello World, once upon a time there was a fox\n" + SHARED), (3, None), (4, ""), (None, "text without an id\n" + SHARED),
            (5, LONG), (5, LONG), (6, "  \t\n "), (7, "mail a.b@c.example.com now"), (None, None), (8, "line\n\n" + SHARED.upper() + "  ")]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, fp long, fingerprint string, component_id long, keys string, key string, row long, digest string, "
              "dropped string, _dropped string, place string, text_bytes string, kept_id long, part long, rest long, words string, plain string, `odd.name` string")
    extra = [None] * 20
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
