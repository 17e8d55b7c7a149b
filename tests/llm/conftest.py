import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, id string, doc string, size int, `a.b` int"


def make_docs(spark, rows):
    """Documents with extra columns whose names clash with working columns."""
    full = [(i, t, lang, src, len(t or ""), 7, "x", "y", 3, 4) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: make_docs(spark, rows)


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls everywhere, empty and very long texts, ties, repeated rows."""
    long_text = " ".join(f"word{i % 977} and" for i in range(60_000))
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (None, "one two three four", "en", "a"), (3, "one two three four", None, "b"),
        (3, "one two three four", None, "b"), (3, "another text under the same id", "en", "b"), (4, long_text, "en", "a"),
        (5, " \t\n\x0b\f\r ", "de", "b"), (6, "é ü ñ 中文 \U0001f600 <|endoftext|> a b", "fr", None), (None, None, None, None),
    ]
    return docs_of(rows)


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
