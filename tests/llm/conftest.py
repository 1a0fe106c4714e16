import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (None, "a text without an id and with some words in it", "en", "a", 46),
        (3, long, "en", "a", len(long)),
        (4, "same row\nsame row", "en", "a", 17),
        (4, "same row\nsame row", "en", "a", 17),
        (5, " \t\n\r\n  ", "en", "a", 8),
        (6, "é ü 漢字 \U0001f600 word " * 40, "de", "b", None),
        (7, "ONE two\x00three\x85four\xa0five " * 30, "fr", "b", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for extra in ("id", "node", "root", "size", "line", "lines", "name", "w", "words", "n_words", "k", "at", "x", "spans", "bucket", "part", "v", "__id", "__key", "__lines", "_id", "key", "gone", "nth", "__gone", "row"):
        df = df.withColumn(extra, df.lang)
    return df


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}
