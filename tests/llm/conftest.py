import pytest

LONG = "the quick brown fox jumps over one lazy dog and " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and keys, clashing names."""
    base = "a small text of some words that is long enough to have five word shingles in it"
    rows = [
        (1, base, "en", "a", 9), (2, base, "en", "a", 9), (2, base, "en", "a", 9), (3, base + " indeed", None, None, None), (4, "", "en", "b", 0), (5, None, "fr", "b", None), (None, "a null key here", "en", "a", 1),
        (6, " \t\n ", "en", None, 3), (7, LONG, "en", "c", 1), (8, "one", "de", "c", 3), (9, "one", "de", "c", 3), (10, "é́🙂 ﬁ\x00 <|endoftext|> ▁x  y", "en", "a", 2), (7, "another text under the key of the long one", "en", "a", 1), (11, "x" * 70_000, None, "d", 1),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for c in ("row", "score", "node", "held", "ids", "decoded", "statistics", "bucket", "k", "size", "target", "taken"):
        d = d.withColumn(c, F.lit("clash"))
    return d


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
