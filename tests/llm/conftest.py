import pytest

LONG = ("wide open letters 12 " * 6000) + "x" * 50_000

ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en"),
    (2, "the quick  brown fox jumps over the lazy dog near the old river bank today.", "en"),
    (3, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en"),
    (4, None, "en"),
    (5, "", "de"),
    (6, " \t\n\r\x0b\x0c ", "de"),
    (7, "Größe und Maß für den Fluß, heute wie gestern: nicht schlecht!", "de"),
    (8, LONG, "en"),
    (9, LONG, None),
    (10, "12 34 .,;", "fr"),
    (11, "été à l'école ▁ 😀 漢字   fin", "fr"),
    (12, "The quick brown fox jumps over the lazy cat near the old river bank today.", "en"),
    (None, "a row without an id", "en"),
    (13, "a", None),
    (14, "repeated row", "en"),
    (14, "repeated row", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with names that operators use inside."""
    extra = "row long, words string, kind string, place int, n int, key string, at long, print long"
    rows = [(*r, 1, "w", "k", 2, 3, "x", 4, 5) for r in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def some(spark):
    """Generated texts of the smallest table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def read():
    return texts
