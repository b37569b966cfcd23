import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000
TEXTS = [
    "A plain sentence of more than ten words that says nothing at all, really.",
    "A plain sentence of more than ten words that says nothing at all, really.",
    "", "   \n\t ", "word", LONG, "1234 5678 !!! ???", "é😀　ñ " * 40,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like work columns."""
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(TEXTS)]
    rows += [(0, TEXTS[0], "en", "s", len(TEXTS[0])), (None, TEXTS[0], None, None, None), (None, None, None, None, None), (90, None, "de", None, 0), (91, "Ein Satz mit Wörtern.", None, "s", 21)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ("row", "fp", "kind", "score", "word", "c", "start", "end", "cell", "key", "hash", "c0", "c1", "gone", "first", "rows", "found", "ids", "at", "__text", "base", "least")
    return df.select("*", *(F.lit("x").alias(n) for n in clash))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
