"""Every operator over odd rows, an empty table, and with clashing columns: a row for each row, nothing crashes."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, decontamination, language, pii, quality, secret_scan, simhash, suffix_tree_lm, toxicity, url_filter

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def toxic(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (91, 1, 0)], LABELS)
    return toxicity.score(docs, toxicity.train_on_fold(docs, labels))


def scored(spark, docs):
    return suffix_tree_lm.score(docs, *suffix_tree_lm.train(docs))


def benchmark(spark):
    return spark.createDataFrame([(1, "nothing at all, really"), (2, None), (None, "word word"), (3, ""), (4, "zzz " * 20)], ITEMS)


OPERATORS = {
    "toxicity": toxic,
    "secrets": lambda s, d: secret_scan.scan(d),
    "bpe": lambda s, d: bpe.digests(d, bpe.default_path()),
    "pii": lambda s, d: pii.scan(d),
    "decontamination": lambda s, d: decontamination.contamination(d, benchmark(s)),
    "lm": scored,
    "simhash": lambda s, d: simhash.components(d),
    "quality": lambda s, d: quality.judge(d),
    "language": lambda s, d: language.predict(d, language.train(d)),
}


def plain(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", OPERATORS)
def test_rows(spark, odd, name):
    rows = OPERATORS[name](spark, odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())
    twice = [r for r in rows if r.doc_id == 0]
    assert len(twice) == 2
    for a, b in zip(*twice, strict=True):  # sums of floats may differ in the last digit
        assert a == (pytest.approx(b) if isinstance(a, float) else b)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, none, name):
    assert OPERATORS[name](spark, none).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, odd, name):
    bare = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert plain(OPERATORS[name](spark, odd).collect()) == plain(OPERATORS[name](spark, bare).collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_bytes_that_are_not_utf8(spark, name):
    """They count as they are, or as U+FFFD: either way each row gives a row."""
    docs = spark.createDataFrame([(1, bytearray(b"fine text \xff\xfe here and there, more of it \xc3")), (2, bytearray(b"plain"))], "doc_id long, text binary")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit("en").alias("lang"))
    assert sorted(r.doc_id for r in OPERATORS[name](spark, docs).collect()) == [1, 2]


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (None, "http://a.com/", None), (1, None, "x"), (2, "", "")], "page_id long, url string, html string")
    odd_pages = pages.select("*", *(F.lit("x").alias(n) for n in ("host", "path", "rule", "verdict")))
    rows = url_filter.judge(odd_pages).collect()
    assert len(rows) == 4 and all(r.verdict == "allow" for r in rows)
    assert url_filter.judge(pages.limit(0)).collect() == []


KEEPERS = {
    "toxicity": lambda s, d: toxicity.reject(d, s.createDataFrame([(0, 1, 0), (4, 0, 0)], LABELS)),
    "near_copies": lambda s, d: simhash.deduplicate(d),
    "decontamination": lambda s, d: decontamination.decontaminate(d, benchmark(s)),
    "secrets": lambda s, d: secret_scan.redact(d),
}


@pytest.mark.parametrize("name", KEEPERS)
def test_filters_keep_columns_and_types(spark, odd, none, name):
    kept = KEEPERS[name](spark, odd)
    assert kept.dtypes == odd.dtypes
    before, after = plain(odd.collect()), plain(kept.collect())
    assert set(after) <= set(before)
    assert KEEPERS[name](spark, none).collect() == []


def test_what_the_filters_do(spark, odd):
    assert KEEPERS["toxicity"](spark, odd).count() == odd.count()  # no toxic label, no toxic document
    assert KEEPERS["secrets"](spark, odd).count() == odd.count()
    near = KEEPERS["near_copies"](spark, odd).collect()
    ids = [r.doc_id for r in near]
    assert ids.count(0) == 1 and 1 not in ids  # the repeated row once, its copy not at all
    assert ids.count(2) == 1 and 3 not in ids and 90 not in ids  # texts without words are copies of each other
    assert ids.count(None) == 0  # rows without an id are copies like any other
    clean = [r.doc_id for r in KEEPERS["decontamination"](spark, odd).collect()]
    assert 0 not in clean and 1 not in clean and 5 not in clean  # the item "word word" has no id and counts all the same
    assert 2 in clean and 91 in clean
