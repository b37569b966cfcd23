"""The SQL of this subpackage on drawn texts, where more happens than in the tables."""

import duckdb
import pandas as pd
import pytest

from pulsegrid.llm import decontamination, secret_scan, sql, url_filter
from tests.llm.test_spans import SECRET_PARTS, drawn


def compared(monkeypatch, spark, module, query, statement, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    monkeypatch.setattr(module, "table", lambda s, d, name: spark.createDataFrame(tables[name]))
    got, want = query(spark, "").toPandas(), con.sql(statement).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist())) for df in (got, want))
    assert a == b
    return got


def test_secrets(monkeypatch, spark):
    texts = drawn(7, [*SECRET_PARTS, "x " * 90, "client_id=abcd", "username: bob7 "], 600)
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = compared(monkeypatch, spark, secret_scan, secret_scan.op2_secrets, sql.SECRETS, documents=docs)
    assert got.n_linked.sum() > 20


def test_decontamination(monkeypatch, spark):
    texts = drawn(8, ["a ", "b ", "C ", "é ", "1", "-", " "], 300)
    items = pd.DataFrame({"item_id": range(20), "text": drawn(9, ["a ", "b ", "c ", "é ", "1"], 20)})
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = compared(monkeypatch, spark, decontamination, decontamination.op6_decontamination, sql.DECONTAMINATION, documents=docs, benchmark=items)
    assert got.contaminated.any() and not got.contaminated.all()


@pytest.mark.parametrize("seed", [1, 2])
def test_urls(monkeypatch, spark, seed):
    parts = ["http://", "a.", "www.", "example.com", "net", "/en/", "/fr/", "/es/", "?", "#", "casino", "cheap-pills", "bet", "-", "xxx", "É", ".com", "free", "WIN"]
    pages = pd.DataFrame({"page_id": range(800), "url": ["http://" + u for u in drawn(seed, parts, 800)], "html": "x"})
    compared(monkeypatch, spark, url_filter, url_filter.op5_urls, sql.URLS, pages=pages)
