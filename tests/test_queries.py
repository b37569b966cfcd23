"""Every registered query that has SQL gives what DuckDB gives on the same tables; the others run."""

import importlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__
from pulsegrid.plans.queries import QUERIES
from pulsegrid.plans.sql import ORACLE_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df):
    def one(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        return repr(round(float(v), 9) + 0.0) if isinstance(v, float | np.floating) else str(v)

    return sorted(tuple(map(one, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con, folder


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_equals_sql(spark, duck, name):
    con, folder = duck
    got, want = __spark_entry__.queries()[name](spark, folder).toPandas(), con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert (len(got) or name == "stream_equals_batch") and normal(got) == normal(want)


def test_audits(spark, duck):
    assert QUERIES["stream_equals_batch"](spark, duck[1]).count() == 0
    r = QUERIES["sync_audit"](spark, duck[1]).first()
    assert r.frames_emitted == r.frames_stored == 607 and r.missing == 0 and r.delivered


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 5 and all(r.n_frames > 0 for r in rows)


def test_everything_but_the_text_subpackage_stands_alone(monkeypatch):
    """Nothing outside the subpackage imports it, but for the entry, which does without."""
    root = Path(__spark_entry__.__file__).parent
    for source in [*root.glob("*.py"), *(root / "pulsegrid").rglob("*.py")]:
        if "llm" not in source.parts and source.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert "pulsegrid.llm" not in source.read_text() and "corpus_pipeline" not in source.read_text(), source
    import sys

    for name in [m for m in sys.modules if m.startswith("pulsegrid.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "pulsegrid.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(__spark_entry__)
    assert set(bare.queries()) == set(QUERIES) and set(bare.oracle_sql()) == set(ORACLE_SQL)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
