"""Every query with SQL equals it on the smallest tables; the others give rows."""

import math
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from weft.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    """What the rows hold is tested in test_brute and test_kernels."""
    got = registry.queries()[name](spark, SF)
    key = next((c for c in ("doc_id", "page_id") if c in got.columns), None)
    if key is None:
        # no benchmark item shares a bucket with these documents; test_brute finds none either
        assert (got.count() > 0) == (name != "lsh_seen_before")
        return
    table = {"doc_id": "documents", "page_id": "pages"}[key]
    ids = [r[0] for r in got.select(key).collect()]
    held = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert ids and len(ids) == len(set(ids)) and set(ids) <= held


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(monkeypatch):
    for name in ("weft.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    for name in [x for x in sys.modules if x.startswith("weft.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    assert set(entry.queries()) == set(registry.queries())
    assert set(entry.oracle_sql()) == set(registry.oracle_sql())


def test_other_import_errors_are_raised(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError("No module named 'missing'", name="missing")

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
