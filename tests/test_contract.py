"""The driver contract: names, oracles and the flagship query."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "rolling_activity" in entry.queries()


def test_core_queries_without_a_package_of_llm(monkeypatch):
    real = entry.importlib.import_module

    def broken(name, *args):
        if name == entry.LLM:
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *args)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.warns(UserWarning, match="xxhash"):
        found = entry.queries()
    assert "rolling_activity" in found and not any(n.startswith("op1_") for n in found)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 30


def _key(value):
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted([_key(r[columns.index(c)]) for c in sorted(columns)] for r in found.fetchall())
    assert sorted([_key(r[c]) for c in sorted(columns)] for r in df.collect()) == expected
