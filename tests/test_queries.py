"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import importlib.util
import os

import duckdb
import pytest

from chronoloom import registry

SF = "/root/testdata/sf0.001"
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    return value


#: Minutes each, whatever the tables' size: many rounds over many graphs.  Their parts have tests of their own, and the driver compares them with their SQL.
SLOW = {"shuffled_year_null", "timeline_k_sweep", "louvain_sweep"}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_same_rows(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert {d[0]: KINDS[str(d[1])] for d in result.description} == dict(found.dtypes)
    columns = sorted(names)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert rows == expected


def test_entry_works_with_and_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert (importlib.util.find_spec("chronoloom.llm") is not None) == ("pipeline" in entry.queries())
