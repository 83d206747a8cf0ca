"""Every registered query against its DuckDB oracle (sf0.001; the driver repeats this at sf0.01)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from weft.catalog import QUERIES as LIBRARY
from weft.oracle import compare

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck_small, name):
    ok, msg = compare(QUERIES[name](spark, SMALL), duck_small, ORACLE[name])
    assert ok, msg


def test_every_query_of_the_library_has_an_oracle():
    assert not set(LIBRARY) - set(ORACLE)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert {r["dataset"] for r in rows} == {"docs_all", "docs_en"}
    assert df.schema == entry.entry(spark).schema
