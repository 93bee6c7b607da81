"""Registered queries of the package and their SQL twins."""

import oracle
import pytest

import __spark_entry__ as entry
from granulake.llm import queries
from granulake.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
queries.load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    rows = oracle.spark_rows(QUERIES[name](spark, SF))
    assert rows[2] and oracle.compare(rows, oracle.duck_rows(duck, ORACLES[name])) is None


def test_one_query_an_operator_and_the_pipeline():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
