"""Every registered query at the smallest scale, against DuckDB where it has a text."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import compare, duck

from factorwise.plans.catalog import load

SF = "/root/testdata/sf0.001"
CATALOG = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(CATALOG.queries))
def test_query(spark, con, name):
    seen = []

    def run(spark, sf):
        seen.append(CATALOG.queries[name](spark, sf))
        return seen[0]

    status, _, note = compare(spark, con, run, CATALOG.sql.get(name), SF)
    assert status in ("ok", "rows"), note
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_every_text_has_a_query():
    assert set(CATALOG.sql) <= set(CATALOG.queries)
