"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks.compare import compare, connect
from checks.oracle import oracle_sql
from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_but_the_runs_has_sql():
    assert set(QUERIES) - set(SQL) == {"walk_run", "walk_rerun"} and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    assert compare(spark, duck, name, SF, SQL[name]) == ""


def test_walk_run(spark):
    rows = QUERIES["walk_run"](spark, SF).collect()
    assert rows and all(r.faces == r.anchors + r.absorbed and r.segmented == r.anchors for r in rows)


def test_walk_rerun(spark):
    """Each walk has the rule and entry of its own last run."""
    rows = {r.walk_id: r for r in QUERIES["walk_rerun"](spark, SF).collect()}
    assert rows
    for w, r in rows.items():
        assert (r.rule, r.entered) == (("fixed", "select") if w % 2 else ("calibrated", "select" if w % 4 == 0 else "gate"))
        assert r.tau == 0.99 or not w % 2
