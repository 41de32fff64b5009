"""Every query against its SQL oracle, on whole tables at the smallest scale factor."""

import pytest

import __spark_entry__ as entry
from compare import DATA, connect, difference

SF = "0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


# Searches over full grids take minutes each: compare.py runs them, and test_models.py
# runs the same code on a planted signal.
GRIDS = {"m7_forest_grid", "m9_forest_report", "m16_score_saved"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - GRIDS))
def test_query_equals_oracle(spark, con, name):
    assert difference(spark, con, SF, name, QUERIES, ORACLES) is None


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert len(df.columns) == 33 + 4
    assert df.schema == QUERIES["c13_matrix_15"](spark, f"{DATA}/sf{SF}").schema
