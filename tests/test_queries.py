import pytest

from rillwork import queries
from rillwork.operators import folds
from rillwork.queries import ORACLE, QUERIES

from compare import same

OWN_TESTS = {"protocol_run", "score_batch", "lasso_rank"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - OWN_TESTS))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_protocol_runs_whole(spark, sf):
    """Every row of lineitem, 200 trees without a bound on depth, 200 rounds, selection by three methods: graded methods and
    the control, which no method of unrelated features beats by much."""
    got = {r["method"]: r for r in QUERIES["protocol_run"](spark, sf).collect()}
    assert set(got) == {*queries.protocol.MODELS, "PlainAverage", "WeightedAverage", "Choquet", "MinOfModels", "NoSkillBaseline"}
    assert all(-0.5 < r["r2"] < 0.1 and r["rmse"] > 0 for r in got.values()) and abs(got["NoSkillBaseline"]["r2"]) < 0.02


def test_new_rows_are_scored_whole(spark, sf):
    rows = QUERIES["score_batch"](spark, sf).collect()
    whole = folds.hash_fold(queries.feature_rows(spark, sf), 5).where("fold = 0").count()
    assert len(rows) == whole and {r["reason"] for r in rows} == {None, "missing l_tax"}
    assert all((r["RandomForest"] is None) == (r["reason"] is not None) for r in rows)


def test_lasso_ranks_every_feature(spark, sf):
    got = QUERIES["lasso_rank"](spark, sf).collect()
    assert {r["feature"] for r in got} == set(queries.FEATURES) and [r["weight"] for r in got] == sorted((r["weight"] for r in got), reverse=True)


def test_entry_imports_and_names():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
