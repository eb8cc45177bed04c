"""Every registered query of the engine against its oracle SQL on the smallest tables."""

import os

import pytest

from tessera import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = con.sql(catalogue.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in rows), key=str) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)


def plan_of(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """One scan a star, pruned columns, pushed filters, key joins without nested loops, no Python."""
    star = plan_of(spark, "agg_basic")
    assert star.count("FileScan") == 1 and "l_tax" not in star
    assert "EqualTo(c_mktsegment,BUILDING)" in plan_of(spark, "bgp_const_object")
    assert plan_of(spark, "optional_same_row").count("FileScan") == 1
    for name in ("minus_lineitem", "not_exists_lineitem", "minus_on_optional", "optional_chain", "flagship_revenue", "fk_path_join", "optional_label", "exists", "not_exists", "minus_labels", "subquery_topk"):
        plan = plan_of(spark, name)
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["path_plus_to_const", "path_plus_tree"])
def test_rounds_broadcast_only_few_rows(spark, monkeypatch, name):
    """However small Catalyst takes the edges for, a round broadcasts no table of more than FEW rows."""
    from tessera.operators import paths

    monkeypatch.setattr(paths, "FEW", 0, raising=False)
    assert "Broadcast" not in " ".join(round_plans(spark, monkeypatch, name))


def round_plans(spark, monkeypatch, name):
    """Plans of what the rounds' joins wrote; the seed of a constant is one row, so plans without the anti-join are left out."""
    from tessera.operators import paths

    plans, write = [], paths.checkpoint

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(paths, "checkpoint", noted)
    catalogue.QUERIES[name](spark, SF)
    out = [x for x in plans if "LeftAnti" in x]
    assert out
    return out


def test_many_seeds_are_not_broadcast(spark, monkeypatch):
    """Neither the bound ends that seed a closure nor the table they came from, once they are many."""
    from tessera.operators import paths

    monkeypatch.setattr(paths, "FEW", 0)
    assert "Broadcast" not in plan_of(spark, "path_star_tree")
