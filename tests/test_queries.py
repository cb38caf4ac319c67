"""All signals against DuckDB, and the driver's contract."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from crossbar import pair_queries, source_queries
from crossbar.plans.catalogue import CATALOGUE, NAMES, SHORT, score
from crossbar.plans.components import COMPONENTS
from crossbar.plans.expr import evaluate, to_sql
from crossbar.plans.predictors import PREDICTORS
from crossbar.queries import ORACLE_SQL, QUERIES, SIGNALS
from crossbar.sources.panel import PANEL_SQL, events_panel, lineitem_panel


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(got, want, places):
    keys = [c for c in ("period", "bar", "name_ix", "i", "j") if c in got.columns]
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    cols = [c for c in cols if c != "name"]
    a, b = (d.sort_values(keys)[cols].to_numpy(dtype=float) for d in (got, want))
    np.testing.assert_allclose(a, b, atol=2 * 10.0**-places)


def test_all_signals_at_once(spark, data, duck):
    nodes = SIGNALS | {f"c_{n}": v for n, v in COMPONENTS.items()} | {f"p_{n}": v for n, v in PREDICTORS.items()}
    got = evaluate(lineitem_panel(spark, data), nodes).toPandas()
    ctes, last = to_sql("panel", nodes)
    want = duck.sql(f"WITH {PANEL_SQL}, {', '.join(ctes)} SELECT * FROM {last}").df()
    close = {}
    for c in nodes:
        a = got.sort_values(["bar", "name_ix"])[c].to_numpy(dtype=float)
        b = want.sort_values(["bar", "name_ix"])[c].to_numpy(dtype=float)
        close[c] = np.mean(np.isclose(a, b, atol=1e-6) | (np.isnan(a) & np.isnan(b)))
    assert {c: v for c, v in close.items() if v < 0.999} == {}  # last digits can turn a rank over


@pytest.mark.parametrize("name", [*pair_queries.QUERIES, *source_queries.QUERIES])
def test_pair_and_source_queries(spark, data, duck, name):
    same(QUERIES[name](spark, data).toPandas(), duck.sql(ORACLE_SQL[name]).df(), 4)


def test_contract(spark):
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 200
    assert __spark_entry__.entry(spark).count() > 0
    assert len(NAMES) == 65


@pytest.mark.parametrize("name", ["ticket2", "ticket6", "ticket7", "ind4", "t2basket6", "ind2", "gbm_ada"])
def test_predictors_run(spark, data, name):
    assert name in CATALOGUE
    got = score(lineitem_panel(spark, data), name, SHORT).toPandas()
    assert len(got) and got.score.notna().all()
    assert got.groupby(["period", "bar"]).score.mean().abs().max() < 1e-8


def test_events_panel_is_dense(spark, data):
    p = events_panel(spark, data).groupBy("bar").count().toPandas()
    assert p["count"].nunique() == 1
