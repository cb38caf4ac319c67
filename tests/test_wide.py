"""Wide bars, long running sums, joins as of a time and walk-forward folds against plain rules."""

import bisect
import random
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossbar.operators import views
from crossbar.operators.wide import as_of, exact_quantile, running, wide_ranks
from crossbar.plans.evaluate import fold_of, walk_forward
from crossbar.sources.panel import from_wide, lineitem_panel, read_wide, wide_table


@pytest.mark.parametrize("large", [0, 4096])
def test_wide_ranks(spark, large):
    rng = random.Random(1)
    rows = [("a", i, rng.choice([None, 1.0, 1.0, 1.0, rng.randint(0, 40) / 4])) for i in range(600)]  # a third has one value
    rows += [("b", i, float(i)) for i in range(90)] + [("c", 1, 5.0), ("d", 1, None), (None, 1, 2.0), (None, 2, 1.0), ("e", 3, 7.0), ("e", 1, 7.0), ("e", 2, 7.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "bar string, name int, value double, cuts string, part int").repartition(5)
    got = {(r.bar, r.name): (r.average, r.place) for r in wide_ranks(df, ["bar"], "value", "name", parts=8, large=large).collect()}
    assert len(got) == len(rows)
    for bar, name, v in rows:
        own = sorted((w, n) for b, n, w in rows if b == bar and w is not None)
        if v is None:
            assert got[bar, name] == (None, None)
            continue
        values, n = [w for w, _ in own], len(own)
        rank = (bisect.bisect_left(values, v) + 1 + bisect.bisect_right(values, v)) / 2
        want = (rank - (n + 1) / 2) / ((n - 1) / 2) if n > 1 else 0.0
        assert abs(got[bar, name][0] - want) < 1e-12 and got[bar, name][1] == own.index((v, name)) + 1


def test_a_bar_of_many_names_is_dealt_out(spark):
    """300,000 names, a third with one value: no task orders more than a few ranges, and ties get shared averages."""
    n = 300_000
    value = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id") % 100_000)
    df = spark.range(0, n, 1, 8).select(F.lit(1).alias("bar"), F.col("id").alias("name"), value.alias("value"))
    got = wide_ranks(df, ["bar"], "value", "name").agg(F.count("place"), F.sum("place"), F.countDistinct("place"), F.round(F.sum("average"), 3), F.max("place")).first()
    assert got[:3] == (n, n * (n + 1) // 2, n) and abs(got[3]) < 1e-3 and got[4] == n


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running(spark, width):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(-50, 200), i, rng.choice([None, 1, 2, -5])) for i in range(400)] + [("a", None, 900 + i, 3) for i in range(5)] + [(None, 4, 950, 2)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, at int, id int, v int, block int")
    got = {r.id: (r.total, r["count"]) for r in running(df, ["k"], "at", "v", width, "id").collect()}
    for k, at, i, _ in rows:
        key = (at is not None, at or 0, i)
        seen = [v for kk, a, j, v in rows if kk == k and (a is not None, a or 0, j) <= key and v is not None]
        assert got[i] == (sum(seen), len(seen))


@pytest.mark.parametrize("width,tolerance", [(1, None), (10, 15), (10_000, 40), (25, 0)])
def test_as_of(spark, width, tolerance):
    rng = random.Random(3)
    right = [(rng.choice(["a", "a", "b", "c"]), rng.randint(-40, 300), i, None if i % 9 == 0 else i * 10) for i in range(60)]
    right += [("a", 100, 200 + i, i) for i in range(5)] + [("a", None, 300, 1), (None, 5, 301, 1)]
    left = [(rng.choice(["a", "a", "b", "d"]), rng.randint(-60, 400), i) for i in range(200)] + [("a", 100, 900), (None, 5, 901), ("a", None, 902), ("a", 100, 900)]
    a = spark.createDataFrame([(*r, "q") for r in left], "k string, at int, id int, part string")
    b = spark.createDataFrame([(*r, "z") for r in right], "k string, at int, seq int, v int, id string")
    found = as_of(a, b, ["k"], "at", ["v"], width, tie="seq", tolerance=tolerance)
    assert found.columns == [*a.columns, "as_of", "v"]
    got = [(r.id, r.as_of, r.v) for r in found.collect()]
    want = []
    for k, at, i in left:
        known = [(t, s, v) for kk, t, s, v in right if kk == k and k is not None and t is not None and at is not None and t <= at]
        t, _, v = max(known, key=lambda r: r[:2]) if known else (None, None, None)
        want.append((i, t, v) if t is not None and (tolerance is None or at - t <= tolerance) else (i, None, None))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert as_of(a.limit(0), b, ["k"], "at", ["v"], width).count() == 0
    assert {r.v for r in as_of(a, b.limit(0), ["k"], "at", ["v"], width).collect()} == {None}


def test_folds(spark, data):
    panel = lineitem_panel(spark, data)
    train, step = 60, 25
    got = fold_of(walk_forward(panel, train, step)).toPandas()
    rows = panel.select("period", "bar").distinct().toPandas()
    want = set()
    for p, g in rows.groupby("period"):
        first, most = g.bar.min(), g.bar.max() - g.bar.min()
        for fold, a in enumerate(range(train, most + 1, step)):
            want |= {(p, fold, b, b - first < a) for b in g.bar if a - train <= b - first < a + step}
    assert {(r.period, r.fold, r.bar, r.is_train) for r in got.itertuples()} == want and len(want) > 0
    names = panel.select("name_ix").distinct().count()
    assert len(got) == len(want) * names
    # folds read what the panel reads, once
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation")
    assert scans(walk_forward(panel, train, step)) == scans(panel)


def test_wide_tables(spark, tmp_path):
    """A wide table as pandas writes it, in several files, against the frame turned on the driver."""
    rng = np.random.default_rng(4)
    columns = pd.MultiIndex.from_product([[f"Feature.{k}" for k in range(1, 7)], ["X.10", "X.2", "Y.1"]])
    wide = pd.DataFrame(rng.normal(size=(40, len(columns))), columns=columns)
    wide.iloc[3, 4], wide.iloc[5, 1], wide.iloc[7, 2] = np.nan, np.inf, -np.inf
    target = pd.DataFrame(rng.normal(size=(40, 3)), columns=["X.10", "X.2", "Y.1"])
    flat = wide.set_axis([str(c) for c in columns], axis=1).assign(**{f"Target|{n}": target[n] for n in target}, bar=np.arange(40), note="x")
    flat.iloc[:25].to_parquet(tmp_path / "a.parquet")
    flat.iloc[25:].to_parquet(tmp_path / "b.parquet")
    table = spark.read.parquet(str(tmp_path))
    for order in ("suffix", "native"):
        want = from_wide(spark, wide, target, order=order)
        got = read_wide(table, order=order)
        assert got.columns == want.columns
        key = lambda r: (r.bar, r.name)
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    few = read_wide(table, features=("f3",))
    assert few.columns == ["period", "bar", "name", "name_ix", "is_train", "f3", "target"]
    schema = few.select("f3")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert "Feature.3" in schema and "Feature.1" not in schema
    again = read_wide(wide_table(want, ["X.10", "X.2", "Y.1"]), period="period")
    assert sorted(again.select("bar", "name", "f1", "f6").collect()) == sorted(want.select("bar", "name", "f1", "f6").collect())
    with pytest.raises(ValueError, match="no column"):
        read_wide(spark.range(3))


def test_views_are_extended_by_new_blocks_only(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=900) + 1e8
    rows = pd.DataFrame({"k": np.where(rng.random(900) < 0.7, "a", "b"), "x": x, "y": 3 * (x - 1e8) + rng.normal(size=900), "block": np.arange(900) // 100, "n": 1})
    rows.loc[5:40, "y"] = np.nan
    folder, path = str(tmp_path / "rows"), str(tmp_path / "view")
    df = spark.createDataFrame(rows).withColumn("y", F.expr("nanvl(y, null)"))
    df.write.partitionBy("block").parquet(folder)
    by, values = ["k"], ["x", "y"]
    for b in range(9):
        if b == 8:  # the older rows are gone: only the view knows them
            for old in range(8):
                shutil.rmtree(f"{folder}/block={old}")
        views.extend(spark.read.parquet(f"{folder}/block={b}"), path, b, by, values)
    views.extend(spark.read.parquet(f"{folder}/block=8"), path, 8, by, values)  # again: counts once
    merged = views.merge(views.blocks(spark, path), by, values)
    got = {r.k: r for r in merged.withColumns({"cov": views.covariance("x", "y"), "slope": views.slope("y", "x")}).collect()}
    for k, g in rows.dropna().groupby("k"):
        a, b = (g.x - 1e8).to_numpy(), g.y.to_numpy()
        assert got[k].n == len(g) and np.isclose(got[k].mean_x - 1e8, a.mean(), atol=1e-7)
        np.testing.assert_allclose([got[k].m_x_x, got[k].m_x_y, got[k].m_y_y], [len(g) * a.var(), ((a - a.mean()) * (b - b.mean())).sum(), len(g) * b.var()], rtol=1e-7)
        np.testing.assert_allclose([got[k]["cov"], got[k].slope], [np.cov(a, b)[0, 1], np.cov(a, b)[0, 1] / a.var(ddof=1)], rtol=1e-7)


@pytest.mark.parametrize(("p", "large"), [(0.5, 0), (0.5, 40), (0.9, 0), (0.0, 3), (1.0, 0)])
def test_exact_quantiles(spark, p, large):
    rng = np.random.default_rng(3)
    drawn = {
        "plain": rng.normal(size=3001), "even": rng.normal(1e8, 1e-3, 2000), "ties": rng.integers(0, 3, 500).astype(float), "scales": 10.0 ** rng.uniform(-300, 300, 1000) * rng.choice([-1, 1], 1000),
        "gap": np.array([0.0] * 50 + [1e300] * 50), "ends": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, 1e-310, -5e-324, 1.0]), "one": np.array([4.0]), None: np.arange(300.0),
        "huge": np.array([-np.inf, *range(200), np.inf]),
    }
    rows = [(name, float(x)) for name, xs in drawn.items() for x in xs] + [("plain", None), ("none", None)]
    df = spark.createDataFrame(rows, "v string, x double").repartition(5)
    got = {r.v: r.quantile for r in exact_quantile(df, ["v"], "x", p, large).collect()}
    assert set(got) == {*drawn, "none"} and got["none"] is None
    for name, xs in drawn.items():
        at = p * (len(xs) - 1)
        low = sorted(xs)[int(at)]
        high = sorted(xs)[min(int(at) + 1, len(xs) - 1)]
        want = low if at == int(at) else low * (1 - at % 1) + high * (at % 1)
        assert got[name] == pytest.approx(want, rel=1e-12, abs=0), name


def test_quantiles_of_nan_and_nothing(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 1.0), (1, 2.0), (2, float("nan"))], "k int, x double")
    for large in (0, 100):
        got = {r.k: r.quantile for r in exact_quantile(df, ["k"], "x", 0.5, large).collect()}
        assert got[1] == 2.0 and np.isnan(got[2])
    assert exact_quantile(df.where("k > 5"), ["k"], "x").count() == 0
