"""Labels and weights of learned legs, evaluation, and streams against batch."""

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from crossbar.operators import matrix as m
from crossbar.plans import evaluate as ev
from crossbar.plans import boost, models
from crossbar.sources.panel import from_wide
from crossbar.streaming import maps

BARS, NAMES = 60, 5


def panel(spark, seed=1):
    rng = np.random.default_rng(seed)
    cols = pd.MultiIndex.from_product([[f"Feature.{k}" for k in range(1, 7)], [f"X.{n}" for n in range(NAMES)]])
    return from_wide(spark, pd.DataFrame(rng.normal(size=(BARS, len(cols))), columns=cols))


def test_training_rows_are_purged(spark):
    df = models.with_labels(panel(spark), models.simple(), ["forward_path", "next_rank"])
    for label, reach in (("forward_path", 5), ("next_rank", 1)):
        b = models.Booster(label, half_life=10.0, cap=20)
        rows = df.withColumn("weight", models.training_weight(b, 40)).where("weight is not null").toPandas()
        assert rows.bar.max() == 39 - reach and rows.bar.min() == 20
        np.testing.assert_allclose(rows.weight, 0.5 ** ((39 - rows.bar) / 10))


def plain_tree(x, y, w, depth, least, ridge):
    """Best split by trying every value of every column; returns a function of a row."""
    worth = lambda r: (w[r] * y[r]).sum() ** 2 / max(w[r].sum() + ridge, 1e-300)

    def build(rows, depth):
        best = (1e-12, None)
        if depth:
            for j in range(x.shape[1]):
                for v in np.unique(x[rows, j])[:-1]:
                    left, right = rows[x[rows, j] <= v], rows[x[rows, j] > v]
                    if min((w[left] > 0).sum(), (w[right] > 0).sum()) >= least:
                        gain = worth(left) + worth(right) - worth(rows)
                        best = max(best, (gain, (j, v, left, right)), key=lambda g: g[0])
        if best[1] is None:
            value = (w[rows] * y[rows]).sum() / max(w[rows].sum() + ridge, 1e-300)
            return lambda row: value
        j, v, left, right = best[1]
        low, high = build(left, depth - 1), build(right, depth - 1)
        return lambda row: low(row) if row[j] <= v else high(row)

    return build(np.arange(len(x)), depth)


def test_trees_by_trying_all_splits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, size=(80, 3)).astype(float)
    y, w = rng.normal(size=80) + x[:, 1], rng.uniform(0.1, 1, size=80) * (rng.random(80) < 0.8)
    edges = boost.cuts(x, 64)
    b = boost.binned(x, edges)
    for depth, least, ridge in ((1, 1, 0.0), (3, 5, 0.0), (4, 1, 5.0)):
        plain = plain_tree(x, y, w, depth, least, ridge)
        tree = boost.grow(b, y, w, boost.Shape(depth, least, ridge))
        np.testing.assert_allclose(tree(b), [plain(r) for r in x], atol=1e-9)
    even = boost.grow(b, y, w, boost.Shape(3, 1, 0.0, symmetric=True))
    assert all(len(set(even.feature[a : 2 * a + 1])) == 1 for a in (0, 1, 3))
    few = boost.grow(b, y, w, boost.Shape(3, 1, 0.0, leaves=5))
    assert len(np.unique(few.leaf(b))) == 5 and len(np.unique(boost.grow(b, y, w, boost.Shape(3)).leaf(b))) == 8


def test_boosting_by_plain_rounds():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, size=(60, 2)).astype(float)
    y, w = x[:, 0] - 0.5 * x[:, 1] + 0.1 * rng.normal(size=60), rng.uniform(0.5, 1, size=60)
    fitted = np.full(60, np.average(y, weights=w))
    for _ in range(5):
        tree = plain_tree(x, y - fitted, w, 2, 3, 1.0)
        fitted = fitted + 0.3 * np.array([tree(r) for r in x])
    got = boost.gradient_boosted(x, y, w, x, 5, 0.3, boost.Shape(2, 3, 1.0), 1.0, 1.0, 64, 7)
    np.testing.assert_allclose(got, fitted, atol=1e-9)
    u, votes = w / w.sum(), []
    for _ in range(5):
        tree = plain_tree(x, y, u, 2, 3, 0.0)
        said = np.array([tree(r) for r in x])
        loss = np.abs(said - y) / np.abs(said - y).max()
        odds = (u @ loss) / (1 - u @ loss)
        votes.append((said, np.log(1 / odds) * 0.5))
        u = u * odds ** (0.5 * (1 - loss))
        u = u / u.sum()
    want = []
    for i in range(60):
        mass = 0.0
        for value, strength in sorted((v[i], s) for v, s in votes):
            mass += strength
            if mass >= 0.5 * sum(s for _, s in votes):
                want.append(value)
                break
    np.testing.assert_allclose(boost.adaptive_boosted(x, y, w, x, 5, 0.5, boost.Shape(2, 3), 64), want, atol=1e-9)


def test_boosters_are_reproducible_and_read_training_rows_only(spark):
    names = list(models.simple())
    df = models.with_labels(panel(spark), models.simple(), ["next_rank"])
    chosen = {"a": dataclasses.replace(models.CAT_ONE_BAR, rounds=20), "b": models.Booster("next_rank", 20, 3, least=5), "c": models.Booster("next_rank", 5, 2, least=5, subsample=1.0, kind="adaptive")}
    one, two = (models.boosted(d, names, chosen, 40).orderBy("bar", "name_ix").toPandas() for d in (df, df.repartition(7)))
    np.testing.assert_array_equal(one.to_numpy(), two.to_numpy())
    assert len(one) == BARS * NAMES and one.notna().all().all()
    later = df.withColumn("next_rank", F.when(F.col("bar") < 39, F.col("next_rank")).otherwise(F.lit(5.0)))
    three = models.boosted(later, names, chosen, 40).orderBy("bar", "name_ix").toPandas()
    np.testing.assert_array_equal(one.to_numpy(), three.to_numpy())
    ranked = models.ranked(models.boosted(df, names, chosen, 40), ["a", "b"]).toPandas()
    assert ranked.groupby("bar").score.mean().abs().max() < 1e-9
    rows = df.orderBy("bar", "name_ix").toPandas()
    x, y = rows[names].to_numpy(), rows["next_rank"].to_numpy()
    train = (rows.bar <= 38).to_numpy()
    want = boost.gradient_boosted(x[train], y[train], np.ones(train.sum()), x, 20, 0.05, boost.Shape(4, 1, 5.0, True), 1.0, 1.0, 64, 7)
    np.testing.assert_allclose(one.a, want, atol=1e-9)


def test_evaluation(spark):
    df = panel(spark).withColumn("score", F.col("f2")).toPandas()
    s = spark.createDataFrame(df[["period", "bar", "name_ix", "f1", "score"]])
    f1, f2 = (df.pivot(index="bar", columns="name_ix", values=c).to_numpy() for c in ("f1", "score"))
    want = np.concatenate([[0], (f2[:-1] * f1[1:]).sum(axis=1)])
    got = ev.profits(s).orderBy("bar").toPandas().profit.to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-12)
    r = ev.sharpe(ev.profits(s)).first()
    assert np.isclose(r.sharpe, want.mean() / want.std())
    ic = np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(f2[:-1], f1[1:])])
    assert np.isclose(ev.information(s).first().ic, ic)
    folds = ev.fold_of(ev.walk_forward(panel(spark), 30, 10)).groupBy("fold", "is_train").count().collect()
    assert {(r.fold, r.is_train): r["count"] // NAMES for r in folds} == {(f, train): 30 if train else 10 for f in range(3) for train in (True, False)}


def batch(make, values):
    fold = make()
    return np.array([fold.step(row) for row in values])


def test_streams_give_the_batch_scores(spark, tmp_path):
    df = panel(spark, 3)
    rows = df.select("period", "bar", "name_ix", F.col("f1").alias("value"), F.timestamp_seconds((F.col("bar") + 1) * 3600).alias("ts"))
    values = df.toPandas().pivot(index="bar", columns="name_ix", values="f1").to_numpy()
    for k, make in enumerate((maps.RecursiveMap, lambda: maps.RunningMean(10.0), lambda: maps.FactorDistance(20, 2))):
        want = batch(make, values)
        for files in (1, 5):
            got = maps.replay(spark, rows, str(tmp_path / f"s{k}-{files}"), make, files=files).toPandas()
            got = got.pivot(index="bar", columns="name_ix", values="score").to_numpy()
            np.testing.assert_allclose(got, want, atol=1e-9)
    np.testing.assert_allclose(batch(maps.RecursiveMap, values), m.recursive_map(values), atol=1e-9)
    np.testing.assert_allclose(batch(lambda: maps.FactorDistance(20, 2), values), m.ou_score(values, 20, 2), atol=1e-9)


def test_late_rows_are_dropped(spark, tmp_path):
    df = panel(spark, 4)
    rows = df.select("period", "bar", "name_ix", F.col("f1").alias("value"), F.timestamp_seconds((F.col("bar") + 1) * 3600).alias("ts")).where("bar < 20")
    late = rows.where("bar = 2").withColumn("value", F.lit(99.0))
    folder = str(tmp_path / "late")
    for part in (rows.where("bar < 10"), rows.where("bar >= 10"), late):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = maps.stateful_scores(source, lambda: maps.RunningMean(5.0)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(maps.SCORES).parquet(f"{folder}/out").toPandas()
    assert got.groupby(["bar", "name_ix"]).size().max() == 1 and got.score.abs().max() < 10
