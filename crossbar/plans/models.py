"""Learned legs: boosted trees on ranked features, labels with a purge, recency weights.

Every period has models of its own, fitted on its training bars: features, labels and weights are columns of the
signal graph, and fitting is one grouped kernel a period (``boost``). Parameter sets of several native boosters are
mapped on it (an approximation of them, not the libraries).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare
from . import boost
from ..functions.scalar import fill, magnitude, tanh
from ..operators import cross as x
from ..operators import series as t
from .components import f1, f2, f3, f4, f5, f6, line, price, residual, target
from .expr import Node, evaluate

rank = x.rank_average
_fields = dict(zip(("f1", "f2", "f3", "f4", "f5", "f6"), (f1, f2, f3, f4, f5, f6)))


def engineered() -> dict[str, Node]:
    """The 28 ranked features of the weighted ensemble."""
    idio = t.cumulate(residual)
    shock = magnitude(f5) / (t.rolling_mean(magnitude(f5), 250, 10) + 1e-9)
    share = fill(tanh(f5 / (t.rolling_std(f5, 250, 20) + 1e-9)))
    raw: dict[str, Node] = {f"r{i}": _fields[f"f{i}"] for i in range(1, 7)}
    raw |= {
        "f6z": fill((f6 - t.rolling_mean(f6, 500, 30)) / (t.rolling_std(f6, 500, 30) + 1e-9)),
        "f6chg": f6 - t.rolling_mean(f6, 60, 5),
        "t5s5": t.rolling_sum(share, 5),
        "t5s20": t.rolling_sum(share, 20),
        "adl60": t.ewm_mean(line, 60),
        "adl100": t.ewm_mean(line, 100),
        "vshock": shock,
        "ir1": residual,
        "irs5": t.rolling_sum(residual, 5),
        "irs20": t.rolling_sum(residual, 20),
        "irs60": t.rolling_sum(residual, 60),
        "idd40": t.drawdown(idio, 40),
        "dh10": t.drawdown(price, 10),
        "dh40": t.drawdown(price, 40),
        "dl20": price - t.rolling_min(price, 20),
        "macd_a": t.macd(f1, 8, 40),
        "macd_b": t.macd(f1, 20, 100),
        "rs5": t.rolling_sum(f1, 5),
        "rs20": t.rolling_sum(f1, 20),
        "rs60": t.rolling_sum(f1, 60),
        "sd20": fill(t.rolling_std(f1, 20, 2)),
        "sd60": fill(t.rolling_std(f1, 60, 5)),
    }
    return {n: fill(rank(v)) for n, v in raw.items()}


def simple() -> dict[str, Node]:
    """The ten ranked features of the single boosters."""
    raw = {f"r{i}": fill(_fields[f"f{i}"]) for i in range(1, 7)}
    raw |= {"rs5": t.rolling_sum(f1, 5), "rs20": t.rolling_sum(f1, 20), "sd20": fill(t.rolling_std(f1, 20, 2)), "f3_f4": fill(f3) - fill(f4)}
    return {n: fill(rank(v)) for n, v in raw.items()}


def path_features() -> dict[str, Node]:
    """The twelve features of the forward-path booster."""
    raw = {f"rs{w}": t.rolling_sum(f1, w) for w in (5, 20, 60)} | {"sd20": fill(t.rolling_std(f1, 20, 2))}
    raw |= {f"r{i}": fill(_fields[f"f{i}"]) for i in range(2, 7)}
    raw |= {f"s{i}": t.rolling_mean(fill(_fields[f"f{i}"]), 20) for i in (2, 5, 6)}
    return {n: fill(rank(v)) for n, v in raw.items()}


#: Labels. They look ahead, so only training rows may use them, and those whose window ends in the block.
LABELS: dict[str, Node] = {
    "next_rank": t.lead(rank(f1)),
    "next_rank_residual": x.project_off(t.lead(rank(f1)), rank(f1), eps=1e-12),
    "target_rank": rank(target),
    "forward_path": rank(t.lead_sum(f1, 2, 5)),
}
REACH = {"next_rank": 1, "next_rank_residual": 1, "target_rank": 5, "forward_path": 5}


@dataclass(frozen=True)
class Booster:
    """One booster: label, training window and tree parameters."""

    label: str
    rounds: int = 200
    depth: int = 4
    rate: float = 0.05
    least: int = 500
    subsample: float = 0.8
    half_life: float | None = None
    cap: int | None = None
    neutral: bool = False
    seed: int = 7
    bins: int = 64
    leaves: int | None = None
    columns: float = 1.0
    ridge: float = 0.0
    kind: str = "gradient"  # or "symmetric", "adaptive"


# The parameter sets of the ensemble and of the single boosters.
ENSEMBLE = (
    Booster("next_rank", 80, 3, 0.06, 1500, 0.6, 1500.0, 8000, leaves=7),
    Booster("next_rank_residual", 80, 3, 0.06, 1500, 0.6, 800.0, 5000, True, leaves=7),
    Booster("next_rank_residual", 80, 3, 0.06, 1500, 0.6, 1500.0, 8000, True, leaves=7),
    Booster("next_rank_residual", 80, 3, 0.06, 1500, 0.6, 3000.0, 12000, True, leaves=7),
)
LGB = Booster("target_rank", 200, 4, 0.05, 500, leaves=15, columns=0.8, ridge=5.0)
XGB = Booster("target_rank", 200, 4, 0.05, 50, columns=0.8, ridge=5.0)
CAT = Booster("target_rank", 200, 4, 0.05, 1, 1.0, ridge=5.0, kind="symmetric")
CAT_ONE_BAR = replace(CAT, label="next_rank")
PATH = Booster("forward_path", 250, 4, 0.05, 200, 1.0, seed=31)
ADA = Booster("target_rank", 200, 4, 0.05, 200, 1.0, kind="adaptive")


def training_weight(b: Booster, train: int) -> Column:
    """Weight of the rows that a booster learns from, null elsewhere: labelled rows of each period's first ``train``
    bars, less those whose label reaches past them, the most recent ``cap`` bars of them; weights halve every
    ``half_life`` bars."""
    age = F.lit(train - 1) - (F.col("bar") - F.min("bar").over(Window.partitionBy("period")))
    fits = (age >= REACH[b.label]) & F.col(b.label).isNotNull()
    if b.cap:
        fits = fits & (age < b.cap)
    return F.when(fits, F.pow(F.lit(0.5), age / b.half_life) if b.half_life else F.lit(1.0))


def predictions(b: Booster, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of all rows, by a model of those that have a weight; 0 without any."""
    rows = np.isfinite(w)
    if not rows.any():
        return np.zeros(len(x))
    shape = boost.Shape(b.depth, b.least, b.ridge, b.kind == "symmetric", b.leaves)
    if b.kind == "adaptive":
        return boost.adaptive_boosted(x[rows], y[rows], w[rows], x, b.rounds, b.rate, shape, b.bins)
    return boost.gradient_boosted(x[rows], y[rows], w[rows], x, b.rounds, b.rate, shape, b.subsample, b.columns, b.bins, b.seed)


def boosted(df: DataFrame, names: list[str], boosters: dict[str, Booster], train: int) -> DataFrame:
    """period, bar, name_ix and a column of raw predictions for each booster; a model a period.

    ``df`` has the features ``names`` and the boosters' labels. Rows are taken in the order of bar and name, so
    draws don't depend on how they arrive.
    """
    labels = sorted({b.label for b in boosters.values()})
    rows = df.select("period", "bar", "name_ix", *names, *labels, *[training_weight(b, train).alias(f"weight_{c}") for c, b in boosters.items()])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bar", "name_ix"], kind="stable")
        x = np.nan_to_num(pdf[names].to_numpy(np.float64))
        out = pdf[["period", "bar", "name_ix"]].copy()
        for column, b in boosters.items():
            out[column] = predictions(b, x, pdf[b.label].to_numpy(np.float64), pdf[f"weight_{column}"].to_numpy(np.float64))
        return out

    prepare(df.sparkSession)
    schema = "period int, bar bigint, name_ix int, " + ", ".join(f"{c} double" for c in boosters)
    return rows.groupBy("period").applyInPandas(run, schema)


def ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank of the mean of ranks of some prediction columns, de-meaned: period, bar, name_ix, score."""
    from .expr import field

    ranks = [rank(field(c)) for c in columns]
    mean = sum(ranks[1:], ranks[0]) * (1 / len(ranks))
    return evaluate(df, {"score": x.demean(rank(mean))})


def with_labels(panel: DataFrame, features: dict[str, Node], labels: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Features and labels of the panel."""
    return evaluate(panel, features | {n: LABELS[n] for n in labels}, extra)
