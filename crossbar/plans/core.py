"""The core leg: five ranked parts off market beta and partly off reversal, and the trend leg beside it.

Everything that one name's history or one bar can say is a signal of the graph; only the parts that need pairs of
names (lead-lag and co-movement) are kernels. Rows before the last ``tail`` training bars count by a common weight,
as ``cap`` rows in sum; of a training part that is hardly longer than the tail they don't count at all.
"""

from __future__ import annotations

import numpy as np

from ..functions.scalar import clip, fill, snap, tanh
from ..operators import cross as x
from ..operators import matrix as m
from ..operators import series as t
from . import components as c
from .expr import TS, Node, each, number, over_history
from .predictors import lagged_reversal

# Weights of the five parts of the core.
PARTS = {"spread": 0.3229, "state": 0.2656, "top": 0.1556, "innovation": 0.1493, "full": 0.1065}
#: Of lagged reversal beside the lead-lag and fade parts of the state, and of what is taken off along reversal.
LAGGED_SHARE, REVERSAL_SHARE = 0.8, 0.25
FIELDS = ("spread", "fade", "lagged", "innovation", "u", "p", "near", "far", "beta", "trend")


def old_rows(train: int, tail: int, least: int, cap: int) -> tuple[int, float]:
    """How many rows come before the tail, and the weight of each."""
    start = max(0, train - tail)
    return start, 0.0 if start <= least else min(1.0, cap / start)


class Weighted:
    """Expanding moments in which the first ``start`` rows of a period count by ``share``."""

    def __init__(self, start: int, share: float):
        self.start, self.share = start, share
        self.place = over_history("place", lambda d: f"row_number() OVER ({TS})")
        self.weight = each("share", lambda d, a: f"(CASE WHEN {a} <= {start} THEN {number(float(share))} ELSE 1.0e0 END)", self.place, params=(start, share))
        self.mass = t.rolling_sum(self.weight, None)

    def sum(self, v: Node) -> Node:
        return t.rolling_sum(fill(v) * self.weight, None)

    def mean(self, v: Node) -> Node:
        return self.sum(v) / self.mass

    def deviation(self, v: Node, least: int) -> Node:
        """Null until more than ``least`` rows count."""
        make = lambda d, a, b, n: f"(CASE WHEN {n} > {least} THEN sqrt(greatest({b} / {n} - ({a} / {n}) * ({a} / {n}), 1.0e-18)) END)"
        return each("share_std", make, self.sum(v), self.sum(v * v), self.mass, params=(least,))

    def after(self, v: Node, rows: int) -> Node:
        """0 in the first rows that count where none before them do."""
        if self.share:
            return v
        return each("after_rows", lambda d, a, i: f"(CASE WHEN {i} > {self.start + rows} THEN {a} ELSE 0.0e0 END)", v, self.place, params=(self.start, rows))


def signals(train: int, tail: int, least: int, cap: int) -> dict[str, Node]:
    """One column for each of FIELDS."""
    w = Weighted(*old_rows(train, tail, least, cap))
    f1, f3, f4, f6 = (fill(c.field(n)) for n in ("f1", "f3", "f4", "f6"))
    moved = x.demean(f1)
    u = fill(clip(moved / (w.deviation(moved, 10) + 1e-12), 3.0))
    surprise = fill(clip(c.e3 / (w.deviation(c.e3, 20) + 1e-9), 5.0))
    p = fill(clip(moved / (t.rolling_std(moved, 60, 10) + 1e-9), 5.0))
    short, long = t.rolling_sum(p, 10), t.rolling_sum(p, 40)
    habit = w.sum(u * fill(t.lag(u))) / (w.sum(u * u) + 1e-9)
    reversal = x.demean(-x.rank_ordinal(f1))
    trend = w.after(x.rank_ordinal(tanh(5.0 * fill(habit)) * u), 30)
    return {
        "spread": x.rank_ordinal(t.ts_rank(f4 - f1, 60, 20)),
        "fade": w.after(-x.rank_ordinal((f6 - w.mean(f6)) / (w.deviation(f6, 10) + 1e-12)), 30),
        "lagged": lagged_reversal(),
        "innovation": w.after(x.rank_ordinal(t.decay_linear(surprise, 5)), 30),
        "u": u,
        "p": p,
        "near": fill(short / (w.deviation(short, 20) + 1e-9)),
        "far": t.ts_rank(long, 120, 40),
        "beta": c.beta,
        "trend": x.rank_ordinal(snap(x.demean(x.project_off(trend, reversal)))),
    }


def blend(f: dict[str, np.ndarray], train: int, tail: int, least: int, cap: int, centre_beta: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(core, trend, beta) of one period from its columns ``signals`` (and f1)."""
    start, share = old_rows(train, tail, least, cap)
    n, k = f["f1"].shape
    weights = np.where(np.arange(n) < start, share, 1.0)
    young = 0 if share else start + 41  # without old rows the pairs begin at the tail
    lead = m.rank_one(m.expanding_adjacency(f["u"], max(1, young - 1), weights))
    lead[:young] = 0.0
    tops, fulls = np.zeros((n, k)), np.zeros((n, k))
    warm = 1 if share else start + 30
    for rows, full, top in m.pair_weights(f["p"], warm, weights):
        tops[rows], fulls[rows] = m.relative_fade(top, f["near"][rows]), m.relative_fade(full, f["far"][rows])
    tops[:warm] = fulls[:warm] = 0.0
    made = {"spread": f["spread"], "state": m.centre(lead + f["fade"] + LAGGED_SHARE * f["lagged"]), "top": tops, "innovation": f["innovation"], "full": fulls}
    core = sum(share_of * made[name] for name, share_of in PARTS.items())
    for direction, part in ((m.centre(f["beta"]) if centre_beta else f["beta"], 1.0), (m.centre(-m.rank_one(f["f1"])), REVERSAL_SHARE)):
        core = core - part * m.project(core, direction)
    return m.centre(core), f["trend"], f["beta"]
