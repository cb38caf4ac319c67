"""Cross-sectional operators: windows over the names of one bar. Null policy: nulls are skipped and stay null.

Average ranks need no extra sort: the number of tied rows is a RANGE frame of the same window as the rank.
Ordinal ranks break ties by name index, so results don't depend on the order of rows.
"""

from __future__ import annotations

from ..functions.scalar import clip, fill, magnitude
from ..plans.expr import XS, Node, each, number, over_bar

_RANKED = f"{XS} ORDER BY {{}} NULLS LAST"


def _xs(name: str, call: str):
    def op(x: Node) -> Node:
        return over_bar(name, lambda d, a: f"{call.format(a)} OVER ({XS})", x)

    op.__name__, op.__doc__ = name, f"{call.format('x')} over the bar."
    return op


mean = _xs("mean", "avg({})")
total = _xs("total", "sum({})")
std_pop = _xs("std_pop", "stddev_pop({})")
std_samp = _xs("std_samp", "stddev_samp({})")
present = _xs("present", "count({})")
least = _xs("least", "min({})")
greatest = _xs("greatest", "max({})")


def size() -> Node:
    """Rows of the bar, nulls included."""
    return over_bar("size", lambda d: f"count(*) OVER ({XS})")


def dot(a: Node, b: Node) -> Node:
    return over_bar("dot", lambda d, x, y: f"sum({x} * {y}) OVER ({XS})", a, b)


def demean(x: Node) -> Node:
    return x - mean(x)


def demean_strict(x: Node) -> Node:
    """De-meaned; a bar with any missing value is all null."""
    return each("strict", lambda d, a, n, j: f"(CASE WHEN {n} = {j} THEN {a} END)", demean(x), present(x), size())


def _average_rank(x: Node) -> Node:
    def make(d, a):
        w = _RANKED.format(a)
        ties = f"count({a}) OVER ({w} RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
        return f"(CASE WHEN {a} IS NOT NULL THEN rank() OVER ({w}) + ({ties} - 1) / 2.0e0 END)"

    return over_bar("average_rank", make, x)


def _spread(rank: Node, n: Node) -> Node:
    """Ranks 1..n on [-1, 1]; null for a lone row."""
    return each("spread", lambda d, r, j: f"(({r} - ({j} + 1) / 2.0e0) / nullif(({j} - 1) / 2.0e0, 0))", rank, n)


def rank_average(x: Node) -> Node:
    """Average rank on [-1, 1], scaled by all names of the bar; a lone name gets 0."""
    return each("lone0", lambda d, a, r, j: f"(CASE WHEN {j} < 2 AND {a} IS NOT NULL THEN 0 ELSE {r} END)", x, _spread(_average_rank(x), size()), size())


def rank_present(x: Node) -> Node:
    """Average rank on [-1, 1] among the names that have a value; null as 0, then de-meaned."""
    return demean(fill(_spread(_average_rank(x), present(x))))


def rank_percent(x: Node) -> Node:
    """Average rank divided by the number of values."""
    return _average_rank(x) / present(x)


def ordinal(x: Node) -> Node:
    """Rank 1..n, ties by name index, nulls last."""
    return over_bar("ordinal", lambda d, a: f"row_number() OVER ({XS} ORDER BY {a} NULLS LAST, name_ix)", x)


def rank_ordinal(x: Node) -> Node:
    """Ordinal rank on [-1, 1]."""
    return fill(_spread(ordinal(x), size()))


def rank_half(x: Node) -> Node:
    """Ordinal rank on [-0.5, 0.5]."""
    return each("half", lambda d, r, j: f"(({r} - 1) / nullif({j} - 1.0e0, 0) - 5.0e-1)", ordinal(x), size())


def rank_centred(x: Node) -> Node:
    """Ordinal rank from 0, centred on [-1, 1]."""
    return each("centred", lambda d, r, j: f"(({r} - 1 - ({j} - 1) / 2.0e0) / nullif(({j} - 1) / 2.0e0, 0))", ordinal(x), size())


def zscore(x: Node, eps: float = 1e-9) -> Node:
    return demean(x) / (std_pop(x) + eps)


def unit(x: Node) -> Node:
    """Divided by the bar's population deviation, at least 1e-12."""
    return each("unit", lambda d, a, s: f"({a} / greatest({s}, 1.0e-12))", x, std_pop(x))


def unit_demeaned(x: Node) -> Node:
    return unit(demean(x))


def standard_clipped(x: Node, limit: float = 3.0) -> Node:
    """De-meaned, unit, clipped; a bar with any missing value is all zero."""
    bad = each("any_null", lambda d, n, j: f"({n} < {j})", present(x), size())
    inner = clip(unit(demean(fill(x))), limit)
    return each("unless", lambda d, b, a: f"(CASE WHEN {b} THEN 0 ELSE {a} END)", bad, inner)


def zclip(x: Node, limit: float = 3.0) -> Node:
    return clip(unit(demean(x)), limit)


def rms_shape(x: Node, limit: float = 3.0, tiny: float = 1e-12) -> Node:
    """De-meaned, scaled by root mean square, winsorised, de-meaned again."""
    c = demean(x)
    rms = over_bar("rms", lambda d, a: f"sqrt(avg({a} * {a}) OVER ({XS}))", c)
    return demean(clip(c / (rms + tiny), limit))


def residual2(y: Node, x1: Node, x2: Node, ridge: float = 0.0) -> Node:
    """Residual of y on a constant, x1 and x2 in each bar, in closed form."""
    ym, a, b = demean(y), demean(x1), demean(x2)
    aa, ab, bb, ay, by = dot(a, a) + ridge, dot(a, b), dot(b, b) + ridge, dot(a, ym), dot(b, ym)
    det = aa * bb - ab * ab + 1e-18
    return ym - a * ((bb * ay - ab * by) / det) - b * ((aa * by - ab * ay) / det)


def residual(y: Node, xs: list[Node]) -> Node:
    """Residual of y on a constant and any number of regressors in each bar, null as 0: each regressor is first
    made orthogonal to those before it, and one that depends on them adds nothing."""
    basis: list[Node] = []
    for v in xs:
        v = demean(fill(v))
        size = dot(v, v)
        for b in basis:
            v = project_off(v, b)
        # what is left of a dependent regressor is rounding
        basis.append(each("independent", lambda d, a, s, n: f"(CASE WHEN {s} > 1.0e-18 * {n} THEN {a} ELSE 0.0e0 END)", v, dot(v, v), size))
    out = demean(fill(y))
    for b in basis:
        out = project_off(out, b)
    return out


def shape_rows(x: Node, limit: float = 4.0, tiny: float = 1e-12) -> Node:
    """De-meaned, scaled by root mean square, winsorised."""
    c = demean(fill(x))
    return clip(c / (over_bar("rms", lambda d, a: f"sqrt(avg({a} * {a}) OVER ({XS}))", c) + tiny), limit)


def project_off(v: Node, r: Node, share: float = 1.0, eps: float = 1e-18) -> Node:
    """v without ``share`` of its component along r."""
    return v - (dot(v, r) / (dot(r, r) + eps)) * r * share


def neutralise(v: Node, exposure: Node, centre: bool = True) -> Node:
    """Off an exposure; centred first unless told otherwise (the constant part then stays in the divisor)."""
    return project_off(v, demean(exposure) if centre else exposure)


def off_unit(v: Node, u: Node) -> Node:
    """Exactly orthogonal to the direction of u, guarded where u is zero."""
    return v - fill(dot(v, u) / dot(u, u)) * u


def same_norm(q: Node, p: Node) -> Node:
    """q with the norm of p."""
    return each("norm", lambda d, a, pp, qq: f"({a} * sqrt({pp}) / (sqrt({qq}) + 1.0e-18))", q, dot(p, p), dot(q, q))


def extreme(x: Node, tail: float = 0.2) -> Node:
    """1 in the lowest or highest share of the bar, else 0; null stays null."""
    p = rank_percent(x)
    return each("extreme", lambda d, a: f"(CASE WHEN {a} <= {number(tail)} OR {a} >= {number(1 - tail)} THEN 1.0e0 WHEN {a} IS NOT NULL THEN 0.0e0 END)", p, params=(tail,))


def big_move(f1: Node, sd: Node, r: Node, times: float = 2.0) -> Node:
    """-r where the move is at least ``times`` deviations, else 0."""
    return each("big_move", lambda d, a, s, x: f"(CASE WHEN {a} >= {number(times)} * {s} THEN -{x} ELSE 0 END)", magnitude(f1), sd, r, params=(times,))


def mixture(w: Node, a: Node, b: Node) -> Node:
    """w a + (1 - w) b."""
    return w * a + (1.0 - w) * b


def blend(parts: list[tuple[Node, float]]) -> Node:
    """Weighted sum of de-meaned parts (null as 0), de-meaned."""
    out = None
    for x, w in parts:
        one = demean(fill(x)) * w
        out = one if out is None else out + one
    return demean(out)
