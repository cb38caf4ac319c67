"""Time-series operators: windows over one name's rows, none of which looks past the current bar (labels aside).

``least`` is the number of values a window needs; with fewer the result is null. The cost of a row is bounded whatever
the length of the window. Up to FRAME rows a sliding frame aggregates its rows anew; beyond that:

    sums, extremes and moments   a window is the end of one block of its own length and the beginning of the next, so
                                 it is made of two running aggregates, one from each side; nothing is subtracted, so no
                                 digits are lost either way
    ranks                        order statistics by digits: values are numbered by size, and those below are counted
                                 digit by digit of that number, in running counts
    exponential means            scaled prefix sums: one running sum in a block of bars and the sum of the block before

``to_sql`` says all of them as plain windows.
"""

from __future__ import annotations

import math

from ..functions.scalar import clip, fill, magnitude, root, tanh
from ..plans.expr import DUCKDB, TS, Node, each, for_short, number, over_history, said_plainly
from . import cross

_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _frame(w: int | None, last: int = 0) -> str:
    if w is None:
        return f"{TS} {_ALL}"
    end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
    return f"{TS} ROWS BETWEEN {w - 1 + last} PRECEDING AND {end}"


def _gated(name: str, call: str, w: int | None, least: int, x: Node, last: int = 0) -> Node:
    f = _frame(w, last)
    return over_history(name, lambda d, a: f"(CASE WHEN count({a}) OVER ({f}) >= {least} THEN {call.format(a)} OVER ({f}) END)", x, params=(w, least, last))


def lag(x: Node, k: int = 1) -> Node:
    return over_history("lag", lambda d, a: f"lag({a}, {k}) OVER ({TS})", x, params=(k,))


def lead(x: Node, k: int = 1) -> Node:
    """For labels only."""
    return over_history("lead", lambda d, a: f"lead({a}, {k}) OVER ({TS})", x, params=(k,))


def lead_sum(x: Node, first: int = 2, last: int = 5) -> Node:
    """Sum of the rows first..last ahead, null where they aren't all there. For labels only."""
    f = f"{TS} ROWS BETWEEN {first} FOLLOWING AND {last} FOLLOWING"
    return over_history("lead_sum", lambda d, a: f"(CASE WHEN count({a}) OVER ({f}) = {last - first + 1} THEN sum({a}) OVER ({f}) END)", x, params=(first, last))


#: Rows that a sliding frame may have, and rows that a rank compares one by one.
FRAME, COMPARED = 512, 128
#: The number of a row in its name's history, from 1.
position = over_history("position", lambda d: f"row_number() OVER ({TS})")
_RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _sides(name: str, call: str, w: int, x: Node) -> tuple[Node, Node]:
    """An aggregate of the window's rows in the block before, and of those in the row's own block of w rows.

    The first is that of the rows from the window's start to the end of its block; where a window fills one block
    exactly, the two are the same rows.
    """
    block = f"PARTITION BY period, name_ix, ({{}} - 1) div {w} ORDER BY {{}}"

    def side(order: str, kind: str) -> Node:
        return over_history(f"{kind}_{name}", lambda d, p, a: f"{call.format(a)} OVER ({block.format(p, p)}{order} {_RUN})", position, x, params=(w,))

    return lag(side(" DESC", "rest"), w - 1), side("", "here")


def _counted(x: Node, w: int) -> Node:
    """Values in the last w rows: a difference of whole numbers."""
    running = over_history("count_all", lambda d, a: f"count({a}) OVER ({_frame(None)})", x)
    return running - fill(lag(running, w))


def _rolling_total(x: Node, w: int, least: int, mean: bool) -> Node:
    before, here = _sides("sum", "sum({})", w, x)

    def make(d, p, b, h, n):
        total = f"(CASE WHEN {p} % {w} <> 0 AND {b} IS NOT NULL THEN coalesce({h}, 0) + {b} ELSE {h} END)"
        return f"(CASE WHEN {n} >= {least} THEN {total}{f' / {n}' if mean else ''} END)"

    return each("roll_mean" if mean else "roll_total", make, position, before, here, _counted(x, w), params=(w, least))


def rolling_mean(x: Node, w: int | None, least: int = 1) -> Node:
    plain = _gated("roll_mean", "avg({})", w, least, x)
    return plain if w is None or w <= FRAME else said_plainly(_rolling_total(x, w, least, True), plain)


def rolling_sum(x: Node, w: int | None, least: int = 1) -> Node:
    plain = _gated("roll_sum", "sum({})", w, least, x)
    return plain if w is None or w <= FRAME else said_plainly(_rolling_total(x, w, least, False), plain)


def long_sum(x: Node, w: int) -> Node:
    """Rolling sum with null as 0; the cost of a row doesn't grow with the window."""
    return rolling_sum(fill(x), w)


def _moments(x: Node, w: int, third: bool = False) -> tuple[Node, Node, Node]:
    """Centred moments of the last w rows: number of values, sum of squared and (if asked for) of cubed deviations.

    Each block is shifted by its first value, so that an offset costs no digits, and the moments of the two sides are
    merged by the difference of their means.
    """
    first = over_history("block_first", lambda d, p, a: f"first({a}, true) OVER (PARTITION BY period, name_ix, ({p} - 1) div {w} ORDER BY {p} {_RUN})", position, x, params=(w,))
    y = x - first
    n, mean, var = (_sides(c, f"{c}({{}})", w, y) for c in ("count", "avg", "var_pop"))
    shift = _sides("max", "max({})", w, first)
    cube = _sides("cube", "sum({0} * {0} * {0})", w, y) if third else ((0, 0))

    def parts(p, nb, nh, mb, mh, vb, vh, sb, sh):
        """Numbers of the sides, the distance of their means, and their own sums of squares; a side without values is 0."""
        a = f"(CASE WHEN {p} % {w} <> 0 THEN coalesce({nb}, 0) ELSE 0 END)"
        gap = f"coalesce(({sh} - {sb}) + ({mh} - {mb}), 0)"
        return a, f"{nh}", gap, f"coalesce({vb}, 0) * {a}", f"coalesce({vh}, 0) * {nh}"

    def squares(d, *args):
        a, h, gap, sa, sh = parts(*args)
        return f"({sa} + {sh} + {gap} * {gap} * ({a} * {h} / nullif(CAST({a} + {h} AS DOUBLE), 0)))"

    def cubes(d, *args):
        *args, cb, ch, mb, mh = args
        a, h, gap, sa, sh = parts(*args)
        own = lambda c, m, s, k: f"(coalesce({c}, 0) - 3 * coalesce({m}, 0) * {s} - coalesce({m}, 0) * coalesce({m}, 0) * coalesce({m}, 0) * {k})"
        n = f"nullif(CAST({a} + {h} AS DOUBLE), 0)"
        both = f"power({gap}, 3) * {a} * {h} * ({a} - {h}) / ({n} * {n}) + 3 * {gap} * ({a} * {sh} - {h} * {sa}) / {n}"
        return f"((CASE WHEN {a} > 0 THEN {own(cb, mb, sa, a)} ELSE 0 END) + {own(ch, mh, sh, h)} + {both})"

    given = (position, *n, *mean, *var, *shift)
    count = _counted(x, w)
    m2 = each("squares", squares, *given, params=(w,))
    return count, m2, each("cubes", cubes, *given, *cube, *mean, params=(w,)) if third else m2


def rolling_std(x: Node, w: int | None, least: int = 2) -> Node:
    plain = _gated("roll_std", "stddev_samp({})", w, least, x)
    if w is None or w <= FRAME:
        return plain
    n, m2, _ = _moments(x, w)
    return said_plainly(each("roll_deviation", lambda d, k, s: f"(CASE WHEN {k} >= {max(2, least)} THEN sqrt({s} / ({k} - 1)) END)", n, m2, params=(w, least)), plain)


def _rolling_extreme(x: Node, w: int | None, least: int, call: str, pick: str) -> Node:
    plain = _gated(f"roll_{call}", f"{call}({{}})", w, least, x)
    if w is None or w <= FRAME:
        return plain
    made = each(f"either_{call}", lambda d, a, b, n: f"(CASE WHEN {n} >= {least} THEN {pick}({a}, {b}) END)", *_sides(call, f"{call}({{}})", w, x), _counted(x, w), params=(w, least))
    return said_plainly(made, plain)


def rolling_max(x: Node, w: int | None, least: int = 1) -> Node:
    return _rolling_extreme(x, w, least, "max", "greatest")


def rolling_min(x: Node, w: int | None, least: int = 1) -> Node:
    return _rolling_extreme(x, w, least, "min", "least")


def before_mean(x: Node, w: int) -> Node:
    """Mean of the w rows before the current one."""
    return _gated("before_mean", "avg({})", w, 1, x, last=1)


def before_sum(x: Node, w: int) -> Node:
    """Sum of the w rows before the current one; nothing before the first row is 0."""
    return fill(_gated("before_sum", "sum({})", w, 1, x, last=1))


def cumulate(x: Node) -> Node:
    return rolling_sum(x, None)


def cumulate_product(x: Node) -> Node:
    """Running product of 1 + x, as the exponential of a running sum; null from a factor at or below 0 on."""
    logs = each("log_factor", lambda d, a: f"(CASE WHEN 1 + {a} > 0 THEN ln(1 + {a}) END)", x)
    bad = each("bad_factor", lambda d, a: f"(CASE WHEN 1 + {a} <= 0 THEN 1 ELSE 0 END)", x)
    total = rolling_sum(logs, None)
    return each("product", lambda d, s, b: f"(CASE WHEN {b} = 0 THEN exp({s}) END)", total, rolling_sum(bad, None))


def _list(dialect: str, x: str, frame: str) -> str:
    if dialect == DUCKDB:
        return f"(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({frame}))"
    return f"collect_list({x}) OVER ({frame})"


#: Bits of a digit of a value's number, and digits: together for histories of up to 2^18 rows.
DIGIT_BITS, DIGITS = 3, 6


def _plain_rank(x: Node, w: int | None, least: int) -> Node:
    f = _frame(w)
    window = over_history("window_list", lambda d, a: _list(d, a, f), x, params=(w,))

    def make(d, a, v):
        keep = (lambda c: f"len(list_filter({v}, lambda q: q {c} {a}))") if d == DUCKDB else (lambda c: f"size(filter({v}, q -> q {c} {a}))")
        n = f"len({v})" if d == DUCKDB else f"size({v})"
        return f"(CASE WHEN {n} >= {least} AND {a} IS NOT NULL THEN ({keep('<')} + ({keep('=')} + 1) / 2.0e0) / {n} END)"

    return each("rolling_rank", make, x, window, params=(least,))


def _compared_rank(x: Node, w: int, least: int) -> Node:
    """The rank by comparing with each of the rows before: 2 for a smaller value, 1 for an equal one."""
    others = over_history("not_above", lambda d, a: "(" + " + ".join(["0", *(f"coalesce(1 - sign(lag({a}, {k}) OVER ({TS}) - {a}), 0)" for k in range(1, w))]) + ")", x, params=(w,))
    return each("compared_rank", lambda d, a, o, k: f"(CASE WHEN {k} >= {least} AND {a} IS NOT NULL THEN ({o} / 2.0e0 + 1) / {k} END)", x, others, _counted(x, w), params=(least,))


def rolling_rank(x: Node, w: int | None, least: int, digits: int = DIGITS) -> Node:
    """Average rank of the current value in its window, as a share of the window's values.

    A short window compares the current value with each of the ones before. In a longer one, or over all rows so far,
    the values of a history are numbered by size. Below a value are those whose number has the same higher digits and a
    smaller digit somewhere: running counts among the rows of equal higher digits, less those before the window began.
    A history of more different values than the digits can number is an error, never a wrong rank.
    """
    if w is not None and w <= COMPARED:
        return said_plainly(_compared_rank(x, w, least), _plain_rank(x, w, least))
    base = 1 << DIGIT_BITS
    number_ = over_history("size_number", lambda d, a: f"(CASE WHEN {a} IS NOT NULL THEN dense_rank() OVER (PARTITION BY period, name_ix ORDER BY {a} NULLS LAST) - 1 END)", x)

    place = [] if w is None else [position]

    def in_window(call: str, among: str, p: str) -> str:
        by = f"PARTITION BY period, name_ix, {among} ORDER BY"
        if w is None:
            return f"{call} OVER ({by} bar {_RUN})"
        upto = f"{by} {p} RANGE BETWEEN UNBOUNDED PRECEDING AND"
        return f"{call} OVER ({upto} CURRENT ROW) - coalesce({call} OVER ({upto} {w} PRECEDING), 0)"

    def level(k: int) -> Node:
        digit, higher = f"shiftright({{0}}, {k * DIGIT_BITS}) % {base}", f"shiftright({{0}}, {(k + 1) * DIGIT_BITS})"

        def make(d, v, p="bar"):
            own, among = digit.format(v), higher.format(v)
            cases = " ".join(f"WHEN {q} THEN {in_window(f'count(CASE WHEN {own} < {q} THEN 1 END)', among, p)}" for q in range(1, base))
            return f"(CASE {own} {cases} ELSE 0 END)"

        return over_history("below", make, number_, *place, params=(w, k))

    below = level(0)
    for k in range(1, digits):
        below = below + level(k)
    equal = over_history("equal", lambda d, v, p="bar": in_window("count(*)", v, p), number_, *place, params=(w,))
    n = _counted(x, w) if w is not None else over_history("count_all", lambda d, a: f"count({a}) OVER ({_frame(None)})", x)

    def make(d, v, b, e, k):
        known = f"(CASE WHEN {v} < {base**digits} THEN {b} ELSE raise_error('more values than {digits} digits can number') END)"
        return f"(CASE WHEN {k} >= {least} AND {v} IS NOT NULL THEN ({known} + ({e} + 1) / 2.0e0) / {k} END)"

    return said_plainly(each("digit_rank", make, number_, below, equal, n, params=(least, digits)), _plain_rank(x, w, least))


def history_rank(x: Node, least: int) -> Node:
    """Rank among all values so far; histories of COMPARED rows at most are looked at as lists."""
    made = each("same", lambda d, a: a, rolling_rank(x, None, least))
    return for_short(said_plainly(made, _plain_rank(x, None, least)), lambda rows: _plain_rank(x, None, least) if rows <= COMPARED else None)


def ts_rank(x: Node, w: int, least: int | None = None) -> Node:
    """Rolling rank on [-1, 1], null as 0."""
    return fill(2.0 * rolling_rank(x, w, max(5, w // 3) if least is None else least) - 1.0)


def _decayed(x: Node, keep: float) -> tuple[Node, Node]:
    """Sums of keep^age times value, and of keep^age, over all rows with a value."""
    block = max(1, int(300 / -math.log(keep)))
    part = f"PARTITION BY period, name_ix, CAST(floor(bar / {number(float(block))}) AS BIGINT) ORDER BY bar {_ALL}"
    prior = f"PARTITION BY period, name_ix ORDER BY CAST(floor(bar / {number(float(block))}) AS BIGINT) RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING"
    grown = f"power({number(keep)}, -(bar % {block}))"
    shrink, across = f"power({number(keep)}, bar % {block})", f"power({number(keep)}, bar % {block} + {block})"

    def total(name: str, value) -> Node:
        return over_history(
            name,
            lambda d, a: f"(coalesce(sum({value(a)} * {grown}) OVER ({part}), 0) * {shrink} + coalesce(sum({value(a)} * {grown}) OVER ({prior}), 0) * {across})",
            x,
            params=(keep,),
        )

    return total("decayed_sum", lambda a: a), total("decayed_mass", lambda a: f"CASE WHEN {a} IS NOT NULL THEN 1 END")


def ewm_mean(x: Node, span: float | None = None, half_life: float | None = None, least: int = 1) -> Node:
    """Exponentially weighted mean with bias correction; weights decay across missing rows."""
    keep = 1 - 2 / (span + 1) if span is not None else 0.5 ** (1 / half_life)
    s, m = _decayed(x, keep)
    return each("ewm", lambda d, a, b, n: f"(CASE WHEN {n} >= {least} THEN {a} / nullif({b}, 0) END)", s, m, over_history("count_all", lambda d, a: f"count({a}) OVER ({_frame(None)})", x), params=(least,))


def ewm_zero(x: Node, span: float) -> Node:
    """The same over values with null as 0, so that missing rows count."""
    return ewm_mean(fill(x), span)


def one_pole(x: Node, half_life: float) -> Node:
    """s_t = d s_{t-1} + (1 - d) x_t from s = 0, null as 0."""
    keep = 0.5 ** (1 / half_life)
    return _decayed(fill(x), keep)[0] * (1 - keep)


def decay_linear(x: Node, w: int) -> Node:
    """Weights w, w - 1, .., 1 back from the current row, over their whole sum; missing rows count as 0."""
    out, mass = fill(x) * float(w), w * (w + 1) / 2
    for k in range(1, w):
        out = out + fill(lag(x, k)) * float(w - k)
    return out * (1 / mass)


def zscore_rolling(x: Node, w: int = 120, least: int = 10) -> Node:
    """(x - mean) / (std + 1e-12) of the window, null as 0."""
    return fill((x - rolling_mean(x, w, least)) / (rolling_std(x, w, least) + 1e-12))


def zscore_clipped(x: Node, w: int = 120, least: int = 20, limit: float = 4.0) -> Node:
    return fill(clip((x - rolling_mean(x, w, least)) / (rolling_std(x, w, least) + 1e-12), limit))


def innovation(x: Node, w: int = 120, least: int = 20, limit: float = 4.0, k: int = 2) -> Node:
    """Rolling z-score less the mean of its last k values, turned round and de-meaned in the bar."""
    z = zscore_clipped(x, w, least, limit)
    return cross.demean(-(z - fill(before_mean(z, k))))


def rolling_beta(x: Node, m: Node, w: int, least: int = 20) -> Node:
    """Slope of x on m by window moments, each with its own gate, centred so that an offset costs no digits: in a sliding
    frame by its own means; in a longer window x and m are shifted by their first values, and where their rows differ,
    what the shift would change is added back."""
    mx, mm = (_gated("roll_mean", "avg({})", w, least, v) for v in (x, m))
    plain = (_gated("roll_mean", "avg({})", w, least, x * m) - mx * mm) / (_gated("roll_mean", "avg({})", w, least, m * m) - mm * mm + 1e-12)
    if w <= FRAME:
        f = _frame(w)

        def make(d, a, b):
            same = " AND ".join(f"count({v}) OVER ({f}) = count({a} * {b}) OVER ({f})" for v in (a, b))
            mean = lambda v: f"(CASE WHEN count({v}) OVER ({f}) >= {least} THEN avg({v}) OVER ({f}) END)"
            raw = f"({mean(f'{a} * {b}')} - {mean(a)} * {mean(b)}) / ({mean(f'{b} * {b}')} - {mean(b)} * {mean(b)} + 1.0e-12)"
            centred = f"covar_pop({a}, {b}) OVER ({f}) / (var_pop({b}) OVER ({f}) + 1.0e-12)"
            return f"(CASE WHEN {same} THEN CASE WHEN count({b}) OVER ({f}) >= {least} THEN {centred} END ELSE {raw} END)"

        return said_plainly(over_history("frame_slope", make, x, m, params=(w, least)), plain)
    x0, m0 = (over_history("history_first", lambda d, a: f"first({a}, true) OVER ({_frame(None)})", v) for v in (x, m))
    y, z = x - x0, m - m0
    mean = lambda v: rolling_mean(v, w, least)
    both = lambda a, b: each("where_both", lambda d, u, v: f"(CASE WHEN {v} IS NOT NULL THEN {u} END)", a, b)
    ey, ez = mean(y), mean(z)
    cross_moment = mean(y * z) - ey * ez + x0 * (mean(both(z, y)) - ez) + m0 * (mean(both(y, z)) - ey)
    return said_plainly(cross_moment / (mean(z * z) - ez * ez + 1e-12), plain)


def expanding_corr(x: Node, y: Node, least: int = 30) -> Node:
    """Correlation over all rows so far by population moments, null as 0."""
    e = lambda v: rolling_mean(v, None, least)
    ex, ey = e(x), e(y)
    den = root(root_product(e(x * x) - ex * ex, e(y * y) - ey * ey))
    return fill((e(x * y) - ex * ey) / (den + 1e-12))


def root_product(a: Node, b: Node) -> Node:
    """Product of two variances, those below 0 as 0."""
    return each("pos_product", lambda d, x, y: f"((CASE WHEN {x} > 0 THEN {x} WHEN {x} <= 0 THEN 0 END) * (CASE WHEN {y} > 0 THEN {y} WHEN {y} <= 0 THEN 0 END))", a, b)


def expanding_std(x: Node, least: int = 10) -> Node:
    """Population deviation so far; in the first rows the mean magnitude where it is 0; at least 1e-12."""
    m = rolling_mean(x, None)
    sd = root(rolling_mean(x * x, None) - m * m)
    n = over_history("count_rows", lambda d, a: f"count(*) OVER ({_frame(None)})", x)
    return each("early", lambda d, s, a, k: f"greatest(CASE WHEN {k} <= {least} AND {s} <= 1.0e-12 THEN {a} ELSE {s} END, 1.0e-12)", sd, rolling_mean(magnitude(x), None), n, params=(least,))


def expanding_std_prior(x: Node, n0: float = 0.0, s1: float = 0.0, s2: float = 0.0, least: int = 10) -> Node:
    """Population deviation so far with the count and sums of earlier rows added. Without any, the first
    ``least`` rows are null: nothing is filled from later rows."""
    n = over_history("count_rows", lambda d, a: f"count(*) OVER ({_frame(None)})", x)
    a, b = rolling_sum(fill(x), None) + s1, rolling_sum(fill(x) * fill(x), None) + s2
    sd = each("prior_std", lambda d, u, v, k: f"sqrt(greatest({v} / ({k} + {number(n0)}) - power({u} / ({k} + {number(n0)}), 2), 1.0e-18))", a, b, n, params=(n0,))
    return each("gate_rows", lambda d, s, k: f"(CASE WHEN {k} + {number(n0)} > {least} THEN {s} END)", sd, n, params=(n0, least))


def expanding_std_pooled(x: Node, least: int = 10) -> Node:
    """Population deviation so far; in the first rows that of all names together."""
    n = over_history("count_rows", lambda d, a: f"count(*) OVER ({_frame(None)})", x)
    m = rolling_mean(x, None)
    own = root(rolling_mean(x * x, None) - m * m)
    s0, s1, s2 = (rolling_sum(cross.total(v), None) for v in (each("one", lambda d, a: f"(CASE WHEN {a} IS NOT NULL THEN 1.0e0 END)", x), x, x * x))
    pooled = root(s2 / s0 - (s1 / s0) * (s1 / s0))
    return each("pooled", lambda d, a, b, k: f"greatest(CASE WHEN {k} < {least} THEN {b} ELSE {a} END, 1.0e-12)", own, pooled, n, params=(least,))


def semi_asymmetry(x: Node, w: int = 60, least: int = 20, eps: float = 1e-12) -> Node:
    """(down - up) / (down + up) of the mean squares below and above 0."""
    up = rolling_mean(each("sq_up", lambda d, a: f"(CASE WHEN {a} > 0 THEN {a} * {a} WHEN {a} <= 0 THEN 0.0e0 END)", x), w, least)
    down = rolling_mean(each("sq_down", lambda d, a: f"(CASE WHEN {a} < 0 THEN {a} * {a} WHEN {a} >= 0 THEN 0.0e0 END)", x), w, least)
    return (down - up) / (down + up + eps)


def vol_of_vol(x: Node, inner: int = 20, outer: int = 60, least: int = 20) -> Node:
    return rolling_std(rolling_std(x, inner, 10), outer, least)


def skew(x: Node, w: int = 60, least: int = 20, eps: float = 1e-12) -> Node:
    """Third standardised moment."""

    def ratio(third: Node, var: Node) -> Node:
        return each("skew", lambda d, t, v: f"({t} / (power(greatest({v}, 0), 1.5e0) + {number(eps)}))", third, var, params=(eps,))

    m1, m2, m3 = (_gated("roll_mean", "avg({})", w, least, v) for v in (x, x * x, x * x * x))
    plain = ratio(m3 - 3.0 * m1 * m2 + 2.0 * m1 * m1 * m1, m2 - m1 * m1)
    if w <= FRAME:
        f = _frame(w)

        def make(d, a):
            spread = f"power(var_pop({a}) OVER ({f}), 1.5e0)"
            shape = f"coalesce(nanvl(skewness({a}) OVER ({f}), 0.0e0), 0.0e0)"
            return f"(CASE WHEN count({a}) OVER ({f}) >= {least} THEN {shape} * {spread} / ({spread} + {number(eps)}) END)"

        return said_plainly(over_history("frame_skew", make, x, params=(w, least, eps)), plain)
    n, squares, cubes = _moments(x, w, third=True)
    share = lambda v: each("share", lambda d, a, k: f"(CASE WHEN {k} >= {least} THEN {a} / {k} END)", v, n, params=(least,))
    return said_plainly(ratio(share(cubes), share(squares)), plain)


def tail_ratio(x: Node, w: int = 60, least: int = 20, eps: float = 1e-12) -> Node:
    """Mean absolute deviation from the rolling mean over the rolling deviation."""
    m = rolling_mean(x, w, least)
    return rolling_mean(magnitude(x - m), w, least) / (rolling_std(x, w, least) + eps)


def extreme_frequency(x: Node, w: int = 60, least: int = 20) -> Node:
    return rolling_mean(cross.extreme(x), w, least)


def downside_beta_gap(x: Node, m: Node, w: int = 60, least: int = 20, eps: float = 1e-12) -> Node:
    """Slope through 0 on falling markets less that on rising ones."""

    def slope(side: str) -> Node:
        xm = each(f"xm{side}", lambda d, a, b: f"(CASE WHEN {b} {side} 0 THEN {a} * {b} WHEN {b} IS NOT NULL THEN 0.0e0 END)", x, m)
        mm = each(f"mm{side}", lambda d, b: f"(CASE WHEN {b} {side} 0 THEN {b} * {b} WHEN {b} IS NOT NULL THEN 0.0e0 END)", m)
        return rolling_sum(xm, w, least) / (rolling_sum(mm, w, least) + eps)

    return slope("<") - slope(">")


def drawdown(price: Node, w: int) -> Node:
    """Distance below the highest value of the window."""
    return rolling_max(price, w) - price


def drawdown_depth(price: Node, sd: Node, w: int = 40) -> Node:
    """Deepest drawdown of the window in deviations, null as 0."""
    return fill(rolling_max(drawdown(price, w), w) / (sd + 1e-9))


def age_of_high(price: Node, w: int = 40) -> Node:
    """Bars since the value was last the highest of its window."""
    high = each("at_high", lambda d, p, m: f"(CASE WHEN {p} >= {m} - 1.0e-12 THEN bar END)", price, rolling_max(price, w))
    return each("age", lambda d, a: f"CAST(bar - {a} AS DOUBLE)", over_history("last_high", lambda d, a: f"max({a}) OVER ({_frame(None)})", high))


def accumulation(price: Node, volume: Node, w: int = 5) -> Node:
    """Running sum of close location times volume, with the window's extremes as high and low; no range is 0."""
    high, low = rolling_max(price, w), rolling_min(price, w)
    location = ((price - low) - (high - price)) / (high - low)
    return cumulate(fill(location * volume))


def volume_share(f5: Node, w: int = 500, scale: float = 1e6) -> Node:
    """Magnitude over its rolling mean."""
    a = magnitude(f5)
    return a / (rolling_mean(a, w) + 1e-12) * scale


def squashed(f5: Node, w: int = 250, least: int = 10) -> Node:
    """tanh of the value in deviations."""
    return tanh(f5 / (rolling_std(f5, w, least) + 1e-9))


def beta_instability(x: Node, m: Node, short: int = 30, long: int = 120, least: int = 10) -> Node:
    return fill(magnitude(rolling_beta(x, m, short, least) - rolling_beta(x, m, long, least)))


def autocorrelation(u: Node, num0: float = 0.0, den0: float = 0.0) -> Node:
    """First autocorrelation so far, sums of earlier rows added."""
    return (rolling_sum(fill(u * lag(u)), None) + num0) / (rolling_sum(u * u, None) + den0 + 1e-9)


def macd(x: Node, fast: int, slow: int) -> Node:
    return ewm_mean(x, fast) - ewm_mean(x, slow)


def lagged_power_scale(x: Node, half_life: float = 60.0, low: float = 0.2, high: float = 5.0) -> Node:
    """x over the root of its exponentially weighted power one bar earlier, the divisor kept in bounds."""
    power = fill(lag(ewm_mean(x * x, half_life=half_life)), 1.0)
    return each("bounded", lambda d, a, p: f"({a} / least(greatest(sqrt({p}), {number(low)}), {number(high)}))", x, power, params=(low, high))


def recency_weight(half_life: float) -> Node:
    """0.5^(age / half-life), age counted from the last bar of the period."""
    last = over_history("last_bar", lambda d: "max(bar) OVER (PARTITION BY period, name_ix)")
    return each("recency", lambda d, b: f"power(5.0e-1, ({b} - bar) / {number(float(half_life))})", last, params=(half_life,))
