"""Row-wise functions. Nulls stay null unless a function says otherwise."""

from __future__ import annotations

from ..plans.expr import Node, each, number


def fill(x: Node, value: float = 0.0) -> Node:
    """Null as ``value``."""
    return each("fill", lambda d, a: f"coalesce({a}, {number(value)})", x, params=(value,))


def magnitude(x: Node) -> Node:
    return each("abs", lambda d, a: f"abs({a})", x)


def sign(x: Node) -> Node:
    return each("sign", lambda d, a: f"CAST(sign({a}) AS DOUBLE)", x)


def log1p(x: Node) -> Node:
    return each("log1p", lambda d, a: f"ln(1 + {a})", x)


def tanh(x: Node) -> Node:
    return each("tanh", lambda d, a: f"tanh({a})", x)


def exp(x: Node) -> Node:
    return each("exp", lambda d, a: f"exp({a})", x)


def root(x: Node) -> Node:
    """Square root of what is above zero, else 0."""
    return each("sqrt", lambda d, a: f"sqrt(CASE WHEN {a} > 0 THEN {a} WHEN {a} <= 0 THEN 0 END)", x)


def at_least(x: Node, low: float) -> Node:
    return each("at_least", lambda d, a: f"(CASE WHEN {a} < {number(low)} THEN {number(low)} ELSE {a} END)", x, params=(low,))


def clip(x: Node, limit: float) -> Node:
    """Between -limit and limit."""
    m = number(limit)
    return each("clip", lambda d, a: f"(CASE WHEN {a} < -{m} THEN -{m} WHEN {a} > {m} THEN {m} ELSE {a} END)", x, params=(limit,))


def soft_threshold(x: Node, cut: float) -> Node:
    """Towards zero by ``cut``, zero inside it."""
    return each("soft", lambda d, a: f"(CAST(sign({a}) AS DOUBLE) * (CASE WHEN abs({a}) > {number(cut)} THEN abs({a}) - {number(cut)} WHEN {a} IS NOT NULL THEN 0 END))", x, params=(cut,))


def where(condition: Node, yes, no) -> Node:
    """``yes`` where the condition holds, ``no`` elsewhere (also where it is null)."""
    return each("where", lambda d, c, a, b: f"(CASE WHEN {c} THEN {a} ELSE {b} END)", condition, yes, no)


def compare(a: Node, operator: str, b) -> Node:
    return each(f"cmp{operator}", lambda d, x, y: f"({x} {operator} {y})", a, b)


def flow(f1: Node, f5: Node) -> Node:
    """Signed log flow: the sign of a return times log(1 + volume)."""
    return sign(f1) * log1p(magnitude(f5))


def logistic(x: Node, steepness: float) -> Node:
    return each("logistic", lambda d, a: f"(1 / (1 + exp(-{number(steepness)} * {a})))", x, params=(steepness,))


def convex(r: Node) -> Node:
    """-(r |r|)."""
    return -(r * magnitude(r))


def snap(x: Node, places: int = 9) -> Node:
    """Rounded, so that values equal up to the last digits of sums tie in a rank."""
    return each("snap", lambda d, a: f"round({a}, {places})", x, params=(places,))
