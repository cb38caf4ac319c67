"""Signals as expression graphs over the panel, laid out in as few shuffles as possible.

A node is a field, a row-wise map or a window over one bar (``xs``) or one name's history (``ts``). Window
functions can't be nested in one projection, so a graph is cut into stages: all windows of one partitioning
that are ready go into one stage, and the layout stays on a partitioning while it has ready work. Equal
sub-expressions are one node, columns are dropped once nothing needs them, and what isn't reached is never
computed. Catalyst then has one exchange for each change of partitioning, whatever the number of signals.

The same graph can be written as one SQL statement (``to_sql``) for another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

SPARK, DUCKDB = "spark", "duckdb"
KEYS = ("period", "bar", "name_ix")
XS = "PARTITION BY period, bar"
TS = "PARTITION BY period, name_ix ORDER BY bar"


def number(x: float | int) -> str:
    """A literal that both dialects read as a double (exponents) or an integer."""
    return str(x) if isinstance(x, int) else f"{x:.17e}"


class Node:
    """One value per row. Arithmetic gives nodes; division by zero gives null."""

    _known: dict[tuple, Node] = {}
    #: The same value as a plain window, for other engines; None if it is said plainly already.
    plain: Node | None = None
    #: The same value in a panel whose histories have so many rows at most; None if there is nothing simpler.
    short: Callable[[int], Node | None] | None = None

    def __new__(cls, kind: str, name: str, args: tuple = (), make: Callable | None = None, params: tuple = ()):
        key = (kind, name, params, tuple(a.number for a in args))
        if key not in cls._known:
            self = super().__new__(cls)
            self.kind, self.name, self.args, self.make, self.params, self.number = kind, name, args, make, params, len(cls._known)
            cls._known[key] = self
        return cls._known[key]

    def text(self, dialect: str, args: list[str]) -> str:
        return self.make(dialect, *args) if self.make else self.name

    def __add__(self, o):
        return _binary("+", self, o)

    def __radd__(self, o):
        return _binary("+", o, self)

    def __sub__(self, o):
        return _binary("-", self, o)

    def __rsub__(self, o):
        return _binary("-", o, self)

    def __mul__(self, o):
        return _binary("*", self, o)

    def __rmul__(self, o):
        return _binary("*", o, self)

    def __truediv__(self, o):
        return each("div", lambda d, a, b: f"({a} / nullif({b}, 0))", self, o)

    def __neg__(self):
        return each("neg", lambda d, a: f"(-{a})", self)


def field(name: str) -> Node:
    return Node("field", name)


def constant(x: float | int) -> Node:
    return Node("map", number(x), (), lambda d: number(x))


def _node(x) -> Node:
    return x if isinstance(x, Node) else constant(float(x))


def each(name: str, make: Callable, *args, params: tuple = ()) -> Node:
    """A row-wise expression of other nodes."""
    return Node("map", name, tuple(_node(a) for a in args), make, params)


def _binary(sign: str, a, b) -> Node:
    return each(sign, lambda d, x, y: f"({x} {sign} {y})", a, b)


def over_bar(name: str, make: Callable, *args, params: tuple = ()) -> Node:
    """A window over the cross-section of one bar; ``make`` writes the OVER clauses."""
    return Node("xs", name, tuple(_node(a) for a in args), make, params)


def over_history(name: str, make: Callable, *args, params: tuple = ()) -> Node:
    """A window over one name's rows up to the current bar."""
    return Node("ts", name, tuple(_node(a) for a in args), make, params)


def said_plainly(node: Node, plain: Node) -> Node:
    """``node`` for Spark, whose value is that of ``plain`` by other means."""
    node.plain = plain
    return node


def for_short(node: Node, short: Callable[[int], Node | None]) -> Node:
    """``node``, for which ``short`` may give something simpler where histories are short."""
    node.short = short
    return node


def _changed(node: Node, done: dict[int, Node], other: Callable[[Node], Node | None]) -> Node:
    """The graph with nodes replaced by others of equal value."""
    if node.number not in done:
        new = other(node)
        if new is None:
            new = Node(node.kind, node.name, tuple(_changed(a, done, other) for a in node.args), node.make, node.params)
        elif new is not node:
            new = _changed(new, done, other)
        done[node.number] = new
    return done[node.number]


_PLAIN = {"+", "-", "*", "neg", "div"}


# --- layout -------------------------------------------------------------------------------------------


class Stage:
    """One projection: the columns carried on and the new ones (column, node, text by dialect)."""

    def __init__(self, keep: list[str], new: list[tuple[str, Node, Callable[[str], str]]]):
        self.keep, self.new = keep, new


def _reach(outputs) -> list[Node]:
    order, seen = [], set()
    todo = [(n, False) for n in outputs]
    while todo:
        node, done = todo.pop()
        if done:
            order.append(node)
        elif node.number not in seen:
            seen.add(node.number)
            todo.append((node, True))
            todo.extend((a, False) for a in node.args)
    return order


def layout(outputs: dict[str, Node], extra: tuple[str, ...] = ()) -> list[Stage]:
    """Stages for some named outputs; the keys and ``extra`` columns come along."""
    nodes = _reach(outputs.values())
    users: dict[int, list[Node]] = {n.number: [] for n in nodes}
    for n in nodes:
        for a in n.args:
            users[a.number].append(n)
    wanted = {n.number for n in outputs.values()}
    # arithmetic with one user is written inside it, and constants always are
    inline = {n.number for n in nodes if n.kind == "map" and n.number not in wanted and (not n.args or n.name in _PLAIN and len(users[n.number]) <= 1)}
    column = {n.number: (n.name if n.kind == "field" else f"c{n.number}") for n in nodes}

    def inputs(node: Node) -> list[Node]:
        out = []
        for a in node.args:
            out += inputs(a) if a.number in inline else [a]
        return out

    def text(node: Node, dialect: str) -> str:
        return node.text(dialect, [text(a, dialect) if a.number in inline else column[a.number] for a in node.args])

    have = {n.number for n in nodes if n.kind == "field"}
    left = [n for n in nodes if n.number not in have and n.number not in inline]
    stages, kind = [], "xs"
    while left:
        ready = [n for n in left if all(a.number in have for a in inputs(n))]
        maps = [n for n in ready if n.kind == "map"]
        if not maps and not any(n.kind == kind for n in ready):
            kind = "ts" if kind == "xs" else "xs"
        batch = maps or [n for n in ready if n.kind == kind]
        numbers = {n.number for n in batch}
        left = [n for n in left if n.number not in numbers]
        needed = {a.number for n in left for a in inputs(n)} | wanted
        keep = [column[n.number] for n in nodes if n.number in have and n.number in needed]
        stages.append(Stage(keep, [(column[n.number], n, lambda d, n=n: text(n, d)) for n in batch]))
        have |= numbers
    names = [c for c in dict.fromkeys(extra) if c not in KEYS]
    for s in stages:
        s.keep = [c for c in dict.fromkeys([*KEYS, *names, *s.keep])]
    last = Stage([*KEYS, *names], [(name, node, lambda d, c=column[node.number]: c) for name, node in outputs.items()])
    return [*stages, last]


def evaluate(panel: DataFrame, outputs: dict[str, Node], extra: tuple[str, ...] = ()) -> DataFrame:
    """Keys, ``extra`` columns and outputs of every row of the panel. Where an operator has a simpler way for short
    histories, their rows are counted first."""
    df = panel
    if any(n.short for n in _reach(outputs.values())):
        longest = panel.groupBy("period", "name_ix").count().agg({"count": "max"}).first()[0] or 0
        done: dict[int, Node] = {}
        outputs = {n: _changed(v, done, lambda v: v.short and v.short(longest)) for n, v in outputs.items()}
    for stage in layout(outputs, extra):
        df = df.selectExpr(*stage.keep, *[f"{make(SPARK)} AS {name}" for name, _, make in stage.new if not (name in stage.keep and make(SPARK) == name)])
    return df


def to_sql(source: str, outputs: dict[str, Node], extra: tuple[str, ...] = (), dialect: str = DUCKDB) -> tuple[list[str], str]:
    """The stages as CTEs, and the name of the last. What Spark computes in blocks is said as plain windows."""
    ctes, last, done = [], source, {}
    outputs = {n: _changed(v, done, lambda v: v.plain) for n, v in outputs.items()}
    for k, stage in enumerate(layout(outputs, extra)):
        cols = [*stage.keep, *[f"{make(dialect)} AS {name}" for name, _, make in stage.new if not (name in stage.keep and make(dialect) == name)]]
        ctes.append(f"e{k} AS (SELECT {', '.join(cols)} FROM {last})")
        last = f"e{k}"
    return ctes, last
