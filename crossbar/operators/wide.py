"""Operators over groups too large for one task: ranks of a wide bar, exact quantiles, running sums of a long history, joins
as of a time.

A group is dealt out to ranges of values or of time. Each range is ordered by a task of its own; what the ranges before
it add up to is a table of a few rows a group. The results are those of one window over the group, whatever the ranges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

#: Ranges that the values of a group are dealt to; a group of fewer rows is one range.
PARTS, LARGE = 64, 4096
#: Buckets of a round of ``exact_quantile``, and rounds at most: together more than the digits of any double.
BUCKETS, ROUNDS = 1024, 8


def _written(df: DataFrame, name: str) -> DataFrame:
    """Kept in the shared folder: estimates that differ between two runs must not be made twice."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _before(column: str, *by: str, order: str) -> Column:
    """Sum of the rows before this one."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def ranked(rows: DataFrame, by: list[str], value: str, parts: int = PARTS, large: int = LARGE) -> DataFrame:
    """``rows`` with ``below`` and ``equal``, the numbers of smaller and of equal values of the group, and ``values``.

    Equal values are counted before they are ordered, so a value that many rows share is one row of its range; only
    counts of different values are sorted, range by range. Ranges are estimated quantiles; any others give the same.
    Nulls aren't counted and get nulls; NaN is the greatest value.
    """
    at = [F.col(c) for c in by]
    quantiles = F.percentile_approx(value, [k / parts for k in range(1, parts)], 1000)
    cuts = rows.groupBy(*at).agg(F.when(F.count(value) > large, quantiles).otherwise(F.expr("filter(array(null), x -> false)")).alias("cuts"))
    cuts = _written(cuts, "cuts")
    counted = rows.where(F.col(value).isNotNull()).groupBy(*at, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("equal"))
    dealt = counted.join(cuts.withColumnsRenamed({c: f"_{c}" for c in by}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    dealt = dealt.withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("v")))).select(*by, "v", "equal", "part")
    sizes = dealt.groupBy(*by, "part").agg(F.sum("equal").alias("size"))
    sizes = sizes.select(*by, "part", _before("size", *by, order="part").alias("ahead"), F.sum("size").over(Window.partitionBy(*by)).alias("values"))
    inside = dealt.withColumn("inside", _before("equal", *by, "part", order="v"))
    table = inside.alias("a").join(sizes.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "part"]])
    table = table.select(*[F.col(f"a.{c}").alias(f"_{c}") for c in by], F.col("v").alias("_v"), (F.col("ahead") + F.col("inside")).alias("below"), "equal", "values")
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col(value) == F.col("_v")]
    return rows.join(table, match, "left").drop("_v", *[f"_{c}" for c in by])


def _met(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of a table of one row a group; null is a group too."""
    named = table.withColumnsRenamed({c: f"_{c}" for c in by})
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(named, match).drop(*[f"_{c}" for c in by])


def exact_quantile(rows: DataFrame, by: list[str], value: str, p: float = 0.5, large: int = 1 << 16) -> DataFrame:
    """``by`` (one column or more) and ``quantile``: the value at the share ``p`` of each group's values in order, between
    two by interpolation.

    Selection by histograms: a round counts a group's values in BUCKETS ranges, with the least and greatest value of
    each, and goes on in the one that holds the place sought. Counts are combined before they move, so a round moves some
    thousand rows a group and task whatever the group's size. What is left of a group, ``large`` rows or less (or copies
    of few values), is counted value by value. Nulls aren't values, a group without any has a null quantile; NaN is the
    greatest value; a quantile between two infinite values of unlike sign is NaN.
    """
    most = 1.7976931348623157e308
    v = F.col(value).cast("double")
    names, by = by, [f"__group{i}" for i in range(len(by))]
    values = rows.select(*[F.col(c).alias(g) for c, g in zip(names, by)], v.alias("v"), F.greatest(F.least(F.nanvl(v, F.lit(most)), F.lit(most)), F.lit(-most)).alias("x"))
    place = F.lit(float(p)) * (F.col("n") - 1)
    first = values.groupBy(*by).agg(F.count("v").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    low = F.greatest(F.floor(place), F.lit(0)).cast("bigint")
    state = first.select(
        *by, "lo", "hi", low.alias("k"), F.least(low + 1, F.greatest(F.col("n") - 1, F.lit(0))).alias("k2"), (place - low).alias("share"),
        F.col("n").alias("left"), F.lit(None).cast("double").alias("quantile"), (F.col("n") == 0).alias("done"),
    )
    state = _written(state, "quantile-0")
    between = F.when(F.col("share") > 0, F.col("a") * (1 - F.col("share")) + F.col("b") * F.col("share")).otherwise(F.col("a"))
    finished = []
    for at in range(1, ROUNDS + 1):
        finished.append(state.where("done"))
        small, going = state.where(~F.col("done") & (F.col("left") <= large)), state.where(~F.col("done") & (F.col("left") > large))
        finished.append(_selected(values, small, by, between))
        if going.isEmpty():
            break
        here = _met(values.where("v is not null"), going.select(*by, "lo", "hi"), by).where("x between lo and hi")
        # halves, since the difference of two doubles may be none
        share = (F.col("x") / 2 - F.col("lo") / 2) / F.nullif(F.col("hi") / 2 - F.col("lo") / 2, F.lit(0.0))
        here = here.withColumn("bucket", F.coalesce(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0)))
        counts = here.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.min("x").alias("low"), F.max("x").alias("high"))
        counts = counts.withColumn("ahead", _before("c", *by, order="bucket"))
        holds = lambda k: (F.col("ahead") <= F.col(k)) & (F.col(k) < F.col("ahead") + F.col("c"))
        found = _met(counts, going.drop("lo", "hi", "left", "quantile", "done"), by).where(holds("k") | holds("k2"))
        kept = ["c", "least", "greatest", "low", "high", "ahead"]
        found = found.groupBy(*by, "k", "k2", "share").agg(F.min_by(F.struct(*kept), "bucket").alias("s"), F.max_by(F.struct(*kept), "bucket").alias("t"))
        # places in two buckets are the end of one and the beginning of the other
        apart = F.col("s.ahead") != F.col("t.ahead")
        same = F.col("s.least") == F.col("s.greatest")
        found = found.withColumns({"a": F.when(apart, F.col("s.greatest")).otherwise(F.col("s.least")), "b": F.when(apart, F.col("t.least")).otherwise(F.col("s.least"))})
        state = _written(found.select(
            *by, F.col("s.low").alias("lo"), F.col("s.high").alias("hi"), (F.col("k") - F.col("s.ahead")).alias("k"), (F.col("k2") - F.col("s.ahead")).alias("k2"), "share",
            F.col("s.c").alias("left"), F.when(apart | same, between).alias("quantile"), (apart | same).alias("done"),
        ), f"quantile-{at}")
    else:
        finished += [state.where("done"), _selected(values, state.where(~F.col("done")), by, between)]
    out = finished[0].select(*by, "quantile")
    for more in finished[1:]:
        out = out.unionByName(more.select(*by, "quantile"))
    return out.withColumnsRenamed(dict(zip(by, names)))


def _selected(values: DataFrame, state: DataFrame, by: list[str], between: Column) -> DataFrame:
    """Quantiles from counts of the different values in what is left of each group."""
    here = _met(values.where("v is not null"), state.select(*by, "lo", "hi", "k", "k2", "share"), by).where("x between lo and hi")
    counts = here.groupBy(*by, "k", "k2", "share", "v").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("ahead", _before("c", *by, order="v"))
    at = lambda k: F.max(F.when((F.col("ahead") <= F.col(k)) & (F.col(k) < F.col("ahead") + F.col("c")), F.col("v")))
    return counts.groupBy(*by, "k", "k2", "share").agg(at("k").alias("a"), at("k2").alias("b")).withColumn("quantile", between)


def wide_ranks(rows: DataFrame, by: list[str], value: str, name: str, parts: int = PARTS, large: int = LARGE) -> DataFrame:
    """``rows`` with ``average``, the average rank on [-1, 1], and ``place``, the ordinal rank from 1 with ties by ``name``;
    null where the value is. A lone value has the average 0."""
    found = ranked(rows, by, value, parts, large)
    tied = found.where("equal > 1").select(*by, value, name)
    first = ranked(tied, [*by, value], name, parts, large).select(*[F.col(c).alias(f"_{c}") for c in [*by, value, name]], F.col("below").alias("earlier"))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, value, name]]
    found = found.join(first, match, "left").drop(*[f"_{c}" for c in [*by, value, name]])
    middle = F.col("below") + (F.col("equal") + 1) / 2
    half = (F.col("values") - 1) / 2
    average = F.when(F.col("values") > 1, (middle - (F.col("values") + 1) / 2) / half).when(F.col("values") == 1, F.lit(0.0))
    place = F.col("below") + F.coalesce("earlier", F.lit(0)) + 1
    return found.withColumns({"average": average, "place": place}).drop("below", "equal", "values", "earlier")


def running(rows: DataFrame, by: list[str], time: str, value: str, width: int, tie: str | None = None) -> DataFrame:
    """``rows`` with ``total`` and ``count`` of the values up to each row, in the order of ``time`` (then ``tie``).

    Two passes: totals of blocks of ``width`` time units and what stands before each block; then sums inside the blocks.
    Null values add nothing; rows without a time come first, as one block.
    """
    blocks = rows.withColumn("block", F.floor(F.col(time) / width))
    totals = blocks.groupBy(*by, "block").agg(F.sum(value).alias("sum"), F.count(value).alias("n"))
    ahead = totals.select(*[F.col(c).alias(f"_{c}") for c in [*by, "block"]], _before("sum", *by, order="block").alias("sum_ahead"), _before("n", *by, order="block").alias("n_ahead"))
    inside = Window.partitionBy(*by, "block").orderBy(time, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumns({"total": F.coalesce(F.sum(value).over(inside), F.lit(0)), "count": F.count(value).over(inside)})
    joined = local.join(ahead, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "block"]])
    joined = joined.withColumns({"total": F.col("total") + F.col("sum_ahead"), "count": F.col("count") + F.col("n_ahead")})
    return joined.drop("block", "sum_ahead", "n_ahead", *[f"_{c}" for c in [*by, "block"]])


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], width: int, tie: str | None = None, tolerance: int | None = None) -> DataFrame:
    """``left`` with the ``values`` and the time (``as_of``) of the last row of ``right`` at or before each row's time.

    Both sides are put in one order within a key and a range of ``width`` time units; a range begins with a halo: the
    last row of the ranges before it. So a key with most of the rows is dealt out by time, and nothing is multiplied.
    Of rows of ``right`` at one time that with the greatest ``tie`` counts. Beyond ``tolerance`` there is none. Keys or
    times that are null match nothing; every row of ``left`` stays, once.
    """
    block = F.floor(F.col(time) / width).alias("__block")
    sound = F.col(time).isNotNull()
    for c in by:
        sound = sound & F.col(c).isNotNull()
    order = F.struct(F.col(time), *([F.col(tie)] if tie else []))
    found = F.struct(F.col(time).alias("as_of"), *values)
    events = right.where(sound).select(*by, block, F.col(time).alias("__time"), (F.col(tie) if tie else F.lit(0)).alias("__tie"), order.alias("__order"), found.alias("__found"))
    lines = left.where(sound).select(*by, block, F.col(time).alias("__time"), F.struct(*left.columns).alias("__left"))
    last = events.groupBy(*by, "__block").agg(F.max_by("__found", "__order").alias("__last"))
    ranges = last.unionByName(lines.select(*by, "__block").distinct(), allowMissingColumns=True).groupBy(*by, "__block").agg(F.first("__last", ignorenulls=True).alias("__last"))
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    halo = ranges.select(*by, "__block", F.last("__last", ignorenulls=True).over(earlier).alias("__found")).where("__found is not null")
    sides = [s.withColumn("__side", F.lit(k)) for k, s in enumerate((halo, events.drop("__order"), lines))]
    both = sides[2].unionByName(sides[1], allowMissingColumns=True).unionByName(sides[0], allowMissingColumns=True)
    # the halo has no time: it comes first
    upto = Window.partitionBy(*by, "__block").orderBy(F.asc_nulls_first("__time"), "__side", F.asc_nulls_first("__tie")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__found", F.last("__found", ignorenulls=True).over(upto)).where("__side = 2")
    near = F.lit(True) if tolerance is None else F.col(f"__left.{time}") - F.col("__found.as_of") <= tolerance
    picked = lambda c: F.when(near, F.col(f"__found.{c}")).alias(c)
    out = met.select("__left.*", *[picked(c) for c in ["as_of", *values]])
    rest = left.where(~F.coalesce(sound, F.lit(False)))
    return out.unionByName(rest, allowMissingColumns=True)
