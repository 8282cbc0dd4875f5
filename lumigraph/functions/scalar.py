"""Column functions: partitions as arrays of arrays, Hilbert order, labels, distribution functions, tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranks import numbered, running


def part_lengths(parts: Column) -> Column:
    return F.transform(parts, F.size)


def part_starts(parts: Column) -> Column:
    """First place (from 1) of every part in the flat list, and the place after the last."""
    lengths = part_lengths(parts)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.aggregate(F.slice(lengths, 1, k), F.lit(1), lambda a, x: a + x))


def push_element(parts: Column, x: Column) -> Column:
    """x at the end of the last part (a first one if there is none)."""
    n = F.size(parts)
    return F.when(n == 0, F.array(F.array(x))).otherwise(F.concat(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), F.array(F.array_append(F.element_at(parts, F.greatest(n, F.lit(1))), x))))


def filter_parts(parts: Column, predicate) -> Column:
    return F.filter(parts, predicate)


def repeat_parts(parts: Column, n: int) -> Column:
    if n < 0:
        raise ValueError("n must not be negative")
    return F.flatten(F.array_repeat(parts, n))


def reset_parts(n: Column, nparts: int | None = None) -> Column:
    """Vertices 1..n in one part (nparts=1), or a part each."""
    if nparts not in (None, 1):
        raise ValueError("there is no default division into so many parts")
    ids = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array(ids) if nparts == 1 else F.transform(ids, lambda x: F.array(x))


def insert_sorted(xs: Column, x: Column, unique: bool = False) -> Column:
    out = F.array_sort(F.array_append(xs, x))
    return F.array_distinct(out) if unique else out


def hilbert_order(i: Column, j: Column, n: int) -> Column:
    """Place of row i, column j (from 1) along the Hilbert curve of an n by n grid, n a power of two."""
    if n < 1 or n & (n - 1):
        raise ValueError("n must be a power of two")
    # The first step goes along the row.
    x, y, d = j - 1, i - 1, F.lit(0)
    s = n // 2
    while s:
        rx, ry = (F.shiftright(x, int(math.log2(s))) % 2).cast("int"), (F.shiftright(y, int(math.log2(s))) % 2).cast("int")
        d = d + F.lit(s * s) * (F.lit(3) * rx).bitwiseXOR(ry)
        fx, fy = F.when((ry == 0) & (rx == 1), F.lit(n - 1) - x).otherwise(x), F.when((ry == 0) & (rx == 1), F.lit(n - 1) - y).otherwise(y)
        x, y = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        s //= 2
    return (d + 1).cast("int")


def quantile_suffix(q: Column) -> Column:
    """0.025 -> 025, 0.5 -> 50."""
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", q), r"^\d+\.", ""), "0+$", "")
    return F.when(F.length(digits) < 2, F.rpad(digits, 2, "0")).otherwise(digits)


def value_group_sizes(values: DataFrame, column: str, most: int) -> DataFrame:
    """value, n for every value 1..most, zeros too."""
    have = values.groupBy(F.col(column).cast("long").alias("value")).agg(F.count("*").alias("n"))
    return values.sparkSession.range(1, most + 1).select(F.col("id").alias("value")).join(have, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def value_groups(values: DataFrame, column: str, place: str, most: int) -> DataFrame:
    """value, places (sorted) for every value 1..most, empty groups too."""
    have = values.groupBy(F.col(column).cast("long").alias("value")).agg(F.array_sort(F.collect_list(place)).alias("places"))
    return values.sparkSession.range(1, most + 1).select(F.col("id").alias("value")).join(have, "value", "left").select("value", F.coalesce("places", F.array().cast("array<long>")).alias("places"))


def ecdf(values: DataFrame, value: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Steps (by..., value, cdf, next_value, next_cdf) of the weighted empirical distribution function; NaN values are refused.

    Without ``by`` the different values are summed up range by range, not in one task.
    """
    if not values.where(F.isnan(value)).isEmpty():
        raise ValueError("NaN has no place in a distribution")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    steps = values.groupBy(*by, F.col(value).alias("value")).agg(F.sum(w).alias("w"))
    if by:
        all_ = Window.partitionBy(*by)
        order = all_.orderBy("value")
        steps = steps.withColumn("cdf", F.sum("w").over(order) / F.sum("w").over(all_))
        return steps.select(*by, "value", "cdf", F.lead("value").over(order).alias("next_value"), F.lead("cdf").over(order).alias("next_cdf"))
    total = steps.agg(F.sum("w").alias("total"))
    summed = running(steps, ["value"], "w", "sum").crossJoin(F.broadcast(total)).select("value", (F.col("sum") / F.col("total")).alias("cdf"))  # total is one row
    placed = numbered(summed, ["value"], "k")
    after = placed.select((F.col("k") - 1).alias("k"), F.col("value").alias("next_value"), F.col("cdf").alias("next_cdf"))
    return placed.join(after, "k", "left").select("value", "cdf", "next_value", "next_cdf")


def ecdf_at(steps: DataFrame, points: DataFrame, x: str = "x", interpolate: bool = False) -> DataFrame:
    """points with f: 0 below the smallest value, NaN at NaN.

    Points and steps are put in one order by ranges of values; every point takes the last step before it, so there is no join on inequality.
    """
    step = F.struct("value", "cdf", "next_value", "next_cdf")
    marks = steps.select(F.col("value").alias("at"), F.lit(0).alias("kind"), step.alias("step"))
    asked = points.select(x).where(~F.isnan(x)).distinct()
    rows = numbered(marks.unionByName(asked.select(F.col(x).alias("at"), F.lit(1).alias("kind")), allowMissingColumns=True), ["at", "kind"], "k")
    # Blocks of neighbouring rows: within a block a window looks back, and each block starts with the last step before it.
    rows = rows.withColumn("block", F.floor(F.col("k") / 65536))
    last = rows.where("kind = 0").groupBy("block").agg(F.max_by("step", "k").alias("step")).select((F.col("block") + 1).alias("block"), F.lit(0).cast("long").alias("k"), "step", F.lit(-1).alias("kind"))
    blocks = rows.select("block").distinct().join(last, "block", "left").select("block", "step")  # a row for each 65536 rows
    filled = blocks.select("block", F.last("step", True).over(Window.orderBy("block")).alias("carried"))
    within = rows.withColumn("within", F.last("step", True).over(Window.partitionBy("block").orderBy("k"))).join(F.broadcast(filled), "block").where("kind = 1")
    found = within.select(F.col("at").alias(x), F.coalesce("within", "carried").alias("s"))
    f = F.col("s.cdf")
    if interpolate:
        f = F.when(F.col("s.next_value").isNull(), f).otherwise(f + (F.col(x) - F.col("s.value")) / (F.col("s.next_value") - F.col("s.value")) * (F.col("s.next_cdf") - F.col("s.cdf")))
    return points.join(found.select(x, f.alias("f")), x, "left").withColumn("f", F.when(F.isnan(x), float("nan")).otherwise(F.coalesce("f", F.lit(0.0))))


def ecdf_range(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., least, most: the extreme values of a distribution."""
    return steps.groupBy(*by).agg(F.min("value").alias("least"), F.max("value").alias("most"))


def log_factorial(x: Column) -> Column:
    """By Stirling's series above 20, exactly below: fine to 1e-12 relative."""
    small = F.element_at(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(21)]), (F.least(x, F.lit(20)) + 1).cast("int"))
    y = (x + 1).cast("double")
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return F.when(x <= 20, small).otherwise(series)


def fisher_pvalue(hits: Column, size: Column, all_hits: Column, total: Column) -> Column:
    """P(X >= hits) for a draw of ``size`` from ``total`` with ``all_hits`` hits."""
    choose = lambda n, k: log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    low, high = F.greatest(hits, size - (total - all_hits), F.lit(0)), F.least(size, all_hits)
    terms = F.transform(F.sequence(low, high), lambda k: F.exp(choose(all_hits, k) + choose(total - all_hits, size - k) - choose(total, size)))
    return F.when(low > high, 0.0).otherwise(F.least(F.lit(1.0), F.aggregate(F.when(low <= high, terms), F.lit(0.0), lambda a, t: a + t)))


#: Up to so many values without ties (or with ties) the test is exact.
EXACT, EXACT_TIED = 50, 10


def normal_tail(z: Column) -> Column:
    """P(Z >= z), with a relative error below 2e-7 (Chebyshev fit of the complementary error function)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.0)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = poly * t + c
    tail = t * F.exp(-x * x - 1.26551223 + t * poly) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def exact_tail(ranks: Sequence[int], sizes: Sequence[int], n1: int, observed: int) -> float:
    """Share of the choices of n1 out of all values whose doubled ranks add up to at least ``observed``."""
    ways: dict[tuple[int, int], int] = {(0, 0): 1}
    for rank, size in zip(ranks, sizes, strict=True):
        for _ in range(size):
            more = dict(ways)
            for (n, s), count in ways.items():
                if n < n1:
                    more[n + 1, s + rank] = more.get((n + 1, s + rank), 0) + count
            ways = more
    return sum(c for (n, s), c in ways.items() if n == n1 and s >= observed) / math.comb(sum(sizes), n1)


def mannwhitney(rows: DataFrame, group: Sequence[str], value: str, is_real: str) -> DataFrame:
    """group..., u, pvalue: right tail that real values exceed permuted ones. Exact up to 50 values without ties or 10 with ties, beyond that by the normal approximation with corrections for ties and continuity.

    Ranks come from one ordered window over the different values of each group; ties share their mean rank.
    """
    g = Window.partitionBy(*group)
    ranked = rows.groupBy(*group, F.col(value).alias("_x")).agg(F.count("*").alias("t"), F.sum(F.col(is_real).cast("int")).alias("r"))
    before = F.coalesce(F.sum("t").over(g.orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("t").over(g)
    ranked = ranked.withColumn("twice", 2 * before + F.col("t") + 1).withColumn("all", n)
    few = F.when(F.col("all") <= EXACT, F.struct("twice", "t"))
    s = ranked.groupBy(*group).agg(F.sum("r").alias("n1"), F.sum("t").alias("n"), F.sum(F.col("twice") * F.col("r")).alias("ranks"), F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"), F.sort_array(F.collect_list(few)).alias("few"))

    @F.pandas_udf("double")
    def exact(n1: pd.Series, ranks: pd.Series, twice: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([exact_tail(x.tolist(), y.tolist(), int(a), int(b)) if len(x) else float("nan") for a, b, x, y in zip(n1, ranks, twice, t, strict=True)])

    n2 = F.col("n") - F.col("n1")
    u = F.col("ranks") / 2 - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.when(F.col("n") > 1, F.col("n1") * n2 / 12 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * F.greatest(F.col("n") - 1, F.lit(1)))))
    z = (u - F.col("n1") * n2 / 2 - 0.5) / F.sqrt(F.when(var > 0, var))
    is_small = (F.col("n") <= EXACT_TIED) | ((F.col("n") <= EXACT) & (F.col("ties") == 0))
    kept = F.when(is_small, F.col("few")).otherwise(F.array().cast("array<struct<twice:bigint,t:bigint>>"))
    small = exact("n1", "ranks", F.transform(kept, lambda x: x["twice"]), F.transform(kept, lambda x: x["t"]))
    approx = F.when(var.isNull() | (var <= 0), 1.0).otherwise(normal_tail(z))
    return s.withColumn("small", small).select(*group, u.alias("u"), F.when(is_small, F.col("small")).otherwise(approx).alias("pvalue"))
