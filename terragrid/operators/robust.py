"""Robust statistics: exact percentiles, index percentiles, histograms, fusion by median deviation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_SHARE, HIGH_SHARE = 0.02, 0.98
#: Values that a global order statistic sorts in one place, at most.
MOST_SORTED = 200_000


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation by keys, a column for each name in ``shares``.

    Values are sorted within their group and picked by position: one shuffle, and a sort that can
    spill, where an aggregate would hold every distinct value of a group in memory."""
    if not keys:
        got = global_percentiles(df, value, list(shares.values()))
        return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(n) for n, v in zip(shares, got)])
    own = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    ranked = ranked.withColumns({"__i": F.row_number().over(own.orderBy("__v")) - 1, "__n": F.count(F.lit(1)).over(own)})

    def at(p: float) -> Column:
        place = p * (F.col("__n") - 1)
        low = F.max(F.when(F.col("__i") == F.floor(place), F.col("__v")))
        high = F.max(F.when(F.col("__i") == F.ceil(place), F.col("__v")))
        share = F.max(place - F.floor(place))
        return low + (high - low) * share

    return ranked.groupBy(*keys).agg(*[at(p).alias(n) for n, p in shares.items()])


def global_percentiles(df: DataFrame, value: str, shares: list[float], most: int = MOST_SORTED) -> list[float | None]:
    """Exact percentiles with linear interpolation over all rows, as numbers; NumPy's and SQL's continuous ones.

    An approximate quantile brackets each; rows below the bracket are counted and those inside it
    counted by value, so what is sorted in one place is at most ``most`` values. A bracket with more is
    narrowed by the same step on its own rows until it fits or holds one value only."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n, found = _order_statistics(rows, lambda n: [int(k) for p in shares for k in (p * (n - 1) // 1, -(-p * (n - 1) // 1))], shares, most)
    if not n:
        return [None] * len(shares)
    out = []
    for p in shares:
        place = p * (n - 1)
        low, high = found[int(place // 1)], found[int(-(-place // 1))]
        out.append(low + (high - low) * (place - place // 1))
    return out


def _order_statistics(rows: DataFrame, places: Callable[[int], list[int]], shares: list[float], most: int) -> tuple[int, dict[int, float]]:
    """How many rows (v) there are, and the values at the zero-based ``places`` of so many, which lie near ``shares`` of them.

    Two passes and a sort of what the brackets hold: number, ends and brackets are one aggregate, rows
    below and inside the brackets another."""
    accuracy = 10_000
    edge = lambda p, d: min(1.0, max(0.0, p + d / accuracy))
    n, low, high, cuts = rows.agg(F.count("v"), F.min("v"), F.max("v"), F.percentile_approx("v", [edge(p, d) for p in shares for d in (-2, 2)], accuracy)).first()
    if not n:
        return 0, {}
    near = lambda k: min(range(len(shares)), key=lambda i: abs(shares[i] * n - k))
    brackets = {}
    for k in sorted(set(places(n))):
        i = near(k)
        brackets[k] = (low if k <= 2 * n / accuracy else cuts[2 * i], high if k >= n - 1 - 2 * n / accuracy else cuts[2 * i + 1])
    counts = rows.agg(*[c for lo, hi in brackets.values() for c in (F.count(F.when(F.col("v") < lo, 1)), F.count(F.when(F.col("v").between(lo, hi), 1)))]).first()
    out, sorted_here = {}, {}
    for i, (k, (lo, hi)) in enumerate(brackets.items()):
        below, inside = counts[2 * i], counts[2 * i + 1]
        if not below <= k < below + inside:  # the approximation missed: all rows are the bracket
            lo, hi, below, inside = low, high, 0, n
        if lo == hi:
            out[k] = lo
        elif inside > most and inside < n:
            deeper = _order_statistics(rows.where(F.col("v").between(lo, hi)), lambda _, k=k, below=below: [k - below], [(k - below) / inside], most)
            out[k] = deeper[1][k - below]
        else:
            if (lo, hi) not in sorted_here:
                sorted_here[lo, hi] = rows.where(F.col("v").between(lo, hi)).groupBy("v").count().orderBy("v").collect()
            at = below
            for v, c in sorted_here[lo, hi]:
                at += c
                if at > k:
                    out[k] = v
                    break
    return n, out


def index_percentile_range(df: DataFrame, keys: list[str], value: str, below: float = 10.0, above: float = 30.0) -> DataFrame:
    """(keys, depth_min, depth_max): the sorted values at floor(share * n), stretched; only positive values count.

    Without keys one row, found by bracketing: no task sorts all rows; without a value both are null."""
    if not keys:
        rows = df.where(F.col(value) > 0).select(F.col(value).cast("double").alias("v"))
        places = lambda n: [int(LOW_SHARE * n), int(HIGH_SHARE * n)]
        n, got = _order_statistics(rows, places, [LOW_SHARE, HIGH_SHARE], MOST_SORTED)
        low, high = (got[k] for k in places(n)) if n else (None, None)
        return df.sparkSession.range(1).select(F.lit(None if low is None else low - below).cast("double").alias("depth_min"), F.lit(None if high is None else high + above).cast("double").alias("depth_max"))
    every = Window.partitionBy(*keys)
    ranked = df.where(F.col(value) > 0).select(*keys, F.col(value).alias("__v"))
    ranked = ranked.withColumns({"__i": F.row_number().over(every.orderBy("__v")) - 1, "__n": F.count(F.lit(1)).over(every)})
    at = lambda p: F.max(F.when(F.col("__i") == F.floor(p * F.col("__n")), F.col("__v")))
    return ranked.groupBy(*keys).agg((at(LOW_SHARE) - below).alias("depth_min"), (at(HIGH_SHARE) + above).alias("depth_max"))


def summaries(df: DataFrame, keys: list[str], medians: dict[str, str], aggregates: list[Column]) -> DataFrame:
    """(keys, aggregates, a median for each name in ``medians``, name to value column).

    Medians are picked by position from sorted groups: one shuffle and a sort for each that can spill, where
    an aggregate would hold a group's distinct values in memory. Without keys one row, by bracketing."""
    if not keys:
        got = {n: global_percentiles(df, v, [0.5])[0] for n, v in medians.items()}
        return df.agg(*aggregates).withColumns({n: F.lit(v).cast("double") for n, v in got.items()})
    own = Window.partitionBy(*keys)
    rows, picked = df, []
    for i, (name, v) in enumerate(medians.items()):
        place, n = f"__place{i}", f"__n{i}"
        rows = rows.withColumns({place: F.row_number().over(own.orderBy(F.col(v).asc_nulls_last())) - 1, n: F.count(v).over(own)})
        middle = 0.5 * (F.col(n) - 1)
        at = lambda f, place=place, v=v, middle=middle: F.max(F.when(F.col(place) == f(middle), F.col(v).cast("double")))
        picked.append(((at(F.floor) + at(F.ceil)) / 2).alias(name))
    return rows.groupBy(*keys).agg(*aggregates, *picked)


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, n, density) of equal bins over the range of the values, clipped to [low, high] first; the last bin is closed."""
    x = F.col(value)
    x = F.least(F.greatest(x, F.lit(low)), F.lit(high)) if low is not None else x
    rows = df.where(F.col(value).isNotNull()).select(x.alias("x"))
    span = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("all"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.coalesce(F.try_divide((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))
    number = F.least(F.lit(bins - 1), F.floor(place)).cast("int")
    # one row of range and total goes to every task
    return rows.join(F.broadcast(span)).groupBy(number.alias("bin"), "lo", "hi", "all").agg(F.count(F.lit(1)).alias("n")).select("bin", "n", F.try_divide(F.col("n"), F.col("all") * width).alias("density"))


def mad_fuse(df: DataFrame, cell: list[str], value: str, least: int = 3) -> DataFrame:
    """(cell, z, n): mean of a cell's values that lie within the median absolute deviation of its median.

    Cells with fewer than ``least`` values are left out. Both medians are windows over one
    partitioning: one shuffle and one sort of the rows.
    """
    own = Window.partitionBy(*cell)
    rows = df.where(F.col(value).isNotNull()).select(*cell, F.col(value).cast("double").alias("__z"))
    rows = rows.withColumns({"__n": F.count("__z").over(own), "__m": F.median("__z").over(own)}).where(F.col("__n") >= least)
    rows = rows.withColumn("__d", F.abs(F.col("__z") - F.col("__m"))).withColumn("__mad", F.median("__d").over(own))
    return rows.where(F.col("__d") <= F.col("__mad")).groupBy(*cell).agg(F.avg("__z").alias("z"), F.first("__n").alias("n"))


def interval_intersection(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """One row (alt_min, alt_max) that all intervals share; rows that can't be read are null and left out."""
    return df.select(low.alias("l"), high.alias("h")).where("l is not null and h is not null").agg(F.max("l").alias("alt_min"), F.min("h").alias("alt_max"))


def bounds(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Least and largest of each value, by keys."""
    return df.groupBy(*keys).agg(*[f(v).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max))])
