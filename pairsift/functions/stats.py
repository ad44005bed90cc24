"""Exact statistics of score columns.

Thresholds and reported percentiles are order statistics. They are found by narrowing, for all groups at once: count
equal-width buckets of the range and go on inside the bucket that holds the rank, so no task and no driver ever holds
more than some thousand values a group, however many there are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

PERCENTILES = {"p50": 50.0, "p90": 90.0, "p95": 95.0, "p99": 99.0, "p99_5": 99.5}
CLIFF_PERCENTILES = (90.0, 95.0, 99.0, 99.5, 99.9)
BUCKETS, ENOUGH = 1024, 16_384
#: Values a side up to which p-values are exact.
EXACT = 10_000


def _moments(value: str) -> list[Column]:
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]


def grouped_stats(df: DataFrame, value: str, key: str, *more: Column) -> DataFrame:
    """A row for each key: mean, population std, min, max, percentiles and further aggregates. There must be few keys (they are worked on by the driver)."""
    rows = df.withColumn(value, F.col(value).cast("double"))
    base = rows.groupBy(key).agg(*_moments(value), *more, F.count(value).alias("__n"))
    found = base.collect()
    groups = {r[key]: (r["__n"], r["min"], r["max"]) for r in found if r["__n"]}
    values = grouped_percentiles(rows, value, list(PERCENTILES.values()), groups, key)
    kept = [f for f in base.schema if f.name != "__n"]
    schema = StructType([*kept, *[StructField(name, DoubleType()) for name in PERCENTILES]])
    out = [(*[r[f.name] for f in kept], *values.get(r[key], [None] * len(PERCENTILES))) for r in found]
    return df.sparkSession.createDataFrame(out, schema)


def score_stats(df: DataFrame, value: str) -> DataFrame:
    """One row of statistics; ValueError over no values."""
    one = grouped_stats(df.select(F.col(value), F.lit(0).alias("__key")).filter(F.col(value).isNotNull()), value, "__key").drop("__key")
    if not one.take(1):
        raise ValueError("cannot compute statistics of an empty column")
    return one


def _check(percentiles: list[float]) -> None:
    if any(not 0 <= p <= 100 for p in percentiles):
        raise ValueError("percentiles must be between 0 and 100")


def order_statistics(df: DataFrame, value: str, wanted: dict, bounds: dict, key: str | None = None, sizes: dict | None = None) -> dict:
    """Of each key the values at its ranks (``wanted``: key to ranks from 0; ``bounds``: key to least and largest value).

    Keys with ``ENOUGH`` values or fewer (``sizes``, if known) are looked at value by value at once.
    """
    rows = df.select((F.lit(0) if key is None else F.col(key)).alias("__key"), F.col(value).alias("__x"))
    found: dict = {k: {} for k in wanted}
    # (key, low, high, values below low, ranks, whether to look at single values)
    open_ = [(k, *bounds[k], 0, ranks, (sizes or {}).get(k, ENOUGH + 1) <= ENOUGH) for k, ranks in wanted.items() if ranks]
    while open_:
        for k, low, high, _, ranks, _ in open_:
            if low == high:
                found[k] |= dict.fromkeys(ranks, low)
        open_ = [x for x in open_ if x[1] < x[2]]
        if not open_:
            break
        widths = [(high - low) / BUCKETS for _, low, high, *_ in open_]
        # where a bucket would be narrower than the gap between doubles, values are few
        fine = [single or low + w == low or w == 0 for (_, low, _, _, _, single), w in zip(open_, widths, strict=True)]
        table = [(i, x[0], x[1], x[2], w or 1.0, f) for i, (x, w, f) in enumerate(zip(open_, widths, fine, strict=True))]
        ranges = df.sparkSession.createDataFrame(table, StructType([StructField("i", LongType()), StructField("k", rows.schema["__key"].dataType), *[StructField(n, DoubleType()) for n in ("low", "high", "width")], StructField("fine", BooleanType())]))
        inside = rows.join(F.broadcast(ranges), F.col("__key").eqNullSafe(F.col("k")) & (F.col("__x") >= F.col("low")) & (F.col("__x") <= F.col("high")))
        slot = F.when(F.col("fine"), F.col("__x")).otherwise(F.least(F.floor((F.col("__x") - F.col("low")) / F.col("width")), F.lit(BUCKETS - 1)).cast("double"))
        counted = inside.groupBy("i", slot.alias("slot")).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high")).collect()
        closer = []
        for i, (k, _, _, before, ranks, _) in enumerate(open_):
            for r in sorted((r for r in counted if r["i"] == i), key=lambda r: r["low"]):
                mine = [x for x in ranks if before <= x < before + r["n"]]
                if mine:
                    closer.append((k, r["low"], r["high"], before, mine, r["n"] <= ENOUGH))
                before += r["n"]
        open_ = closer
    return found


def grouped_percentiles(df: DataFrame, value: str, percentiles: list[float], groups: dict, key: str | None = None) -> dict:
    """Percentiles of each group (key to number of values, least and largest), interpolated between neighbouring order statistics."""
    _check(percentiles)
    places = {k: [p / 100 * (n - 1) for p in percentiles] for k, (n, _, _) in groups.items()}
    wanted = {k: sorted({r for x in places[k] for r in (math.floor(x), min(math.floor(x) + 1, n - 1))}) for k, (n, _, _) in groups.items()}
    values = order_statistics(df, value, wanted, {k: (low, high) for k, (_, low, high) in groups.items()}, key, {k: n for k, (n, _, _) in groups.items()})
    out = {}
    for k, (n, _, _) in groups.items():
        out[k] = []
        for x in places[k]:
            a, b, t = values[k][math.floor(x)], values[k][min(math.floor(x) + 1, n - 1)], x - math.floor(x)
            out[k].append(a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t))
    return out


def exact_percentiles(df: DataFrame, value: str, percentiles: list[float]) -> list[float]:
    """Percentiles by linear interpolation between the two neighbouring order statistics; nulls are left out."""
    _check(percentiles)
    df = df.select(F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    n, low, high = df.agg(F.count("*"), F.min(value), F.max(value)).first()
    if not n:
        raise ValueError("cannot compute a percentile of an empty column")
    return grouped_percentiles(df, value, percentiles, {0: (n, low, high)})[0]


def threshold_cliff(df: DataFrame, value: str, percentiles: list[float] | None = None) -> tuple[float, float, float]:
    """(percentile, its value, jump) of the largest jump between consecutive percentiles; the first one of equal ones."""
    percentiles = list(CLIFF_PERCENTILES if percentiles is None else percentiles)
    if len(percentiles) < 2:
        raise ValueError("a cliff needs at least 2 percentiles")
    values = exact_percentiles(df, value, percentiles)
    best = (percentiles[1], values[1], 0.0)
    for p, before, after in zip(percentiles[1:], values[:-1], values[1:], strict=True):
        if abs(after - before) > best[2]:
            best = (p, after, abs(after - before))
    return best


def running_counts(df: DataFrame, value: str, counts: list[str]) -> DataFrame:
    """Running sums of the count columns over the values in order, without a global sort in one task.

    Sums of equal-width buckets (``BUCKETS`` rows) give each bucket its start; inside a bucket a window goes on.
    """
    low, high = df.agg(F.min(value), F.max(value)).first()
    width = ((high or 0) - (low or 0)) / BUCKETS or 1.0
    dealt = df.withColumn("__bucket", F.least(F.floor((F.col(value) - F.lit(low or 0.0)) / width), F.lit(BUCKETS - 1)))
    starts = dealt.groupBy("__bucket").agg(*[F.sum(c).alias(f"__{c}") for c in counts])
    earlier = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("__bucket", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in counts])
    inside = W.partitionBy("__bucket").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = dealt.join(F.broadcast(starts), "__bucket")
    return joined.select(value, *[(F.sum(c).over(inside) + F.col(f"__{c}")).alias(c) for c in counts])


def compare_distributions(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: ks_statistic, p_value, mean_diff and std_diff (a - b, population), n_a and n_b; ValueError if a side is empty."""
    both = a.select(F.col(value).cast("double").alias("value"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(value).cast("double").alias("value"), F.lit(0).alias("a"), F.lit(1).alias("b"))).filter("value IS NOT NULL")
    side = lambda f, s: f(F.when(F.col(s) == 1, F.col("value")))
    n_a, n_b, mean_diff, std_diff = both.agg(F.sum("a"), F.sum("b"), side(F.avg, "a") - side(F.avg, "b"), side(F.stddev_pop, "a") - side(F.stddev_pop, "b")).first()
    if not n_a or not n_b:
        raise ValueError("cannot compare with an empty distribution")
    counts = both.groupBy("value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    gap = F.abs(F.col("a") / F.lit(n_a) - F.col("b") / F.lit(n_b))
    statistic = running_counts(counts, "value", ["a", "b"]).agg(F.max(gap)).first()[0]
    return df_row(a, [("ks_statistic", statistic), ("p_value", ks_p_value(statistic, n_a, n_b)), ("mean_diff", mean_diff), ("std_diff", std_diff), ("n_a", n_a), ("n_b", n_b)])


def df_row(df: DataFrame, values: list[tuple[str, float | int]]) -> DataFrame:
    """One row of numbers."""
    kinds = ", ".join(f"{name} {'long' if isinstance(value, int) else 'double'}" for name, value in values)
    return df.sparkSession.createDataFrame([tuple(value for _, value in values)], kinds)


def ks_p_value(statistic: float, n_a: int, n_b: int) -> float:
    """Two-sided p-value of the two-sample Kolmogorov-Smirnov statistic: exact up to ``EXACT`` values a side, else the asymptotic one."""
    return exact_ks_p_value(statistic, n_a, n_b) if max(n_a, n_b) <= EXACT else asymptotic_ks_p_value(statistic, n_a, n_b)


def exact_ks_p_value(statistic: float, n_a: int, n_b: int) -> float:
    """The share of lattice paths from (0, 0) to (n_a, n_b) that reach a point (i, j) with abs(i / n_a - j / n_b) >= statistic.

    Of the paths to a point that is not so far out itself, the share that has been out is the mean of its two
    predecessors' shares, weighted by the paths through them (i and j out of i + j). The points of one diagonal i + j
    depend on the one before only, so it goes by diagonals. All terms are positive: small values keep their digits.
    """
    whole = math.lcm(n_a, n_b)
    out = round(statistic * whole)  # the statistic is a multiple of 1 / whole
    if out <= 0:
        return 1.0
    share = np.zeros(1)  # of the diagonal's points, by i from ``first``
    first = 0
    for total in range(1, n_a + n_b + 1):
        low, high = max(0, total - n_b), min(n_a, total)
        i = np.arange(low, high + 1)
        # predecessors (i - 1, j) and (i, j - 1); one that is off the grid has weight 0
        before = np.zeros(high - low + 3)
        before[first - low + 1 : first - low + 1 + len(share)] = share
        share = (before[:-2] * i + before[1:-1] * (total - i)) / total
        share[np.abs(i * (whole // n_a) - (total - i) * (whole // n_b)) >= out] = 1.0
        first = low
    return float(min(1.0, share[0]))


def asymptotic_ks_p_value(statistic: float, n_a: int, n_b: int) -> float:
    """The limiting series, with a correction of its argument for finite samples."""
    effective = math.sqrt(n_a * n_b / (n_a + n_b))
    x = (effective + 0.12 + 0.11 / effective) * statistic
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * math.fsum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
