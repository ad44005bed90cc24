"""Thresholds of a stream: mergeable quantile sketches of the scores seen so far, one a detector.

A sketch (KLL, the built-in functions) of ``k`` has at most some 3 * k values, whatever it has seen. With a probability of
99 % the rank of a quantile that it gives is off by no more than ``rank_error(k)`` of all values; below ``k`` values it is
exact. A micro-batch is sketched by partial aggregation and merged into the last batch's sketches, so the work of a
batch does not grow with the stream.

The quantiles at the percentile less and plus that error (and one value, as the exact threshold lies between
neighbouring values) hold the exact threshold between them. A score outside of the two is flagged as all scores so far
would flag it; ``certain`` says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.detectors import Detector

K = 8192


def rank_error(k: int) -> float:
    """Of a quantile's normalised rank, at 99 % confidence: the fit that its authors publish for the sketch."""
    return 2.296 / k**0.9021


def sketched(scores: DataFrame, names: list[str], k: int = K) -> DataFrame:
    """detector_name and sketch of the score columns ``names``."""
    one = scores.agg(*[F.kll_sketch_agg_double(F.col(n).cast("double"), F.lit(k)).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("detector_name"), F.col(n).alias("sketch")) for n in names])
    return one.select(F.explode(rows).alias("s")).select("s.*")


def merged(sketches: DataFrame, k: int = K) -> DataFrame:
    """One sketch for each detector_name, of all that its sketches have seen."""
    return sketches.groupBy("detector_name").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def bounds(sketches: DataFrame, percentiles: dict[str, float], k: int = K) -> dict[str, dict[str, float]]:
    """Of each detector that has seen scores: seen, threshold, low and high."""
    seen = {r["detector_name"]: r["seen"] for r in sketches.select("detector_name", F.kll_sketch_get_n_double("sketch").alias("seen")).collect()}
    found = {}
    wanted = {n: p / 100 for n, p in percentiles.items() if seen.get(n)}
    if wanted:
        columns = []
        for name, share in wanted.items():
            off = rank_error(k) + 1 / seen[name]
            ranks = F.array(*[F.lit(min(1.0, max(0.0, r))) for r in (share, share - off, share + off)])
            columns.append(F.first(F.when(F.col("detector_name") == name, F.kll_sketch_get_quantile_double("sketch", ranks)), ignorenulls=True).alias(name))
        row = sketches.agg(*columns).first()
        found = {n: dict(zip(("threshold", "low", "high"), row[n], strict=True), seen=seen[n]) for n in wanted}
    return found


def certain(detector: Detector, score: Column, low: Column, high: Column) -> Column:
    """Whether the exact threshold of all scores so far, which is from ``low`` to ``high``, flags the score as either of them does."""
    return detector.flags(score, low) == detector.flags(score, high)
