"""Runs of detectors: score all pairs, find thresholds, flag, summarise.

The scores of all detectors come from one pass over the texts. Only narrow score columns are kept between the two
steps of a run (thresholds need all scores), as a table in the shared folder, so a lost executor costs no second pass over the
texts; detectors with a constant threshold need no second step.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import PERCENTILES, exact_percentiles, grouped_stats
from ..operators.detectors import Detector, registry, tokenised
from ..sources.store import stored
from .config import Settings


@dataclass(frozen=True)
class DetectorRun:
    run_id: int
    detector: Detector
    threshold: float
    percentile: float
    signals: DataFrame  # example_id, run_id, detector_name, score, flagged, metadata (a variant)

    def summary(self) -> DataFrame:
        """One row: id, detector_name, threshold, percentile_used, total_examples, flagged_count and the statistics, null for no scores."""
        rows = self.signals.select("score", "flagged", F.lit(0).alias("__key"))
        one = grouped_stats(rows, "score", "__key", F.count("*").alias("total_examples"), F.count_if("flagged").alias("flagged_count")).drop("__key")
        names = ["total_examples", "flagged_count", "mean", "std", "min", "max", *PERCENTILES]
        if not one.take(1):
            nothing = ", ".join(f"{n} {'long' if n in names[:2] else 'double'}" for n in names)
            one = self.signals.sparkSession.createDataFrame([(0, 0, *[None] * (len(names) - 2))], nothing)
        one = one.select(*names)
        return one.select(F.lit(self.run_id).cast("long").alias("id"), F.lit(self.detector.name).alias("detector_name"), F.lit(self.threshold).alias("threshold"), F.lit(self.percentile).alias("percentile_used"), "*")


def usable(pairs: DataFrame, settings: Settings | None = None, names: list[str] | None = None) -> dict[str, Detector]:
    """The configured detectors (or those named) that are enabled and whose input columns the pairs have, in their order."""
    settings = settings or Settings()
    wanted = settings.detectors if names is None else names
    return {n: d for n, d in registry().items() if n in wanted and settings.detector(n).enabled and set(d.needs) <= set(pairs.columns)}


def threshold_of(detector: Detector, scores: DataFrame, column: str, percentile: float) -> float:
    """The constant threshold, or the percentile of the scores; 0.0 without scores."""
    if detector.fixed_threshold is not None:
        return detector.fixed_threshold
    return exact_percentiles(scores, column, [percentile])[0] if scores.take(1) else 0.0


def run_detector(pairs: DataFrame, detector: Detector, percentile: float = 99.5, run_id: int = 1, done: DataFrame | None = None, metadata: bool = True) -> DetectorRun:
    """Score and flag the pairs (example_id and the columns the detector needs); examples in ``done`` (a resumed run's) are left out, and metadata is null if not wanted."""
    if done is not None:
        pairs = pairs.join(done.select("example_id"), "example_id", "left_anti")
    split = tokenised(pairs) if {"chosen", "rejected"} <= set(pairs.columns) else pairs
    scored = split.select("example_id", detector.score().alias("score"), (F.to_variant_object(detector.metadata()) if metadata else F.lit(None).cast("variant")).alias("metadata"))
    if detector.fixed_threshold is None:
        scored = stored(scored)
    threshold = threshold_of(detector, scored.select("score"), "score", percentile)
    signals = scored.select("example_id", F.lit(run_id).cast("long").alias("run_id"), F.lit(detector.name).alias("detector_name"), "score", detector.flags(F.col("score"), F.lit(threshold)).alias("flagged"), "metadata")
    return DetectorRun(run_id, detector, threshold, percentile, signals)


@contextmanager
def scored(pairs: DataFrame, detectors: dict[str, Detector], settings: Settings, run_ids: dict[str, int], done: DataFrame | None = None) -> Iterator[tuple[dict[str, float], DataFrame]]:
    """Thresholds and signals of runs of several detectors, from one pass over the pairs; scores are kept as long as the context is open.

    ``done`` (example_id, and an array of detectors) says which examples a detector leaves out.
    """
    split = tokenised(pairs) if {"chosen", "rejected"} <= set(pairs.columns) else pairs
    columns = [c for n, d in detectors.items() for c in (d.score().alias(f"score_{n}"), F.to_variant_object(d.metadata()).alias(f"meta_{n}"))]
    wide = split.select("example_id", *columns)
    wide = wide.withColumn("done", F.array().cast("array<string>")) if done is None else wide.join(done, "example_id", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    wide = wide.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        thresholds, rows = {}, []
        for name, detector in detectors.items():
            mine = wide.filter(~F.array_contains("done", name)).select(F.col(f"score_{name}").alias("score"))
            thresholds[name] = threshold_of(detector, mine, "score", settings.detector(name).threshold_percentile)
            flag = detector.flags(F.col(f"score_{name}"), F.lit(thresholds[name]))
            rows.append(F.struct(F.lit(run_ids[name]).cast("long").alias("run_id"), F.lit(name).alias("detector_name"), F.col(f"score_{name}").alias("score"), flag.alias("flagged"), F.col(f"meta_{name}").alias("metadata")))
        signals = wide.select("example_id", "done", F.explode(F.array(*rows)).alias("signal")).filter(~F.array_contains("done", F.col("signal.detector_name")))
        yield thresholds, signals.select("example_id", "signal.*")
    finally:
        wide.unpersist()


def run_all(pairs: DataFrame, settings: Settings | None = None, names: list[str] | None = None) -> DataFrame:
    """Signals (example_id, detector_name, threshold, score, flagged) of all enabled detectors, from one pass over the pairs."""
    settings = settings or Settings()
    unknown = set(names or ()) - set(registry())
    if unknown:
        raise ValueError(f"unknown detectors: {', '.join(sorted(unknown))}")
    detectors = usable(pairs, settings, names)
    split = tokenised(pairs) if {"chosen", "rejected"} <= set(pairs.columns) else pairs
    scores = stored(split.select("example_id", *[d.score().alias(n) for n, d in detectors.items()]))
    rows = []
    for name, detector in detectors.items():
        threshold = threshold_of(detector, scores.select(name), name, settings.detector(name).threshold_percentile)
        rows.append(F.struct(F.lit(name).alias("detector_name"), F.lit(threshold).alias("threshold"), F.col(name).alias("score"), detector.flags(F.col(name), F.lit(threshold)).alias("flagged")))
    return scores.select("example_id", F.explode(F.array(*rows)).alias("signal")).select("example_id", "signal.*")
