"""Human reviews of flagged examples: a log of events, the last one of each (example, detector) counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import latest

LABELS = ("true_positive", "false_positive", "needs_review")


def upserted(log: DataFrame) -> DataFrame:
    """The label of each (example_id, detector_name): the latest by updated_at, ties by label."""
    return latest(log, ["example_id", "detector_name"], [F.desc("updated_at"), F.desc("label")])


def submitted(log: DataFrame, examples: DataFrame, requests: DataFrame) -> DataFrame:
    """The log with requests (dataset_index, detector_name, label, updated_at) added; ValueError for an unknown label, LookupError for an unknown index."""
    bad = requests.filter(F.col("label").isNull() | ~F.col("label").isin(*LABELS)).select("label").first()
    if bad is not None:
        raise ValueError(f"label must be one of {', '.join(LABELS)}, not {bad['label']!r}")
    known = requests.join(examples.select(F.col("id").alias("example_id"), "dataset_index"), "dataset_index", "left")
    missing = known.filter("example_id IS NULL").select("dataset_index").first()
    if missing is not None:
        raise LookupError(f"no example has index {missing['dataset_index']}")
    return log.unionByName(known.select(*log.columns))


def reviews_for(reviews: DataFrame, ids: DataFrame, detector: str) -> DataFrame:
    """example_id and label of the reviews of these examples (example_id) for a detector."""
    return reviews.filter(F.col("detector_name") == detector).join(ids, "example_id", "left_semi").select("example_id", "label")


def review_stats(reviews: DataFrame) -> DataFrame:
    """Counts by detector and label; labels outside the usual three are counted as other."""
    usual = [F.count_if(F.col("label") == name).alias(name) for name in LABELS]
    return reviews.groupBy("detector_name").agg(*usual, F.count_if(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))).alias("other"))


def reviewer_precision(reviews: DataFrame) -> DataFrame:
    """The counts with their total, and the share of true among decided reviews in per cent (null if none is decided)."""
    decided = F.col("true_positive") + F.col("false_positive")
    return review_stats(reviews).select("detector_name", *LABELS, (decided + F.col("needs_review")).alias("total"), F.round(F.try_divide(100 * F.col("true_positive"), decided), 1).alias("precision"))
