"""Reward models: pairwise loss, evaluation, training sets, and a linear Bradley-Terry model.

The linear model here has three features and fixed or fitted weights; ``trainer`` has one over hashed words. ``evaluated``
takes any rewards, so deep scorers plug in as columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_ratio, present, words


def pair_loss(chosen: Column | str, rejected: Column | str) -> Column:
    """-log sigmoid of the gap, without overflow."""
    gap = F.col(chosen) - F.col(rejected) if isinstance(chosen, str) else chosen - rejected
    return F.greatest(-gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap)))


def train_metrics(rewards: DataFrame) -> DataFrame:
    """Mean loss and accuracy of (chosen_reward, rejected_reward)."""
    won = (F.col("chosen_reward") > F.col("rejected_reward")).cast("double")
    return rewards.agg(F.avg(pair_loss("chosen_reward", "rejected_reward")).alias("loss"), F.avg(won).alias("accuracy"))


def evaluated(rewards: DataFrame) -> DataFrame:
    """accuracy (ties count as wrong), correct, total and avg_reward_gap; zeros over no rows."""
    gap = F.col("chosen_reward") - F.col("rejected_reward")
    one = rewards.agg(F.count_if(gap > 0).alias("correct"), F.count("*").alias("total"), F.coalesce(F.avg(gap), F.lit(0.0)).alias("avg_reward_gap"))
    return one.select(F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0).alias("accuracy"), "correct", "total", "avg_reward_gap")


def training_pairs(examples: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Pairs whose index is not excluded and whose prompt and responses are not empty."""
    kept = examples if excluded is None else examples.join(excluded.select("dataset_index"), "dataset_index", "left_anti")
    return kept.filter((present("prompt") != "") & (present("chosen") != "") & (present("rejected") != ""))


def training_from_store(examples: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """All examples, or those of the ids; empty texts stay."""
    return examples if ids is None else examples.join(ids.select("id"), "id", "left_semi")


FEATURES = ("words", "unique", "length")


def features(text: str, prefix: str) -> dict[str, Column]:
    tokens = words(text)
    return {f"{prefix}_words": F.log1p(F.size(tokens)), f"{prefix}_unique": distinct_ratio(tokens), f"{prefix}_length": F.log1p(F.char_length(present(text)))}


def differences(pairs: DataFrame) -> DataFrame:
    both = pairs.withColumns({**features("chosen", "c"), **features("rejected", "r")})
    return both.select("dataset_index", *[(F.col(f"c_{f}") - F.col(f"r_{f}")).alias(f) for f in FEATURES])


@dataclass(frozen=True)
class Trained:
    weights: dict[str, float]
    final_loss: float
    final_accuracy: float
    history: dict[str, list[float]]  # epoch_loss and epoch_accuracy, of the weights that each epoch began with


def train_linear(pairs: DataFrame, epochs: int = 20, rate: float = 1.0, l2: float = 1e-3) -> Trained:
    """Bradley-Terry training by gradient descent on the mean pairwise loss, from weights of zero; an epoch is one aggregate.

    Features are divided by their root mean square, found in one aggregate before. ValueError without pairs.
    """
    rows = differences(pairs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, *squares = rows.agg(F.count("*"), *[F.avg(F.col(f) * F.col(f)) for f in FEATURES]).first()
        if not n:
            raise ValueError("no pairs to train on")
        scale = [x**0.5 or 1.0 for x in squares]
        weights, history = [0.0] * len(FEATURES), {"epoch_loss": [], "epoch_accuracy": []}
        for _ in range(epochs):
            gap = sum((F.lit(w) * F.col(f) / F.lit(d) for w, f, d in zip(weights, FEATURES, scale, strict=True)), F.lit(0.0))
            missed = F.lit(1.0) / (1.0 + F.exp(gap))
            loss, accuracy, *slopes = rows.agg(F.avg(pair_loss(gap, F.lit(0.0))), F.avg((gap > 0).cast("double")), *[F.avg(missed * F.col(f) / F.lit(d)) for f, d in zip(FEATURES, scale, strict=True)]).first()
            history["epoch_loss"].append(loss)
            history["epoch_accuracy"].append(accuracy)
            weights = [w + rate * (s - l2 * w) for w, s in zip(weights, slopes, strict=True)]
        return Trained({f: w / d for f, w, d in zip(FEATURES, weights, scale, strict=True)}, history["epoch_loss"][-1], history["epoch_accuracy"][-1], history)
    finally:
        rows.unpersist()


def linear_rewards(pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """dataset_index, chosen_reward and rejected_reward under the weights."""
    both = pairs.withColumns({**features("chosen", "c"), **features("rejected", "r")})
    score = lambda side: sum((F.lit(w) * F.col(f"{side}_{f}") for f, w in weights.items()), F.lit(0.0))
    return both.select("dataset_index", score("c").alias("chosen_reward"), score("r").alias("rejected_reward"))


def compare(clean: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """Both evaluations, their differences (clean minus unfiltered) and the winner; a tie goes to unfiltered."""
    a, b = (df.select(F.col("accuracy").alias(f"{n}_accuracy"), F.col("avg_reward_gap").alias(f"{n}_gap"), F.lit(1).alias("one")) for df, n in ((clean, "clean"), (unfiltered, "unfiltered")))
    both = a.join(b, "one").drop("one")
    diff = F.col("clean_accuracy") - F.col("unfiltered_accuracy")
    return both.select("*", diff.alias("accuracy_diff"), (F.col("clean_gap") - F.col("unfiltered_gap")).alias("gap_diff"), F.when(diff > 0, "clean").otherwise("unfiltered").alias("winner"))
