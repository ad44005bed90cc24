"""Ingest of raw dialogue pairs (dataset_index, chosen, rejected) into examples.

Rows of null text are errors; NUL characters are deleted; the prompt is the last human turn of the chosen dialogue.
The index is a column of the source, so order never depends on how files are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialogue import last_turn, parse_turns


@dataclass(frozen=True)
class Ingested:
    examples: DataFrame
    errors: DataFrame
    summary: DataFrame


def source_limit(raw: DataFrame, limit: int) -> DataFrame:
    """The first rows by index; unlike a bare limit it always means the same ones, and it reaches the scan."""
    return raw.filter(F.col("dataset_index") < limit)


def cleaned(text: str) -> Column:
    return F.translate(F.col(text), "\0", "")


def _null_text() -> Column:
    return F.col("chosen").isNull() | F.col("rejected").isNull()


def parsed_examples(raw: DataFrame) -> DataFrame:
    """Examples of the rows with both texts."""
    clean = raw.filter(~_null_text()).select("dataset_index", cleaned("chosen").alias("chosen_full"), cleaned("rejected").alias("rejected_full"))
    turned = clean.withColumns({"__chosen": parse_turns("chosen_full"), "__rejected": parse_turns("rejected_full")})
    return turned.select(
        "dataset_index",
        "chosen_full",
        "rejected_full",
        last_turn(F.col("__chosen"), "assistant").alias("chosen_last_assistant"),
        last_turn(F.col("__rejected"), "assistant").alias("rejected_last_assistant"),
        last_turn(F.col("__chosen"), "human").alias("prompt"),
    )


def ingest(raw: DataFrame, existing: DataFrame | None = None, resume_from: int = 0) -> Ingested:
    """Examples, errors (index, error) and a summary of the rows from ``resume_from`` on; indices in ``existing`` are skipped."""
    visited = raw.filter(F.col("dataset_index") >= resume_from)
    if existing is None:
        marked = visited.withColumn("__known", F.lit(False))
    else:
        known = existing.select("dataset_index").distinct().withColumn("__known", F.lit(True))
        marked = visited.join(known, "dataset_index", "left").withColumn("__known", F.coalesce("__known", F.lit(False)))
    fresh = marked.filter(~F.col("__known")).drop("__known")
    errors = fresh.filter(_null_text()).select(F.col("dataset_index").alias("index"), F.lit("text is null").alias("error"))
    skipped, failed = F.col("__known"), ~F.col("__known") & _null_text()
    summary = marked.agg(F.count("*").alias("total_processed"), F.count_if(~skipped & ~failed).alias("total_inserted"), F.count_if(skipped).alias("skipped"), F.count_if(failed).alias("errors"))
    return Ingested(parsed_examples(fresh), errors, summary)


def progress(examples: DataFrame) -> DataFrame:
    """count, and the largest index or -1."""
    return examples.agg(F.count("*").alias("count"), F.coalesce(F.max("dataset_index"), F.lit(-1)).alias("max_index"))
