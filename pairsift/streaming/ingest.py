"""Streaming ingest: raw pairs, parsed, scored and flagged in micro-batches by the same functions as in batch.

An index that an earlier batch has brought is left out. Which have been seen is state: a bitmap for each block of
``BLOCK`` consecutive indices, so a batch reads and writes the blocks that it touches, and no batch reads what others have
stored. Of several rows of one index in a batch the one with the smallest texts stays (nulls last), on every run.

Thresholds: constant ones flag at once. Percentiles come from a sketch of all scores seen (see ``sketches``), which each batch
takes from the last one and stores anew; a signal holds the flag that this threshold gives on arrival. ``settled`` holds
all signals against the last batch's thresholds, as a batch run over the whole stream would, and says of which the sketch
is certain. Batch ids make a repeated batch overwrite itself. Rows of null index or text go to a folder of errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.detectors import Detector, registry, tokenised
from ..plans.config import Settings
from ..plans.pipeline import usable
from ..sources.ingest import ingest
from .sketches import K, bounds, certain, merged, sketched

RAW = "dataset_index long, chosen string, rejected string"
BLOCK, NO_BLOCK = 512, -(1 << 62)
#: Batches whose sketches are kept; a batch needs the one before it.
KEPT = 3
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


class NewIndices(StatefulProcessor):
    """The rows of a block whose index no batch before has brought, one for each index."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "bits binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[0] == NO_BLOCK:  # rows without an index are errors, all of them
            yield from (pd.DataFrame({"dataset_index": pd.array([None] * len(f), "Int64"), "chosen": f["chosen"], "rejected": f["rejected"]}) for f in rows)
            return
        bits = bytearray(self.seen.get()[0]) if self.seen.exists() else bytearray(BLOCK // 8)
        best: dict[int, tuple] = {}
        for frame in rows:
            for index, chosen, rejected in zip(frame["dataset_index"], frame["chosen"], frame["rejected"], strict=True):
                at = int(index) % BLOCK
                if not bits[at >> 3] >> (at & 7) & 1:
                    order = (chosen is None, chosen or "", rejected is None, rejected or "")
                    if at not in best or order < best[at][0]:
                        best[at] = (order, int(index), chosen, rejected)
        for at in best:
            bits[at >> 3] |= 1 << (at & 7)
        if best:
            self.seen.update((bytes(bits),))
        yield pd.DataFrame([row[1:] for _, row in sorted(best.items())], columns=["dataset_index", "chosen", "rejected"])

    def close(self) -> None:
        pass


def new_rows(raw: DataFrame) -> DataFrame:
    """The rows of a stream whose index has not come before."""
    raw.sparkSession.conf.set(_PROVIDER, _ROCKS)  # the only one that keeps states of this kind
    block = F.when(F.col("dataset_index").isNull(), NO_BLOCK).otherwise(F.shiftright("dataset_index", BLOCK.bit_length() - 1))
    blocks = raw.select("dataset_index", "chosen", "rejected", block.alias("block"))
    return blocks.groupBy("block").transformWithStateInPandas(NewIndices(), RAW, "Append", "None")


def scored(examples: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, dict[str, Detector]]:
    """dataset_index and a column of scores for each detector that the examples have the columns for."""
    pairs = examples.select("dataset_index", "prompt", F.col("chosen_last_assistant").alias("chosen"), F.col("rejected_last_assistant").alias("rejected"))
    detectors = usable(pairs, settings)
    return tokenised(pairs).select("dataset_index", *[d.score().alias(n) for n, d in detectors.items()]), detectors


def _verdict(detector: Detector, score: Column, found: dict) -> list[Column]:
    """threshold, flagged and certain of a score; null where a percentile has seen nothing."""
    row = found.get(detector.name)
    if detector.fixed_threshold is not None:
        threshold, sure = F.lit(detector.fixed_threshold), F.lit(True)
    else:
        threshold, low, high = (F.lit(row and row[c]).cast("double") for c in ("threshold", "low", "high"))
        sure = certain(detector, score, low, high)
    return [threshold.cast("double").alias("threshold"), detector.flags(score, threshold).alias("flagged"), sure.alias("certain")]


def _signals(scores: DataFrame, detectors: dict[str, Detector], found: dict) -> DataFrame:
    """dataset_index, detector_name, score, threshold, flagged and certain."""
    rows = [F.struct(F.lit(n).alias("detector_name"), F.col(n).cast("double").alias("score"), *_verdict(d, F.col(n), found)) for n, d in detectors.items()]
    return scores.select("dataset_index", F.explode(F.array(*rows)).alias("s")).select("dataset_index", "s.*")


def start_ingest(raw: DataFrame, out: str, checkpoint: str, settings: Settings | None = None, k: int = K) -> StreamingQuery:
    """Write examples, errors, signals and sketches of every micro-batch under ``out``, in folders by batch id."""
    settings = settings or Settings()

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        no_index = F.col("dataset_index").isNull()
        done = ingest(rows.filter(~no_index))
        examples = done.examples.persist(StorageLevel.MEMORY_AND_DISK)
        scores, detectors = scored(examples, settings)
        scores = scores.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            examples.write.mode("overwrite").parquet(f"{out}/examples/batch={batch_id}")
            lost = rows.filter(no_index).select(F.col("dataset_index").alias("index"), F.lit("index is null").alias("error"))
            done.errors.unionByName(lost).write.mode("overwrite").parquet(f"{out}/errors/batch={batch_id}")
            wanted = {n: settings.detector(n).threshold_percentile for n, d in detectors.items() if d.fixed_threshold is None}
            now = f"{out}/sketches/batch={batch_id}"
            if wanted:
                news = sketched(scores, list(wanted), k)
                if batch_id > 0:
                    news = news.unionByName(spark.read.schema("detector_name string, sketch binary").parquet(f"{out}/sketches/batch={batch_id - 1}"))
                merged(news, k).coalesce(1).write.mode("overwrite").parquet(now)
                found = bounds(spark.read.parquet(now), wanted, k)
            else:
                found = {}
            _signals(scores, detectors, found).write.mode("overwrite").parquet(f"{out}/signals/batch={batch_id}")
            _delete(spark, f"{out}/sketches/batch={batch_id - KEPT}")
        finally:
            for frame in (scores, examples, rows):
                frame.unpersist()

    return new_rows(raw).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(spark: SparkSession, out: str, settings: Settings | None = None, k: int = K) -> DataFrame:
    """dataset_index, detector_name, score, threshold, flagged and certain of all signals, by the last batch's thresholds."""
    settings = settings or Settings()
    detectors = {n: d for n, d in registry().items() if n in settings.detectors}
    last = spark.read.parquet(f"{out}/sketches").agg(F.max("batch")).first()[0]
    sketches = spark.read.parquet(f"{out}/sketches/batch={last}")
    found = bounds(sketches, {n: settings.detector(n).threshold_percentile for n in detectors}, k)
    chosen = F.coalesce(*[F.when(F.col("detector_name") == n, F.struct(*_verdict(d, F.col("score"), found))) for n, d in detectors.items()])
    rows = spark.read.parquet(f"{out}/signals").select("dataset_index", "detector_name", "score")
    return rows.withColumn("v", chosen).select("dataset_index", "detector_name", "score", "v.*")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
