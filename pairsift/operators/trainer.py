"""A Bradley-Terry reward model over hashed words, trained in mini-batches by AdamW.

A response is a sparse vector: its lower-case words and pairs of neighbouring words, hashed to 2**bits features, each
occurrence 1 / sqrt(occurrences). Its reward is the product with the weights. The loss of a pair is -log sigmoid of the
rewards' difference.

Pairs are shuffled anew each epoch, by a hash of (seed, epoch, index) that also says which batch they are in: a batch has
``batch_size`` pairs in expectation. Texts are hashed once, to vectors in a table. An epoch's batches are dealt to the partitions of a
table, so a step reads its own batch and no other. Each task adds up the gradients of its pairs, Spark adds the tasks' by feature, and
the driver takes the step: weights and both moments are 3 * 2**bits numbers, whatever the data.

Steps follow each other, and a job for each of many small batches would be mostly waiting. So batches of less than ``_RUN`` pairs go
in runs of some ``_RUN`` pairs together: a run is one partition, whose task takes the steps of its batches in their order and
returns weights and moments to the driver, for the next run's task.

Nulls and edges: null texts are empty, an empty text has reward 0; a null index is hashed as the empty text, and repeated rows
all count. Training without pairs is a ValueError.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.store import shared_folder

#: Numbers of a step that are added up beside the gradient.
_LOSS, _WON, _PAIRS = -1, -2, -3
#: Pairs of one file of a batch.
_FILE = 100_000
#: Pairs of a run of batches, in expectation.
_RUN = 20_000
#: Pairs that are hashed to vectors together.
_SLICE = 256


@dataclass(frozen=True)
class TrainSettings:
    bits: int = 18
    epochs: int = 1
    batch_size: int = 4096
    rate: float = 0.01
    decay: float = 0.01
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    seed: int = 1


@dataclass(frozen=True)
class TrainedModel:
    settings: TrainSettings
    weights: np.ndarray
    final_loss: float
    final_accuracy: float
    history: dict[str, list[float]]  # epoch_loss and epoch_accuracy, of the weights that each batch began with


def _number(text: Column) -> Column:
    """32 bits of a hash."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _digits(text: bytes) -> int:
    """``_number`` of one text."""
    return int.from_bytes(hashlib.md5(text).digest()[:4], "big")


def _hashed(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of all features of lists of words: one for each word and each pair of neighbours. Equal ones are hashed once."""
    sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    known, at = [w.encode() for w in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(tokens)), sizes)
    # the last word has no neighbour
    first = np.flatnonzero(rows[1:] == rows[:-1])
    pairs, which = np.unique(at[first] * max(1, len(known)) + at[first + 1], return_inverse=True)
    of_words = np.array([_digits(w) for w in known], np.int64)
    of_pairs = np.array([_digits(known[p // len(known)] + b" " + known[p % len(known)]) for p in pairs.tolist()], np.int64)
    return np.concatenate([rows, rows[first]]), np.concatenate([of_words[at], of_pairs[which]])


_SPARSE = "struct<at:array<int>,value:array<double>>"


def _summed(tokens: pa.Array, bits: int) -> pa.Array:
    """Of lists of words, the distinct features of each, hashed to 2**bits, and their values."""
    ats, values, counts = [np.zeros(0, np.int32)], [np.zeros(0)], [np.zeros(1, np.int64)]
    for low in range(0, len(tokens), _SLICE):
        part = tokens.slice(low, _SLICE)
        rows, numbers = _hashed(part)
        sizes = np.bincount(rows, minlength=len(part))
        keys, n = np.unique((rows << bits) | (numbers & ((1 << bits) - 1)), return_counts=True)
        rows = keys >> bits
        ats.append((keys & ((1 << bits) - 1)).astype(np.int32))
        values.append(n / np.sqrt(sizes[rows]))
        counts.append(np.bincount(rows, minlength=len(part)))
    offsets = pa.array(np.cumsum(np.concatenate(counts)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (ats, values)]
    return pa.StructArray.from_arrays(lists, ["at", "value"])


def vectors(pairs: DataFrame, bits: int) -> DataFrame:
    """dataset_index, and chosen and rejected as sparse vectors: ``at`` and ``value``."""
    summed = F.arrow_udf(lambda tokens: _summed(tokens, bits), _SPARSE)
    return pairs.select("dataset_index", *[summed(F.transform(words(side), lambda w: F.lower(w))).alias(side) for side in ("chosen", "rejected")])


def kept_vectors(pairs: DataFrame, bits: int) -> DataFrame:
    """``vectors`` as a table in the shared folder."""
    folder = f"{shared_folder(pairs.sparkSession)}/vectors"
    vectors(pairs, bits).write.parquet(folder)
    return pairs.sparkSession.read.parquet(folder)


def _entries(side: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of all entries."""
    at, value = side.flatten()
    sizes = pc.list_value_length(at).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(side)), sizes), at.flatten().to_numpy(), value.flatten().to_numpy()


def _rewards(side: pa.StructArray, weights: np.ndarray) -> np.ndarray:
    rows, at, values = _entries(side)
    return np.bincount(rows, weights[at] * values, minlength=len(side))


def _gradient(pairs: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, float, int, int]:
    """The gradient's sum, and the sums of losses, won pairs and pairs."""
    sides = [_entries(pairs.column(side)) for side in ("chosen", "rejected")]
    gap = np.subtract(*[np.bincount(rows, weights[at] * values, minlength=pairs.num_rows) for rows, at, values in sides])
    miss = 1 / (1 + np.exp(np.minimum(gap, 700)))
    total = np.subtract(*[np.bincount(at, miss[rows] * values, minlength=len(weights)) for rows, at, values in reversed(sides)])
    return total, float((np.maximum(-gap, 0) + np.log1p(np.exp(-np.abs(gap)))).sum()), int((gap > 0).sum()), len(gap)


@dataclass
class _State:
    """Weights and both moments after a number of steps, and the epoch's sums of losses, won pairs and pairs so far."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    loss: float = 0.0
    won: int = 0
    pairs: int = 0

    def step(self, s: TrainSettings, gradient: np.ndarray, loss: float, won: int, n: int) -> None:
        self.steps += 1
        gradient = gradient / n
        self.first = s.beta1 * self.first + (1 - s.beta1) * gradient
        self.second = s.beta2 * self.second + (1 - s.beta2) * gradient * gradient
        moved = (self.first / (1 - s.beta1**self.steps)) / (np.sqrt(self.second / (1 - s.beta2**self.steps)) + s.epsilon)
        self.weights = self.weights * (1 - s.rate * s.decay) - s.rate * moved
        self.loss, self.won, self.pairs = self.loss + loss, self.won + won, self.pairs + n


def _step_sums(batch: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, int, int]:
    """The gradient's sum, and the sums of losses, won pairs and pairs, over a batch."""
    shared = batch.sparkSession.sparkContext.broadcast(weights)
    size = len(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, won, pairs = np.zeros(size), 0.0, 0, 0
        for part in batches:
            more = _gradient(part, shared.value)
            total, loss, won, pairs = total + more[0], loss + more[1], won + more[2], pairs + more[3]
        used = np.flatnonzero(total)
        keys = np.concatenate([used, [_LOSS, _WON, _PAIRS]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate([total[used], [loss, won, pairs]]))], ["feature", "total"])

    try:
        sums = batch.mapInArrow(add, "feature long, total double").groupBy("feature").agg(F.sum("total").alias("total")).toArrow()
    finally:
        shared.destroy()
    keys, totals = sums["feature"].to_numpy(), sums["total"].to_numpy()
    gradient = np.zeros(size)
    gradient[keys[keys >= 0]] = totals[keys >= 0]
    rest = dict(zip(keys[keys < 0].tolist(), totals[keys < 0].tolist(), strict=True))
    return gradient, rest.get(_LOSS, 0.0), int(rest.get(_WON, 0)), int(rest.get(_PAIRS, 0))


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The training batches of rows in the order of ``batch``; one may go over several Arrow batches."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        at = part.column("batch").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if low < high:
                if held and held[-1].column("batch")[0].as_py() != at[low]:
                    yield pa.concat_batches(held)
                    held = []
                held.append(part.slice(low, high - low))
    if held:
        yield pa.concat_batches(held)


def _run_steps(run: DataFrame, state: _State, s: TrainSettings) -> _State:
    """The state after the batches of a run, in one task."""
    shared = run.sparkSession.sparkContext.broadcast(state)

    def steps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = replace(shared.value)
        for batch in _batches(parts):
            now.step(s, *_gradient(batch, now.weights))
        lists = [pa.array([x]) for x in (now.weights, now.first, now.second)]
        yield pa.RecordBatch.from_arrays([*lists, *[pa.array([x]) for x in (now.steps, now.loss, now.won, now.pairs)]], _STATE)

    kinds = ["array<double>"] * 3 + ["long", "double", "long", "long"]
    try:
        row = run.coalesce(1).sortWithinPartitions("batch").mapInArrow(steps, ", ".join(f"{n} {k}" for n, k in zip(_STATE, kinds, strict=True))).toArrow()
    finally:
        shared.destroy()
    arrays = [row[n].combine_chunks().flatten().to_numpy() for n in _STATE[:3]]
    return _State(*arrays, *[row[n][0].as_py() for n in _STATE[3:]])


_STATE = ["weights", "first", "second", "steps", "loss", "won", "pairs"]


def train(pairs: DataFrame, settings: TrainSettings = TrainSettings()) -> TrainedModel:
    """Weights fitted to (dataset_index, chosen, rejected)."""
    return fit(kept_vectors(pairs, settings.bits), settings)


def fit(features: DataFrame, settings: TrainSettings = TrainSettings()) -> TrainedModel:
    """Weights fitted to the rows of ``kept_vectors``."""
    s, spark = settings, features.sparkSession
    root = shared_folder(spark)
    count = features.count()
    if not count:
        raise ValueError("no pairs to train on")
    batches = -(-count // s.batch_size)
    # batches that make a run together; 1: each is a job of its own
    together = max(1, _RUN // s.batch_size)
    state, history = _State(*(np.zeros(1 << s.bits) for _ in range(3))), {"epoch_loss": [], "epoch_accuracy": []}
    for epoch in range(s.epochs):
        drawn = _number(F.concat(F.lit(f"{s.seed}:{epoch}:"), F.coalesce(F.col("dataset_index").cast("string"), F.lit(""))))
        dealt = features.withColumn("batch", drawn % batches).withColumn("file", F.pmod(F.xxhash64("dataset_index"), F.lit(max(1, s.batch_size // _FILE))))
        dealt = dealt.withColumn("run", F.floor(F.col("batch") / together)).drop("dataset_index")
        dealt.repartition("run", "file").drop("file").write.partitionBy("run").parquet(f"{root}/epoch{epoch}")
        state = replace(state, loss=0.0, won=0, pairs=0)
        for r in sorted(r["run"] for r in spark.read.parquet(f"{root}/epoch{epoch}").select("run").distinct().collect()):
            run = spark.read.schema(f"chosen {_SPARSE}, rejected {_SPARSE}, batch long").parquet(f"{root}/epoch{epoch}/run={r}")
            if together > 1:
                state = _run_steps(run, state, s)
            else:
                state.step(s, *_step_sums(run.drop("batch"), state.weights))
        history["epoch_loss"].append(state.loss / state.pairs)
        history["epoch_accuracy"].append(state.won / state.pairs)
    last = [history[k][-1] if s.epochs else math.nan for k in ("epoch_loss", "epoch_accuracy")]
    return TrainedModel(s, state.weights, *last, history)


def rewards(pairs: DataFrame, model: TrainedModel) -> DataFrame:
    """dataset_index, chosen_reward and rejected_reward."""
    return scored(vectors(pairs, model.settings.bits), model)


def scored(features: DataFrame, model: TrainedModel) -> DataFrame:
    """``rewards`` of the rows of ``vectors``."""
    shared = features.sparkSession.sparkContext.broadcast(model.weights)
    reward = F.arrow_udf(lambda side: pa.array(_rewards(side, shared.value)), "double")
    return features.select("dataset_index", *[reward(side).alias(f"{side}_reward") for side in ("chosen", "rejected")])
