"""Quality classifier: logistic FTRL regression on hashed word n-grams, scored as sparse dot products.

Tokens are runs of word bytes (letters, digits, all non-ASCII) and runs of other marks, so that marks stuck to
words count on their own. Features are hashed tokens and pairs of neighbours; a token that repeats the one before
it, or the one before that, is also a feature of its own.

Nulls and edges: a null text counts as empty and gets the score of the bias; labels that are null, or whose id is
null, teach nothing; several labels of one id are averaged; without any label every score is 0.5. Repeated
documents each get their result. The regression learns from a sample drawn by a hash of the id, bounded in rows and in
bytes (``sample_rows``, ``sample_bytes``); every whole text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_KINDS, DRAWS, LOWER_BYTES, bounded_sample, boxed, flat, id_remainder, limit_batches, mixed, run_hashes, slices, sparse_rows, table
from .ftrl import Examples, FtrlProximal, probabilities


@dataclass(frozen=True)
class QualitySettings:
    bits: int = 18
    sample_rows: int = 5000  # labelled rows to learn from; an upper bound in expectation
    sample_bytes: int = 1 << 26  # of their texts, at most
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    accept: float = 0.3


@dataclass
class QualityModel:
    settings: QualitySettings
    weights: np.ndarray
    bias: float


def word_ngrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the hashed tokens and pairs; each text's values have length 1."""
    n = len(data)
    kind = BYTE_KINDS[data]
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    tokens = run_hashes(LOWER_BYTES[data], starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1
    follows, skips = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    pairs = tokens[:-1] * np.uint64(0x100000001B3) + mixed(tokens[1:])
    pairs = np.where(tokens[1:] == tokens[:-1], np.uint64(1), pairs)
    again = skips & (tokens[2:] == tokens[:-2])
    keys = np.concatenate([tokens, mixed(pairs[follows]), np.full(int(again.sum()), mixed(np.array([2], np.uint64))[0])])
    rows = np.concatenate([owner, owner[1:][follows], owner[2:][again]])
    rows, buckets, counts = sparse_rows(rows, keys >> np.uint64(64 - bits), bits)
    values = 1.0 + np.log(counts)
    norms = np.sqrt(np.bincount(rows, values * values, minlength=len(offsets) - 1))
    return rows, buckets, values / np.where(norms > 0, norms, 1.0)[rows]


def train_quality_model(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings(), learn: Column | None = None) -> QualityModel:
    """Fit on labelled documents (labels: doc_id, quality) for which ``learn`` holds; by default id remainder modulo 5 is not 0."""
    learn = id_remainder("doc_id", 5) != 0 if learn is None else learn
    marks = labels.filter(F.col("quality").isNotNull() & learn).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("mark"))
    share = min(1.0, settings.sample_rows / max(marks.count(), 1))
    at = F.xxhash64("doc_id")
    marks = marks.filter(F.pmod(at, F.lit(DRAWS)) < F.lit(int(share * DRAWS) or 1))
    picked = bounded_sample(docs.select("doc_id", "text").join(marks, "doc_id").select("text", "mark", at.alias("at")).limit(2 * settings.sample_rows), settings.sample_bytes)
    data, offsets = flat(picked["text"])
    targets = picked["mark"].to_numpy()[:, None]
    size = 1 << settings.bits
    examples = Examples()
    for low, high in slices(offsets):
        part = offsets[low : high + 1] - offsets[low]
        examples.add(*word_ngrams(data[offsets[low] : offsets[high]], part, settings.bits), high - low)
    examples.pack()
    model = FtrlProximal(size + 1, 1, settings.alpha, settings.beta, settings.l1, settings.l2)
    for _ in range(settings.epochs):
        for i in range(len(examples)):
            model.learn(*examples.get(i, size), targets[i])
    weights = model.weights()[:, 0]
    return QualityModel(settings, weights[:-1].astype(np.float32), float(weights[-1]))


def quality_scores(spark: SparkSession, model: QualityModel, text: str = "text") -> Column:
    """A double column: the probability of label 1."""
    limit_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**bits weights, whatever the data

    def score(texts: pa.Array) -> pa.Array:
        m: QualityModel = shared.value
        data, offsets = flat(texts)
        out = np.zeros(len(offsets) - 1)
        for low, high in slices(offsets):
            part = offsets[low : high + 1] - offsets[low]
            rows, buckets, values = word_ngrams(data[offsets[low] : offsets[high]], part, m.settings.bits)
            out[low:high] = np.bincount(rows, values * m.weights[buckets], minlength=high - low)
        return pa.array(probabilities((out + m.bias)[:, None])[:, 0], pa.float64())

    return F.arrow_udf(score, "double")(F.col(text))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality_model(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_scores(spark, model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= model.settings.accept, 1).otherwise(0).cast("int"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a score of at least ``accept``; their columns are unchanged."""
    model = train_quality_model(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return boxed(docs, quality_scores(spark, model).alias("quality")).filter(F.col("quality") >= model.settings.accept).select("row.*")
