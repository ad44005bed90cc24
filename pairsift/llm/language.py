"""Language identification: multinomial FTRL regression on TF-IDF character n-grams, with calibrated scores.

Document frequencies are counted over every training document, in one distributed pass; the regression is
fitted on a bounded sample of them, and every whole text is scored. The sample is drawn by a hash: ``sample_rows`` rows
in expectation, but of each language at least ``language_rows`` (all, if it has fewer), so rare languages are learned
too, and the sample holds ``sample_bytes`` of text at most. All languages are told apart; if they are more than a model of
``model_bytes`` has room for (2,048 by default), that is a ValueError.

Nulls and edges: a null text, or one without a letter, is ``und`` with score 0; rows with a null language or a
null id teach nothing; a null id is not held out; without any training row every text is ``und``. Repeated rows
each get their result. Only the columns named here are read, so others may be called anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DRAWS, bounded_sample, boxed, flat, id_remainder, limit_batches, mixed, slices, sparse_rows, table
from .ftrl import Examples, FtrlProximal, best_temperature, probabilities

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageSettings:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    sample_rows: int = 2500  # the regression's training rows; an upper bound in expectation
    language_rows: int = 100  # of each language, at least
    model_bytes: int = 1 << 30  # of the regression while it learns, 16 a weight
    sample_bytes: int = 1 << 26
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    @property
    def most_languages(self) -> int:
        return self.model_bytes >> self.bits + 4


@dataclass
class LanguageModel:
    settings: LanguageSettings
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0


def has_letter(text: str) -> bool:
    """Whether a text holds a character of the Unicode categories of letters (no digits, fractions or circled numbers)."""
    return any(map(str.isalpha, text))


def ngram_rows(data: bytes, offsets: np.ndarray, settings: LanguageSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the character n-grams of lower-cased texts; what is no letter counts as a space."""
    texts = [data[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    ascii_letter = (codes >= 97) & (codes <= 122)
    codes = np.where(ascii_letter | (codes >= 0xAA), codes, np.uint64(32))
    owner = np.repeat(np.arange(len(texts)), lengths)
    rows, buckets, key = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(settings.orders) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        key = key[:size] * np.uint64(0x1000193) + codes[n - 1 :] + np.uint64(n)
        if n in settings.orders:
            inside = owner[:size] == owner[n - 1 :]
            rows.append(owner[:size][inside])
            buckets.append(mixed(key[inside]) >> np.uint64(64 - settings.bits))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return sparse_rows(np.concatenate(rows), np.concatenate(buckets), settings.bits)


def tfidf(data: bytes, offsets: np.ndarray, idf: np.ndarray, settings: LanguageSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) with sublinear term frequencies; each text's values have length 1."""
    rows, buckets, counts = ngram_rows(data, offsets, settings)
    values = (1.0 + np.log(counts)) * idf[buckets]
    norms = np.sqrt(np.bincount(rows, values * values, minlength=len(offsets) - 1))
    return rows, buckets, values / np.where(norms > 0, norms, 1.0)[rows]


def document_frequencies(texts: DataFrame, settings: LanguageSettings) -> tuple[int, np.ndarray]:
    """Texts, and texts with each bucket: each task adds up its own, Spark adds the tasks'."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << settings.bits) + 1, np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            total[-1] += len(offsets) - 1
            for low, high in slices(offsets):
                part = offsets[low : high + 1] - offsets[low]
                _, buckets, _ = ngram_rows(data[offsets[low] : offsets[high]].tobytes(), part, settings)
                total[:-1] += np.bincount(buckets, minlength=1 << settings.bits)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    sums = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most 2**bits + 1 rows
    total = np.zeros((1 << settings.bits) + 1, np.int64)
    total[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return int(total[-1]), total[:-1]


def train_language_model(docs: DataFrame, settings: LanguageSettings = LanguageSettings(), learn: Column | None = None) -> LanguageModel:
    """Fit on the rows of (doc_id, text, lang) for which ``learn`` holds; by default id remainder modulo 4 is not 2."""
    limit_batches(docs.sparkSession)
    learn = id_remainder("doc_id", 4) != 2 if learn is None else learn
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text").alias("at"))
    n, frequencies = document_frequencies(rows.select("text"), settings)
    idf = np.log((1.0 + n) / (1.0 + frequencies)) + 1.0
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(settings.most_languages + 1).collect()
    if len(sizes) > settings.most_languages:
        raise ValueError(f"more than {settings.most_languages} languages: raise model_bytes or lower bits")
    share = min(1.0, settings.sample_rows / max(n, 1))
    shares = {r["lang"]: max(share, min(1.0, settings.language_rows / r["n"])) for r in sizes}
    limits = F.create_map(*[F.lit(x) for lang, part in shares.items() for x in (lang, int(part * DRAWS) or 1)]) if shares else F.lit(None).cast("map<string,long>")
    # repeated rows are drawn alike, hence the limit
    drawn = rows.filter(F.pmod("at", F.lit(DRAWS)) < F.try_element_at(limits, F.col("lang"))).limit(2 * (settings.sample_rows + settings.language_rows * len(shares)))
    picked = bounded_sample(drawn, settings.sample_bytes)
    data, offsets = flat(picked["text"])
    names = picked["lang"].to_pylist()
    languages = sorted(set(names))
    classes = np.array([languages.index(x) for x in names], np.int64)
    model = FtrlProximal((1 << settings.bits) + 1, max(2, len(languages)), settings.alpha, settings.beta, settings.l1, settings.l2)
    bias = 1 << settings.bits
    examples = Examples()
    for low, high in slices(offsets):
        part = offsets[low : high + 1] - offsets[low]
        examples.add(*tfidf(data[offsets[low] : offsets[high]].tobytes(), part, idf, settings), high - low)
    examples.pack()
    targets = np.eye(max(2, len(languages)))
    for _ in range(settings.epochs):
        for i in range(len(examples)):
            if i % 5 != 4:
                model.learn(*examples.get(i, bias), targets[classes[i]])
    weights = model.weights()
    back = [i for i in range(len(examples)) if i % 5 == 4]
    held = [examples.get(i, bias) for i in back]
    scores = np.array([values @ weights[features] for features, values in held]).reshape(len(back), weights.shape[1])
    return LanguageModel(settings, languages, idf, weights.astype(np.float32), best_temperature(scores, classes[back]))


def predict_languages(spark: SparkSession, model: LanguageModel, text: str = "text") -> Column:
    """A struct column (lang, score) of the text column."""
    limit_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**bits weights for each language, whatever the data

    def predict(texts: pa.Array) -> pa.Array:
        m: LanguageModel = shared.value
        data, offsets = flat(texts)
        best, score = np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1)
        for low, high in slices(offsets) if m.languages else ():
            part, body = offsets[low : high + 1] - offsets[low], data[offsets[low] : offsets[high]].tobytes()
            rows, buckets, values = tfidf(body, part, m.idf, m.settings)
            weights = m.weights[buckets, : len(m.languages)]
            sums = np.stack([np.bincount(rows, values * weights[:, k], minlength=high - low) for k in range(len(m.languages))], axis=1) + m.weights[-1, : len(m.languages)]
            p = probabilities(sums / m.temperature) if len(m.languages) > 1 else np.ones((high - low, 1))
            lettered = np.array([has_letter(body[a:b].decode("utf-8", "replace")) for a, b in zip(part[:-1], part[1:], strict=True)])
            best[low:high] = np.where(lettered, p.argmax(axis=1), -1)
            score[low:high] = np.where(lettered, p.max(axis=1), 0.0)
        names = np.array([*m.languages, UNKNOWN], object)[best]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return F.arrow_udf(predict, "struct<lang:string,score:double>")(F.col(text))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_language_model(docs)
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), predict_languages(spark, model).alias("p"))
    return scored.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


#: A document stays if some language is found with at least this probability.
KEEP_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised; their columns are unchanged."""
    model = train_language_model(docs.select("doc_id", "text", "lang"))
    found = boxed(docs, predict_languages(spark, model).alias("language"))
    return found.filter((F.col("language.lang") != UNKNOWN) & (F.col("language.score") >= KEEP_SCORE)).select("row.*")
