"""Text vectors without an outside model: words weighed by their rarity, projected at random.

A word stands for 256 signs, the bits of its SHA-256, so words have no table and nothing is learned but document
frequencies. These are counted by 20 bits of the same hash: the fitted model is one array of ``BUCKETS`` numbers, whatever
the corpus. A text is the sum of its words' signs, each times its weight, (1 + ln tf) * idf in units of 1 / 1024. By the
random projection the cosine of two such vectors is that of the weighted bags of words, give or take about 1 / 16. Words stand
in no order: a text and the same words in another order are alike.

Words are runs of letters and digits in lower case. Texts without any (null ones too) are alike, and unlike all others. The
components are whole numbers, so they do not depend on the order of the words.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present
from .backends import with_embeddings

DIMENSIONS, BITS = 256, 20
BUCKETS = 1 << BITS
UNIT = 1024
#: Words whose signs a task keeps.
_KEPT = 1 << 16
_WORD = re.compile(r"[^\W_]+")


def _words(text: Column | str) -> Column:
    found = F.regexp_extract_all(F.lower(present(text)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def _bucket(word: Column) -> Column:
    return F.conv(F.substring(F.sha2(word.cast("binary"), 256), 1, BITS // 4), 16, 10).cast("int")


@dataclass(frozen=True)
class Embedder:
    texts: int
    weights: np.ndarray  # of each bucket: idf in units of 1 / UNIT

    def vectors(self, texts: list[str]) -> np.ndarray:
        return self.factory()(texts)

    def factory(self) -> Callable[[list[str]], np.ndarray]:
        """A function from texts to vectors of whole numbers, for one task."""
        weights, signs = self.weights, {}

        def of(word: str) -> tuple[int, np.ndarray]:
            if word not in signs:
                if len(signs) >= _KEPT:
                    signs.clear()
                digest = hashlib.sha256(word.encode("utf-8", "surrogatepass")).digest()
                bits = np.unpackbits(np.frombuffer(digest, np.uint8)).astype(np.int64)
                signs[word] = int(weights[int.from_bytes(digest[:4], "big") >> (32 - BITS)]), 2 * bits - 1
            return signs[word]

        def one(text: str) -> np.ndarray:
            total = np.zeros(DIMENSIONS, np.int64)
            for word, n in Counter(_WORD.findall(text.lower()) or [""]).items():
                weight, sign = of(word)
                total += int(weight * (1 + np.log(n)) + 0.5) * sign
            return total

        return lambda texts: np.array([one(text) for text in texts]).reshape(len(texts), DIMENSIONS)


def fit_embedder(texts: DataFrame, *columns: str) -> Embedder:
    """From the document frequencies of the text columns, each value of which is a document. Without texts all words weigh the same."""
    every = texts.select(F.explode(F.array(*[F.struct(F.col(c).alias("text")) for c in columns])).alias("t")).select("t.text")
    total = every.count()
    buckets = every.select(F.explode(F.array_distinct(F.transform(_words("text"), _bucket))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).toPandas()
    frequency = np.zeros(BUCKETS, np.int64)
    frequency[buckets["bucket"].to_numpy(np.int64)] = buckets["n"].to_numpy(np.int64)
    weights = UNIT * (np.log((1 + total) / (1 + frequency)) + 1)
    return Embedder(total, np.floor(weights + 0.5).astype(np.int32))


def with_own_embeddings(pairs: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """The pairs with unit vectors chosen_embedding and rejected_embedding; without an embedder, of one fitted on the pairs."""
    embedder = embedder or fit_embedder(pairs, "chosen", "rejected")
    return with_embeddings(pairs, embedder.factory)


def own_similarity(pairs: DataFrame, embedder: Embedder) -> DataFrame:
    """The pairs with ``similarity``: the cosine of the whole vectors, before they are rounded to 32 bits."""

    @F.pandas_udf("double")
    def cosine(chosen: pd.Series, rejected: pd.Series) -> pd.Series:
        make = embedder.factory()
        a, b = (make(side.fillna("").tolist()).astype(np.float64) for side in (chosen, rejected))
        size = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
        return pd.Series((a * b).sum(axis=1) / np.maximum(size, 1e-12))

    return pairs.withColumn("similarity", cosine("chosen", "rejected"))
