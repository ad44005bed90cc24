"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For every benchmark item, windows of the item's size are taken from each whole text. A window's SimHash over its
five-word shingles is looked up in an index of the items' SimHashes, cut into blocks: within a radius of r bits over
m blocks some block differs by at most r // m bits, and every item is filed under all values that close, so equal
keys find all items within the radius. Candidates are verified by the exact weighted (multiset) Jaccard similarity
of the shingles, sum of the smaller counts over sum of the larger ones.

A window that reaches any similarity shares a shingle with the item. So windows are fingerprinted where they hold a
shingle of an item of their size, and nowhere else; that leaves out none that could be verified.

Everything happens within the task that reads a text; only matches leave it. The benchmark goes to the tasks in
blocks of at most ``block_bytes``, one pass over the texts each, so what is sent is bounded whatever its size.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. Nulls and edges: null texts and items are
empty and never match; an item of fewer than five words is one shingle; a text shorter than an item is one window;
of equally similar windows the first counts; repeated rows and items each get their matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_KINDS, boxed, flat, limit_batches, shingles_of, slices, table, words_of

WORD_BYTES = BYTE_KINDS == 1
POPULAR = 1 << 20  # bits of the table that says which shingles may be an item's


@dataclass(frozen=True)
class LeakSettings:
    shingle: int = 5
    similarity: float = 0.8
    radius: int = 20
    blocks: int = 7
    block_bytes: int = 1 << 22


def window_fingerprints(shingles: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of ``size`` shingles."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[size:] - sums[:-size]) > size, axis=1, bitorder="little").view(np.uint64)[:, 0]


class Benchmark:
    """Some items: their shingles, their fingerprints in Hamming blocks, and which sizes hold which shingle."""

    def __init__(self, ids: list, texts: pa.Array, settings: LeakSettings) -> None:
        self.settings = settings
        words, at = words_of(*flat(texts), WORD_BYTES)
        self.ids, self.sizes, self.counts, prints = [], [], [], []
        homes: dict[tuple[int, int], set[int]] = defaultdict(set)
        for item, a, b in zip(ids, at[:-1], at[1:], strict=True):
            if b == a:
                continue
            k = min(settings.shingle, b - a)
            shingles = shingles_of(words[a:b], k)
            self.ids.append(item)
            self.sizes.append((k, len(shingles)))
            values, counts = np.unique(shingles, return_counts=True)
            self.counts.append(dict(zip(values.tolist(), counts.tolist(), strict=True)))
            prints.append(window_fingerprints(shingles, len(shingles))[0])
            for value in values.tolist():
                homes[k, value].add(len(shingles))
        self.prints = np.array(prints, np.uint64)
        self.by_k = {}
        for k in sorted({k for k, _ in self.sizes}):
            keys = np.array(sorted(v for q, v in homes if q == k), np.uint64)
            may = np.zeros(POPULAR, bool)
            may[(keys % np.uint64(POPULAR)).astype(np.int64)] = True
            self.by_k[k] = (keys, may, [sorted(homes[k, v]) for v in keys.tolist()])
        edges = np.linspace(0, 64, settings.blocks + 1).astype(int)
        self.cuts = [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.index: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, value in enumerate(self.prints.tolist()):
            for block, (first, width) in enumerate(self.cuts):
                own = (value >> first) & ((1 << width) - 1)
                for errors in range(settings.radius // settings.blocks + 1):
                    for bits in combinations(range(width), errors):
                        self.index[block, own ^ sum(1 << x for x in bits)].append(i)

    def near(self, fingerprint: int) -> list[int]:
        """The items within the radius."""
        found: set[int] = set()
        for block, (first, width) in enumerate(self.cuts):
            found.update(self.index.get((block, (fingerprint >> first) & ((1 << width) - 1)), ()))
        return [i for i in found if (fingerprint ^ int(self.prints[i])).bit_count() <= self.settings.radius]

    def matches(self, words: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
        """(similarity, first word, words, differing bits) of the best window of each item found in one text."""
        best: dict[int, tuple[float, int, int, int]] = {}
        for k, (keys, may, homes) in self.by_k.items():
            if len(words) < k:
                continue
            shingles = shingles_of(words, k)
            places = np.flatnonzero(may[(shingles % np.uint64(POPULAR)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, shingles[places]), len(keys) - 1)
            held = keys[at] == shingles[places]
            anchors: dict[int, list[int]] = defaultdict(list)
            for place, i in zip(places[held].tolist(), at[held].tolist(), strict=True):
                for size in homes[i]:
                    anchors[size].append(place)
            for size, found in anchors.items():
                self._windows(shingles, k, size, found, best)
        return best

    def _windows(self, shingles: np.ndarray, k: int, size: int, anchors: list[int], best: dict) -> None:
        """Windows of ``size`` shingles that hold an anchor."""
        size_here = min(size, len(shingles))
        last = len(shingles) - size_here
        low = 0
        while low < len(anchors):
            high = low
            while high + 1 < len(anchors) and anchors[high + 1] - anchors[high] < size_here and anchors[high + 1] - anchors[low] < 4096:
                high += 1
            first, end = max(0, anchors[low] - size_here + 1), min(last, anchors[high])
            part = shingles[first : end + size_here]
            known: dict[int, list[int]] = {}
            for i, fingerprint in enumerate(window_fingerprints(part, size_here).tolist()):
                near = known.get(fingerprint)
                if near is None:
                    near = known[fingerprint] = [x for x in self.near(fingerprint) if self.sizes[x] == (k, size)]
                for item in near:
                    similarity = self._similarity(item, part[i : i + size_here])
                    before = best.get(item, (-1.0, 0))
                    if similarity >= self.settings.similarity and (similarity, -(first + i)) > (before[0], -before[1]):
                        best[item] = (similarity, first + i, size_here + k - 1, (fingerprint ^ int(self.prints[item])).bit_count())
            low = high + 1

    def _similarity(self, item: int, window: np.ndarray) -> float:
        own, total, both = self.counts[item], 0, 0
        seen: dict[int, int] = {}
        for value in window.tolist():
            seen[value] = seen.get(value, 0) + 1
        for value, n in seen.items():
            both += min(n, own.get(value, 0))
        total = len(window) + sum(own.values()) - both
        return both / total


def benchmark_blocks(benchmark: DataFrame, settings: LeakSettings) -> Iterator[Benchmark]:
    """The items (item_id, text) in blocks of bounded size."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // settings.block_bytes))
    kept = benchmark.filter("text IS NOT NULL").select("item_id", "text").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        rows = kept.filter(F.col("block") == block).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield Benchmark(rows["item_id"].to_pylist(), rows["text"], settings)


def _found(data: np.ndarray, offsets: np.ndarray, items: Benchmark) -> Iterator[tuple[int, int, tuple]]:
    """(text, item, match) of all matches."""
    for low, high in slices(offsets):
        words, at = words_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], WORD_BYTES)
        for i in range(high - low):
            for item, match in sorted(items.matches(words[at[i] : at[i + 1]]).items()):
                yield low + i, item, match


_LEAKS = "doc_id long, item_id long, similarity double, first_word long, n_words long, bits int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings()) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words and bits of each item's best window in each text of (doc_id, text)."""
    limit_batches(docs.sparkSession)
    out = None
    for items in benchmark_blocks(benchmark, settings):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # built from at most about block_bytes of text

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column(0), []
                for i, item, (similarity, first, n, bits) in _found(*flat(batch.column(1)), shared.value):
                    rows.append((ids[i].as_py(), shared.value.ids[item], similarity, first, n, bits))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words", "bits"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, _LEAKS)
        out = part if out is None else out.unionByName(part)
    return out


def leaking(spark: SparkSession, items: Benchmark, text: str = "text") -> Column:
    """A boolean column: whether a text holds any of the items."""
    limit_batches(spark)
    shared = spark.sparkContext.broadcast(items)

    def leaks(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        out[[i for i, _, _ in _found(*flat(texts), shared.value)]] = True
        return pa.array(out)

    return F.arrow_udf(leaks, "boolean")(F.col(text))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with a window of at least 0.8 similarity, and its best window."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any benchmark item; their columns are unchanged."""
    kept = docs
    for items in benchmark_blocks(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text"), LeakSettings()):
        kept = boxed(kept, leaking(spark, items).alias("leaks")).filter(~F.col("leaks")).select("row.*")
    return kept
