"""Language-model scoring: prediction by partial matching over bytes, and a word-count baseline.

Pretrained model: counts of every (context, byte) of ``order`` bytes of context over all training texts; shorter
contexts follow from longer ones. A byte is coded at the longest context that has seen it. Each longer context that
was seen pays an escape, D / (T + D) with D distinct bytes in T occurrences, and its bytes are excluded below.
Below the empty context all bytes not seen at all are equally likely. A text begins with ``order`` start marks and
ends with an end mark, which is coded like a byte. The code length depends on each (context, byte) alone, so its
logarithm is found once per distinct one, in tables of Spark, and summed over the text.

Neither the vocabulary nor the model is broadcast. Texts are packed into chunks; a chunk gives its distinct words
and (context, byte) pairs with its own counts, Spark sums them over all chunks, and sends each chunk the sums of
what it holds. A word has one row for each chunk that holds it, however often it occurs there.

``adaptive_scores`` is the other mode: each text alone, by a trie that learns as it reads.

Nulls and edges: a null text counts as empty and has the end mark alone; a null id neither teaches nor is held out;
without training texts all bytes are equally likely. Repeated rows each get their result; their texts count again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, flat, id_remainder, limit_batches, slices, table, written

END, BEGIN, SYMBOL = 256, 257, 9  # marks, and bits of a symbol
CHUNK_BYTES, ROWS_A_PACK, GROUP_ROWS = 1 << 25, 1 << 20, 1 << 18


@dataclass(frozen=True)
class PpmSettings:
    order: int = 4  # bytes of context, 2 to 5


# ---------------------------------------------------------------- chunks

_CHUNK = "chunk long, doc_ids array<long>, train array<boolean>, lengths array<long>, texts binary"


def packed_texts(docs: DataFrame) -> DataFrame:
    """Chunks of rows (doc_id, text, train): some ten MB of text each, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, train, lengths, bodies = [], [], [], []
        made = TaskContext.get().partitionId() << 32

        def chunk() -> pa.RecordBatch:
            nonlocal made
            made += 1
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join(bodies))
            columns = [pa.array([made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "train", "lengths", "texts"])

        held = 0
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for low, high in slices(offsets, CHUNK_BYTES // 8):
                ids += batch.column(0)[low:high].to_pylist()
                train += batch.column(2)[low:high].to_pylist()
                lengths += np.diff(offsets[low : high + 1]).tolist()
                bodies.append(data[offsets[low] : offsets[high]].tobytes())
                held += len(bodies[-1])
                if held >= CHUNK_BYTES:
                    yield chunk()
                    ids, train, lengths, bodies, held = [], [], [], [], 0
        if ids:
            yield chunk()

    return docs.select("doc_id", "text", "train").mapInArrow(pack, _CHUNK)


class Chunk:
    """The texts of one chunk row."""

    def __init__(self, lengths: list[int], train: list[bool], blob: bytes) -> None:
        self.data = zstandard.ZstdDecompressor().decompress(blob)
        self.offsets = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
        self.train = np.array(train, bool)

    def words(self) -> tuple[dict[bytes, int], list[np.ndarray]]:
        """Numbers of the distinct words in order of appearance, and each text's words as such numbers."""
        numbers: dict[bytes, int] = {}
        texts = []
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            words = self.data[a:b].lower().split()
            for w in words:
                if w not in numbers:
                    numbers[w] = len(numbers)
            texts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        return numbers, texts

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For some texts at a time: the first one's number, and all (context, byte) pairs with the number of their text from there."""
        for low, high in slices(self.offsets, 1 << 20):
            while low < high:  # text numbers fit in 12 bits
                top = min(high, low + 4096)
                yield low, *text_grams(self.data[self.offsets[low] : self.offsets[top]], self.offsets[low : top + 1] - self.offsets[low], order)
                low = top


def text_grams(data: bytes, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, text) for every byte and end mark: the ``order`` symbols before it and itself, 9 bits each."""
    count, lengths = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(count), lengths + order + 1)
    starts = offsets[:-1] + np.arange(count) * (order + 1)
    symbols = np.full(len(owner), BEGIN, np.uint64)
    symbols[starts + lengths + order] = END
    inside = np.ones(len(owner), bool)
    inside[(starts[:, None] + np.arange(order)).ravel()] = False
    body = inside.copy()
    body[starts + lengths + order] = False
    symbols[body] = np.frombuffer(data, np.uint8)
    places = np.flatnonzero(inside)
    grams = np.zeros(len(places), np.uint64)
    for back in range(order, -1, -1):
        grams = (grams << np.uint64(SYMBOL)) | symbols[places - back]
    return grams, owner[places]


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def chunk_counts(chunks: DataFrame, order: int) -> DataFrame:
    """(chunk, number, word, gram, n): each chunk's distinct words (the end as the empty word) and pairs, with their training counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["lengths"], row["train"], row["texts"])
                numbers, texts = chunk.words()
                learned = [t for t, train in zip(texts, chunk.train, strict=True) if train]
                n = np.bincount(np.concatenate([*learned, np.zeros(0, np.int32)]), minlength=len(numbers)).astype(np.int64)
                words = [*numbers, b""]
                n = np.append(n, int(chunk.train.sum()))
                for low in range(0, len(words), 100_000):
                    part = pa.array(words[low : low + 100_000], pa.binary()).cast(pa.string())
                    yield _counts(row["chunk"], np.arange(low, low + len(part)), part, None, n[low : low + len(part)])
                found = []
                for first, grams, owner in chunk.grams(order):
                    keys = np.sort((grams << np.uint64(1)) | chunk.train[first + owner].astype(np.uint64))
                    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    found.append(_counted(keys[edge] >> np.uint64(1), np.diff(np.append(edge, len(keys))) * (keys[edge] & np.uint64(1)).astype(np.int64)))
                    if len(found) == 16:
                        found = [_counted(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                if found:
                    keys, n = _counted(*(np.concatenate(x) for x in zip(*found, strict=True)))
                    for low in range(0, len(keys), 100_000):
                        yield _counts(row["chunk"], None, None, keys[low : low + 100_000], n[low : low + 100_000])

    return chunks.mapInArrow(count, "chunk long, number int, word string, gram long, n long")


def _counts(chunk: int, numbers: np.ndarray | None, words: pa.Array | None, grams: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    size = len(n)
    columns = [
        pa.array(np.full(size, chunk)),
        pa.nulls(size, pa.int32()) if numbers is None else pa.array(numbers, pa.int32()),
        pa.nulls(size, pa.string()) if words is None else words,
        pa.nulls(size, pa.int64()) if grams is None else pa.array(grams.astype(np.int64)),
        pa.array(n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "number", "word", "gram", "n"])


# ---------------------------------------------------------------- model


class Level:
    """The contexts of one length: distinct pairs, their counts, and sums over each context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shorter: np.ndarray) -> None:
        """shorter: the count of each pair when its context loses its first byte."""
        self.keys, self.counts = keys, counts
        _, self.context = np.unique(keys >> np.uint64(SYMBOL), return_inverse=True)
        seen = counts > 0
        self.total = np.bincount(self.context, counts)
        self.distinct = np.bincount(self.context, seen)
        self.below = np.bincount(self.context, shorter * seen)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.searchsorted(self.keys, keys)
        context = self.context[at]
        return self.counts[at], self.total[context], self.distinct[context], self.below[context]


def low_bits(keys: np.ndarray, symbols: int) -> np.ndarray:
    return keys & np.uint64((1 << SYMBOL * symbols) - 1)


def pair_log10(grams: np.ndarray, counts: np.ndarray, shorter: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of each pair. The grams hold all that share all but the first of their context bytes.

    ``shorter``: a row (count, total, distinct, below) of each gram at every context length from 2 to order - 2.
    ``pairs`` counts (byte, byte) over everything.
    """
    singles = pairs.sum(axis=0)
    seen = pairs > 0
    totals, kinds_of, belows = pairs.sum(axis=1), seen.sum(axis=1), (seen * singles).sum(axis=1)
    levels: dict[int, Level] = {}
    for j in range(max(2, order - 1), order + 1):
        keys, first = np.unique(low_bits(grams, j + 1), return_index=True)
        sums = np.bincount(np.searchsorted(keys, low_bits(grams, j + 1)), counts)
        if j == order and order > 2:
            below = levels[j - 1].of(low_bits(keys, j))[0]
        elif j == 2:
            below = pairs[((keys >> np.uint64(SYMBOL)) & np.uint64(511)).astype(np.int64), (keys & np.uint64(511)).astype(np.int64)]
        else:
            below = shorter[first, j - 3, 0]
        levels[j] = Level(keys, sums, below)
    byte, last = (grams & np.uint64(511)).astype(np.int64), ((grams >> np.uint64(SYMBOL)) & np.uint64(511)).astype(np.int64)
    out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    less_total, less_distinct = np.zeros(len(grams)), np.zeros(len(grams))
    for j in range(order, -1, -1):
        if j in levels:
            count, total, distinct, below = levels[j].of(low_bits(grams, j + 1))
        elif j >= 2:
            count, total, distinct, below = shorter[:, j - 2].T
        elif j == 1:
            count, total, distinct, below = pairs[last, byte], totals[last], kinds_of[last], belows[last]
        else:
            count, total, distinct = singles[byte], np.full(len(grams), singles.sum()), np.full(len(grams), (singles > 0).sum())
            below = distinct * 0
        left, kinds = total - less_total, distinct - less_distinct
        known = open_ & (total > 0)
        found, missed = known & (count > 0), known & (count == 0) & (kinds > 0)
        out[found] += np.log10(count[found] / (left + kinds)[found])
        out[missed] += np.log10(kinds[missed] / (left + kinds)[missed])
        open_ &= ~found
        less_total, less_distinct = np.where(total > 0, below, 0), np.where(total > 0, distinct, 0)
    unseen = 257 - (singles > 0).sum()
    out[open_] -= np.log10(max(unseen, 1))
    return out


def _low(column: str, symbols: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << SYMBOL * symbols) - 1))


def short_level(sums: DataFrame, size: int) -> DataFrame:
    """(key, level): of every pair with ``size`` context bytes its count, and total, distinct and below of its context.

    A context has at most 257 pairs, and a pair at most 258 with one byte less before it, so no key is a hot one.
    """
    counts = sums.groupBy(_low("gram", size + 1).alias("key")).agg(F.sum("n").alias("n"))
    shorter = counts.withColumn("short", F.sum("n").over(W.partitionBy(_low("key", size)))) if size > 2 else counts.join(
        F.broadcast(sums.groupBy(_low("gram", 2).alias("last")).agg(F.sum("n").alias("short"))), _low("key", 2) == F.col("last")
    )
    context = W.partitionBy(F.shiftright("key", SYMBOL))
    level = F.array(*[x.cast("double") for x in (F.col("n"), F.sum("n").over(context), F.count_if(F.col("n") > 0).over(context), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("short"))).over(context), F.lit(0)))])
    return shorter.select("key", level.alias("level"))


def pair_table(grams: DataFrame, order: int) -> DataFrame:
    """(gram, value): log10 probability of every distinct pair of (gram, n).

    Sums of the shorter contexts come as columns; the two longest ones are worked out where all grams lie that share
    all but their first context byte. Those are at most 258 times 257, so what a task holds at once is bounded.
    """
    sums = written(grams.groupBy("gram").agg(F.sum("n").alias("n")))
    short = sums.groupBy(_low("gram", 2).alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros((512, 512), np.int64)  # byte pairs: at most 258 * 257
    keys = short["pair"].to_numpy()
    pairs[keys >> SYMBOL, keys & 511] = short["n"].to_numpy()
    shared = grams.sparkSession.sparkContext.broadcast(pairs)
    levels = range(2, order - 1)
    found = sums
    for j in levels:
        found = found.join(short_level(sums, j).withColumnsRenamed({"key": f"key{j}", "level": f"level{j}"}), _low("gram", j + 1) == F.col(f"key{j}")).drop(f"key{j}")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = last = 0

        def out() -> pa.RecordBatch:
            keys, n, shorter = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(pair_log10(keys, n, shorter, shared.value, order))], ["gram", "value"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy().astype(np.uint64)
            shorter = np.stack([batch.column(2 + i).flatten().to_numpy().reshape(-1, 4) for i in range(len(levels))], axis=1) if levels else np.zeros((len(keys), 0, 4))
            rows = (keys, batch.column(1).to_numpy(), shorter)
            group = low_bits(keys >> np.uint64(SYMBOL), max(1, order - 1))
            # rows come sorted by group, so the last group held goes on at the start of the batch, if anywhere
            edge = int((group == last).sum()) if held else 0
            if size >= GROUP_ROWS and edge < len(group):
                held.append(tuple(x[:edge] for x in rows))
                yield out()
                held, size, rows = [], 0, tuple(x[edge:] for x in rows)
            held.append(rows)
            size += len(rows[0])
            last = group[-1]
        if held:
            yield out()

    # a number of the context without its first byte
    context = F.shiftright("gram", SYMBOL).bitwiseAND(F.lit((1 << SYMBOL * max(1, order - 1)) - 1))
    parts = max(1, int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = found.withColumn("context", context).repartition(parts, "context").sortWithinPartitions("context")
    return dealt.select("gram", "n", *[f"level{j}" for j in levels]).mapInArrow(values, "gram long, value double")


# ---------------------------------------------------------------- scores


def _packs(rows: DataFrame, kind: str) -> DataFrame:
    """(chunk, kind, keys, amounts): rows (chunk, key, value) of a partition packed into one row for each chunk."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            chunks, keys, values = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3))
            order = np.lexsort((keys, chunks))
            chunks, keys, values = chunks[order], keys[order], values[order]
            edges = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1], [True]]))
            packer = zstandard.ZstdCompressor(level=1)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                steps = np.diff(keys[a:b].astype(np.int64), prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array([chunks[a]]), pa.array([kind]), pa.array([packer.compress(steps.tobytes())], pa.binary()), pa.array([packer.compress(values[a:b].astype(np.float64).tobytes())], pa.binary())], ["chunk", "kind", "keys", "amounts"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS_A_PACK:
                yield from out()
                held = []
        if held:
            yield from out()

    return rows.mapInArrow(pack, "chunk long, kind string, keys binary, amounts binary")


def _unpacked(packs: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    reader = zstandard.ZstdDecompressor()
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    for row_kind, steps, amounts in zip(packs["kind"].to_pylist(), packs["keys"].to_pylist(), packs["amounts"].to_pylist(), strict=True):
        if row_kind == kind:
            keys.append(np.cumsum(np.frombuffer(reader.decompress(steps), np.int64)))
            values.append(np.frombuffer(reader.decompress(amounts), np.float64))
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


_SCORES = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def corpus_scores(docs: DataFrame, settings: PpmSettings = PpmSettings()) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of rows (doc_id, text, train)."""
    limit_batches(docs.sparkSession)
    order = settings.order
    chunks = written(packed_texts(docs))
    counts = written(chunk_counts(chunks, order))
    words = counts.filter("word IS NOT NULL").select("chunk", F.col("number").cast("long").alias("key"), "word", "n")
    words = words.withColumn("value", F.sum("n").over(W.partitionBy("word")).cast("double"))
    # a word's rows all show its sum, so each adds its share to the number of distinct words
    share = F.when(F.col("value") > 0, F.col("n") / F.col("value")).otherwise(0.0)
    words = written(words.select("chunk", "key", "value", "n", share.alias("share")))
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("share"), F.lit(0.0))).first()
    kinds = round(kinds)
    grams = counts.filter("gram IS NOT NULL").select("chunk", "gram", "n")
    scored = grams.select("chunk", "gram").join(pair_table(grams.select("gram", "n"), order), "gram").select("chunk", F.col("gram").alias("key"), "value")
    packs = _packs(words.select("chunk", "key", "value"), "word").unionByName(_packs(scored, "gram"))

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known = _unpacked(right, "word")[1]  # the words' numbers are 0, 1, 2 ... and the end comes last
        logs, base = np.log10(known + 0.5), math.log10(total + 0.5 * (kinds + 1))
        pairs, values = _unpacked(right, "gram")
        out = []
        for row in left.to_pylist():
            chunk = Chunk(row["lengths"], row["train"], row["texts"])
            _, texts = chunk.words()
            sums = np.zeros(len(texts))
            for first, grams, owner in chunk.grams(order):
                if order <= 4:  # in one number, which sorts fastest
                    keys = np.sort((grams << np.uint64(12)) | owner.astype(np.uint64))
                    grams, owner = keys >> np.uint64(12), (keys & np.uint64(4095)).astype(np.int64)
                part = np.bincount(owner, values[np.searchsorted(pairs, grams.astype(np.int64))])
                sums[first : first + len(part)] = part
            n = np.array([len(t) + 1 for t in texts], np.int64)
            hits = np.array([int((known[t] > 0).sum()) for t in texts], np.int64) + int(known[-1] > 0)
            bases = np.array([logs[t].sum() for t in texts]) + logs[-1] - n * base
            out.append(pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "train": pa.array(row["train"], pa.bool_()), "n_tokens": n, "n_known": hits, "train_tokens": np.full(len(n), total, np.int64), "base_score": bases, "score": sums}))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()

    return chunks.groupBy("chunk").cogroup(packs.groupBy("chunk")).applyInArrow(score, _SCORES)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    remainder = id_remainder("doc_id", 5)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", F.coalesce(remainder != 1, F.lit(False)).alias("train"))
    held_out = F.coalesce(id_remainder("doc_id", 5) == 1, F.lit(False))
    return corpus_scores(docs).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# ---------------------------------------------------------------- adaptive mode


class AdaptiveTrie:
    """Contexts of up to ``order`` bytes with the counts of the bytes that followed; it codes a byte, then learns it."""

    def __init__(self, order: int) -> None:
        self.order, self.counts = order, {}

    def code(self, context: bytes, symbol: int) -> float:
        """log10 probability of the symbol; then it is counted in every context."""
        out, excluded, found = 0.0, set(), False
        for size in range(min(self.order, len(context)), -1, -1):
            seen = self.counts.setdefault(context[len(context) - size :], {})
            if not found:
                rest = {s: c for s, c in seen.items() if s not in excluded}
                whole = sum(rest.values()) + len(rest)
                if symbol in rest:
                    out += math.log10(rest[symbol] / whole)
                    found = True
                elif rest:
                    out += math.log10(len(rest) / whole)
                excluded |= set(seen)
            seen[symbol] = seen.get(symbol, 0) + 1
        return out if found else out - math.log10(257 - len(excluded))

    def text(self, data: bytes) -> float:
        places = enumerate([*data, END])
        return sum(self.code(data[max(0, i - self.order) : i], s) for i, s in places)


def adaptive_scores(text: str, order: int = 4) -> Column:
    """log10 probability of each text by a trie that starts empty and learns as it reads; memory grows with one text."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([AdaptiveTrie(order).text((texts[i].as_py() or "").encode()) for i in range(len(texts))], pa.float64())

    return F.arrow_udf(run, "double")(F.col(text))
