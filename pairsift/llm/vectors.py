"""Exact top-k inner products, pruned by multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; of each segment its mean and its deviation are kept. By Cauchy-Schwarz
the product of two segments of length n is at most n * mean * mean' + deviation * deviation', so a dot product of
these statistics bounds the score from above (and the distance from below). Candidates are held against each
query's k-th best score at the coarsest level first; only what no level excludes gets its exact integer score.

Vectors are put in the order of the signs of their segment means and packed into chunks (kept in the shared folder, so
that a row's place is its identity). Each query is held against its own chunk first, which gives it a threshold. A chunk
is known by the ranges of its segment means and its largest deviations, which bound its product with any query; packs
of these, a ten-thousandth of the vectors' size, meet the blocks of queries, and only chunks that some query of a block needs
are sent to that block. So how much is sent depends on how the vectors cluster: where they do not, all of it, once for
each ``BLOCK_BYTES`` of queries.

Vectors with a component of 2**28 or more after scaling are packed apart, as doubles (which hold them exactly), and meet
all others too; pairs whose product may exceed 64 bits are scored in integers of any size.

Nulls and edges: vectors that are null or hold null or non-finite components and rows without an id take no part; vectors
meet only those of their own length; a repeated row is a row of its own, so it is a candidate for its copies. Empty
tables give no rows. A score among a query's k best that does not fit in a long is an error, as is a component that is
no finite double after scaling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, table

LEVELS = (1, 4, 16)
CHUNK_ROWS, CHUNKS_A_GROUP, SPAN = 16384, 4, 512
#: Query vectors of a block, queries of a block that are held against candidates at once, and chunks of a pack of ranges.
BLOCK_BYTES, AT_ONCE, PACK_CHUNKS = 1 << 24, 1024, 4096
LARGEST = 1 << 28
#: What rounding may take from a bound, as a part of the product of the norms.
ROUNDING = 1e-5
TOO_WIDE = "op7_topk: a score does not fit in a long"


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) of the vectors of each length; null components are no numbers."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    raw = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    present = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[present]):
        rows = np.flatnonzero(present & (lengths == size))
        yield rows, raw[starts[rows][:, None] + np.arange(size)[None, :]]


def _valid(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer matrix) of the vectors of each length; those with large components apart, as doubles."""
    batch = batch.filter(pc.is_valid(batch.column(0)))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for rows, raw in _matrices(batch.column(1)):
        with np.errstate(over="ignore"):
            values = np.floor(scale * raw)
        finite = np.isfinite(raw).all(axis=1)
        if not np.isfinite(values[finite]).all():
            raise ValueError("op7_topk: a component is not finite after scaling")
        small = (np.abs(values) < LARGEST).all(axis=1)
        for good, kind in ((finite & small, np.int32), (finite & ~small, np.float64)):
            if good.any():
                yield ids[rows[good]].astype(np.int64), values[good].astype(kind)


def in_order(vectors: DataFrame) -> DataFrame:
    """The rows of (vec_id, embedding) in ranges of like vectors: those whose segment means have the same signs lie together, by their norms."""

    def place(values: pa.Array) -> pa.Array:
        code, norm = np.full(len(values), -1, np.int64), np.zeros(len(values), np.float32)
        for rows, raw in _matrices(values):
            raw = np.nan_to_num(raw, nan=0.0, posinf=0.0, neginf=0.0)
            signs = [p.sum(axis=1) > 0 for p in np.array_split(raw, LEVELS[-1], axis=1)]
            code[rows] = sum((x.astype(np.int64) << (LEVELS[-1] - 1 - i) for i, x in enumerate(signs)), np.int64(raw.shape[1]) << 32)
            with np.errstate(over="ignore"):
                norm[rows] = norms(raw)
        return pa.StructArray.from_arrays([pa.array(code), pa.array(norm)], ["code", "norm"])

    placed = vectors.select("vec_id", "embedding", F.arrow_udf(place, "struct<code:long,norm:float>")("embedding").alias("place"))
    tasks = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = -(-vectors.count() // CHUNK_ROWS)
    # the id too, as copies of a vector may be a good part of all
    keys = ("place.code", "place.norm", "vec_id")
    return placed.repartitionByRange(max(1, min(chunks, max(tasks, chunks // 16))), *keys).sortWithinPartitions(*keys).select("vec_id", "embedding")


_CHUNK = "chunk long, size int, ids binary, vectors binary"


def packed(vectors: DataFrame, scale: float) -> DataFrame:
    """Chunks of (vec_id, embedding) rows as integer matrices, one for each length and some thousand rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list] = {}
        made = TaskContext.get().partitionId() << 32

        def chunk(kind: tuple) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids, values = (np.concatenate(x) for x in zip(*waiting.pop(kind), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([kind[0]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["chunk", "size", "ids", "vectors"])

        for batch in batches:
            for ids, values in _valid(batch, scale):
                kind = (values.shape[1], values.dtype.char)
                waiting.setdefault(kind, []).append((ids, values))
                if sum(len(x) for x, _ in waiting[kind]) >= CHUNK_ROWS:
                    yield chunk(kind)
        for kind in list(waiting):
            yield chunk(kind)

    return vectors.mapInArrow(pack, _CHUNK)


def _matrix(size: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    kind = np.float64 if len(vectors) > 4 * size * len(ids) else np.int32
    return ids, np.frombuffer(vectors, kind).reshape(len(ids), size)


def norms(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(np.square(values.astype(np.float64)).sum(axis=1))


def segment_statistics(values: np.ndarray, level: int) -> np.ndarray:
    """sqrt(n) * mean and deviation of each of ``level`` segments, and a part of the norm for rounding; the dot product of two such rows bounds that of the vectors."""
    parts = [p for p in np.array_split(values.astype(np.float64), level, axis=1) if p.shape[1]]
    with np.errstate(over="ignore", invalid="ignore"):
        means = [p.sum(axis=1) / np.sqrt(p.shape[1]) for p in parts]
        deviations = [np.sqrt(np.maximum(np.square(p).sum(axis=1) - m * m, 0.0)) for p, m in zip(parts, means, strict=True)]
    return np.stack([*means, *deviations, np.sqrt(ROUNDING) * norms(values)], axis=1) if parts else np.zeros((len(values), 0))


_integers = np.frompyfunc(int, 1, 1)


def exact_scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inner products of the rows, and whether they are below what fits in a long; above it is an error."""
    scores, under = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    with np.errstate(over="ignore", invalid="ignore"):
        fits = norms(a) * norms(b) < 2.0**62  # a bound of all partial sums
        scores[fits] = np.einsum("ij,ij->i", a[fits].astype(np.int64), b[fits].astype(np.int64))
    rest = np.flatnonzero(~fits)
    for low in range(0, len(rest), 4096):
        at = rest[low : low + 4096]
        for i, score in zip(at, (_integers(a[at]) * _integers(b[at])).sum(axis=1), strict=True):
            if score >= 1 << 63:  # it is among the best k, or others above the range are
                raise OverflowError(TOO_WIDE)
            under[i] = score < -(1 << 63)
            scores[i] = 0 if under[i] else score
    return scores, under


def spans(ids: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
    """(places, ids, vectors, statistics at each level) of some candidates at a time; those of large norms first, so that thresholds rise early."""
    order = np.argsort(-norms(values), kind="stable")
    for low in range(0, len(order), SPAN):
        part = order[low : low + SPAN]
        yield part, ids[part], values[part], [segment_statistics(values[part], level) for level in LEVELS]


class Best:
    """The k best candidates of each query of a block so far."""

    def __init__(self, chunks: np.ndarray, ats: np.ndarray, values: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        """floor: scores that each query's k-th best is known to reach."""
        self.chunks, self.ats, self.values, self.k = chunks, ats, values, k
        self.stats = [segment_statistics(values, level) for level in LEVELS]
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.under = np.zeros(0, bool)  # scores below the range of a long: the last of all
        self.floor = np.full(len(values), -np.inf) if floor is None else floor.copy()
        self.survivors = 0

    def _exact(self, open_: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, candidate, score, whether it is below the range of a long) of the open pairs."""
        rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(rows):
            return
        a, b = self.values[rows], values[columns]
        if values.shape[1] * np.abs(b).max(initial=0).astype(float) * np.abs(a).max(initial=0) < 2**52:
            # doubles hold these sums exactly, and a product of matrices is the fastest way to some of its places
            scores = (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
            wanted = open_[np.ix_(rows, columns)] & ~(scores < self.floor[rows][:, None])
            r, c = np.nonzero(wanted)
            yield rows[r], columns[c], scores[r, c], np.zeros(len(r), bool)
            return
        r, c = np.nonzero(open_)
        for low in range(0, len(r), 65536):
            part = slice(low, low + 65536)
            yield r[part], c[part], *exact_scores(self.values[r[part]], values[c[part]])

    def meet(self, chunk: int, ats: np.ndarray, ids: np.ndarray, values: np.ndarray, stats: list[np.ndarray]) -> None:
        """Hold the queries against some candidates of a chunk."""
        open_ = np.ones((len(self.values), len(ids)), bool)
        open_[(self.chunks == chunk)[:, None] & (self.ats[:, None] == ats[None, :])] = False
        for mine, theirs in zip(self.stats, stats, strict=True):
            rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(rows):
                return
            with np.errstate(over="ignore", invalid="ignore"):
                bound = mine[rows] @ theirs[columns].T
                bound += 1e-9 * np.abs(bound) + 1e-6
                # a bound that overflowed to no number excludes nothing
                open_[np.ix_(rows, columns)] &= ~(bound < self.floor[rows][:, None])
        self.survivors += int(open_.sum())
        for r, c, scores, under in self._exact(open_, values):
            # what is below the threshold is not among the best; equal scores may be, by their ids
            good = under | ~(scores < self.floor[r])
            r, c, scores, under = r[good], c[good], scores[good], under[good]
            query, found = np.concatenate([self.query, r]), np.concatenate([self.ids, ids[c]])
            scores, under = np.concatenate([self.scores, scores]), np.concatenate([self.under, under])
            order = np.lexsort((found, ~scores, under, query))
            query = query[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
            kept = order[rank < self.k]
            self.query, self.ids, self.scores, self.under = query[rank < self.k], found[kept], scores[kept], under[kept]
            last = rank == self.k - 1
            self.floor[query[last]] = np.maximum(self.floor[query[last]], np.where(under[order[last]], -np.inf, scores[order[last]]))


_QUERIES = "size int, q_wide boolean, chunk long, ats binary, ids binary, vectors binary, floors binary"


def home_queries(chunks: DataFrame, every: int, k: int) -> DataFrame:
    """A row for each chunk: its vectors whose id is divisible by ``every``, and what their k-th best score reaches in the chunk itself."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, size, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, values = _matrix(size, ids, vectors)
                ats = np.flatnonzero(ids % every == 0).astype(np.int32)
                if len(ats):
                    floors = [Best(np.full(len(part), chunk), part, values[part], k) for part in np.array_split(ats, -(-len(ats) // AT_ONCE))]
                    for span in spans(ids, values):
                        for best in floors:
                            best.meet(chunk, *span)
                    out = (size, values.dtype == np.float64, chunk, ats.tobytes(), ids[ats].tobytes(), values[ats].tobytes(), np.concatenate([best.floor for best in floors]).tobytes())
                    kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, kinds, strict=True)], [c.split()[0] for c in _QUERIES.split(", ")])

    return chunks.mapInArrow(pick, _QUERIES)


def query_blocks(picked: DataFrame) -> DataFrame:
    """block and the queries of some neighbouring chunks, about ``BLOCK_BYTES`` of them."""
    part = F.shiftright("chunk", 32)
    sizes = picked.select("chunk", part.alias("part"), F.octet_length("vectors").cast("long").alias("bytes"))
    # running sums over all chunks, by partitions first, so no task gets them all
    inside = F.sum("bytes").over(W.partitionBy("part").orderBy("chunk")) - F.col("bytes")
    starts = sizes.groupBy("part").agg(F.sum("bytes").alias("all"))
    starts = starts.select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("before"))
    placed = sizes.withColumn("inside", inside).join(F.broadcast(starts), "part").select("chunk", F.floor((F.col("inside") + F.col("before")) / BLOCK_BYTES).cast("int").alias("block"))

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        counts = [len(x) // 4 for x in rows["ats"].to_pylist()]
        one = [b"".join(rows[c].to_pylist()) for c in ("ats", "ids", "vectors", "floors")]
        homes = np.repeat(rows["chunk"].to_numpy(), counts)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([key[1].as_py()], pa.int32()), "q_wide": pa.array([key[2].as_py()]), "q_chunks": pa.array([homes.tobytes()], pa.binary()), **{f"q_{c}": pa.array([x], pa.binary()) for c, x in zip(("ats", "ids", "vectors", "floors"), one, strict=True)}})

    kinds = "block int, size int, q_wide boolean, q_chunks binary, q_ats binary, q_ids binary, q_vectors binary, q_floors binary"
    return picked.join(placed, "chunk").groupBy("block", "size", "q_wide").applyInArrow(join, kinds)


def chunk_ranges(chunks: DataFrame) -> DataFrame:
    """chunk, size, and of each segment at the finest level the least and largest mean and the largest deviation; and the largest norm."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, size, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stats = segment_statistics(_matrix(size, ids, vectors)[1], LEVELS[-1])
                n = stats.shape[1] // 2
                ranges = np.concatenate([stats[:, :n].min(axis=0), stats[:, :n].max(axis=0), stats[:, n:].max(axis=0)])
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([size], pa.int32()), pa.array([ranges.tobytes()], pa.binary())], ["chunk", "size", "ranges"])

    return chunks.mapInArrow(measure, "chunk long, size int, ranges binary")


def may_hold(queries: np.ndarray, floors: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Which chunks may hold a candidate for any of the queries, by their ranges."""
    stats = segment_statistics(queries, LEVELS[-1])
    n = stats.shape[1] // 2
    low, high, rest = ranges[:, :n], ranges[:, n : 2 * n], ranges[:, 2 * n :]
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(stats[:, :n], 0) @ high.T + np.minimum(stats[:, :n], 0) @ low.T + stats[:, n:] @ rest.T
        bound += 1e-9 * np.abs(bound) + 1e-6
        return ~(bound < floors[:, None]).all(axis=0)


def meetings(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """block, size, q_wide, chunk: the chunks that a block needs."""
    ranges = chunk_ranges(chunks)
    packs = max(1, -(-chunks.count() // PACK_CHUNKS))
    count = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    packed_ranges = ranges.withColumn("pack", F.pmod(F.xxhash64("chunk"), F.lit(packs)).cast("int")).groupBy("size", "pack").agg(F.collect_list(F.struct("chunk", "ranges")).alias("held"))
    sent = packed_ranges.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(blocks, ["block", "size"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, queries = _matrix(row["size"], row["q_ids"], row["q_vectors"])
                numbers = np.array([x["chunk"] for x in row["held"]], np.int64)
                ranges = np.array([np.frombuffer(x["ranges"], np.float64) for x in row["held"]])
                floors, found = np.frombuffer(row["q_floors"], np.float64), np.zeros(len(numbers), bool)
                for low in range(0, len(ids), AT_ONCE):
                    open_ = np.flatnonzero(~found)
                    found[open_] |= may_hold(queries[low : low + AT_ONCE], floors[low : low + AT_ONCE], ranges[open_])
                n = int(found.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["block"], np.int32)), pa.array(np.full(n, row["size"], np.int32)), pa.array([row["q_wide"]] * n, pa.bool_()), pa.array(numbers[found])], ["block", "size", "q_wide", "chunk"])

    parts = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sent.repartition(parts, "block", "pack").mapInArrow(choose, "block int, size int, q_wide boolean, chunk long")


def top_k(vectors: DataFrame, k: int, every: int, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``every`` the ``k`` best others of (vec_id, embedding)."""
    chunks = checkpointed(packed(in_order(vectors.select(F.col("vec_id").cast("long"), "embedding")), scale))
    blocks = checkpointed(query_blocks(checkpointed(home_queries(chunks, every, k))))
    needed = checkpointed(meetings(chunks, blocks))
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    count = chunks.count()
    groups = max(-(-count // CHUNKS_A_GROUP), min(count, parts), 1)
    needed = needed.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    key = ("block", "size", "q_wide", "part")
    kinds = "chunk long, at int, query_id long, vec_id long, score long"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for q in left.to_pylist():
            q_ids, q_values = _matrix(q["size"], q["q_ids"], q["q_vectors"])
            q_chunks, q_ats, floors = np.frombuffer(q["q_chunks"], np.int64), np.frombuffer(q["q_ats"], np.int32), np.frombuffer(q["q_floors"], np.float64)
            parts = [slice(low, low + AT_ONCE) for low in range(0, len(q_ids), AT_ONCE)]
            bests = [Best(q_chunks[x], q_ats[x], q_values[x], k, floors[x]) for x in parts]
            for i in np.argsort(right["chunk"].to_numpy()):
                for span in spans(*_matrix(q["size"], right["ids"][i].as_py(), right["vectors"][i].as_py())):
                    for best in bests:
                        best.meet(right["chunk"][i].as_py(), *span)
            for x, best in zip(parts, bests, strict=True):
                at = best.query
                found.append(pa.table({"chunk": best.chunks[at], "at": best.ats[at].astype(np.int32), "query_id": q_ids[x][at], "vec_id": best.ids, "score": pa.array(best.scores, mask=best.under)}))
        return pa.concat_tables(found) if found else pa.table({n: pa.array([], t) for n, t in (("chunk", pa.int64()), ("at", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()))})

    queries = needed.select(*key).distinct().join(blocks, ["block", "size", "q_wide"]).groupBy(*key)
    candidates = needed.join(chunks, ["chunk", "size"]).select(*[F.col(c).alias(f"c_{c}") for c in key], "chunk", "ids", "vectors")
    partial = queries.cogroup(candidates.groupBy(*[f"c_{c}" for c in key])).applyInArrow(search, kinds)
    rank = F.row_number().over(W.partitionBy("chunk", "at").orderBy(F.desc_nulls_last("score"), F.asc("vec_id")))
    score = F.coalesce("score", F.raise_error(F.lit(TOO_WIDE)).cast("long")).alias("score")
    return partial.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 5 best of every query."""
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


ORACLE_OP7 = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_no,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row_no, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.row_no <> b.row_no AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
