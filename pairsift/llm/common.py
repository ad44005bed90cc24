"""Helpers shared by the training-data operators: reading, keys, shared folders, text buffers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many bytes, so that temporaries stay small.
SLICE_BYTES = 1 << 19
#: Texts of one Arrow batch, together.
BATCH_BYTES = 1 << 23
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Texts that a task's Parquet reader holds at once, uncompressed.
READ_ROWS = 256
_READ = "spark.sql.parquet.columnarReaderBatchSize"
#: Samples are drawn by a hash modulo this.
DRAWS = 1 << 40
#: Keys that more rows have than this, and more than one in HOT_KEYS of all rows, are joined apart.
HOT_ROWS, HOT_KEYS = 256, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the checkpoint folder the session has been given.

    Where neither is set, a local session uses a temporary folder; on a cluster that is an error, as executors have no
    folder in common.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pairsift-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    _deleted_at_exit(spark, context.getCheckpointDir())
    return root.rstrip("/")


_LEAVING: set[str] = set()


def _deleted_at_exit(spark: SparkSession, path: str) -> None:
    if path in _LEAVING:
        return
    _LEAVING.add(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, kept in the folder all executors share."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of tables written since a scope began, innermost scope last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; whatever still needs them must have been written elsewhere."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for folder in _SCOPES.pop():
            delete_folder(spark, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder; for wide rows it takes less disk than a checkpoint."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    if _SCOPES:
        _SCOPES[-1].append(folder)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Have the driver collect plans that are done with, as their shuffle files are deleted no sooner."""
    gc.collect()
    spark._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """A new folder for a table; what is left there is deleted when the driver ends."""
    folder = f"{shared_root(spark)}/table-{uuid.uuid4().hex}"
    _deleted_at_exit(spark, folder)
    return folder


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame | None:
    """key and salts of the keys that have more than their share of rows; None if there are none.

    A key is hot if it has more than one in ``HOT_KEYS`` of all rows, so there are fewer hot ones, whatever the size, and
    they can be broadcast. Each salt stands for no more rows than that share.
    """
    total, top = counts.agg(F.sum(n), F.max(n)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (top or 0) <= limit:
        return None
    return counts.filter(F.col(n) > limit).select(key, F.ceil(F.col(n) / limit).cast("int").alias("salts"))


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined (``how``: inner or left) by a key with ``lookup`` (one row a key); the rows of hot keys are dealt to several tasks, each with a copy of the lookup's row."""
    if hot is None:
        return rows.join(lookup, key, how)
    several = F.coalesce("salts", F.lit(1))
    # the partition too, as all columns may be alike
    place = F.xxhash64(F.spark_partition_id(), *rows.columns)
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(place, several).cast("int")).drop("salts")
    copied = lookup.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), several - 1))).drop("salts")
    return salted.join(copied, [key, "salt"], how).drop("salt")


def over_key(rows: DataFrame, key: str, sums: dict[str, Column], hot: Column | None) -> DataFrame:
    """``rows`` with aggregates over all rows of the same key; those of hot keys by partial sums, which are joined as a broadcast.

    ``hot`` tells the rows of keys that many rows share (None: there are none); there must be few such keys, and only
    speed depends on which.
    """
    if hot is None:
        return rows.withColumns({name: value.over(W.partitionBy(key)) for name, value in sums.items()})
    crowded = rows.filter(hot)
    # rows of hot keys go through the window alone, so none of it gets them together
    alone = rows.withColumn("alone", F.when(hot, F.xxhash64(*rows.columns)).otherwise(0))
    found = alone.withColumns({name: value.over(W.partitionBy(key, "alone")) for name, value in sums.items()}).drop("alone")
    whole = crowded.groupBy(key).agg(*[value.alias(f"hot_{name}") for name, value in sums.items()], F.lit(True).alias("is_hot"))
    joined = found.join(F.broadcast(whole), key, "left")
    return joined.select(*rows.columns, *[F.when(F.col("is_hot"), F.col(f"hot_{name}")).otherwise(F.col(name)).alias(name) for name in sums])


def not_broadcast(rows: DataFrame) -> DataFrame:
    """``rows`` for a join by a shuffle of both sides, whatever size Spark expects.

    It takes an exploded table for no larger than the table before, and a file's compressed bytes for its rows, so it
    would send large tables to the driver as a broadcast.
    """
    return rows.hint("merge")


def boxed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns in one struct ``row``, and more columns beside it: none of them can clash with a column of the row."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def limit_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES`` from here on, unless the session has a smaller limit: Python and the JVM each keep some copies of a batch."""
    if spark.conf.get(_BATCH, None) is None or _bytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def limit_reads(spark: SparkSession) -> None:
    """Hold the rows that the Parquet reader has at once to ``READ_ROWS`` from here on, unless the session has a smaller limit: whole texts are wide."""
    if int(spark.conf.get(_READ)) > READ_ROWS:
        spark.conf.set(_READ, READ_ROWS)


def _bytes(size: str) -> int:
    text = size.strip().lower().removesuffix("b")
    return int(text[:-1]) << 10 * (1 + "kmgt".index(text[-1])) if text[-1] in "kmgt" else int(text)


def bounded_sample(rows: DataFrame, most_bytes: int) -> pa.Table:
    """The rows (text, at and others) on the driver, in the order of ``at``; whole texts, as many as fit in ``most_bytes`` together, and one at least."""
    kept = rows.persist()
    try:
        sizes = kept.select("at", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).toArrow().sort_by([("at", "ascending")])
        fits = np.cumsum(sizes["size"].to_numpy()) <= most_bytes
        fits[:1] = True
        if not fits.all():
            kept_at = sizes["at"].to_numpy()[fits][-1]
            rows = kept.filter(F.col("at") <= F.lit(int(kept_at)))
        others = [(c, "ascending") for c in rows.columns if c not in ("at", "text")]
        return rows.toArrow().sort_by([("at", "ascending"), *others])
    finally:
        kept.unpersist()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and their n + 1 offsets; a null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text is alone in its range."""
    low, count = 0, len(offsets) - 1
    while low < count:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, count)
        low = high


def mixed(keys: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) over unsigned keys."""
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(29))


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, as far as they have been needed."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << max(10, int(n - 1).bit_length())
            inverse = pow(self.BASE, -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (self.BASE, inverse))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs data[start:end], from one prefix sum over all bytes."""
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sparse_rows(rows: np.ndarray, buckets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the distinct pairs, sorted by row."""
    keys = np.sort((rows.astype(np.uint64) << np.uint64(bits)) | buckets)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64), counts


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, 2, np.uint8)
    kind[[9, 10, 11, 12, 13, 32, 0]] = 0
    kind[128:] = 1
    for low, high in ((48, 58), (65, 91), (97, 123)):
        kind[low:high] = 1
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return kind, lower


#: 0 for white space and NUL, 1 for letters, digits and non-ASCII bytes, 2 for marks; and bytes with A-Z lower-cased.
BYTE_KINDS, LOWER_BYTES = _byte_classes()


def words_of(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of the given bytes, A-Z lower-cased) of all texts, and where each text's words begin."""
    word = word_bytes[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = word
    edge[1:] ^= word
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    split = inner[word[inner] & word[inner - 1]]  # a text ends in a word and the next begins with one
    marks = np.flatnonzero(edge)
    starts, ends = np.sort(np.concatenate([marks[::2], split])), np.sort(np.concatenate([marks[1::2], split]))
    return run_hashes(LOWER_BYTES[data], starts, ends), np.searchsorted(starts, offsets)


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbours, from every place where k words follow."""
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + words[i : i + len(out)]
    return mixed(out)
