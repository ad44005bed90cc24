"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into few segments. If two fingerprints differ in at most 2m - 1 bits over m
segments, some segment differs by at most one bit, and then the segments agree once that bit is deleted. So each
fingerprint is indexed under every one-bit deletion of every segment (one key a bit); equal keys are joined and
verified by the exact distance. A pair is emitted only under its first shared key.

A key shared by more than ``dense`` fingerprints is not paired out. Its members are indexed under all points within
half the radius instead: two fingerprints are within the radius just if they share such a point, so linking each
member to the least of its point's group gives the same components, in rows that grow with the members alone.

Fingerprints are computed in Python over Arrow buffers; everything after is DataFrame operations on distinct
fingerprints, so copies cost one row each.

Nulls and edges: a null text counts as empty; without words the fingerprint is zero, linked like any other; fewer
words than a shingle make one shingle. Null ids are never the smallest; a component without any other id gets null.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, flat, hot_keys, join_hot, limit_batches, limit_reads, mixed, not_broadcast, table, written
from .components import components


@dataclass(frozen=True)
class SimHashSettings:
    shingle: int = 4
    segments: tuple[tuple[int, int, int], ...] = ((0, 0, 21), (0, 21, 42), (0, 42, 64))  # (64-bit word, first bit, last bit + 1)
    radius: int = 4
    dense: int = 4096

    @property
    def words(self) -> int:
        return 1 + max(w for w, _, _ in self.segments)


CONTRACT = SimHashSettings()


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 with seed 42 of the k-word shingles, words being lower-cased and separated by ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """Bits that over half of the hashes set; further words use hashes of the hashes."""
    out = np.zeros(words, np.uint64)
    for w in range(words if len(hashes) else 0):
        keys = hashes if w == 0 else mixed(hashes + np.uint64(w * 0xD1B54A32D192ED03 % (1 << 64)))
        bits = np.zeros(64, np.int64)
        for low in range(0, len(keys), 1 << 16):
            bits += np.unpackbits(keys[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * bits > len(keys), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(text: str, shingle: int) -> Column:
    """A column of the 64-bit fingerprints of the texts, as longs."""

    def compute(texts: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        body = data.tobytes()
        out = np.array([fingerprint(shingle_hashes(body[a:b], shingle), 1)[0] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
        return pa.array(out.view(np.int64))

    return F.arrow_udf(compute, "long")(F.col(text))


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x)


def _without_each(segment: Column, bits: Column) -> Column:
    return F.transform(bits, lambda x: segment.bitwiseAND(F.bitwise_not(x["mask"])).bitwiseOR(x["tag"]))


def deletion_keys(settings: SimHashSettings) -> Column:
    """An array column of one key a bit: which bit, and its segment without that bit."""
    keys = []
    for w, first, last in settings.segments:
        segment = F.shiftrightunsigned(F.col(f"f{w}"), first).bitwiseAND(F.lit((1 << (last - first)) - 1))
        bits = [(1 << b, (64 * w + first + b) << 32) for b in range(last - first)]
        both = F.arrays_zip(F.lit([m for m, _ in bits]).alias("mask"), F.lit([t for _, t in bits]).alias("tag"))
        keys.append(_without_each(segment, both))
    return F.concat(*keys)


def distance(settings: SimHashSettings) -> Column:
    total = F.bit_count(F.col("a.f0").bitwiseXOR(F.col("b.f0")))
    for w in range(1, settings.words):
        total = total + F.bit_count(F.col(f"a.f{w}").bitwiseXOR(F.col(f"b.f{w}")))
    return total


def first_shared_key(settings: SimHashSettings) -> Column:
    """Whether no earlier key than a.key is shared: no earlier segment agrees, and the deleted bit is the one that differs (or the first)."""
    bit, none_before, out = F.shiftright(F.col("a.key"), 32).cast("int"), F.lit(True), F.lit(False)
    for w, first, last in settings.segments:
        here = F.col(f"a.f{w}").bitwiseXOR(F.col(f"b.f{w}")).bitwiseAND(_signed(((1 << (last - first)) - 1) << first))
        mine = (bit >= 64 * w + first) & (bit < 64 * w + last)
        deleted = (here == F.expr("shiftleft(1L, shiftright(a.key, 32) & 63)")) | ((here == 0) & (bit == 64 * w + first))
        out = out | (mine & deleted & none_before)
        none_before = none_before & (F.bit_count(here) > 1)
    return out


def dense_links(members: DataFrame, radius: int) -> DataFrame:
    """(a, b) that join all members (f0) within the radius: each to the least member that shares a point half the radius away."""
    reach = radius // 2 if radius % 2 == 0 else (radius + 1) // 2
    masks = [sum(1 << b for b in bits) for size in range(reach + 1) for bits in combinations(range(64), size)]
    points = members.select("f0", F.explode(F.lit([m - (1 << 64) if m >> 63 else m for m in masks])).alias("mask")).select("f0", F.col("f0").bitwiseXOR(F.col("mask")).alias("point"))
    least = points.groupBy("point").agg(F.min("f0").alias("a"), F.max("f0").alias("most")).filter("a <> most").drop("most")
    links = not_broadcast(points).join(not_broadcast(least), "point").filter("a <> f0").select("a", F.col("f0").alias("b")).distinct()
    return links if radius % 2 == 0 else links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_links(nodes: DataFrame, settings: SimHashSettings) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints f0 within the radius that share a key; for dense keys links that connect the same ones."""
    keys = nodes.select("f0", F.explode(deletion_keys(settings)).alias("key"))
    crowded = checkpointed(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > settings.dense).select("key"))
    any_crowded = bool(crowded.take(1))
    sparse = keys.join(crowded, "key", "left_anti") if any_crowded else keys
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.f0") < F.col("b.f0")) & (distance(settings) <= settings.radius) & first_shared_key(settings)
    links = not_broadcast(sparse.alias("a")).join(not_broadcast(sparse.alias("b")), near).select(F.col("a.f0").alias("a"), F.col("b.f0").alias("b"))
    if not any_crowded:
        return links
    members = keys.join(crowded, "key", "left_semi").select("f0").distinct()
    return links.unionByName(dense_links(members, settings.radius)).distinct()


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document, fingerprints linked at 4 or fewer bits."""
    limit_batches(spark)
    limit_reads(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", fingerprints("text", CONTRACT.shingle).alias("f0"))
    docs = written(docs)
    # each fingerprint makes 64 keys, so few bytes of them are much work: they are dealt to all tasks
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    nodes = checkpointed(docs.groupBy("f0").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")).repartition(parts, "f0"))
    links = near_links(nodes.select("f0"), CONTRACT)
    roots = components(links)
    linked = nodes.join(roots, nodes["f0"] == roots["node"], "left").select("f0", "low", "copies", F.coalesce("root", "f0").alias("root"))
    linked = checkpointed(linked)
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    found = checkpointed(join_hot(linked, lows.drop("n"), "root", hot_keys(lows, "root", "n")).select("f0", "copies", "component_id"))
    return join_hot(not_broadcast(docs), found.drop("copies"), "f0", hot_keys(found, "f0", "copies")).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
