"""Near-duplicate documents: SimHash links by deletion variants and exact candidates by prefixes, verified by Jaccard similarity.

The similarity is that of the sets of five-word shingles, 0.8 or more. Of n shingles, a text lacks at most n / 5 of
those of a similar one, so of its n / 5 + m smallest shingle hashes (its keys) it shares m at least, less where the
other text is smaller. A text with fewer shared keys has no near duplicate; of the rest, each keeps its rarest keys, so
many that similar texts still share one (prefix filtering). No pair is lost by that, wherever its edits lie.

Texts of equal word sequences are one node, whatever their number. Groups are connected components, so pairs inside a
component are not needed. First come the links of the SimHash operator between the nodes that are left: each fingerprint
with the least one within the radius, each node with the least of its fingerprint. SimHash alone would miss pairs, as at
0.8 far more bits may differ than any indexable radius. So each node is also held against the hub of each of its keys,
the member that shares most keys, which connects the bulk of a large group in rows that grow with its members. Then all
pairs that do not have the same hub follow: the texts that have such keys left are joined by the rarest of all their
shingles, as far down as the pair could still share enough, and their bitmaps must leave room for the similarity. Keys
that the same nodes share count as one.

Words are separated by ASCII white space, A-Z lower-cased; fewer than five words make one shingle. Null texts count
as empty, and all empty texts are copies of each other. Of each group the row with the smallest id stays, null ids
last; of equal rows one stays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BYTE_KINDS, HOT_KEYS, HOT_ROWS, delete_folder, flat, hot_keys, join_hot, limit_batches, mixed, not_broadcast, over_key, release, shared_folder, shingles_of, slices, words_of, written
from .components import components
from .simhash import SimHashSettings, fingerprint, near_links

#: All but ASCII white space.
WORD_BYTES = BYTE_KINDS != 0
WORD_BYTES[0] = True
BROADCAST_ROWS = 500_000
#: One in so many nodes is looked at for keys that many nodes have.
SAMPLE = 16
#: Members of a shingle that one task holds against each other, or against as many others.
PAIR_BLOCK = 4096
#: Bits of the bitmap of a set of shingles.
BITMAP = 512


@dataclass(frozen=True)
class NearDuplicateSettings:
    shingle: int = 5
    similarity: float = 0.8
    #: Keys beyond what a similar text may lack, as a part of the shingles: more keys tell more texts apart early.
    spare: float = 0.1
    simhash: SimHashSettings = SimHashSettings(shingle=5)

    def least(self, size: int) -> int:
        """The least number of shingles that a similar text has, and shares."""
        return math.ceil(self.similarity * size - 1e-9)

    def spared(self, size: int) -> int:
        return max(1, math.ceil(self.spare * size - 1e-9))


def _sequence_hash(words: np.ndarray) -> np.uint64:
    """A hash of a sequence of words."""
    places = mixed(np.arange(1, len(words) + 1, dtype=np.uint64))
    return mixed(np.array([np.bitwise_xor.reduce(mixed(words + places), initial=np.uint64(len(words)))], np.uint64))[0]


def _each(texts: pa.Array):
    """The word hashes of each text."""
    data, offsets = flat(texts)
    for low, high in slices(offsets):
        words, at = words_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], WORD_BYTES)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield words[a:b]


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    return shingles_of(words, min(k, len(words))) if len(words) else np.zeros(0, np.uint64)


def signatures(text: str, settings: NearDuplicateSettings) -> Column:
    """A struct column: node, the hash of the word sequence; size, the number of shingles; keys, the smallest shingle hashes."""

    def compute(texts: pa.Array) -> pa.Array:
        nodes, sizes, keys = [], [], [np.zeros(0, np.uint64)]
        for words in _each(texts):
            hashes = np.unique(_shingles(words, settings.shingle))
            size = len(hashes)
            nodes.append(_sequence_hash(words))
            sizes.append(size)
            keys.append(hashes[: size - settings.least(size) + settings.spared(size)])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys[1:])]), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists], ["node", "size", "keys"])

    return F.arrow_udf(compute, "struct<node:long,size:int,keys:array<long>>")(F.col(text))


def shingle_sets(text: str, k: int) -> Column:
    """A struct column: node, the sorted distinct hashes of the k-word shingles, their number, their SimHash f0, and a bitmap of them in longs m0, m1 ..."""
    masks = [f"m{i}" for i in range(BITMAP // 64)]

    def compute(texts: pa.Array) -> pa.Array:
        nodes, sets, maps = [], [], np.zeros((len(texts), BITMAP), bool)
        for i, words in enumerate(_each(texts)):
            nodes.append(_sequence_hash(words))
            sets.append(np.unique(_shingles(words, k)))
            maps[i, (sets[-1] % np.uint64(BITMAP)).astype(np.int64)] = True
        sizes = np.array([len(x) for x in sets], np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
        longs = np.packbits(maps, axis=1, bitorder="little").view(np.int64).reshape(len(texts), -1)
        prints = np.array([fingerprint(x, 1)[0] for x in sets], np.uint64).view(np.int64)
        columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), lists, pa.array(sizes), pa.array(prints), *[pa.array(np.ascontiguousarray(longs[:, i])) for i in range(len(masks))]]
        return pa.StructArray.from_arrays(columns, ["node", "shingles", "size", "f0", *masks])

    return F.arrow_udf(compute, f"struct<node:long,shingles:array<long>,size:int,f0:long,{','.join(f'{m}:long' for m in masks)}>")(F.col(text))


def may_be_similar(similarity: float) -> Column:
    """Whether the bitmaps of rows a and b leave room for this Jaccard similarity; it is never false for a pair that has it.

    A bit of a that b lacks stands for at least one shingle of a that b lacks.
    """

    def lacks(x: str, y: str) -> Column:
        total = F.lit(0)
        for i in range(BITMAP // 64):
            total = total + F.bit_count(F.col(f"{x}.m{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}.m{i}"))))
        return total

    only_a, only_b, a, b = lacks("a", "b"), lacks("b", "a"), F.col("a.size"), F.col("b.size")
    return (a - only_a >= similarity * (a + only_b)) & (b - only_b >= similarity * (b + only_a))


def crowded_keys(keys: DataFrame) -> DataFrame:
    """key and n_hot: keys that many nodes have, and about how many; from the keys of one in ``SAMPLE`` nodes, at most ``HOT_KEYS`` of them."""
    counts = keys.groupBy("key").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") > max(HOT_ROWS // SAMPLE, total // HOT_KEYS)).select("key", (F.col("n") * SAMPLE).alias("n_hot"))


def shared_keys(nodes: DataFrame, settings: NearDuplicateSettings) -> DataFrame:
    """key, n, node, size: keys that n > 1 of the distinct nodes (node, size, keys) share; all similar nodes share one.

    Which keys count as the rarest of a node may be any order that is the same for all nodes. So crowded keys are not
    counted: their estimate stands for their number, and no window gets their rows together.
    """
    by_node = W.partitionBy("node")
    keys = nodes.select("node", "size", F.explode("keys").alias("key"))
    sampled = nodes.filter(F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(SAMPLE)) == 0)
    crowded = written(crowded_keys(sampled.select(F.explode("keys").alias("key"))))
    some = bool(crowded.take(1))
    # the smallest text that can be similar spares the fewest
    need = F.greatest(F.ceil(settings.spare * F.ceil(settings.similarity * F.col("size") - 1e-9) - 1e-9), F.lit(1))

    def counted(rows: DataFrame) -> DataFrame:
        """With n, the number of nodes of each key."""
        if not some:
            return rows.withColumn("n", F.count("*").over(W.partitionBy("key")))
        known = rows.join(F.broadcast(crowded), "key", "left")
        alone = known.withColumn("alone", F.when(F.col("n_hot").isNull(), F.col("key")).otherwise(F.xxhash64("node", "key")))
        return alone.withColumn("n", F.coalesce("n_hot", F.count("*").over(W.partitionBy("alone")))).drop("n_hot", "alone")

    def enough(rows: DataFrame) -> DataFrame:
        return counted(rows).filter("n > 1").withColumn("own", F.count("*").over(by_node)).filter(F.col("own") >= need)

    # most keys go here, so their shuffle files need not wait for what follows
    first = written(enough(keys).drop("n", "own"))
    release(nodes.sparkSession)
    held = enough(first)
    # similar nodes share ``need`` of these, so they share one of the rarest without the last need - 1 of each
    rarest = held.withColumn("place", F.row_number().over(by_node.orderBy("n", "key"))).filter(F.col("place") <= F.col("own") - need + 1).select("key", "node", "size")
    # keys of the same members are one key; a crowded one stays as it is
    same = W.partitionBy("key" if not some else "alone")
    sums = {"n": F.count("*"), "x": F.bit_xor(F.xxhash64("node")), "y": F.bit_xor(F.xxhash64(F.lit(1), "node"))}
    if some:
        rarest = rarest.join(F.broadcast(crowded), "key", "left").withColumn("alone", F.when(F.col("n_hot").isNull(), F.col("key")).otherwise(F.xxhash64("node", "key")))
        hot = F.col("n_hot").isNotNull()
        sums = {"n": F.when(hot, F.col("n_hot")).otherwise(sums["n"].over(same)), "x": F.when(hot, F.col("key")).otherwise(sums["x"].over(same)), "y": F.when(hot, F.lit(0)).otherwise(sums["y"].over(same))}
    else:
        sums = {name: value.over(same) for name, value in sums.items()}
    members = rarest.withColumns(sums).filter("n > 1")
    return written(members.select(F.xxhash64("n", "x", "y").alias("key"), "n", "node", "size").dropDuplicates(["key", "node"]))


def shared_by_many(rows: DataFrame) -> Column | None:
    """Whether a row of ``shared_keys`` has a key that many share; there are at most ``HOT_KEYS`` such keys. None if there are none."""
    count, top = rows.agg(F.count("*"), F.max("n")).first()
    limit = max(HOT_ROWS, count // HOT_KEYS)
    return F.col("n") > limit if (top or 0) > limit else None


def star_pairs(rows: DataFrame, similarity: float, hot: Column | None) -> DataFrame:
    """(a, b, fame): each node with the hubs of its keys, where the sizes fit. A key's hub is the member whose keys are shared most."""
    fame = rows.groupBy("node").agg(F.sum("n").alias("fame"))
    famed = over_key(rows.join(fame, "node"), "key", {"hub": F.max(F.struct("fame", "node", "size"))}, hot)
    pairs = famed.select("node", "size", "hub").filter("node <> hub.node")
    fits = (F.col("size") >= similarity * F.col("hub.size")) & (F.col("hub.size") >= similarity * F.col("size"))
    return pairs.filter(fits).select(F.col("node").alias("a"), F.col("hub.node").alias("b"), "hub.fame").distinct()


def simhash_pairs(prints: DataFrame, settings: SimHashSettings) -> DataFrame:
    """(a, b, fame) of (node, f0): links of the SimHash operator, one at most for each fingerprint and each node; their fame is 0, below that of hubs.

    A fingerprint's node is its least; the others are linked to that, and that to the node of the least fingerprint within
    the radius. So links grow with the nodes, however many fingerprints lie close together.
    """
    parts = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = written(prints.groupBy("f0").agg(F.min("node").alias("low"), F.count("*").alias("n")))
    # each fingerprint makes 64 keys, so these alone are dealt to all tasks
    least = near_links(groups.select("f0").repartition(parts, "f0"), settings).select(F.greatest("a", "b").alias("f0"), F.least("a", "b").alias("to")).groupBy("f0").agg(F.min("to").alias("to"))
    lows = groups.select(F.col("f0").alias("to"), F.col("low").alias("b"))
    apart = least.join(not_broadcast(groups.select("f0", F.col("low").alias("a"))), "f0").join(not_broadcast(lows), "to").select("a", "b")
    alike = join_hot(prints.select("node", "f0"), not_broadcast(groups.select("f0", "low")), "f0", hot_keys(groups, "f0", "n")).filter("node <> low")
    return alike.select(F.col("node").alias("a"), F.col("low").alias("b")).unionByName(apart).withColumn("fame", F.lit(0).cast("long"))


def star_roots(stars: DataFrame) -> DataFrame:
    """(node, root): each node's most famous hub, and that one's, if it has one. A node that has none is its own root."""
    up = written(stars.groupBy("a").agg(F.max(F.struct("fame", "b")).alias("hub")).select(F.col("a").alias("node"), F.col("hub.b").alias("hub"), F.col("hub.fame").alias("fame")))
    # only upwards, so that two nodes that are each other's hubs agree on one
    higher = up.select(F.col("node").alias("hub"), F.col("hub").alias("top"), F.col("fame").alias("top_fame"))
    risen = up.join(not_broadcast(higher), "hub", "left")
    climbs = F.struct("top_fame", "top") > F.struct("fame", "hub")
    return risen.select("node", F.when(F.col("top").isNotNull() & climbs, F.col("top")).otherwise(F.col("hub")).alias("root"))


def rarest_shingles(texts: DataFrame, similarity: float) -> DataFrame:
    """key, n, node, size, rest: of (node, size, root, shingles) the rarest shingles of each node; similar nodes of different roots share one.

    Shingles that no two roots share don't count. A similar text shares ``similarity`` of all shingles at least, so a node with
    fewer that count has none, and the others need as many as they may lack, and one. n is the number of nodes with the
    shingle, rest the number of the node's shingles that are not before it: so many at most are shared if this is the first.
    """
    each = texts.select("node", "size", "root", F.explode("shingles").alias("key"))
    counts = each.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    counts = written(counts.filter("low <> high").select("key", "n"))
    met = join_hot(each.drop("root"), counts, "key", hot_keys(counts, "key", "n"))
    by_node = W.partitionBy("node")
    placed = met.withColumns({"own": F.count("*").over(by_node), "place": F.row_number().over(by_node.orderBy("n", "key"))})
    least = F.ceil(similarity * F.col("size") - 1e-9)
    return written(placed.withColumn("rest", F.col("own") - F.col("place") + 1).filter(F.col("rest") >= least).select("key", "n", "node", "size", "rest"))


def cross_pairs(rows: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float, hot: Column | None) -> DataFrame:
    """(a, b): all pairs that share a key, may be similar and have not the same root (or one the other as root).

    Members of a key are many and few of them are similar, so those whose keys have several roots are joined by their rarest
    shingles instead, of which the smaller text of a pair needs fewer still.
    """
    held = written(sets.drop("shingles", "f0").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # keys whose members all have one root are done
    rooted = rows.select("key", "n", "node").join(not_broadcast(held.select("node", "root")), "node")
    left = over_key(rooted, "key", {"low": F.min("root"), "high": F.max("root")}, hot).filter("low <> high").select("node", "root").distinct()
    rarest = rarest_shingles(written(sets.select("node", "size", "shingles").join(left, "node")), similarity)
    # a crowded shingle's nodes are dealt to blocks, and each pair of blocks is a key of its own
    blocks = F.ceil(F.col("n") / PAIR_BLOCK).cast("int")
    dealt = rarest.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks).cast("int")}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # equal sizes share this part of each, and the smaller text more of its own
    part = similarity / (1 + similarity)
    smaller = dealt.filter(F.col("rest") >= F.ceil(2 * part * F.col("size") - 1e-9))
    one = smaller.select("key", "node", "rest", F.col("block").alias("low"), F.col("other").alias("high")).join(not_broadcast(held), "node")
    other = dealt.select("key", "node", "rest", F.col("other").alias("low"), F.col("block").alias("high")).join(not_broadcast(held), "node")
    apart = (F.col("a.root") != F.col("b.root")) & (F.col("a.root") != F.col("b.node")) & (F.col("a.node") != F.col("b.root"))
    # the cheapest conditions come first
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.low") == F.col("b.low")) & (F.col("a.high") == F.col("b.high"))
    ordered = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.node") < F.col("b.node")))
    enough = F.least("a.rest", "b.rest") >= F.ceil(part * (F.col("a.size") + F.col("b.size")) - 1e-9)
    near = same & ordered & (F.col("a.size") >= similarity * F.col("b.size")) & enough & apart & may_be_similar(similarity)
    return one.alias("a").join(other.alias("b"), near).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, hot: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose shingle sets (node, shingles) are similar enough. ``hot`` says which b have many pairs; these are dealt out."""
    mine, other = sets.select(F.col("node").alias("a"), F.col("shingles").alias("mine")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("other"))
    both = F.size(F.array_intersect("mine", "other"))
    held = join_hot(pairs, other, "b", hot).join(mine, "a")
    return held.filter(both >= similarity * (F.size("mine") + F.size("other") - both)).select(*pairs.columns)


def row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes that tell rows of different id or text apart; ``row`` holds all columns."""
    keys = (F.xxhash64("doc_id", "text").alias("row1"), F.xxhash64(F.lit(2), "text", "doc_id").alias("row2"))
    return docs.select("doc_id", "text", *keys, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def signed_rows(docs: DataFrame, settings: NearDuplicateSettings) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text, row1, row2): (doc_id, row1, row2, node) of every row, and the ``shared_keys`` of all nodes, as tables.

    Tables with all keys are deleted as soon as the next one is written.
    """
    spark = docs.sparkSession
    signing, distinct = shared_folder(spark), shared_folder(spark)
    both = written(docs.select("doc_id", "row1", "row2", signatures("text", settings).alias("s")).select("doc_id", "row1", "row2", "s.*"), signing)
    signed = written(both.drop("size", "keys"))
    nodes = written(both.select("node", "size", "keys").dropDuplicates(["node"]), distinct)
    delete_folder(spark, signing)
    release(spark)
    rows = shared_keys(nodes, settings)
    delete_folder(spark, distinct)
    return signed, rows


def near_duplicates(docs: DataFrame, settings: NearDuplicateSettings = NearDuplicateSettings()) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text, row1, row2): (doc_id, row1, row2, node) of every row, and links (a, b) that connect the same nodes as all pairs that are similar enough."""
    limit_batches(docs.sparkSession)
    signed, rows = signed_rows(docs, settings)
    release(docs.sparkSession)
    hot = shared_by_many(rows)
    hubs = written(star_pairs(rows, settings.similarity, hot))
    first = signed.groupBy("node").agg(F.min(F.struct("row1", "row2")).alias("row"))
    wanted = written(rows.select("node").distinct().join(first, "node").select("row.*"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = docs.join(wanted, ["row1", "row2"], "left_semi").select(shingle_sets("text", settings.shingle).alias("s")).select("s.*").dropDuplicates(["node"])
    sets = written(sets)
    release(docs.sparkSession)
    candidates = written(hubs.unionByName(simhash_pairs(sets.select("node", "f0"), settings.simhash)).groupBy("a", "b").agg(F.max("fame").alias("fame")))
    often = hot_keys(candidates.groupBy("b").agg(F.count("*").alias("n")), "b", "n")
    stars = written(verified(not_broadcast(candidates), sets, settings.similarity, often))
    release(docs.sparkSession)
    rest = verified(cross_pairs(rows, sets, star_roots(stars), settings.similarity, hot), sets, settings.similarity)
    return signed, stars.select("a", "b").unionByName(rest)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without all but one of each group of near duplicates; their columns are unchanged."""
    keyed = row_keys(docs)
    rows, links = near_duplicates(keyed.drop("row"))
    grouped = rows.join(components(links), "node", "left").withColumn("group", F.coalesce("root", "node"))
    # null ids come last; a struct takes them for smallest, hence the flag
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row1", "row2")).alias("first"))
    kept = written(first.select("first.row1", "first.row2"))
    # the last join shuffles whole texts, and needs nothing of the files before it
    release(spark)
    return keyed.select("row1", "row2", "row").join(kept, ["row1", "row2"], "left_semi").dropDuplicates(["row1", "row2"]).select("row.*")
