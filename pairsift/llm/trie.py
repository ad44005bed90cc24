"""The trie of conversations: a node for each distinct sequence of first turns, with its members, ends and subtree sums.

A turn is its MD5 (of role and text) and its text's bytes; texts go no further. A node is told by 128 bits: the exclusive
or, over its turns, of two 64-bit hashes of (depth, MD5). Depth is hashed too, so order counts, and the identity of
every prefix of a conversation is a running aggregate, which can be cut into blocks and put together again.

Partial tries: each partition combines its conversations' nodes into a table of its own (members counted, smallest
member). These tables are merged by node, ``FAN`` partitions at a time, until one is left, so a node that all
conversations share is some rows a task. Ends are merged likewise: lists of the conversations that end at a node,
by ranges of ids, each list bounded by its range; their digest reads these lists in order as a stream.

Rollup from the bottom: each node is owned by the member that comes first in a fixed random order. What one
conversation owns is a stretch of its own path, from where it leaves an owner before it down to its end, so the trie is
cut into stretches. A stretch's sum goes to the node that it hangs from, and from there with that node's stretch on, round
by round; running sums within each stretch then give every node its subtree. The rounds are as many as owners change
on a path: the logarithm of the conversations, in expectation, however deep the trie.

Hot conversations (``hot_keys``: more than 256 turns, and more than one in 100,000 of all) are ordered by ranges over
several tasks, and their running aggregates go by blocks of ``BLOCK`` turns.

Nulls and edges: turns are ordered by (turn, MD5), null turns first, and repeated turns stay; a null role or text is
empty; rows with a null conversation id belong to none. Conversations without a turn are members and ends of the root.
An empty table gives no node. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, limit_batches, table, written

BLOCK, FAN = 4096, 64
#: Ids of one list of ends lie in a range of so many.
END_RANGE = 1 << 16


@dataclass(frozen=True)
class Aggregate:
    of: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]


SUM = Aggregate(F.sum, lambda a, b: a + b)
XOR = Aggregate(F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def running(rows: DataFrame, key: str, at: str, names: list[str], kind: Aggregate, blocks: bool, down: bool = False) -> DataFrame:
    """``rows`` with the columns ``names`` aggregated over all rows of the same key up to ``at`` (``down``: from ``at`` on); with blocks, no task gets a whole key."""
    order = F.col(at).desc() if down else F.col(at)
    if not blocks:
        upto = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return rows.withColumns({n: kind.of(F.col(n)).over(upto) for n in names})
    rows = rows.withColumn("block", F.floor(F.col(at) / BLOCK))
    upto = W.partitionBy(key, "block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.withColumns({n: kind.of(F.col(n)).over(upto) for n in names})
    whole = rows.groupBy(key, "block").agg(*[kind.of(F.col(n)).alias(f"all_{n}") for n in names])
    before = W.partitionBy(key).orderBy(F.col("block").desc() if down else F.col("block")).rowsBetween(W.unboundedPreceding, -1)
    offsets = whole.select(key, "block", *[F.coalesce(kind.of(F.col(f"all_{n}")).over(before), F.lit(0)).alias(f"all_{n}") for n in names])
    return inside.join(offsets, [key, "block"]).withColumns({n: kind.join(F.col(n), F.col(f"all_{n}")) for n in names}).select(*[c for c in rows.columns if c != "block"])


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """conv_id, place (from 0), digest and size of each turn; conv_id and n of each conversation; the hot ones."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    counts = conversations.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "conv_id", "n")
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    columns = ["conv_id", "place", "digest", "size"]

    def placed(part: DataFrame, *key: str) -> DataFrame:
        return part.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("long") - 1)

    if hot is None:
        return placed(rows, "conv_id").select(columns), counts, None
    ids = F.broadcast(hot.select("conv_id"))
    cold = placed(rows.join(ids, "conv_id", "left_anti"), "conv_id")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, as ranges drawn again after a lost task could differ
    ranged = written(rows.join(ids, "conv_id", "left_semi").repartitionByRange(parts, F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()))
    held = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("held"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = held.select("conv_id", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    # a range holds some end and begin of a conversation and whole ones between: few rows
    joined = placed(ranged, "conv_id", "part").join(offsets, ["conv_id", "part"]).withColumn("place", F.col("place") + F.col("before"))
    return cold.select(columns).unionByName(joined.select(columns)), counts, hot


def branched(turns: DataFrame, counts: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Each conversation c behind the first h turns of c - c % 5 in place of its own first h, h being crc32(c) % 9.

    conv_id, depth (from 1), total, digest and size of each turn; conv_id and total of each conversation.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    convs = counts.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 5}).join(bases, "base", "left").withColumn("taken", taken)
    convs = convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    own = join_hot(turns.filter(F.col("place") >= h), convs, "conv_id", hot)
    own = own.select("conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "total", "digest", "size")
    first = turns.filter((F.col("place") < 8) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "base")
    before = first.join(convs.filter("taken > 0"), "base").filter("place < taken").select("conv_id", (F.col("place") + 1).alias("depth"), "total", "digest", "size")
    return own.unionByName(before), convs.select("conv_id", "total")


def whole(turns: DataFrame, counts: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Each conversation as it is; columns as those of ``branched``."""
    convs = counts.select("conv_id", F.col("n").alias("total"))
    return join_hot(turns, convs, "conv_id", hot).select("conv_id", (F.col("place") + 1).alias("depth"), "total", "digest", "size"), convs


NODE = ["hi", "lo", "depth", "parent_hi", "parent_lo", "size"]


def merged_tries(rows: DataFrame) -> DataFrame:
    """NODE, n_convs, conv_id and owner: partial tries merged ``FAN`` at a time."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = rows.select(*NODE, F.lit(1).cast("long").alias("n_convs"), "conv_id", F.xxhash64("conv_id").alias("owner"), F.spark_partition_id().alias("part"))
    sums = [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("owner").alias("owner")]
    while parts > FAN:
        parts = -(-parts // FAN)
        tables = tables.withColumn("part", F.pmod(F.floor(F.col("part") / FAN), F.lit(parts))).groupBy(*NODE, "part").agg(*sums)
    return tables.groupBy(*NODE).agg(*sums)


def end_lists(ends: DataFrame) -> DataFrame:
    """hi, lo, at and ids: the conversations that end at a node, in ranges of ids, each list sorted and comma-joined."""
    lists = ends.groupBy("hi", "lo", F.floor(F.col("conv_id") / END_RANGE).alias("at")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    return lists.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lists that come sorted by node and range: one SHA-256 a node, over all its lists."""
    kept, now, sha = [], None, None

    def flush() -> pa.RecordBatch:
        hi, lo, out = zip(*kept) if kept else ((), (), ())
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(out, pa.string())], ["hi", "lo", "ends_sha256"])

    for batch in batches:
        for hi, lo, ids in zip(batch["hi"].to_pylist(), batch["lo"].to_pylist(), batch["ids"]):
            if (hi, lo) != now:
                if now is not None:
                    kept.append((*now, sha.hexdigest()))
                now, sha = (hi, lo), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_buffer())
        yield flush()
    if now is not None:
        kept.append((*now, sha.hexdigest()))
    yield flush()


def end_digests(lists: DataFrame) -> DataFrame:
    """hi, lo and ends_sha256 of each node where a conversation ends."""
    limit_batches(lists.sparkSession)
    dealt = lists.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "at").select("hi", "lo", "ids")
    return dealt.mapInArrow(_digests, "hi long, lo long, ends_sha256 string")


def subtree_sums(stretches: DataFrame, hangs: DataFrame, names: list[str], blocks: bool) -> DataFrame:
    """owner, depth and the sums over each node's subtree.

    ``stretches`` has a row (owner, depth, names) for each node, ``hangs`` the node (up_owner, up_depth) that an owner's stretch
    hangs from. Each round takes what the last one brought to a stretch one stretch further up.
    """
    sums = [F.sum(n).alias(n) for n in names]
    news, all_news = stretches, stretches
    while True:
        moved = news.groupBy("owner").agg(*sums).join(hangs, "owner")
        news = written(moved.groupBy(F.col("up_owner").alias("owner"), F.col("up_depth").alias("depth")).agg(*sums))
        if not news.take(1):
            break
        all_news = all_news.unionByName(news)
    return running(all_news.groupBy("owner", "depth").agg(*sums), "owner", "depth", names, SUM, blocks, down=True)


def prefix_trie(conversations: DataFrame, paths: Callable[..., tuple[DataFrame, DataFrame]] = whole) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its 128 bits (hi, lo)."""
    turns, counts, hot = ordered_turns(conversations)
    rows, convs = paths(turns, counts, hot)
    lanes = {"hi": F.xxhash64(F.lit(1), "depth", "digest"), "lo": F.xxhash64(F.lit(2), "depth", "digest")}
    rows = rows.withColumns(lanes).withColumns({"own_hi": F.col("hi"), "own_lo": F.col("lo")}).drop("digest")
    rows = running(rows, "conv_id", "depth", ["hi", "lo"], XOR, hot is not None)
    rows = rows.withColumns({"parent_hi": F.col("hi").bitwiseXOR(F.col("own_hi")), "parent_lo": F.col("lo").bitwiseXOR(F.col("own_lo"))})
    zero = F.lit(0).cast("long")
    at_root = convs.select("conv_id", "total", *[(F.lit(None).cast("long") if c.startswith("parent") else zero).alias(c) for c in NODE])
    rows = written(rows.select("conv_id", "total", *NODE).unionByName(at_root))
    ends = end_digests(end_lists(rows.filter("depth = total").select("hi", "lo", "conv_id")))

    nodes = written(merged_tries(rows).withColumns({"node": F.struct("hi", "lo"), "parent": F.struct(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo"))}))
    children = nodes.filter("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("up_owner"))
    # the root is the parent of most nodes
    under = join_hot(nodes.filter("depth > 0"), above, "parent", hot_keys(children, "parent", "n_children"))
    known = nodes.filter("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "up_owner": F.lit(None).cast("long")}).unionByName(under)
    known = known.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = written(known.select("hi", "lo", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "owner", "up_owner", ((F.col("n_convs") - 1) * F.col("size")).alias("saved")))

    hangs = known.filter("up_owner <> owner").select("owner", "up_owner", (F.col("depth") - 1).alias("up_depth"))
    stretches = known.select("owner", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    sums = subtree_sums(stretches, hangs, ["n_leaves", "saved_tokens"], hot is not None)
    out = known.join(sums, ["owner", "depth"]).join(ends, ["hi", "lo"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "hi", "lo")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each behind the first turns of another."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return prefix_trie(rows, branched).drop("hi", "lo")


ORACLE_OP12 = """
WITH t AS (
  SELECT conv_id, strlen(coalesce(text, '')) AS size, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(a, b)), 4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, t.place AS spot, digest, size FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, t.place + 100, digest, size FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY spot)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM p GROUP BY path, depth
), k AS (
  SELECT n.*, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND left(m.path, 32 * n.depth) = n.path) AS n_children FROM n
), s AS (
  SELECT a.path, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((k.n_convs - 1) * k.size) AS saved_tokens
  FROM k JOIN p a ON a.conv_id = k.conv_id AND a.depth <= k.depth GROUP BY a.path
), e AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path
)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(ends, '')) AS ends_sha256
FROM k JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n u ON u.depth = k.depth - 1 AND u.path = left(k.path, 32 * (k.depth - 1))
"""
