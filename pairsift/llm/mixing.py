"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source with n documents and target weight w gets the rate lambda = total * w / n. Each document draws a uniform
number from a hash of its key and the seed, and its count is the Poisson quantile of that number: how many values of
the source's cumulative distribution it reaches. A rate above ``PART_RATE`` is cut into equal parts, each with a draw of its
own (the sum of Poisson numbers is one), so no distribution has more than some two hundred values. Documents are exploded
by their counts and dealt out by a hash of (key, copy, seed), in which order each partition is sorted: a global shuffle
without a sampling pass, the same on every run and every retry.

The key of a document is its id. Rows whose id is null or repeated take a hash of the whole row to it, and rows that
are alike in all columns their number among those too, so all rows draw apart and a source of such rows meets its target
like any other. Equal rows are numbered by input partition, one row a partition and distinct row, so a group of any size
is spread; which of them gets which number makes no difference.

The rates are broadcast only if there are at most ``BROADCAST_SOURCES`` sources (some 2 kB each); otherwise they are
joined by source, and the rows of sources that hold much of them are dealt to as many tasks as they need. Repeated ids are broadcast up to
``BROADCAST_IDS``, and joined by id beyond that.

Nulls and edges: a null source is a source of its own; sources without a target (or with a target of 0) get no copies;
empty tables give no rows. Columns of the input are kept whatever they are called; the new ones take a leading
underscore if their name is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import boxed, hot_keys, join_hot, table

BROADCAST_SOURCES, BROADCAST_IDS = 8_192, 500_000
PART_RATE = 64.0


def uniform(*parts: Column | str) -> Column:
    """52 bits of a hash of the parts, as a long."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def poisson_cdf(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2 ... as an array, far beyond any 52-bit number's quantile."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.ln(rate) - F.ln(k.cast("double"))
        return F.struct(log.alias("log"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + F.exp(log))).alias("cdf"))

    steps = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["cdf"])
    return F.when(rate > 0, steps).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, temperature: float, epochs: float) -> DataFrame:
    """source, parts and cdf (of one part of the rate): by given weights, or by counts raised to ``temperature`` (0: all sources alike, 1: as they are)."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        shares = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "s string, w double")
        shares = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    all_w, all_n = shares.agg(F.sum("w"), F.sum("n")).first()
    rate = F.lit(epochs * (all_n or 0)) * F.col("w") / F.lit(float(all_w)) / F.col("n") if all_w else F.lit(0.0)
    cut = shares.select("source", rate.alias("rate")).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int"))
    return cut.select("source", "parts", poisson_cdf(F.col("rate") / F.col("parts")).alias("cdf"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """row, source, none and id: the key that each row draws by."""
    source = (F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("none"))
    text_id = F.col("doc_id").cast("string")
    repeated = docs.filter("doc_id IS NOT NULL").groupBy(text_id.alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id")
    boxes = boxed(docs, *source, text_id.alias("id"))
    unique, others = boxes.filter("id IS NOT NULL"), boxes.filter("id IS NULL")
    if several := len(repeated.take(1)):
        if repeated.count() <= BROADCAST_IDS:
            repeated = F.broadcast(repeated)
        others = others.unionByName(unique.join(repeated, "id", "left_semi").select(*boxes.columns))
        unique = unique.join(repeated, "id", "left_anti").select(*boxes.columns)
    if not several and not docs.filter("doc_id IS NULL").take(1):
        return unique
    # JSON tells nulls in different columns apart, as xxhash64 does not
    hashed = others.withColumns({"h": F.md5(F.to_json("row", {"ignoreNullFields": "false"}).cast("binary")), "part": F.spark_partition_id()})
    # the rows of a partition are counted there, so a group of any size is one row a partition
    held = hashed.groupBy("h", "part").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in boxes.columns])
    held = held.withColumn("upto", F.sum("n").over(W.partitionBy("h").orderBy("part")))
    numbered = held.withColumn("at", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)))
    key = F.concat_ws(":", F.coalesce("id", F.lit("")), "h", F.col("at").cast("string"))
    return unique.unionByName(numbered.select("row", "source", "none", key.alias("id")))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 1) -> DataFrame:
    """The rows of docs (doc_id, source and others), each as often as drawn, shuffled; with ``copy`` (from 0) and ``shuffle_key``."""
    taken = {c.lower() for c in docs.columns}
    fresh = []
    for name in ("copy", "shuffle_key"):
        while name in taken:
            name = f"_{name}"
        fresh.append(name)
    source = (F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("none"))
    rates = source_rates(docs.select("source"), weights, temperature, epochs).select(*source, "parts", "cdf")
    boxes = keyed_rows(docs)
    if rates.select("source").count() <= BROADCAST_SOURCES:
        joined = boxes.join(F.broadcast(rates), ["source", "none"])
    else:
        both = F.struct("source", "none")
        counts = boxes.groupBy(both.alias("mix")).agg(F.count("*").alias("n"))
        joined = join_hot(boxes.withColumn("mix", both), rates.select(both.alias("mix"), "parts", "cdf"), "mix", hot_keys(counts, "mix", "n"))

    def quantile(*more: Column) -> Column:
        drawn = uniform(F.col("id"), F.lit(f"count{seed}"), *more) / F.lit(float(1 << 52))
        return F.size(F.filter("cdf", lambda c: c <= drawn))

    several = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda total, part: total + quantile(part.cast("string")))
    counted = joined.withColumn("drawn", uniform(F.col("id"), F.lit(f"count{seed}")) / F.lit(float(1 << 52)))
    one = F.size(F.filter("cdf", lambda c: c <= F.col("drawn")))
    counted = counted.withColumn("count", F.when(F.col("parts") == 1, one).otherwise(several)).filter("count > 0")
    copies = counted.select("row", "id", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", uniform(F.col("id"), F.col("copy").cast("string"), F.lit(f"order{seed}")))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = keyed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
    return out.select("row.*", F.col("copy").alias(fresh[0]), F.col("shuffle_key").alias(fresh[1]))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as drawn at weights of the square roots of the sources' sizes, one epoch in all."""
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


#: For tables whose ids are neither null nor repeated; tests hold those that are against brute force.
ORACLE_OP2 = """
WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (
  SELECT source, whole, greatest(CAST(ceil(whole / 64) AS INTEGER), 1) AS parts
  FROM (SELECT source, (SELECT sum(n) FROM n) * w / (SELECT sum(w) FROM n) / n AS whole FROM n)
), q AS (SELECT source, parts, whole / parts AS rate FROM r),
p AS (
  SELECT source, parts, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT source, parts, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INTEGER) + 1)) AS k FROM q)
), c AS (
  SELECT source, parts, list(cdf ORDER BY k) AS cdf FROM p GROUP BY source, parts
), u AS (
  SELECT d.*, c.cdf, unnest(range(c.parts)) AS part, c.parts
  FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source
), d AS (
  SELECT doc_id, text, lang, source, n_chars,
         sum(len(list_filter(cdf, lambda x: x <= CAST('0x' || substr(md5(doc_id || ':count1' || CASE WHEN parts > 1 THEN ':' || part ELSE '' END), 1, 13) AS BIGINT) / 4503599627370496.0))) AS count_
  FROM u GROUP BY doc_id, text, lang, source, n_chars
), e AS (
  SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(CAST(count_ AS BIGINT))) AS INTEGER) AS copy FROM d
)
SELECT *, CAST('0x' || substr(md5(doc_id || ':' || copy || ':order1'), 1, 13) AS BIGINT) AS shuffle_key FROM e
"""
