"""Inputs for the queries, derived from the given tables: pairs, transcripts, run history, reviews, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import Settings

#: Detector names in their order; history run ids are 3 * position + 1, 2, 3.
DETECTORS = tuple(Settings().detectors)
RUNS_EACH = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a scan for each core, from which it is cut finely enough by itself.
ENOUGH_BYTES = 32 << 20


def dealt(rows: DataFrame, source: DataFrame) -> DataFrame:
    """The rows in as many tasks as the session has cores, if their source is small and comes in fewer pieces: texts are much work a byte.

    What is shuffled is bounded by ``ENOUGH_BYTES`` a core; a large source is never shuffled, however few files it has.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(cores) if size < cores * ENOUGH_BYTES and len(source.inputFiles()) < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents")
    return dealt(source, source)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset_index, prompt, chosen, rejected: documents 2k and 2k + 1, with prefixes that some detectors look for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark")
    half = F.expr("doc_id div 2")
    chosen = docs.filter("doc_id % 2 = 0").select(half.alias("i"), F.col("text").alias("chosen_text"))
    rejected = docs.filter("doc_id % 2 = 1").select(half.alias("i"), F.col("text").alias("rejected_text"))
    prompts = items.select(F.col("item_id").alias("item"), F.col("text").alias("prompt_text"))
    i = F.col("i")
    joined = dealt(chosen.join(rejected, "i").withColumn("item", i % F.lit(items.count())).join(prompts, "item"), docs)
    return joined.select(
        i.alias("dataset_index"),
        F.concat(F.when(i % 13 == 5, "how to kill time. ").when(i % 26 == 7, "how to hack and torture a model. ").otherwise(""), "prompt_text").alias("prompt"),
        F.concat(F.when(i % 11 == 4, "I cannot help with that. ").when(i % 17 == 6, "As an AI, I won't. ").otherwise(""), "chosen_text").alias("chosen"),
        F.when(i % 22 == 4, "Sure, here you go.").otherwise(F.col("rejected_text")).alias("rejected"),
    )


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs as stored examples: id, dataset_index, prompt, chosen, rejected."""
    return pairs(spark, sf_dir).select((F.col("dataset_index") + 1).alias("id"), "dataset_index", "prompt", "chosen", "rejected")


def _tag(role: Column) -> Column:
    return F.when(role == "user", "Human: ").when(role == "assistant", "Assistant: ").otherwise("")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset_index, chosen, rejected: each conversation, and the same with its last assistant turn replaced by its first."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    answers = F.filter("turns", lambda t: t["role"] == "assistant")
    first, last = F.get(answers, F.lit(0))["text"], F.try_element_at(answers, F.lit(-1))["turn"]
    line = lambda t: F.concat(_tag(t["role"]), t["text"])
    swapped = lambda t: F.concat(_tag(t["role"]), F.when(t["turn"] == F.col("last"), F.col("first")).otherwise(t["text"]))
    named = turns.withColumns({"first": first, "last": F.coalesce(last, F.lit(-1))})
    return named.select(F.col("conv_id").alias("dataset_index"), F.array_join(F.transform("turns", line), "\n\n").alias("chosen"), F.array_join(F.transform("turns", swapped), "\n\n").alias("rejected"))


def raw_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcripts with some null texts and NUL characters, as a raw source may have them."""
    i = F.col("dataset_index")
    return transcripts(spark, sf_dir).select(i, F.when(i % 10 != 3, F.concat(F.col("chosen"), F.when(i % 4 == 0, F.lit("\0")).otherwise(""))).alias("chosen"), F.when(i % 20 != 7, F.col("rejected")).alias("rejected"))


def history_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs a detector, the last of them not completed; the last detector has no completed run."""
    settings, n = Settings(), examples(spark, sf_dir).count()
    rows = [(RUNS_EACH * d + k, name, 0.5 + 0.05 * d, settings.detectors[name].threshold_percentile, n, (10 * d + k) * 3600, None if k == 3 or d == len(DETECTORS) - 1 else (10 * d + k + 1) * 3600) for d, name in enumerate(DETECTORS) for k in range(1, RUNS_EACH + 1)]
    frame = spark.createDataFrame(rows, "id long, detector_name string, threshold double, percentile_used double, total_examples long, started long, completed long")
    at = lambda c: F.timestamp_seconds(F.lit(1_767_225_600) + F.col(c)).cast("timestamp_ntz")
    return frame.select("id", "detector_name", "threshold", "percentile_used", "total_examples", at("started").alias("started_at"), at("completed").alias("completed_at"))


def history_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal of every example in every run of the history."""
    ids = examples(spark, sf_dir).select("id")
    d, k = F.col("r.d"), F.col("r.k")
    runs = F.array(*[F.struct(F.lit(i).alias("d"), F.lit(j).alias("k"), F.lit(name).alias("name")) for i, name in enumerate(DETECTORS) for j in range(1, RUNS_EACH + 1)])
    level = (F.col("id") * 7 + d * 13 + k * 29) % 100
    rows = ids.withColumn("r", F.explode(runs)).withColumn("level", level)
    return rows.select(
        F.col("id").alias("example_id"),
        (d * RUNS_EACH + k).cast("long").alias("run_id"),
        F.col("r.name").alias("detector_name"),
        (F.col("level") / 100.0).cast("double").alias("score"),
        (F.col("level") >= d + 90).alias("flagged"),
        F.when(F.col("id") % 4 != 0, F.to_variant_object(F.struct(F.col("id").alias("n")))).alias("metadata"),
    )


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review events (example_id, detector_name, label, updated_at) from labels; every fifth is revised a day later."""
    marks = table(spark, sf_dir, "labels").filter("quality IS NOT NULL AND toxic IS NOT NULL")
    label = F.when(F.col("toxic") == 1, "true_positive").when(F.col("quality") == 1, "false_positive").otherwise("needs_review")
    name = F.element_at(F.array(*[F.lit(x) for x in DETECTORS[:3]]), (F.col("doc_id") % 3 + 1).cast("int"))
    at = lambda shift: F.timestamp_seconds(F.lit(1_767_225_600 + shift) + F.col("doc_id")).cast("timestamp_ntz")
    first = marks.select((F.col("doc_id") + 1).alias("example_id"), name.alias("detector_name"), label.alias("label"), at(0).alias("updated_at"))
    second = marks.filter("doc_id % 5 = 0").select((F.col("doc_id") + 1).alias("example_id"), name.alias("detector_name"), F.when(F.col("quality") == 1, "true_positive").otherwise("false_positive").alias("label"), at(86_400).alias("updated_at"))
    return first.unionByName(second)


# Responses that test the parser.
ODD_RESPONSES = ("oops", "[1]", "null", "{}", "", '{"helpfulness_delta": null}', '{"helpfulness_delta": 4.7, "honest_preference": 5, "label_confidence": 5}', '{"helpfulness_delta": "4.7"}', '{"helpfulness_delta": "4", "honest_preference": 2, "label_confidence": true, "reason": "odd"}')


def judge_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id and response: verdicts from the numbers in events, and odd ones with negative ids."""
    k = F.get_json_object("props", "$.k").cast("int")
    parts = [F.lit('{"helpfulness_delta": '), (k % 5 + 1).cast("string"), F.lit(', "honest_preference": '), (k % 4 + 2).cast("string"), F.lit(', "label_confidence": '), (k % 3 + 3).cast("string"), F.lit(', "reason": "r'), k.cast("string"), F.lit('"}')]
    real = table(spark, sf_dir, "events").select(F.col("event_id").alias("pair_id"), F.concat(*parts).alias("response"))
    odd = spark.createDataFrame([(-i, r) for i, r in enumerate(ODD_RESPONSES, 1)], "pair_id long, response string")
    return real.unionByName(odd)


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, chosen_embedding and rejected_embedding: vectors 2k and 2k + 1."""
    vectors = table(spark, sf_dir, "embeddings")
    half = F.expr("vec_id div 2").alias("pair_id")
    a = vectors.filter("vec_id % 2 = 0").select(half, F.col("embedding").alias("chosen_embedding"))
    b = vectors.filter("vec_id % 2 = 1").select(half, F.col("embedding").alias("rejected_embedding"))
    return a.join(b, "pair_id")
