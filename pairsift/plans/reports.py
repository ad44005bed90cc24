"""Reports over examples, signals and runs.

``runs`` holds id, detector_name, threshold, percentile_used, started_at and completed_at; ``signals`` holds
example_id, run_id, detector_name, score, flagged and metadata. Latest runs are one row for each detector, so they
are small; signals are filtered by run before anything else is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import grouped_stats
from .config import Settings


def latest_runs(runs: DataFrame, by: str = "completed_at") -> DataFrame:
    """The last run of each detector by ``completed_at`` (completed ones only) or ``started_at``; ties go to the larger id."""
    dated = runs.filter(F.col(by).isNotNull())
    return dated.groupBy("detector_name").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "detector_name"]), F.struct(by, "id")).alias("run")).select("detector_name", "run.*")


def _configured(runs: DataFrame, settings: Settings, exclude: list[str]) -> DataFrame:
    names = [n for n in settings.detectors if n not in exclude]
    return latest_runs(runs).filter(F.col("detector_name").isin(names)).select("detector_name", F.col("id").alias("run_id"))


def flagged_any(signals: DataFrame, runs: DataFrame, settings: Settings | None = None, exclude: list[str] = []) -> DataFrame:
    """example_id of the examples that any configured detector's latest completed run flags."""
    wanted = _configured(runs, settings or Settings(), exclude)
    return signals.filter("flagged").join(F.broadcast(wanted), ["detector_name", "run_id"], "left_semi").select("example_id").distinct()


def clean_ids(examples: DataFrame, signals: DataFrame, runs: DataFrame, settings: Settings | None = None, exclude: list[str] = []) -> DataFrame:
    """id of the examples that none of them flags."""
    return examples.select("id").join(flagged_any(signals, runs, settings, exclude), F.col("id") == F.col("example_id"), "left_anti")


def _pct(part: str, whole: str):
    return F.when(F.col(whole) > 0, F.round(100 * F.col(part) / F.col(whole), 2)).otherwise(0.0)


def quality_report(signals: DataFrame, runs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """A row for each configured detector: its status, and its latest completed run's threshold, counts and statistics."""
    spark, settings = signals.sparkSession, settings or Settings()
    names = spark.createDataFrame([(n,) for n in settings.detectors], "detector_name string")
    latest = latest_runs(runs).withColumnRenamed("id", "run_id")
    mine = signals.join(F.broadcast(latest.select("detector_name", "run_id")), ["detector_name", "run_id"], "left_semi")
    sums = grouped_stats(mine, "score", "detector_name", F.count("*").alias("total_scored"), F.count_if("flagged").alias("flagged"))
    rows = names.join(latest, "detector_name", "left").join(sums, "detector_name", "left")
    ran = F.col("run_id").isNotNull()
    counts = rows.withColumns({c: F.when(ran, F.coalesce(c, F.lit(0))) for c in ("total_scored", "flagged")})
    return counts.select(
        "detector_name",
        F.when(ran, "complete").otherwise("not_run").alias("status"),
        "threshold",
        "percentile_used",
        "total_scored",
        "flagged",
        F.when(ran, _pct("flagged", "total_scored")).alias("flagged_pct"),
        *["mean", "std", "min", "max", "p50", "p90", "p95", "p99", "p99_5"],
        F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("completed_at"),
    )


def quality_totals(examples: DataFrame, signals: DataFrame, runs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row: total_examples, flagged_any, clean_examples."""
    flagged = flagged_any(signals, runs, settings).count()
    return examples.agg(F.count("*").alias("total_examples")).select("total_examples", F.lit(flagged).cast("long").alias("flagged_any"), (F.col("total_examples") - flagged).alias("clean_examples"))


def experiments(examples: DataFrame, signals: DataFrame, runs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The totals with the share of clean examples in per cent."""
    return quality_totals(examples, signals, runs, settings).withColumn("clean_pct", _pct("clean_examples", "total_examples"))


def detector_stats(signals: DataFrame, runs: DataFrame) -> DataFrame:
    """Signals and flags of each detector's latest started run, complete or not."""
    latest = latest_runs(runs, "started_at").select("detector_name", F.col("id").alias("run_id"), "threshold")
    sums = signals.join(F.broadcast(latest.select("detector_name", "run_id")), ["detector_name", "run_id"], "left_semi").groupBy("detector_name").agg(F.count("*").alias("total"), F.count_if("flagged").alias("flagged"))
    rows = latest.join(sums, "detector_name", "left").fillna(0, ["total", "flagged"])
    return rows.select("detector_name", "run_id", "threshold", "total", "flagged", _pct("flagged", "total").alias("flag_rate"))


def export_flagged(examples: DataFrame, signals: DataFrame) -> DataFrame:
    """dataset_index of the examples that any run flags, complete or not, in order."""
    ids = signals.filter("flagged").select(F.col("example_id").alias("id"))
    return examples.join(ids, "id", "left_semi").select("dataset_index").distinct().orderBy("dataset_index")


def write_flagged(examples: DataFrame, signals: DataFrame, path: str) -> None:
    """The same as JSON lines, in order over the files' names."""
    export_flagged(examples, signals).write.mode("overwrite").json(path)


def write_flagged_array(examples: DataFrame, signals: DataFrame, path: str) -> int:
    """The same as one JSON array in one file, streamed through the driver a partition at a time; returns how many. The file is there once it is whole."""
    spark = examples.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, aside = where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    stream, n = files.create(aside, True), 0
    try:
        stream.write(bytearray(b"["))
        held: list[str] = []
        for row in export_flagged(examples, signals).toLocalIterator():
            held.append(str(row[0]))
            n += 1
            if len(held) == 10_000:
                stream.write(bytearray((", " * (n > 10_000) + ", ".join(held)).encode()))
                held = []
        stream.write(bytearray(((", " if held and n > len(held) else "") + ", ".join(held) + "]").encode()))
    finally:
        stream.close()
    files.delete(where, False)
    if not files.rename(aside, where):
        raise OSError(f"could not move {path}.part into place")
    return n


def metadata_text(signals: DataFrame) -> Column:
    """The metadata as JSON, whether it is a variant or a text."""
    found = F.to_json("metadata") if dict(signals.dtypes)["metadata"] == "variant" else F.col("metadata")
    return F.coalesce(found, F.lit("{}"))


def metadata_number(signals: DataFrame, path: str) -> Column:
    """A number of the metadata by its path; null where there is none."""
    found = F.col("metadata") if dict(signals.dtypes)["metadata"] == "variant" else F.try_parse_json("metadata")
    return F.try_variant_get(found, path, "double")


def flagged_explorer(examples: DataFrame, signals: DataFrame, runs: DataFrame, detector: str, limit: int = 200, between: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Flagged examples of a detector's latest completed run (of signals without a run if it has none), by id.

    ``between`` has paths of metadata and the least and the largest number that they may have.
    """
    latest = latest_runs(runs.filter(F.col("detector_name") == detector)).select("id").first()
    run = F.col("run_id").isNull() if latest is None else F.col("run_id") == latest["id"]
    hits = signals.filter((F.col("detector_name") == detector) & F.col("flagged") & run)
    for path, (least, most) in (between or {}).items():
        hits = hits.filter(metadata_number(signals, path).between(least, most))
    hits = hits.select("example_id", "score", metadata_text(signals).alias("metadata"))
    joined = hits.join(examples, hits["example_id"] == examples["id"])
    return joined.select("example_id", "dataset_index", "prompt", "chosen", "rejected", F.round("score", 4).alias("score"), "metadata").orderBy("example_id").limit(limit)


def detector_names(signals: DataFrame) -> DataFrame:
    return signals.select("detector_name").distinct().orderBy("detector_name")


def example_signals(examples: DataFrame, signals: DataFrame, run_ids: list[int]) -> DataFrame:
    """Each example with its signals in some runs, as an array."""
    mine = signals.filter(F.col("run_id").isin(run_ids)).groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("run_id", "detector_name", "score", "flagged"))).alias("signals"))
    return examples.select("id").join(mine, F.col("id") == F.col("example_id"), "left").select("id", "signals")
