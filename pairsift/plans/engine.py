"""The engine over a store: ingest, score, report, review. Errors are ValueError (bad request) and LookupError (no such row)."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import PERCENTILES, grouped_stats
from ..operators import reviews
from ..operators.detectors import registry
from ..sources.ingest import ingest, progress, source_limit
from ..sources.store import Store
from . import pipeline, reports
from .config import Settings


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class Engine:
    """All operations of the preference-pair engine over the six tables of a store."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None) -> None:
        self.spark, self.store, self.settings = spark, Store(spark, root), settings or Settings()

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    def ingest(self, raw: DataFrame, limit: int | None = None, resume_from: int = 0) -> dict[str, int]:
        """Store the examples of (dataset_index, chosen, rejected) that are not there yet; returns the summary."""
        rows = raw if limit is None else source_limit(raw, limit)
        known = self.store.read("examples").select("dataset_index")
        done = ingest(rows, known, resume_from)
        summary = done.summary.first().asDict()
        if summary["total_inserted"]:
            self.store.append("examples", done.examples, "dataset_index")
        return summary

    def progress(self) -> dict[str, int]:
        return progress(self.store.read("examples")).first().asDict()

    def pairs(self) -> DataFrame:
        """The stored examples as pairs to score."""
        rows = self.store.read("examples")
        return rows.select(F.col("id").alias("example_id"), "prompt", F.col("chosen_last_assistant").alias("chosen"), F.col("rejected_last_assistant").alias("rejected"))

    def score(self, names: list[str] | None = None, pairs: DataFrame | None = None, resume: bool = False) -> DataFrame:
        """Run detectors (all enabled ones, or some by name) over the pairs, store signals and runs, and return the report.

        ``pairs`` may bring columns for the detectors of models (see operators.backends). ``resume`` leaves out examples
        that a completed run of the detector has a signal for.

        A run's row is there before its signals and is completed after them. If a call fails in between, the next one
        takes the open runs up: their signals are written again in place of what may be there.
        """
        names = None if names in (None, ["all"]) else names
        unknown = set(names or ()) - set(registry())
        if unknown:
            raise ValueError(f"unknown detectors: {', '.join(sorted(unknown))}")
        pairs = self.pairs() if pairs is None else pairs
        detectors = pipeline.usable(pairs, self.settings, names)
        if detectors:
            ids = self._begun(list(detectors))
            done = self._done(ids) if resume else None
            with pipeline.scored(pairs, detectors, self.settings, ids, done) as (thresholds, signals):
                self.store.replace_partitions("quality_signals", signals, "example_id")
            self._completed(detectors, ids, thresholds)
        return self.report()

    def _begun(self, names: list[str]) -> dict[str, int]:
        """The ids of the detectors' open runs; those without one get a row first."""

        def open_runs() -> dict[str, int]:
            rows = self.store.read("detector_runs").filter(F.col("completed_at").isNull() & F.col("detector_name").isin(names))
            return {r["detector_name"]: r["id"] for r in rows.groupBy("detector_name").agg(F.max("id").alias("id")).collect()}

        missing = [n for n in names if n not in open_runs()]
        if missing:
            rows = [(n, 0.0, self.settings.detector(n).threshold_percentile, 0, 0, "{}", _now()) for n in missing]
            kinds = "detector_name string, threshold double, percentile_used double, total_examples long, flagged_count long, stats string, started_at timestamp_ntz"
            self.store.append("detector_runs", self.spark.createDataFrame(rows, kinds), "detector_name")
        return open_runs()

    def _done(self, ids: dict[str, int]) -> DataFrame:
        """example_id and the detectors that completed runs have scored it with."""
        complete = self.store.read("detector_runs").filter(F.col("completed_at").isNotNull() & F.col("detector_name").isin(list(ids))).select("detector_name", F.col("id").alias("run_id"))
        signals = self.store.read("quality_signals").join(F.broadcast(complete), ["detector_name", "run_id"], "left_semi")
        return signals.groupBy("example_id").agg(F.collect_set("detector_name").alias("done"))

    def _completed(self, detectors: dict, ids: dict[str, int], thresholds: dict[str, float]) -> None:
        """Write counts, thresholds and statistics into the runs' rows."""
        mine = self.spark.createDataFrame(list(ids.items()), "detector_name string, run_id long")
        signals = self.store.read("quality_signals").join(F.broadcast(mine), ["detector_name", "run_id"], "left_semi")
        found = {r["detector_name"]: r for r in grouped_stats(signals, "score", "detector_name", F.count("*").alias("n"), F.count_if("flagged").alias("flagged")).collect()}
        rows, now = [], _now()
        for name in detectors:
            r = found.get(name)
            stats = json.dumps({k: r[k] for k in ("mean", "std", "min", "max", *PERCENTILES)}) if r else "{}"
            rows.append((ids[name], thresholds[name], self.settings.detector(name).threshold_percentile, r["n"] if r else 0, r["flagged"] if r else 0, stats, now))
        new = self.spark.createDataFrame(rows, "id long, n_threshold double, n_percentile_used double, n_total_examples long, n_flagged_count long, n_stats string, n_completed_at timestamp_ntz")
        runs = self.store.read("detector_runs")
        changed = ("threshold", "percentile_used", "total_examples", "flagged_count", "stats", "completed_at")
        joined = runs.join(F.broadcast(new), "id", "left")
        self.store.overwrite("detector_runs", joined.select(*[F.coalesce(f"n_{c}", c).alias(c) if c in changed else F.col(c) for c in runs.columns]))

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        runs = self.store.read("detector_runs").select("id", "detector_name", "threshold", "percentile_used", "total_examples", "started_at", "completed_at")
        return self.store.read("quality_signals"), runs

    def report(self) -> DataFrame:
        return reports.quality_report(*self._tables(), self.settings)

    def experiments(self) -> dict:
        return reports.experiments(self.store.read("examples"), *self._tables(), self.settings).first().asDict()

    def clean_ids(self, exclude: list[str] = []) -> DataFrame:
        return reports.clean_ids(self.store.read("examples"), *self._tables(), self.settings, exclude)

    def export_flagged(self, path: str) -> None:
        reports.write_flagged(self.store.read("examples"), self.store.read("quality_signals"), path)

    def review(self, dataset_index: int, detector: str, label: str) -> None:
        """Add or change the review of an example for a detector."""
        log = self.store.read("reviews").select("example_id", "detector_name", "label", "updated_at")
        request = self.spark.createDataFrame([(dataset_index, detector, label, _now())], "dataset_index long, detector_name string, label string, updated_at timestamp_ntz")
        reviews.submitted(log, self.store.read("examples"), request)  # raises for a bad label or index
        known = request.join(self.store.read("examples").select(F.col("id").alias("example_id"), "dataset_index"), "dataset_index")
        self.store.append("reviews", known.drop("dataset_index"), "example_id")

    def record_model(self, name: str, dataset_filter: str, training_config: dict, metrics: dict, model_path: str | None = None) -> int:
        """Store a trained reward model's record; returns its id."""
        return self.store.insert("reward_models", name=name, dataset_filter=dataset_filter, training_config=json.dumps(training_config), metrics=json.dumps(metrics), model_path=model_path)

    def reward_model(self, model_id: int) -> dict | None:
        found = self.store.get("reward_models", model_id)
        return found and {**found, "training_config": json.loads(found["training_config"]), "metrics": json.loads(found["metrics"])}

    def record_evaluation(self, model_id: int, eval_type: str, results: dict) -> int:
        """Store an evaluation of a reward model; LookupError if there is no such model."""
        if self.store.get("reward_models", model_id) is None:
            raise LookupError(f"no reward model has id {model_id}")
        return self.store.insert("evaluations", reward_model_id=model_id, eval_type=eval_type, results=json.dumps(results))

    def evaluations(self, model_id: int) -> DataFrame:
        return self.store.read("evaluations").filter(F.col("reward_model_id") == model_id)

    def reviews(self) -> DataFrame:
        return reviews.upserted(self.store.read("reviews").select("example_id", "detector_name", "label", "updated_at"))

    def review_stats(self) -> DataFrame:
        return reviews.reviewer_precision(self.reviews())
