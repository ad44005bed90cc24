import datetime
import gzip
import json
import os
from contextlib import nullcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsift.operators import reviews, reward
from pairsift.plans import reports
from pairsift.plans.config import DetectorConfig, Settings
from pairsift.sources.ingest import ingest, progress, source_limit
from pairsift.sources.loader import load_pairs
from pairsift.sources.store import Store, duplicate_keys, with_ids
from pairsift.streaming.ingest import raw_stream, start_ingest


def raw(spark, n=10):
    return spark.createDataFrame([(i, f"Human: Question {i}\n\nAssistant: Good answer {i}", f"Human: Question {i}\n\nAssistant: Bad answer {i}") for i in range(n)], "dataset_index long, chosen string, rejected string")


def test_ingest(spark):
    done = ingest(raw(spark))
    assert done.summary.first().asDict() == {"total_processed": 10, "total_inserted": 10, "skipped": 0, "errors": 0}
    row = done.examples.filter("dataset_index = 3").first()
    assert (row["prompt"], row["chosen_last_assistant"], row["rejected_last_assistant"]) == ("Question 3", "Good answer 3", "Bad answer 3")
    assert ingest(raw(spark), resume_from=5).summary.first()["total_inserted"] == 5
    assert ingest(raw(spark), done.examples.filter("dataset_index < 4")).summary.first()["skipped"] == 4
    assert source_limit(raw(spark), 3).count() == 3 and source_limit(raw(spark), 30).count() == 10


def test_ingest_errors_and_nuls(spark):
    rows = raw(spark, 2).unionByName(spark.createDataFrame([(7, None, "x"), (8, "Human: a\0b", "")], "dataset_index long, chosen string, rejected string"))
    done = ingest(rows)
    assert [r["index"] for r in done.errors.collect()] == [7]
    assert done.examples.filter("dataset_index = 8").first()["prompt"] == "ab"
    assert done.summary.first()["errors"] == 1


def test_progress(spark):
    assert tuple(progress(raw(spark, 0)).first()) == (0, -1)
    assert tuple(progress(raw(spark, 4)).first()) == (4, 3)


def test_ids_are_consecutive(spark):
    rows = with_ids(spark.range(0, 997).select((F.col("id") * 7919 % 997).alias("x")), "x", 5).orderBy("x").collect()
    assert [r["id"] for r in rows] == list(range(5, 1002))


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("examples").count() == 0
    store.append("examples", ingest(raw(spark, 4)).examples, "dataset_index")
    store.append("examples", ingest(raw(spark, 6).filter("dataset_index >= 4")).examples, "dataset_index")
    got = store.read("examples")
    assert sorted((r["id"], r["dataset_index"]) for r in got.collect()) == [(i + 1, i) for i in range(6)]
    assert duplicate_keys(got, ["dataset_index"]).count() == 0 and got.filter("created_at IS NULL").count() == 0
    runs = spark.createDataFrame([("repetition", 0.0, 1.0, 0, 0)], "detector_name string, threshold double, percentile_used double, total_examples long, flagged_count long")
    store.append("detector_runs", runs, "detector_name")
    store.update_run(1, threshold=0.25, total_examples=6)
    assert store.read("detector_runs").first()["threshold"] == 0.25
    with pytest.raises(ValueError, match="not found"):
        store.update_run(9, threshold=1.0)
    signals = spark.createDataFrame([(1, 0.5, True, "repetition", 1), (2, 0.7, False, "repetition", 1)], "example_id long, score double, flagged boolean, detector_name string, run_id long")
    store.append("quality_signals", signals, "example_id")
    assert store.read("quality_signals").filter("flagged AND run_id = 1").count() == 1


def history(spark):
    at = datetime.datetime(2026, 1, 1)
    runs = [(1, "a", 0.1, 1.0, at, at), (2, "a", 0.2, 1.0, at, at + datetime.timedelta(1)), (3, "a", 0.3, 1.0, at + datetime.timedelta(2), None), (4, "b", 0.4, 1.0, at, None)]
    frame = spark.createDataFrame(runs, "id long, detector_name string, threshold double, percentile_used double, started_at timestamp_ntz, completed_at timestamp_ntz")
    signals = spark.createDataFrame([(e, r, "a" if r < 4 else "b", e / 10, (e + r) % 3 == 0, None) for e in range(1, 7) for r in range(1, 5)], "example_id long, run_id long, detector_name string, score double, flagged boolean, metadata string")
    return signals, frame, Settings(detectors={"a": DetectorConfig(), "b": DetectorConfig(), "c": DetectorConfig()})


def test_reports(spark):
    signals, runs, settings = history(spark)
    examples = spark.createDataFrame([(i, i - 1, "p", "c", "r") for i in range(1, 8)], "id long, dataset_index long, prompt string, chosen string, rejected string")
    latest = {r["detector_name"]: r["id"] for r in reports.latest_runs(runs).collect()}
    assert latest == {"a": 2} and {r["detector_name"]: r["id"] for r in reports.latest_runs(runs, "started_at").collect()} == {"a": 3, "b": 4}
    flagged = {r[0] for r in reports.flagged_any(signals, runs, settings).collect()}
    clean = {r[0] for r in reports.clean_ids(examples, signals, runs, settings).collect()}
    assert flagged == {1, 4} and clean == {2, 3, 5, 6, 7}
    assert reports.clean_ids(examples, signals, runs, settings, ["a"]).count() == 7
    assert tuple(reports.quality_totals(examples, signals, runs, settings).first()) == (7, 2, 5)
    report = {r["detector_name"]: r for r in reports.quality_report(signals, runs, settings).collect()}
    assert report["a"]["flagged_pct"] == 33.33 and report["b"]["status"] == report["c"]["status"] == "not_run"
    assert reports.clean_ids(examples, signals, runs.limit(0), settings).count() == 7
    assert [r[0] for r in reports.export_flagged(examples, signals).collect()] == [0, 1, 2, 3, 4, 5]
    assert reports.flagged_explorer(examples, signals, runs, "b").count() == 0
    assert reports.flagged_explorer(examples, signals, runs, "a", 1).first()["metadata"] == "{}"
    assert reports.experiments(examples, signals, runs, settings).first()["clean_pct"] == 71.43


def test_reviews(spark):
    at = datetime.datetime(2026, 1, 1)
    log = spark.createDataFrame([(1, "a", "true_positive", at), (1, "a", "false_positive", at + datetime.timedelta(1)), (2, "a", "true_positive", at), (3, "b", "needs_review", at)], "example_id long, detector_name string, label string, updated_at timestamp_ntz")
    now = reviews.upserted(log)
    assert {(r["example_id"], r["label"]) for r in now.collect()} == {(1, "false_positive"), (2, "true_positive"), (3, "needs_review")}
    precision = {r["detector_name"]: (r["total"], r["precision"]) for r in reviews.reviewer_precision(now).collect()}
    assert precision == {"a": (2, 50.0), "b": (1, None)}
    examples = spark.createDataFrame([(1, 0)], "id long, dataset_index long")
    ask = lambda i, label: spark.createDataFrame([(i, "a", label, at)], "dataset_index long, detector_name string, label string, updated_at timestamp_ntz")
    assert reviews.submitted(log, examples, ask(0, "needs_review")).count() == 5
    with pytest.raises(ValueError, match="label"):
        reviews.submitted(log, examples, ask(0, "maybe"))
    with pytest.raises(LookupError):
        reviews.submitted(log, examples, ask(5, "needs_review"))


def test_reward(spark):
    rewards = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (800.0, -800.0), (-800.0, 800.0)], "chosen_reward double, rejected_reward double")
    one = reward.evaluated(rewards).first()
    assert (one["accuracy"], one["correct"], one["total"]) == (0.5, 2, 4)
    assert reward.train_metrics(rewards).first()["loss"] == pytest.approx((0.31326 + 0.69315 + 0 + 1600) / 4, abs=1e-4)
    empty = reward.evaluated(rewards.limit(0)).first()
    assert (empty["accuracy"], empty["total"], empty["avg_reward_gap"]) == (0.0, 0, 0.0)
    pairs = spark.createDataFrame([(i, "p", "word " * (i % 5 + 3), "word " * (i % 3 + 1)) for i in range(40)], "dataset_index long, prompt string, chosen string, rejected string")
    weights = reward.train_linear(pairs).weights
    assert reward.evaluated(reward.linear_rewards(pairs, weights)).first()["accuracy"] > 0.9
    assert reward.training_pairs(pairs.unionByName(spark.createDataFrame([(99, "", "a", "b")], pairs.schema)), pairs.limit(0)).count() == 40


def test_training_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], rng.integers(1, 12))) for _ in range(120)]
    pairs = spark.createDataFrame([(i, "p", texts[2 * i], texts[2 * i + 1]) for i in range(60)], "dataset_index long, prompt string, chosen string, rejected string")
    got = reward.train_linear(pairs, epochs=12)
    feature = lambda t: np.array([np.log1p(len(t.split())), len(set(t.split())) / len(t.split()), np.log1p(len(t))])
    x = np.array([feature(texts[2 * i]) - feature(texts[2 * i + 1]) for i in range(60)])
    scale = np.sqrt((x * x).mean(axis=0))
    w, losses, hits = np.zeros(3), [], []
    for _ in range(12):
        gap = (x / scale) @ w
        losses.append(np.log1p(np.exp(-gap)).mean())
        hits.append((gap > 0).mean())
        w = w + ((x / scale) / (1 + np.exp(gap))[:, None]).mean(axis=0) - 1e-3 * w
    assert got.history["epoch_loss"] == pytest.approx(losses) and got.history["epoch_accuracy"] == pytest.approx(hits)
    assert list(got.weights.values()) == pytest.approx(w / scale) and got.final_loss == pytest.approx(losses[-1])
    assert got.final_loss < losses[0]
    with pytest.raises(ValueError, match="no pairs"):
        reward.train_linear(pairs.limit(0))


def test_transactions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda n: spark.createDataFrame([(i, 0.5, True, "repetition", 1) for i in range(n)], "example_id long, score double, flagged boolean, detector_name string, run_id long")
    store.append("quality_signals", rows(2), "example_id")
    with pytest.raises(OSError), store.transaction():
        store.append("quality_signals", rows(3), "example_id")
        store.insert("reward_models", name="m")
        assert store.read("quality_signals").count() == 5
        raise OSError("stop")
    assert store.read("quality_signals").count() == 2 and not store.exists("reward_models")
    with store.transaction():
        store.append("quality_signals", rows(3), "example_id")
        store.append("quality_signals", rows(1), "example_id")
        store.insert("reward_models", name="m")
    assert sorted(r["id"] for r in store.read("quality_signals").collect()) == list(range(1, 7)) and store.get("reward_models", 1)["name"] == "m"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["quality_signals", "reward_models"]
    store.replace_partitions("quality_signals", rows(1), "example_id")
    assert store.read("quality_signals").count() == 1


class Dies:
    """A file system that lets the driver die at its n-th rename."""

    def __init__(self, files, left):
        self.files, self.left = files, left

    def __getattr__(self, name):
        return getattr(self.files, name)

    def rename(self, source, target):
        self.left[0] -= 1
        if self.left[0] == 0:
            raise KeyboardInterrupt
        return self.files.rename(source, target)


@pytest.mark.parametrize("n", range(1, 7))
def test_a_transaction_is_whole_after_a_crash(spark, tmp_path, monkeypatch, n):
    rows = lambda n: spark.createDataFrame([(i, 0.5, True, "repetition", 1 + i % 2) for i in range(n)], "example_id long, score double, flagged boolean, detector_name string, run_id long")
    store = Store(spark, str(tmp_path))
    store.append("quality_signals", rows(4), "example_id")
    real, left = store._files, [n]
    with pytest.raises(KeyboardInterrupt) if n < 6 else nullcontext(), store.transaction():
        store.append("quality_signals", rows(2).coalesce(1), "example_id")
        store.insert("reward_models", name="m")
        store.insert("evaluations", eval_type="t")
        monkeypatch.setattr(store, "_files", lambda path: (real(path)[0], Dies(real(path)[1], left)))
    again = Store(spark, str(tmp_path))
    counts = (again.read("quality_signals").count(), again.read("reward_models").count(), again.read("evaluations").count())
    # the first rename is that of the intent: before it nothing has come about, after it all
    assert counts == ((4, 0, 0) if n == 1 else (6, 1, 1))
    assert again.recover() == 0 and not [p for p in tmp_path.iterdir() if p.name.startswith(".intent") and not p.name.endswith((".part", ".crc"))]


@pytest.mark.parametrize("n", range(1, 5))
def test_an_overwrite_is_whole_after_a_crash(spark, tmp_path, monkeypatch, n):
    store = Store(spark, str(tmp_path))
    store.insert("reward_models", name="old")
    new = store.read("reward_models").withColumn("name", F.lit("new"))
    real, left = store._files, [n]
    monkeypatch.setattr(store, "_files", lambda path: (real(path)[0], Dies(real(path)[1], left)))
    with pytest.raises(KeyboardInterrupt) if n < 4 else nullcontext():
        store.overwrite("reward_models", new)
    assert [r["name"] for r in Store(spark, str(tmp_path)).read("reward_models").collect()] == ["old" if n == 1 else "new"]


def test_metadata_is_a_variant_read_by_path(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    at = datetime.datetime(2026, 1, 1)
    runs = spark.createDataFrame([(1, "a", 0.5, at, at)], "id long, detector_name string, threshold double, started_at timestamp_ntz, completed_at timestamp_ntz")
    examples = spark.createDataFrame([(i, i - 1, "p", "c", "r") for i in range(1, 6)], "id long, dataset_index long, prompt string, chosen string, rejected string")
    texts = ['{"ratio": 0.25, "of": {"n": 3}}', '{"ratio": 0.5}', '{"ratio": "high"}', None, "no json"]
    rows = spark.createDataFrame([(i + 1, 1.0, True, t, "a", 1) for i, t in enumerate(texts)], "example_id long, score double, flagged boolean, metadata string, detector_name string, run_id long")
    store.append("quality_signals", rows, "example_id")
    held = store.read("quality_signals")
    assert dict(held.dtypes)["metadata"] == "variant"
    for signals in (held, rows):
        found = reports.flagged_explorer(examples, signals, runs, "a", between={"$.ratio": (0.2, 0.3)}).collect()
        assert [(r["example_id"], json.loads(r["metadata"])) for r in found] == [(1, json.loads(texts[0]))]
        assert [r["example_id"] for r in reports.flagged_explorer(examples, signals, runs, "a", between={"$.of.n": (3, 3)}).collect()] == [1]
    assert {r["example_id"]: r["metadata"] for r in reports.flagged_explorer(examples, held, runs, "a").collect()}[4] == "{}"


def test_small_sources_are_dealt_and_large_ones_are_not(spark, monkeypatch):
    from pairsift.sources import inputs

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data here")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = lambda: inputs.dealt(docs, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan()
    monkeypatch.setattr(inputs, "ENOUGH_BYTES", 1)
    assert "Repartition" not in plan()


def test_a_failed_overwrite_puts_the_table_back(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.insert("reward_models", name="m")
    real = store._files

    class Stuck:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def rename(self, source, target):
            return False if "-old-" not in source.toString() and target.toString().endswith("/reward_models") else self.files.rename(source, target)

    monkeypatch.setattr(store, "_files", lambda path: (real(path)[0], Stuck(real(path)[1])))
    with pytest.raises(OSError):
        store.overwrite("reward_models", store.read("reward_models").limit(0))
    assert store.read("reward_models").count() == 1


def test_loader(spark, tmp_path):
    (tmp_path / "train").mkdir()
    lines = [json.dumps({"chosen": f"c{i}", "rejected": f"r{i}", "more": 1}) for i in range(30)]
    (tmp_path / "train" / "b.jsonl").write_text("\n".join(lines[20:]))
    with gzip.open(tmp_path / "train" / "a.jsonl.gz", "wt") as f:
        f.write("\n".join([*lines[:19], "no object"]))
    (tmp_path / "test.jsonl").write_text(lines[0])
    got = load_pairs(spark, str(tmp_path)).orderBy("dataset_index").collect()
    assert [(r["dataset_index"], r["chosen"], r["rejected"]) for r in got] == [(i, *((f"c{i}", f"r{i}") if i != 19 else (None, None))) for i in range(30)]
    assert load_pairs(spark, str(tmp_path), "test").count() == 1
    spark.createDataFrame([("c", "r")], "chosen string, rejected string").write.parquet(str(tmp_path / "valid"))
    assert load_pairs(spark, str(tmp_path), "valid", "parquet").first()["dataset_index"] == 0
    assert ingest(load_pairs(spark, str(tmp_path))).summary.first()["errors"] == 1
    with pytest.raises(LookupError):
        load_pairs(spark, str(tmp_path), "other")
    with pytest.raises(ValueError):
        load_pairs(spark, str(tmp_path), form="xml")


def test_flagged_as_one_array(spark, tmp_path):
    examples = spark.range(25_000).select((F.col("id") + 1).alias("id"), F.col("id").alias("dataset_index"))
    signals = examples.select(F.col("id").alias("example_id"), F.lit(True).alias("flagged"))
    for n in (0, 1, 10_000, 20_000, 25_000):
        path = tmp_path / f"{n}.json"
        assert reports.write_flagged_array(examples, signals.filter(F.col("example_id") <= n), str(path)) == n
        assert json.loads(path.read_text()) == list(range(n))


def test_streaming_errors_and_repeats(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("raw", "out", "mark"))
    rows = raw(spark, 4).unionByName(spark.createDataFrame([(9, None, "x")], "dataset_index long, chosen string, rejected string"))
    rows.coalesce(1).write.parquet(source)
    start_ingest(raw_stream(spark, source, 1), out, mark).awaitTermination()
    raw(spark, 6).coalesce(1).write.mode("append").parquet(source)
    start_ingest(raw_stream(spark, source, 1), out, mark).awaitTermination()
    assert sorted(r["dataset_index"] for r in spark.read.parquet(f"{out}/examples").collect()) == [0, 1, 2, 3, 4, 5]
    assert [r["index"] for r in spark.read.parquet(f"{out}/errors").collect()] == [9]


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "raw")
    raw(spark, 6).repartition(3).write.parquet(source)
    start_ingest(raw_stream(spark, source, 1), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    raw(spark, 9).filter("dataset_index >= 6").write.mode("append").parquet(source)
    start_ingest(raw_stream(spark, source, 1), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "examples")).select("dataset_index").distinct().count() == 9
    signals = spark.read.parquet(str(tmp_path / "out" / "signals"))
    assert signals.count() == 9 * 5 and signals.filter("detector_name = 'length_ratio' AND flagged IS NOT NULL").count() == 9
