import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsift.operators.detectors import registry
from pairsift.plans.config import DetectorConfig, Settings
from pairsift.plans.pipeline import run_all
from pairsift.sources.ingest import ingest
from pairsift.streaming import ingest as streams
from pairsift.streaming.ingest import RAW, raw_stream, settled, start_ingest
from pairsift.streaming.sketches import bounds, merged, rank_error, sketched


def pair(i, mark=""):
    draw = random.Random(i)
    text = lambda: " ".join(draw.choice("a b c d e f g h".split()) for _ in range(draw.randrange(1, 40)))
    return i, f"Human: q{i}\n\nAssistant: {text()}{mark}", f"Human: q{i}\n\nAssistant: {text()}"


class Stream:
    def __init__(self, spark, root, **more):
        self.spark, self.root, self.more = spark, root, more
        self.out = f"{root}/out"

    def feed(self, *files):
        """Each file is a list of rows, and a batch of its own."""
        for rows in files:
            self.spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(f"{self.root}/raw")
        self.query = start_ingest(raw_stream(self.spark, f"{self.root}/raw", 1), self.out, f"{self.root}/mark", **self.more)
        self.query.awaitTermination()

    def read(self, name):
        return self.spark.read.parquet(f"{self.out}/{name}")


def test_late_and_repeated_indices(spark, tmp_path):
    stream = Stream(spark, str(tmp_path))
    stream.feed([pair(i) for i in range(0, 40)], [pair(i, " again") for i in range(30, 60)])
    # late ones, repeats of either batch, a far block, and two rows of one index
    stream.feed([pair(i, " again") for i in range(20, 50)] + [pair(70), pair(100_000), pair(71, " z"), pair(71, " b"), (None, "x", "y"), (72, None, "y"), (72, "x", None)])
    stream.feed([pair(100_000, " again"), pair(72), pair(61)])
    got = {r["dataset_index"]: r["chosen_full"] for r in stream.read("examples").collect()}
    want = {i: pair(i, " again" if 40 <= i < 60 else "")[1] for i in [*range(60), 70, 100_000, 61]} | {71: pair(71, " b")[1]}
    assert got == want and stream.read("examples").count() == len(want)
    assert sorted((str(r["index"]), r["error"]) for r in stream.read("errors").collect()) == [("72", "text is null"), ("None", "index is null")]


def test_no_batch_reads_what_others_have_stored(spark, tmp_path):
    stream = Stream(spark, str(tmp_path))
    stream.feed(*[[pair(i) for i in range(20 * k, 20 * k + 20)] for k in range(5)])
    for name in ("examples", "errors", "signals", "raw"):
        shutil.rmtree(f"{stream.out if name != 'raw' else stream.root}/{name}")
    assert len([p for p in (tmp_path / "out" / "sketches").iterdir() if p.name.startswith("batch=")]) == streams.KEPT
    stream.feed([pair(i) for i in range(90, 110)])
    assert sorted(r[0] for r in stream.read("examples").select("dataset_index").collect()) == list(range(100, 110))
    # the sketches have seen all 110
    last = spark.read.parquet(f"{stream.out}/sketches/batch=5")
    assert {r[0] for r in last.select(F.kll_sketch_get_n_double("sketch")).collect()} == {110}
    assert stream.query.lastProgress is None or all(x["numRowsUpdated"] <= 1 for x in stream.query.recentProgress[-1]["stateOperators"])


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    """The last batch's commit is lost, as if the driver had died before it: the batch runs again."""
    stream = Stream(spark, str(tmp_path))
    stream.feed([pair(i) for i in range(10)], [pair(i) for i in range(5, 20)])
    before = sorted(map(str, stream.read("signals").collect()))
    for path in (tmp_path / "mark" / "commits").glob("*1*"):
        path.unlink()
    stream.feed()
    assert sorted(map(str, stream.read("signals").collect())) == before
    assert {r[0] for r in spark.read.parquet(f"{stream.out}/sketches/batch=1").select(F.kll_sketch_get_n_double("sketch")).collect()} == {20}


@pytest.mark.parametrize("k", [8, 8192])
def test_flags_agree_with_batch_outside_the_error(spark, tmp_path, k):
    settings = Settings(detectors={**Settings().detectors, "repetition": DetectorConfig(threshold_percentile=30.0), "length_ratio": DetectorConfig(threshold_percentile=60.0)})
    rows = [pair(i) for i in range(300)]
    random.Random(1).shuffle(rows)
    stream = Stream(spark, str(tmp_path), settings=settings, k=k)
    stream.feed(rows[:100], rows[60:200], rows[200:])
    done = ingest(spark.createDataFrame(rows, RAW)).examples
    pairs = done.select(F.col("dataset_index").alias("example_id"), "prompt", F.col("chosen_last_assistant").alias("chosen"), F.col("rejected_last_assistant").alias("rejected"))
    want = {(r["example_id"], r["detector_name"]): (r["score"], r["flagged"]) for r in run_all(pairs, settings).collect()}
    got = settled(spark, stream.out, settings, k).collect()
    assert len(got) == len(want) == 5 * 300
    for r in got:
        score, flagged = want[r["dataset_index"], r["detector_name"]]
        assert r["score"] == score
        if r["certain"]:
            assert r["flagged"] == flagged, r
    unsure = {n: sum(not r["certain"] for r in got if r["detector_name"] == n) for n in registry()}
    assert unsure["refusal_bias"] == unsure["unsafe_prompt"] == 0
    if k == 8192:
        assert max(unsure.values()) <= 300 * 0.05
    arrived = {(r["dataset_index"], r["detector_name"]): r["flagged"] for r in stream.read("signals").collect()}
    assert len(arrived) == 5 * 300 and None not in arrived.values()


def test_merged_sketches_keep_their_error(spark):
    k = 200
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 20_000), rng.exponential(5, 20_000)])
    parts = np.array_split(rng.permutation(values), 7)
    every = None
    for part in parts:
        one = sketched(spark.createDataFrame([(float(x),) for x in part], "length_ratio double"), ["length_ratio"], k)
        every = one if every is None else merged(every.unionByName(one), k)
    for p in (1.0, 37.0, 50.0, 99.5):
        row = bounds(every, {"length_ratio": p}, k)["length_ratio"]
        assert row["seen"] == len(values)
        rank = np.searchsorted(np.sort(values), row["threshold"]) / len(values)
        assert abs(rank - p / 100) <= 2 * rank_error(k)
        assert row["low"] <= np.percentile(values, p) <= row["high"]
    assert rank_error(8192) < 0.001


def test_a_stream_without_usable_rows(spark, tmp_path):
    stream = Stream(spark, str(tmp_path))
    stream.feed([(1, None, None)])
    assert settled(spark, stream.out).count() == 0 and stream.read("errors").count() == 1
    stream.feed([pair(3)])
    assert settled(spark, stream.out).filter("detector_name = 'length_ratio' AND flagged").count() == 1
