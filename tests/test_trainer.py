import hashlib
import math
import random

import numpy as np
import pytest

from pairsift.operators import reward, trainer
from pairsift.operators.trainer import TrainSettings, rewards, train


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def vector(text, bits):
    words = [w.lower() for w in (text or "").split()]
    found = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    out = np.zeros(1 << bits)
    for f in found:
        out[number(f) % (1 << bits)] += 1 / math.sqrt(len(found))
    return out


def plain(rows, s):
    """Batch by batch with dense vectors."""
    count = -(-len(rows) // s.batch_size)
    w, m, v = (np.zeros(1 << s.bits) for _ in range(3))
    t, history = 0, {"epoch_loss": [], "epoch_accuracy": []}
    for epoch in range(s.epochs):
        batches = {}
        for i, chosen, rejected in rows:
            batches.setdefault(number(f"{s.seed}:{epoch}:{'' if i is None else i}") % count, []).append(vector(chosen, s.bits) - vector(rejected, s.bits))
        losses, won = [], 0
        for b in sorted(batches):
            d = np.array(batches[b])
            gap = d @ w
            losses += list(np.log1p(np.exp(-gap)))
            won += int((gap > 0).sum())
            g = (-d / (1 + np.exp(gap))[:, None]).mean(axis=0)
            t += 1
            m, v = s.beta1 * m + (1 - s.beta1) * g, s.beta2 * v + (1 - s.beta2) * g * g
            w = w * (1 - s.rate * s.decay) - s.rate * (m / (1 - s.beta1**t)) / (np.sqrt(v / (1 - s.beta2**t)) + s.epsilon)
        history["epoch_loss"].append(np.mean(losses))
        history["epoch_accuracy"].append(won / len(losses))
    return w, history


def made(n):
    draw = random.Random(8)
    text = lambda good: " ".join(draw.choice(["Good", "fine", "the", "a", "é"] if good else ["bad", "poor", "the", "a", "of"]) for _ in range(draw.randrange(0, 9)))
    return [(i, text(draw.random() < 0.9), text(draw.random() < 0.1)) for i in range(n)]


SCHEMA = "dataset_index long, chosen string, rejected string"


@pytest.mark.parametrize("s", [TrainSettings(bits=8, epochs=3, batch_size=16, rate=0.05), TrainSettings(bits=10, epochs=1, batch_size=1000, decay=0.5, seed=9)])
def test_equals_a_plain_run(spark, monkeypatch, s):
    monkeypatch.setattr(trainer, "_FILE", 5)
    rows = [*made(90), (None, None, "x y"), (None, "", ""), (3, "Good", None), (3, "Good", None)]
    got = train(spark.createDataFrame(rows, SCHEMA).repartition(3), s)
    weights, history = plain(rows, s)
    assert got.weights == pytest.approx(weights, abs=1e-9)
    assert got.history["epoch_loss"] == pytest.approx(history["epoch_loss"]) and got.history["epoch_accuracy"] == pytest.approx(history["epoch_accuracy"])
    assert (got.final_loss, got.final_accuracy) == (got.history["epoch_loss"][-1], got.history["epoch_accuracy"][-1])
    scored = {r["dataset_index"]: (r["chosen_reward"], r["rejected_reward"]) for r in rewards(spark.createDataFrame(rows[:90], SCHEMA), got).collect()}
    for i, chosen, rejected in rows[4:90]:
        assert scored[i] == pytest.approx((vector(chosen, s.bits) @ weights, vector(rejected, s.bits) @ weights), abs=1e-9)


def test_learns_what_is_preferred(spark):
    rows = made(600)
    model = train(spark.createDataFrame(rows[:400], SCHEMA), TrainSettings(bits=12, epochs=2, batch_size=100, rate=0.05))
    one = reward.evaluated(rewards(spark.createDataFrame(rows[400:], SCHEMA), model)).first()
    assert one["accuracy"] > 0.75 and one["avg_reward_gap"] > 0
    assert model.history["epoch_loss"][1] < model.history["epoch_loss"][0]


def test_no_pairs(spark):
    with pytest.raises(ValueError, match="no pairs"):
        train(spark.createDataFrame([], SCHEMA))


@pytest.mark.parametrize("run", [1, 32])
def test_batches_in_runs_and_alone_equal_a_plain_run(spark, monkeypatch, run):
    monkeypatch.setattr(trainer, "_RUN", run)
    s, rows = TrainSettings(bits=6, epochs=2, batch_size=16, rate=0.05), made(90)
    got = train(spark.createDataFrame(rows, SCHEMA).repartition(3), s)
    weights, history = plain(rows, s)
    assert got.weights == pytest.approx(weights, abs=1e-9)
    assert got.history["epoch_loss"] == pytest.approx(history["epoch_loss"]) and got.history["epoch_accuracy"] == pytest.approx(history["epoch_accuracy"])


def test_small_batches_share_jobs(spark):
    spark.sparkContext.setJobGroup("steps", "")
    try:
        train(spark.createDataFrame(made(200), SCHEMA), TrainSettings(bits=6, batch_size=5))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("steps")) < 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
