import hashlib
import math
import re

import numpy as np
import pytest

from pairsift.operators import embedding
from pairsift.operators.detectors import semantic_similarity
from pairsift.operators.embedding import fit_embedder, own_similarity, with_own_embeddings
from pairsift.plans.pipeline import run_all, run_detector

PARIS = ("Paris is the capital of France.", "The capital city of France is Paris.")
APART = ("The weather is sunny and warm today.", "Quantum computing uses qubits for parallel computation.")
TEXTS = [*PARIS, *APART, "The cat sat on the mat, and the cat slept.", "", None, "!!!", "Ünïcode wörds 42", "the the the", "a_b c-d", "Is it the one?"]


def pairs(spark, rows):
    return spark.createDataFrame([(i, "p", a, b) for i, (a, b) in enumerate(rows)], "example_id long, prompt string, chosen string, rejected string")


def brute(texts):
    """Cosines of all texts, from the definition."""
    bags = []
    for text in texts:
        bag = {}
        for word in re.findall(r"[^\W_]+", (text or "").lower()) or [""]:
            bag[word] = bag.get(word, 0) + 1
        bags.append(bag)
    bits = {w: format(int(hashlib.sha256(w.encode()).hexdigest(), 16), "0256b") for bag in bags for w in bag}
    frequency = {}
    for bag in bags:
        for bucket in {bits[w][:20] for w in bag}:
            frequency[bucket] = frequency.get(bucket, 0) + 1
    vectors = []
    for bag in bags:
        v = np.zeros(256)
        for w, n in bag.items():
            idf = math.floor(1024 * (math.log((1 + len(texts)) / (1 + frequency[bits[w][:20]])) + 1) + 0.5)
            v += math.floor(idf * (1 + math.log(n)) + 0.5) * np.array([1 if b == "1" else -1 for b in bits[w]])
        vectors.append(v / np.linalg.norm(v))
    return np.array(vectors) @ np.array(vectors).T


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding, "_KEPT", 3)
    embedder = fit_embedder(spark.createDataFrame([(t,) for t in TEXTS], "text string"), "text")
    want = brute(TEXTS)
    places = [(i, j) for i in range(len(TEXTS)) for j in range(len(TEXTS))]
    rows = own_similarity(pairs(spark, [(TEXTS[i], TEXTS[j]) for i, j in places]), embedder).orderBy("example_id").collect()
    for (i, j), r in zip(places, rows, strict=True):
        assert r["similarity"] == pytest.approx(want[i, j], abs=1e-12)


def test_alike_reordered_and_unrelated_texts(spark):
    rows = pairs(spark, [PARIS, APART, (PARIS[0], PARIS[0]), ("one two three four", "four three two one"), ("", None), ("", "words")])
    for fitted in (None, fit_embedder(rows.limit(0), "chosen")):
        run = run_detector(with_own_embeddings(rows, fitted), semantic_similarity(), 50.0)
        score = [r["score"] for r in run.signals.orderBy("example_id").collect()]
        assert score[0] > 0.8 and score[1] < 0.5 and min(score[2], score[3], score[4]) > 0.99 and score[5] < 0.5


def test_the_detector_runs_without_recorded_vectors(spark):
    rows = pairs(spark, [PARIS, APART, *[(f"text {i} of many words", f"another {i} with fewer") for i in range(20)]])
    assert "semantic_similarity" not in {r["detector_name"] for r in run_all(rows).collect()}
    got = {r["example_id"]: r["score"] for r in run_all(with_own_embeddings(rows)).collect() if r["detector_name"] == "semantic_similarity"}
    exact = {r["example_id"]: r["similarity"] for r in own_similarity(rows, fit_embedder(rows, "chosen", "rejected")).collect()}
    assert got == {i: pytest.approx(x, abs=1e-6) for i, x in exact.items()}


def test_cosines_keep_those_of_the_bags(spark):
    """By the random projection: the share of common words, within some sixteenths."""
    rng = np.random.default_rng(3)
    rows = []
    for common in range(0, 40, 4):
        words = rng.choice(10_000, 80 - common, replace=False)
        rows.append((" ".join(f"w{w}" for w in words[:40]), " ".join(f"w{w}" for w in words[40 - common :])))
    got = own_similarity(pairs(spark, rows), fit_embedder(pairs(spark, []), "chosen")).orderBy("example_id").collect()
    assert max(abs(r["similarity"] - 4 * i / 40) for i, r in enumerate(got)) < 0.2
