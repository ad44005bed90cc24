import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairsift.functions import stats


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_score_stats(spark):
    one = stats.score_stats(frame(spark, [1, 2, 3, 4, 5]), "x").first()
    assert (one["mean"], one["min"], one["max"], one["p50"]) == (3.0, 1.0, 5.0, 3.0)
    assert one["std"] == pytest.approx(np.std([1, 2, 3, 4, 5]))
    assert stats.score_stats(frame(spark, [42]), "x").first()["std"] == 0
    with pytest.raises(ValueError, match="empty"):
        stats.score_stats(frame(spark, []), "x")


def test_percentile_bounds(spark):
    values = frame(spark, range(101))
    assert stats.exact_percentiles(values, "x", [0, 37, 100]) == [0.0, 37.0, 100.0]
    for p in (101, -1):
        with pytest.raises(ValueError, match="between 0 and 100"):
            stats.exact_percentiles(values, "x", [p])
    with pytest.raises(ValueError, match="empty"):
        stats.exact_percentiles(frame(spark, []), "x", [50])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, width=32), min_size=1, max_size=60), st.lists(st.floats(0, 100), min_size=1, max_size=3))
def test_percentiles_equal_numpy(spark, values, percentiles):
    assert stats.exact_percentiles(frame(spark, values), "x", percentiles) == [float(np.percentile(values, p)) for p in percentiles]


def test_percentiles_narrow_down(spark, monkeypatch):
    monkeypatch.setattr(stats, "ENOUGH", 3)
    rng = np.random.default_rng(1)
    values = np.round(np.concatenate([rng.exponential(1e-6, 400), rng.normal(1e5, 1, 50)]), 9)
    wanted = [0, 1, 50, 88.8, 90, 99.5, 100]
    assert stats.exact_percentiles(frame(spark, values), "x", wanted) == [float(np.percentile(values, p)) for p in wanted]


def test_cliff(spark):
    p, value, jump = stats.threshold_cliff(frame(spark, [0] * 999 + [100]), "x")
    assert jump > 0 and value > 0 and p == 99.9
    assert stats.threshold_cliff(frame(spark, [7] * 10), "x") == (95.0, 7.0, 0.0)
    with pytest.raises(ValueError, match="at least 2"):
        stats.threshold_cliff(frame(spark, [1]), "x", [50])
    with pytest.raises(ValueError, match="empty"):
        stats.threshold_cliff(frame(spark, []), "x")


def test_compare(spark):
    same = stats.compare_distributions(frame(spark, range(100)), frame(spark, range(100)), "x").first()
    assert (same["ks_statistic"], same["mean_diff"], same["n_a"]) == (0, 0, 100)
    apart = stats.compare_distributions(frame(spark, [0] * 100), frame(spark, [1] * 100), "x").first()
    assert (apart["ks_statistic"], apart["mean_diff"]) == (1, -1)
    with pytest.raises(ValueError, match="empty"):
        stats.compare_distributions(frame(spark, []), frame(spark, [1]), "x")


def test_compare_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, 300).round(2), rng.normal(0.4, 2, 200).round(2)
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)
    assert stats.compare_distributions(frame(spark, a), frame(spark, b), "x").first()["ks_statistic"] == pytest.approx(want, abs=1e-12)


def test_exact_p_values_equal_all_orders():
    """Every order of the two samples' values is as likely: count those that are as far apart."""
    for n_a, n_b in ((1, 1), (1, 8), (2, 3), (5, 5), (4, 7), (6, 6)):
        reached = []
        for places in itertools.combinations(range(n_a + n_b), n_a):
            a, far = 0, 0
            for k in range(n_a + n_b):
                a += k in places
                far = max(far, abs(a * n_b - (k + 1 - a) * n_a))
            reached.append(far)
        for far in {*reached, 0}:
            want = sum(x >= far for x in reached) / math.comb(n_a + n_b, n_a)
            assert stats.exact_ks_p_value(far / (n_a * n_b), n_a, n_b) == pytest.approx(want, abs=1e-12)


# Of two samples of n values each, 2 * (C(2n, n - k) - C(2n, n - 2k) + ...) / C(2n, n) for a statistic of k / n.
@pytest.mark.parametrize(
    ("n", "k", "p"),
    [(3, 3, 0.1), (4, 3, 0.228571429), (5, 4, 0.079365079), (8, 5, 0.087024087), (10, 6, 0.052447552), (10, 7, 0.012340601), (12, 12, 0.00000074), (15, 8, 0.026248486), (18, 6, 0.275418463), (19, 9, 0.02674948)],
)
def test_exact_p_values_of_equal_sizes(n, k, p):
    closed = 2 * sum((-1) ** (i - 1) * math.comb(2 * n, n - i * k) for i in range(1, n // k + 1)) / math.comb(2 * n, n)
    assert stats.exact_ks_p_value(k / n, n, n) == pytest.approx(closed, rel=1e-12)
    assert stats.ks_p_value(k / n, n, n) == pytest.approx(p, abs=5e-10)


def test_p_values_beyond_the_exact_ones(monkeypatch):
    assert stats.ks_p_value(0.0, 100, 100) == 1.0
    assert 0 < stats.ks_p_value(1.0, 100, 100) < 1e-50
    assert stats.ks_p_value(0.136, 200, 200) == pytest.approx(0.05, abs=0.01)
    for statistic, n_a, n_b in ((0.05, 2000, 1500), (0.03, 4000, 4000), (0.1, 700, 300)):
        assert stats.asymptotic_ks_p_value(statistic, n_a, n_b) == pytest.approx(stats.exact_ks_p_value(statistic, n_a, n_b), rel=0.06)
    monkeypatch.setattr(stats, "EXACT", 10)
    assert stats.ks_p_value(0.2, 50, 40) == stats.asymptotic_ks_p_value(0.2, 50, 40)


def test_drift_has_a_small_p_value(spark):
    drift = stats.compare_distributions(frame(spark, range(100)), frame(spark, [x + 40 for x in range(100)]), "x").first()
    assert drift["p_value"] == pytest.approx(stats.exact_ks_p_value(0.4, 100, 100)) and drift["p_value"] < 1e-6


def test_grouped_stats_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(stats, "ENOUGH", 3)
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(0, 1, 500).round(3), "b": np.concatenate([rng.exponential(1e-7, 300), [1e9]]), "c": np.array([2.0]), None: rng.integers(0, 4, 200) / 4}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("a", None), ("d", None)]
    got = {r["k"]: r for r in stats.grouped_stats(spark.createDataFrame(rows, "k string, x double"), "x", "k", F.count("*").alias("rows")).collect()}
    assert got["d"]["mean"] is got["d"]["p50"] is None and got["a"]["rows"] == 501
    for k, values in groups.items():
        assert got[k]["std"] == pytest.approx(np.std(values), rel=1e-9, abs=1e-12)
        assert [got[k][name] for name in stats.PERCENTILES] == [float(np.percentile(values, p)) for p in stats.PERCENTILES.values()]


def test_ngrams_equal_brute_force(spark):
    from pairsift.functions.text import ngram_repetition, word_hashes

    texts = ["", "a", "a b", "a b a b a b", "x " * 40, "a b c d e f g a b c d"]
    rows = spark.createDataFrame([(t.split(),) for t in texts], "w array<string>").withColumn("h", word_hashes(F.col("w")))
    got = rows.select(*[ngram_repetition(F.col("h"), n) for n in (1, 2, 4)]).collect()
    for text, row in zip(texts, got, strict=True):
        words = text.split()
        for n, rate in zip((1, 2, 4), row, strict=True):
            grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            assert rate == pytest.approx((len(grams) - len(set(grams))) / len(grams) if grams else 0.0)
