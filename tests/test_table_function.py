import pytest
from pyspark.errors import PySparkException

from pairsift.operators import table_function
from pairsift.operators.detectors import registry
from pairsift.plans.pipeline import run_detector

TEXTS = ["", None, "I can't help with that.", "The cat sat. The cat sat.", "a b c " * 12, "word　and\xa0space", "As an AI, I won't", "Ünï ünï"]
PROMPTS = [None, "how to kill time", "how to hack and torture a model", "make a bomb and money launder", "Paris"]


@pytest.fixture(scope="module")
def pairs(spark):
    table_function.register(spark)
    rows = [(i, PROMPTS[i % 5], TEXTS[i % 8], TEXTS[(i * 3 + i // 8) % 8], 1.0) for i in range(64)]
    frame = spark.createDataFrame(rows, "example_id long, prompt string, chosen string, rejected string, score double").repartition(3)
    frame.createOrReplaceTempView("some_pairs")
    return frame


@pytest.mark.parametrize("name", sorted(table_function.SCORERS))
def test_equals_the_columns(spark, pairs, name):
    detector = registry()[name]
    run = run_detector(pairs, detector, 30.0)
    want = {r["example_id"]: (r["score"], r["flagged"]) for r in run.signals.collect()}
    got = spark.sql(f"SELECT * FROM score_pairs(TABLE(some_pairs), '{name}', {run.threshold!r})")
    assert got.columns == [*pairs.columns, "_score", "flagged"]
    assert {r["example_id"]: (r["_score"], r["flagged"]) for r in got.collect()} == want
    alone = spark.sql(f"SELECT _score, flagged FROM score_pairs(TABLE(SELECT * FROM some_pairs WHERE example_id < 10), '{name}')").collect()
    assert len(alone) == 10 and all((r["flagged"] is None) == (detector.fixed_threshold is None) for r in alone)


def test_arguments_are_checked(spark, pairs):
    for call, said in (
        ("'x', 'repetition'", "relation"),
        ("TABLE(some_pairs), 'other'", "one of"),
        ("TABLE(SELECT chosen FROM some_pairs), 'repetition'", "text column rejected"),
        ("TABLE(SELECT 1 AS prompt), 'unsafe_prompt'", "text column prompt"),
        ("TABLE(some_pairs), 'repetition', 'much'", "number"),
    ):
        with pytest.raises(PySparkException, match=said):
            spark.sql(f"SELECT * FROM score_pairs({call})").collect()
    assert spark.sql("SELECT * FROM score_pairs(TABLE(SELECT prompt FROM some_pairs LIMIT 0), 'unsafe_prompt')").collect() == []
