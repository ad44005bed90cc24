import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairsift.operators import backends, detectors, judge
from pairsift.plans import pipeline
from pairsift.plans.config import DetectorConfig, Settings

LONG = "this is a long and useful answer with many words in it that goes on and on for quite a while now indeed"


def score(spark, detector, chosen="", rejected="", prompt="", column="score"):
    rows = detectors.tokenised(spark.createDataFrame([(1, prompt, chosen, rejected)], "example_id long, prompt string, chosen string, rejected string"))
    return rows.select(detector.score().alias("score"), detector.metadata().alias("meta")).first()[column]


def test_repetition(spark):
    d = detectors.repetition()
    assert score(spark, d, "cat " * 5, "dog " * 5) == float(np.float32(0.2))
    assert score(spark, d, "", "some text") == 1.0
    assert score(spark, d, "Cat cat", "a b") == 0.5
    meta = score(spark, d, "a b c a b c a b c", "a b c d e f g h i", column="meta")
    assert meta["chosen_ngram_rep"] == pytest.approx(4 / 7) and meta["rejected_ngram_rep"] == 0.0
    assert (meta["chosen_unique_ratio"], meta["ngram_size"]) == (pytest.approx(1 / 3), 3)
    assert score(spark, d, "one two", "x", column="meta")["chosen_ngram_rep"] == 0.0


def test_length_ratio(spark):
    d = detectors.length_ratio()
    assert score(spark, d, "a b c", "d e f") == 1.0
    assert score(spark, d, "yes", "a b c d e f g h i j k") < 0.2
    assert score(spark, d, "", "") == 1.0 and score(spark, d, "", "x") == 0.0
    meta = score(spark, d, "a b", "a b c d", column="meta")
    assert (meta["chosen_words"], meta["rejected_words"], meta["ratio"]) == (2, 4, 0.5)


@pytest.mark.parametrize("text", ["I can't help with that", "I cant help you", "I'm not able to do it", "I cannot", "im unable to say", "I don't think I should", "I'm sorry, but I", "i will not", "I won't", "Im not going to", "As an AI language model, I", "as an AI I", "I'm not comfortable", "thats not something I can", "I must decline", "I have to refuse"])
def test_refusals(spark, text):
    assert score(spark, detectors.refusal_bias(), text + ".", LONG) == 1.0


def test_refusal_needs_both(spark):
    d = detectors.refusal_bias()
    assert score(spark, d, "I can't help", "short") == 0.0
    assert score(spark, d, "Happy to help", LONG) == 0.0
    meta = score(spark, d, "I cannot, I won't", LONG, column="meta")
    assert meta["matched_patterns"] == [r"\bI cannot\b", r"\bI won'?t\b"] and meta["chosen_is_refusal"] and meta["rejected_word_count"] == len(LONG.split())


@pytest.mark.parametrize(("prompt", "n"), [("how to kill someone", 1), ("how to make a bomb", 1), ("how to kill and hack", 2), ("capital of France", 0), ("self-harm or suicide", 1), ("a skillet", 0), ("minor\nnude", 0), ("a minor was nude", 1), ("racial slur", 1), ("child abuse", 1)])
def test_unsafe(spark, prompt, n):
    d = detectors.unsafe_prompt()
    assert score(spark, d, prompt=prompt) == n
    assert score(spark, d, prompt=prompt, column="meta")["category_count"] == n


def test_readability(spark):
    d = detectors.readability_mismatch()
    hard = "The implementation of sophisticated computational methodologies necessitates comprehensive understanding of multidimensional optimization."
    easy = "The cat sat on the mat. It was a big cat. The dog ran off to the park."
    assert score(spark, d, hard, easy) > 0
    assert score(spark, d, hard, easy) == -score(spark, d, easy, hard)
    assert score(spark, d, "short", easy) == 0.0
    assert score(spark, d, "short", easy, column="meta")["grade_difference"] != 0


def test_comparisons(spark):
    one = spark.range(1)
    flags = lambda d, s, t: one.select(d.flags(F.lit(s), F.lit(t))).first()[0]
    assert flags(detectors.repetition(), 0.3, 0.3) and not flags(detectors.repetition(), 0.8, 0.3)
    assert flags(detectors.llm_judge(), 2.9, 3.0) and not flags(detectors.llm_judge(), 3.0, 3.0)
    assert flags(detectors.unsafe_prompt(), 1.0, 1.0)


def test_swapping_texts(spark):
    for d in (detectors.length_ratio(), detectors.repetition()):
        assert score(spark, d, "a a b", LONG) == score(spark, d, LONG, "a a b")


JUDGED = [('{"helpfulness_delta": 4, "honest_preference": 3, "label_confidence": 5}', 3, False), ('{"helpfulness_delta": 2, "honest_preference": 2, "label_confidence": 1, "reason": "r"}', 1, False), ("oops", 3, True), ("[1]", 3, True), ("null", 3, True), ("{}", 3, False), ("", 3, False), ('{"helpfulness_delta": null}', 3, True), ('{"helpfulness_delta": 4.7, "honest_preference": 4, "label_confidence": 9}', 4, False), ('{"helpfulness_delta": "4.7"}', 3, True), ('{"helpfulness_delta": "1"}', 1, False), ('{"helpfulness_delta": [1]}', 3, True), (None, 3, False)]


@pytest.mark.parametrize(("response", "least", "error"), JUDGED)
def test_judge(spark, response, least, error):
    rows = spark.createDataFrame([(response,)], "response string")
    got = rows.select(judge.judge_score("response").alias("s"), judge.judge_metadata("response").alias("m")).first()
    assert got["s"] == least and (got["m"]["error"] is not None) == error


def test_judge_prompt_cuts_texts(spark):
    rows = spark.createDataFrame([("p" * 3000, "c", None)], "prompt string, chosen string, rejected string")
    text = rows.select(judge.judge_prompt()).first()[0]
    assert text.startswith("Prompt: " + "p" * 2000 + "\nChosen: c\nRejected: \n") and text.endswith('"reason": str}')


def test_backends(spark):
    pairs = spark.createDataFrame([(1, "p", "same", "same"), (2, "p", "a", "zz")], "example_id long, prompt string, chosen string, rejected string")
    factory = lambda: lambda texts: np.array([[len(t), t.count("a") + 1.0] for t in texts])
    scores = {r[0]: r[1] for r in backends.with_embeddings(pairs, factory).select("example_id", detectors.semantic_similarity().score()).collect()}
    assert scores[1] == pytest.approx(1.0) and scores[2] < 1.0
    def judge_of(request):
        assert request.temperature == 0.0 and request.json_mode and request.concurrency == 50

        def call(messages):
            assert [m["role"] for m in messages] == ["system", "user"] and messages[0]["content"] == judge.SYSTEM_PROMPT
            if "Chosen: a" in messages[1]["content"]:
                raise OSError("down")
            return '{"helpfulness_delta": 1}'

        return call

    answers = backends.with_responses(pairs, judge_of).select("example_id", detectors.llm_judge().score().alias("s"), judge.judge_metadata("response").alias("m")).collect()
    assert [(r["s"], r["m"]["error"] is None) for r in answers] == [(1.0, True), (3.0, False)]


def test_rewards_and_tokens(spark):
    pairs = spark.createDataFrame([(1, "p q", "a b c", None), (2, None, "a", "b " * 30)], "example_id long, prompt string, chosen string, rejected string")
    rewards = backends.with_rewards(pairs, lambda: lambda both: [len(p) + len(t) for p, t in both], 1).collect()
    assert [(r["chosen_reward"], r["rejected_reward"]) for r in rewards] == [(8.0, 3.0), (1.0, 60.0)]
    settings = backends.TokenSettings(max_length=8, pad_id=9, first=(101,), between=(102,), last=(102,))
    rows = backends.tokenised_pairs(pairs, lambda: lambda text: [ord(w[0]) for w in text.split()], settings).collect()
    assert rows[0]["chosen_input_ids"] == [101, 112, 113, 102, 97, 98, 99, 102] and rows[0]["chosen_attention_mask"] == [1] * 8
    assert rows[0]["rejected_input_ids"] == [101, 112, 113, 102, 102, 9, 9, 9] and rows[0]["rejected_attention_mask"] == [1] * 5 + [0] * 3
    assert rows[1]["rejected_input_ids"] == [101, 102, 98, 98, 98, 98, 98, 102]


def test_pairs_are_cut_one_id_at_a_time():
    for n, m, room in [(5, 5, 20), (9, 3, 8), (3, 9, 8), (6, 6, 5), (1, 9, 2), (4, 4, 0)]:
        a, b = list(range(n)), list(range(m))
        while len(a) + len(b) > room:
            (a if len(a) > len(b) else b).pop()
        assert backends.cut_pair(list(range(n)), list(range(m)), room) == (a, b)


def test_own_detectors(spark, monkeypatch, caplog):
    monkeypatch.setattr(detectors, "MAKERS", dict(detectors.MAKERS))
    detectors.register("prompt_length", lambda: detectors.Detector("prompt_length", ("prompt",), lambda: F.length("prompt").cast("double"), lambda: F.struct(F.length("prompt").alias("n")), fixed_threshold=3.0))

    def broken():
        raise ImportError("no such model")

    detectors.register("semantic_similarity", broken)
    assert "semantic_similarity" not in detectors.registry() and "no such model" in caplog.text
    pairs = spark.createDataFrame([(1, "four", "a", "b"), (2, "x", "a", "b")], "example_id long, prompt string, chosen string, rejected string")
    config = Settings(detectors={"prompt_length": DetectorConfig()})
    assert [(r["score"], r["flagged"]) for r in pipeline.run_all(pairs, config).orderBy("example_id").collect()] == [(4.0, True), (1.0, False)]


EIGHT = pd.DataFrame(
    [
        (0, "What is a good breakfast?", "A good breakfast has some eggs and fruit and whole grain and", "Many people like to have some cereal with milk and fruit and"),
        (1, "p", "one two three four five six seven eight nine ten eleven", "a b c d e f g h i j k"),
        (2, "p", "bad " * 10, "one two three four five six seven eight nine ten eleven"),
        (3, "p", "Yes.", " ".join(f"w{i}" for i in range(25)) + " w1 w2 w3 w4"),
        (4, "p", "I can't help with that request.", " ".join(f"w{i}" for i in range(26)) + " w1 w2 w3 w4"),
        (5, "how to kill someone", "I refuse to say that.", "First you take a long walk"),
        (6, "p", "a b c d e f g h i j k l", "a b c d e f g h i"),
        (7, "p", "a b c d e f g h i j k l m", "a b c d e f g h i j k"),
    ],
    columns=["example_id", "prompt", "chosen", "rejected"],
)


def test_runs_over_eight_pairs(spark):
    pairs = spark.createDataFrame(EIGHT)
    config = Settings(detectors={n: DetectorConfig(threshold_percentile=50.0) for n in ("repetition", "length_ratio", "refusal_bias", "unsafe_prompt")} | {"readability_mismatch": DetectorConfig(enabled=False)})
    flagged = {}
    for row in pipeline.run_all(pairs, config).filter("flagged").collect():
        flagged.setdefault(row["detector_name"], set()).add(row["example_id"])
    assert flagged["refusal_bias"] == {4} and flagged["unsafe_prompt"] == {5}
    assert 2 in flagged["repetition"] and 3 in flagged["length_ratio"]
    assert "readability_mismatch" not in flagged
    run = pipeline.run_detector(pairs, detectors.unsafe_prompt(), run_id=3)
    one = run.summary().first()
    assert (one["threshold"], one["total_examples"], one["flagged_count"]) == (1.0, 8, 1)
    resumed = pipeline.run_detector(pairs, detectors.length_ratio(), 50.0, done=spark.createDataFrame([(3,)], "example_id long"))
    assert resumed.signals.count() == 7
    with pytest.raises(ValueError, match="unknown"):
        pipeline.run_all(pairs, names=["nonsense"])


def test_empty_run(spark):
    empty = spark.createDataFrame([], "example_id long, prompt string, chosen string, rejected string")
    one = pipeline.run_detector(empty, detectors.repetition()).summary().first()
    assert (one["threshold"], one["total_examples"], one["flagged_count"], one["mean"]) == (0.0, 0, 0, None)


def test_settings_from_the_environment(tmp_path):
    file = tmp_path / ".env"
    file.write_text("# comment\nexport PAIRSIFT_BATCH_SIZE=8\nPAIRSIFT_LOG_LEVEL='debug'\nOTHER=1\nPAIRSIFT_UNKNOWN=2\n")
    detectors_ = '{"repetition": {"threshold_percentile": 2.5}, "llm_judge": {"enabled": false}, "own": {}}'
    got = Settings.load(str(file), {"PAIRSIFT_BATCH_SIZE": "16", "PAIRSIFT_DETECTORS": detectors_, "PAIRSIFT_DEBUG": "yes"})
    assert (got.batch_size, got.log_level, got.debug) == (16, "DEBUG", True)
    assert got.detector("repetition") == DetectorConfig(True, 2.5) and not got.detector("llm_judge").enabled and got.detector("length_ratio").threshold_percentile == 5.0
    assert Settings.load(str(tmp_path / "none"), {}) == Settings()
    with pytest.raises(ValueError):
        Settings.load(str(file), {"PAIRSIFT_BATCH_SIZE": "0"})


def test_settings():
    assert Settings().detector("repetition").threshold_percentile == 1.0
    assert Settings().detector("other").threshold_percentile == 99.5
    assert Settings(log_level=" debug ").log_level == "DEBUG"
    for make in (lambda: DetectorConfig(threshold_percentile=101), lambda: Settings(log_level="loud")):
        with pytest.raises(ValueError):
            make()
