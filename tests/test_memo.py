import json
import time

import pytest
from pyspark.sql import functions as F

from pairsift.operators.backends import JudgeRequest
from pairsift.operators.detectors import llm_judge
from pairsift.operators.memo import Asking, request_key, stored_answers, with_kept_responses
from pairsift.plans.pipeline import run_detector

FAST = Asking(attempts=3, first_wait=0.001)


def pairs(spark, rows):
    return spark.createDataFrame([(i, p, c, r) for i, (p, c, r) in enumerate(rows)], "example_id long, prompt string, chosen string, rejected string")


class Backend:
    """Answers with a score made of the message; each call leaves a line in a file, and some fail."""

    def __init__(self, log, fails=0, broken=""):
        self.log, self.fails, self.broken = str(log), fails, broken

    def calls(self):
        try:
            return [json.loads(x) for x in open(self.log)]
        except FileNotFoundError:
            return []

    def __call__(self, request):
        log, fails, broken, seen = self.log, self.fails, self.broken, {}

        def answer(messages):
            text = messages[1]["content"]
            seen[text] = seen.get(text, 0) + 1
            with open(log, "a") as f:
                f.write(json.dumps([text, time.time(), request.model]) + "\n")
            if broken and broken in text or seen[text] <= fails:
                raise OSError("no answer")
            return json.dumps({"helpfulness_delta": len(text) % 5 + 1, "honest_preference": 4, "label_confidence": 4})

        return answer


ROWS = [("p", "a", "b"), ("p", "aa", "b"), ("p", "a", "b"), (None, "a", "b"), ("", "a", "b"), ("p", "a", "b")]


def test_one_call_a_request_and_none_in_a_second_run(spark, tmp_path):
    backend, folder = Backend(tmp_path / "log", fails=1), str(tmp_path / "answers")
    first = with_kept_responses(pairs(spark, ROWS), backend, folder, asking=FAST).orderBy("example_id").collect()
    # three requests, each of which failed once
    assert len(backend.calls()) == 6 and len({c[0] for c in backend.calls()}) == 3
    again = with_kept_responses(pairs(spark, ROWS[::-1] + [("p", "new", "b")]), backend, folder, asking=FAST).collect()
    assert len(backend.calls()) == 8 and stored_answers(pairs(spark, []), folder).count() == 4
    assert first[0]["response"] == first[2]["response"] == first[5]["response"] and first[3]["response"] == first[4]["response"]
    assert {r["chosen"]: r["response"] for r in again if r["prompt"] == "p"} | {"a": first[0]["response"], "aa": first[1]["response"]} == {r["chosen"]: r["response"] for r in again if r["prompt"] == "p"}
    run = run_detector(with_kept_responses(pairs(spark, ROWS), backend, folder), llm_judge())
    assert len(backend.calls()) == 8 and {r["score"] for r in run.signals.collect()} <= {1.0, 2.0, 3.0, 4.0}


def test_other_requests_are_other_keys(spark, tmp_path):
    backend, folder = Backend(tmp_path / "log"), str(tmp_path / "answers")
    for request in (JudgeRequest(), JudgeRequest(model="other"), JudgeRequest(temperature=0.5), JudgeRequest()):
        with_kept_responses(pairs(spark, ROWS[:1]), backend, folder, request).collect()
    assert [c[2] for c in backend.calls()] == ["gpt-4o-mini", "other", "gpt-4o-mini"]
    keys = spark.createDataFrame([("a",), ("b",), ("a",)], "m string").select(request_key(F.col("m"))).collect()
    assert keys[0] == keys[2] != keys[1]


def test_failing_calls_are_errors_and_asked_again(spark, tmp_path):
    folder = str(tmp_path / "answers")
    broken = Backend(tmp_path / "one", broken="Chosen: aa")
    got = with_kept_responses(pairs(spark, ROWS), broken, folder, asking=FAST).orderBy("example_id").collect()
    assert [r["response"] == "null" for r in got] == [False, True, False, False, False, False]
    assert sum("Chosen: aa" in c[0] for c in broken.calls()) == 3
    run = run_detector(with_kept_responses(pairs(spark, ROWS), broken, folder, asking=FAST), llm_judge()).signals.orderBy("example_id").collect()
    assert (run[1]["score"], run[1]["metadata"].toPython()["error"]) == (3.0, "response is not a verdict")
    whole = Backend(tmp_path / "two")
    assert all(r["response"] != "null" for r in with_kept_responses(pairs(spark, ROWS), whole, folder, asking=FAST).collect())
    assert len(whole.calls()) == 1


def test_a_run_that_stops_goes_on_behind_its_portions(spark, tmp_path, monkeypatch):
    from pairsift.operators import memo

    folder, backend = str(tmp_path / "answers"), Backend(tmp_path / "log")
    rows = pairs(spark, [("p", f"text {i}", "b") for i in range(60)])
    real, portions = memo._asked, []

    def asked(*args):
        portions.append(1)
        if len(portions) == 3:
            raise OSError("the driver stops")
        return real(*args)

    monkeypatch.setattr(memo, "_asked", asked)
    with pytest.raises(OSError):
        with_kept_responses(rows, backend, folder, asking=Asking(portion=15))
    done = stored_answers(rows, folder).count()
    assert 0 < done == len(backend.calls()) < 60
    monkeypatch.setattr(memo, "_asked", real)
    assert with_kept_responses(rows, backend, folder, asking=Asking(portion=15)).filter("response = 'null'").count() == 0
    assert len(backend.calls()) == 60


def test_calls_keep_their_distance(spark, tmp_path):
    backend = Backend(tmp_path / "log")
    rows = pairs(spark, [("p", f"text {i}", "b") for i in range(24)])
    with_kept_responses(rows, backend, str(tmp_path / "answers"), asking=Asking(calls_per_second=40)).collect()
    at = sorted(c[1] for c in backend.calls())
    # each of 4 tasks has 10 calls a second, the fullest at least 6 calls
    assert len(at) == 24 and at[-1] - at[0] >= 0.45
    assert with_kept_responses(rows.limit(0), backend, str(tmp_path / "answers")).count() == 0
