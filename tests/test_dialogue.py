import re

import pytest
from pyspark.sql import functions as F

from pairsift.functions import dialogue
from pairsift.functions.text import words

SINGLE = "Human: Hello\n\nAssistant: Hi there!"
THREE = "\n\n".join(f"Human: {n} question\n\nAssistant: {n} answer" for n in ("First", "Second", "Third"))

CASES = {
    SINGLE: [("human", "Hello"), ("assistant", "Hi there!")],
    "": [],
    "   \n\n  ": [],
    "Just some random text": [],
    "Human: Just a human turn here": [("human", "Just a human turn here")],
    "Assistant: alone": [("assistant", "alone")],
    "Human:   padded content   \n\nAssistant:   also padded   ": [("human", "padded content"), ("assistant", "also padded")],
    "Human: line one\nline two\nline three\n\nAssistant: response": [("human", "line one\nline two\nline three"), ("assistant", "response")],
    "Some preamble text\n\nHuman: hello\n\nAssistant: hi": [("human", "hello"), ("assistant", "hi")],
    "Human:\n\nAssistant: x": [("human", ""), ("assistant", "x")],
    "Human: a human: b\nassistant: c": [("human", "a human: b\nassistant: c")],
    "Human:　wide \n\nAssistant: \xa0ok\x85": [("human", "wide"), ("assistant", "ok")],
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(t,) for t in [*CASES, THREE, None]], "text string").withColumn("turns", dialogue.parse_turns("text"))
    t = F.col("turns")
    out = rows.select("text", "turns", *[f(t, r).alias(n) for n, f, r in (("la", dialogue.last_turn, "assistant"), ("lh", dialogue.last_turn, "human"), ("aa", dialogue.all_turns, "assistant"), ("ah", dialogue.all_turns, "human"))], dialogue.count_turns(t).alias("n"))
    return {r["text"]: r for r in out.collect()}


@pytest.mark.parametrize("text", CASES)
def test_turns(parsed, text):
    assert [(t["role"], t["content"]) for t in parsed[text]["turns"]] == CASES[text]


def test_null_text_has_no_turns(parsed):
    assert parsed[None]["turns"] == [] and parsed[None]["la"] == ""


def test_last_all_and_count(parsed):
    row = parsed[THREE]
    assert (row["la"], row["lh"]) == ("Third answer", "Third question")
    assert row["aa"] == "First answer\nSecond answer\nThird answer"
    assert row["ah"].split("\n")[0] == "First question"
    assert (row["n"]["human"], row["n"]["assistant"]) == (3, 3)
    assert parsed["Human: Just a human turn here"]["la"] == ""
    assert parsed["Assistant: alone"]["lh"] == ""


def test_words_split_like_python(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = ["".join(f"a{i}{s}" for i, s in enumerate(spaces)), " lead", "trail ", "", "​zero width​", "x\x00y"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(words("t")).collect()]
    assert got == [t.split() for t in texts]
    assert re.split(r"\s+", texts[0].strip()) == got[0]
