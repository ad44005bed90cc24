import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pairsift.llm.infill import InfillSettings, fill_in_middle, restored

SPACE = " \t\n\x0b\f\r"


def begins(unit, before, at):
    if unit == "char":
        return True
    return before == "\n" if unit == "line" else before in SPACE and at not in SPACE


def brute(doc_id, text, s):
    text = text or ""
    marks = (s.prefix_mark, s.suffix_mark, s.middle_mark)
    at = [i for i in range(len(text)) if begins(s.unit, text[i - 1] if i else "\n", text[i])]
    n = len(at)
    digest = hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    place = [0, *at[1:], len(text)] if n else [0]
    form = "plain" if not text or any(m in text for m in marks) or h[2] % 100 >= s.cut_percent else "spm" if h[3] % 100 < s.spm_percent else "psm"
    if form == "plain":
        return n, form, None, None, text
    a, b = place[lo], place[hi]
    pre, mid, suf = text[:a], text[a:b], text[b:]
    p, q, m = marks
    return n, form, lo, hi - lo, p + pre + q + suf + m + mid if form == "psm" else q + suf + p + pre + m + mid


def texts():
    draw = random.Random(5)
    letters = ["a", "é", "€", "😀", " ", "\n", "\t", "<", ">", "P", "\U0010ffff", "\x80", "́"]
    out = ["", None, " ", "\n", "x", "<P>", "a<S>b", "almost <P mark", "<<M", "ends with <", "   leading", "word", "😀" * 9, "日" * 40, "\n\n\nlines\n\n"]
    out += ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 60))) for _ in range(150)]
    return out


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("chunk_bytes", [4, 5, 16, 1 << 16])
def test_against_brute_force(spark, make_docs, unit, chunk_bytes):
    s = InfillSettings(unit=unit, chunk_bytes=chunk_bytes, spm_percent=40)
    rows = [(i, text) for i, text in enumerate(texts())]
    docs = make_docs(rows)
    out = fill_in_middle(docs, s)
    got = {r["doc_id"]: r for r in out.withColumn("back", restored(F.col("infill.output"), F.col("infill.form"), s)).collect()}
    assert out.columns == [*docs.columns, "infill"] and len(got) == len(rows)
    forms = set()
    for doc_id, text in rows:
        assert tuple(got[doc_id]["infill"]) == brute(doc_id, text, s), (doc_id, text)
        assert got[doc_id]["back"] == (text or "")
        forms.add(got[doc_id]["infill"]["form"])
    assert forms == {"plain", "psm", "spm"}


def test_nulls_repeated_rows_and_clashes(spark):
    s = InfillSettings(chunk_bytes=8)
    rows = [(None, "long enough for chunks", "a"), (None, "long enough for chunks", "b"), (None, "another long enough", "c"), (3, "one id, first text", "d"), (3, "one id, and a second text", "e"), (3, "one id, first text", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, infill string")
    got = fill_in_middle(docs, s)
    assert got.columns == ["doc_id", "text", "infill", "_infill"]
    assert sorted((str(r["doc_id"]), r["text"], r["infill"], *r["_infill"][:1]) for r in got.collect()) == sorted((str(i), text, x, len(text)) for i, text, x in rows)
    for r in got.collect():
        assert tuple(r["_infill"]) == brute(r["doc_id"], r["text"], s)
    assert fill_in_middle(docs.limit(0), s).collect() == []


def test_one_very_long_text_and_its_copies(spark):
    text = "Wörter und 😀 " * 120_000
    s = InfillSettings(cut_percent=100)
    docs = spark.range(6).select((F.col("id") % 2).alias("doc_id"), F.lit(text).alias("text")).repartition(3)
    got = fill_in_middle(docs, s).select("doc_id", "infill.*").select("doc_id", "n", "prefix_units", "middle_units", F.sha2(F.col("output").cast("binary"), 256).alias("sha"), (restored(F.col("output"), F.col("form"), s) == text).alias("same")).collect()
    assert len(got) == 6 and all(r["same"] for r in got)
    for doc_id in (0, 1):
        n, _, prefix, middle, output = brute(doc_id, text, s)
        mine = {tuple(r)[1:5] for r in got if r["doc_id"] == doc_id}
        assert mine == {(n, prefix, middle, hashlib.sha256(output.encode()).hexdigest())}


def test_settings_are_checked():
    for wrong in ({"unit": "token"}, {"chunk_bytes": 3}, {"prefix_mark": ""}, {"prefix_mark": "<S>"}, {"prefix_mark": "aba"}, {"suffix_mark": "><"}, {"middle_mark": "x<P>y"}):
        with pytest.raises(ValueError):
            InfillSettings(**wrong)
