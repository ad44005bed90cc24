import random
import re

from pairsift.llm import license as scan

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None,
    "",
    " -- ",
    "CC-BY cc by; Cc.bY",
    "general PUBLIC license all rights reserved All Rights Reserved",
    "cc bÿ cc",
    "ￋcc by K cc by",
    "K cc by İall rights reserved",
    "the general public; licence",
    "GNU general public license, cc by cc by cc by",
    ("word " * 40_000) + "all rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Released under the MIT License.",
    "licensed under the apache license version 2.0 and cc by nc",
]


def test_base_columns_equal_brute_force(spark, make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(TEXTS)])
    got = {r["doc_id"]: r for r in scan.scan_licenses(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_templates_with_changed_words(spark, make_docs):
    words = next(t.text for t in scan.TEMPLATES if t.text.startswith("permission is hereby")).split()
    texts = [" ".join(words), " ".join(words[:6] + ["very", "new"] + words[6:]), " ".join(words[:5] + words[6:]), " ".join(words[: len(words) // 2]), " ".join(w for pair in zip(words, ["x"] * len(words)) for w in pair)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan.scan_licenses(make_docs(list(enumerate(texts)))).collect()}
    assert got[0] == ("mit", 1.0)
    assert got[1][0] == got[2][0] == "mit" and got[1][1] < 1
    assert got[3] == got[4] == ("", 0.0)


def brute_labels(text):
    """Licenses by words: each span of a template's length and the drift, its places looked up in order."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    settings, best = scan.LicenseSettings(), {}
    for t in scan.TEMPLATES:
        own = t.text.split()
        k = min(3, len(own))
        grams = [own[i : i + k] for i in range(len(own) - k + 1)]
        for d in range(-len(own), len(words)):
            drift = 0 if t.base else settings.drift
            last, n, any_here = -1, 0, False
            for q, gram in enumerate(grams):
                places = [p for p in range(max(0, d + q), d + q + drift + 1) if words[p : p + k] == gram]
                any_here = any_here or (d + q >= 0 and words[d + q : d + q + k] == gram)
                if places and places[0] > last:
                    last, n = places[0], n + 1
            if any_here and n >= len(grams) * (1.0 if t.base else settings.coverage):
                best[t.label] = max(best.get(t.label, 0), n / len(grams))
    return ",".join(sorted(best)), max(best.values(), default=0.0)


def test_labels_equal_brute_force(spark, make_docs):
    rng = random.Random(6)
    texts = ["under the mit under the mit license", "Released under the MIT license the mit license the mit license", "mit license under the released"]
    for _ in range(120):
        words = []
        for _ in range(rng.randint(1, 3)):
            copy = rng.choice(scan.TEMPLATES).text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 2)] = rng.choices(["the", "license", "x", "software", "under"], k=rng.randint(0, 4))
                copy = copy or ["x"]
            words += copy * rng.choice([1, 1, 2]) + ["y"] * rng.randint(0, 3)
        texts.append(" ".join(words))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan.scan_licenses(make_docs(list(enumerate(texts)))).collect()}
    want = {i: brute_labels(t) for i, t in enumerate(texts)}
    assert {i: (labels, round(score, 9)) for i, (labels, score) in got.items()} == {i: (labels, round(score, 9)) for i, (labels, score) in want.items()}
    assert got[0] == ("", 0.0) and got[1] == ("mit", 1.0) and got[2] == ("", 0.0)
    assert len({labels for labels, _ in got.values()}) > 15


def test_repeated_rows_and_null_ids(spark, make_docs):
    rows = [(1, "cc by")] * 3 + [(None, "cc by"), (None, "cc by"), (None, None), (1, "other text")]
    got = sorted(((r["doc_id"], r["n_base"]) for r in scan.scan_licenses(make_docs(rows)).collect()), key=str)
    assert got == sorted([(1, 1)] * 3 + [(None, 1)] * 2 + [(None, 0), (1, 0)], key=str)


def test_empty_table(spark, make_docs):
    assert scan.scan_licenses(make_docs([])).count() == 0
