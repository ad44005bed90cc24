import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsift.llm import ftrl, language, quality

WORDS = {"en": "the of and to in that was for with house water".split(), "de": "der die und das nicht mit für haus wasser schön".split(), "fr": "le la les des est pour avec maison eau été".split()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(6, 40))), lang) for i in range(600) for lang in [rng.choice(list(WORDS))]]


def test_language_of_held_out_rows(spark, make_docs, corpus, tmp_path):
    make_docs(corpus).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in language.op4_language(spark, str(tmp_path)).collect()}
    held = [(i, lang) for i, _, lang in corpus if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i, _ in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_rows(spark, make_docs, corpus):
    odd = [(1000, None), (1001, ""), (1002, "123 ... !! \u00b2\u00bd\u2460\u0663"), (1003, "der die das und nicht " * 60_000, "de"), (None, "the of and", None), (0, "le la les des", "fr"), (0, "le la les des", "fr")]
    model = language.train_language_model(make_docs(corpus + odd))
    rows = make_docs(odd).select("doc_id", language.predict_languages(spark, model).alias("p")).select("doc_id", "p.*").collect()
    assert [r["lang"] for r in rows] == ["und", "und", "und", "de", "en", "fr", "fr"] and rows[0]["score"] == 0


def test_language_without_training_rows(spark, make_docs):
    model = language.train_language_model(make_docs([]))
    assert make_docs([(1, "the")]).select(language.predict_languages(spark, model).alias("p")).first()["p"]["lang"] == "und"
    one = language.train_language_model(make_docs([(i, "abc def", "xx") for i in range(8)]))
    assert make_docs([(1, "the")]).select(language.predict_languages(spark, one).alias("p")).first()["p"]["lang"] == "xx"


def test_document_frequencies_cover_all_rows(spark, make_docs):
    settings = language.LanguageSettings(orders=(1,))
    n, frequencies = language.document_frequencies(make_docs([(1, "aab"), (2, "b"), (3, None), (4, "")]).select("text"), settings)
    assert n == 4 and sorted(frequencies[frequencies > 0].tolist()) == [1, 2]


def test_language_stage_keeps_columns_and_clean_rows(spark, make_docs, corpus):
    docs = make_docs([*corpus, (9999, "?? 12"), (9998, None)])
    kept = language.language_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == len(corpus)
    assert kept.select("score", "node").distinct().first() == (1.5, "n")


def noisy(rng, good):
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(rng.randint(30, 80))]
    return " ".join(words) if good else " ".join(w + rng.choice(["***", "###", "%%%"]) for w in words)


@pytest.fixture(scope="module")
def marked():
    rng = random.Random(8)
    return [(i, noisy(rng, i % 4 > 0), int(i % 4 > 0)) for i in range(500)]


def test_quality_of_held_out_rows(spark, make_docs, marked, tmp_path):
    make_docs([(i, t) for i, t, _ in marked]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, _, q in marked], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in quality.op8_quality(spark, str(tmp_path)).collect()}
    held = [(i, q) for i, _, q in marked if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == {i for i, _ in held}
    assert np.mean([got[i]["predicted"] == q for i, q in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_quality_of_odd_rows(spark, make_docs, marked):
    docs = make_docs([(i, t) for i, t, _ in marked] + [(None, "x"), (700, None), (700, None), (701, "word " * 100_000)])
    labels = spark.createDataFrame([(i, q) for i, _, q in marked] + [(None, 1), (3, None), (5, 0), (5, 1)], "doc_id long, quality int")
    model = quality.train_quality_model(docs, labels)
    scores = [r[0] for r in docs.filter("doc_id IS NULL OR doc_id >= 700").select(quality.quality_scores(spark, model)).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    nothing = quality.train_quality_model(docs, labels.limit(0))
    assert docs.limit(2).select(quality.quality_scores(spark, nothing)).collect()[0][0] == 0.5
    assert make_docs([]).select(quality.quality_scores(spark, model)).count() == 0


def test_scores_do_not_depend_on_batches(spark, make_docs, marked):
    docs = make_docs([(i, t) for i, t, _ in marked])
    model = quality.train_quality_model(docs, spark.createDataFrame([(i, q) for i, _, q in marked], "doc_id long, quality int"))
    one, two = ({r[0]: r[1] for r in docs.repartition(n).select("doc_id", quality.quality_scores(spark, model)).collect()} for n in (1, 5))
    assert one == pytest.approx(two, abs=1e-12)


def test_word_ngrams_equal_brute_force():
    texts = [b"The the cat!! sat", b"", "é é".encode(), b"a,b"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    rows, _, values = quality.word_ngrams(data, offsets, 20)
    # distinct features: the, cat, !!, sat, and pairs the-the, the-cat, cat-!!, !!-sat; é, é-é; a , b and two pairs
    assert np.bincount(rows, minlength=4).tolist() == [8, 0, 2, 5]
    assert np.bincount(rows, values**2, minlength=4) == pytest.approx([1, 0, 1, 1])


def test_ftrl_keeps_weak_features_at_zero():
    model = ftrl.FtrlProximal(3, 1, alpha=0.5, beta=1.0, l1=1.0, l2=0.1)
    for _ in range(100):
        model.learn(np.array([0]), np.array([1.0]), np.array([1.0]))
        model.learn(np.array([1]), np.array([1.0]), np.array([0.0]))
    model.learn(np.array([2]), np.array([1.0]), np.array([1.0]))
    w = model.weights()[:, 0]
    assert w[0] > 0.5 and w[1] < -0.5 and w[2] == 0


def test_temperature():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, 3, 4000)
    scores = rng.normal(0, 1, (4000, 3)) + 2 * np.eye(3)[classes]
    assert ftrl.best_temperature(scores * 5, classes) == pytest.approx(5 * ftrl.best_temperature(scores, classes), rel=0.02)


M64 = (1 << 64) - 1


def finished(key):
    key = (key ^ (key >> 31)) * 0x9E3779B97F4A7C15 & M64
    return key ^ (key >> 29)


class PlainFtrl:
    """One example at a time with dictionaries, as the method is published."""

    def __init__(self, outputs, alpha, beta, l1, l2):
        self.outputs, self.alpha, self.beta, self.l1, self.l2 = outputs, alpha, beta, l1, l2
        self.z, self.n = {}, {}

    def weight(self, key):
        z, n = self.z.get(key, 0.0), self.n.get(key, 0.0)
        return 0.0 if abs(z) <= self.l1 else -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(n)) / self.alpha + self.l2)

    def scores(self, example):
        return [sum(v * self.weight((f, k)) for f, v in example.items()) for k in range(self.outputs)]

    def learn(self, example, target):
        scores = self.scores(example)
        if self.outputs == 1:
            p = [1 / (1 + math.exp(-scores[0]))]
        else:
            p = [math.exp(s - max(scores)) for s in scores]
            p = [x / sum(p) for x in p]
        for f, v in example.items():
            for k in range(self.outputs):
                g, w, n = v * (p[k] - target[k]), self.weight((f, k)), self.n.get((f, k), 0.0)
                self.z[f, k] = self.z.get((f, k), 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w
                self.n[f, k] = n + g * g


def unit(counts, factor=lambda f: 1.0):
    values = {f: (1 + math.log(c)) * factor(f) for f, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in values.values())) or 1.0
    return {f: v / norm for f, v in values.items()}


def char_ngrams(text, settings):
    codes = [ord(c) if "a" <= c <= "z" or ord(c) >= 0xAA else 32 for c in text.lower()]
    out = Counter()
    for n in settings.orders:
        for i in range(len(codes) - n + 1):
            key = 0
            for j in range(n):
                key = (key * 0x1000193 + codes[i + j] + j + 1) & M64
            out[finished(key) >> (64 - settings.bits)] += 1
    return out


def test_language_query_equals_brute_force(spark, make_docs, corpus, tmp_path):
    rows = [*corpus[:160], (2000, None, "en"), (2001, "\u00b2", "de"), (None, "the of", "fr")]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    settings = language.LanguageSettings()
    at = {r[0]: r[1] for r in make_docs(rows).select("doc_id", F.xxhash64("doc_id", "text")).collect()}
    learned = sorted((at[i], lang, text) for i, text, lang in rows if i is not None and text is not None and zlib.crc32(str(i).encode()) % 4 != 2)
    counts = [char_ngrams(t, settings) for _, _, t in learned]
    documents = Counter(f for c in counts for f in c)
    weigh = lambda c: unit(c, lambda f: math.log((1 + len(learned)) / (1 + documents[f])) + 1)
    names = sorted({lang for _, lang, _ in learned})
    model = PlainFtrl(len(names), settings.alpha, settings.beta, settings.l1, settings.l2)
    examples = [{**weigh(c), "bias": 1.0} for c in counts]
    for _ in range(settings.epochs):
        for i, example in enumerate(examples):
            if i % 5 != 4:
                model.learn(example, [float(x == learned[i][1]) for x in names])
    back = [(model.scores(examples[i]), names.index(learned[i][1])) for i in range(4, len(examples), 5)]
    soft = lambda s, t: [math.exp((x - max(s)) / t) / sum(math.exp((y - max(s)) / t) for y in s) for x in s]
    loss = lambda t: -sum(math.log(max(soft(s, t)[k], 1e-12)) for s, k in back)
    temperature = min((math.exp(x / 200) for x in range(-599, 600)), key=loss)
    got = {r["doc_id"]: r for r in language.op4_language(spark, str(tmp_path)).collect()}
    for i, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        p = soft(model.scores({**weigh(char_ngrams(text, settings)), "bias": 1.0}), temperature)
        assert got[i]["lang_pred"] == names[p.index(max(p))]
        assert got[i]["score"] == pytest.approx(max(p), abs=0.02)


def test_rare_languages_are_learned(spark, make_docs, corpus):
    rows = [*corpus, *((3000 + i, "zuzu kaka lolo " * (3 + i % 5), "zz") for i in range(12))]
    settings = language.LanguageSettings(sample_rows=60, language_rows=40)
    model = language.train_language_model(make_docs(rows), settings)
    assert model.languages == ["de", "en", "fr", "zz"]
    assert make_docs([(1, "kaka zuzu lolo kaka")]).select(language.predict_languages(spark, model).alias("p")).first()["p"]["lang"] == "zz"


def test_many_languages_are_all_learned(spark, make_docs):
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300)]
    rows = [(8 * k + i, f"{words[k]} " * (4 + i), f"l{k:03d}") for k in range(300) for i in range(8)]
    settings = language.LanguageSettings(bits=15)
    model = language.train_language_model(make_docs(rows), settings)
    assert len(model.languages) == 300
    got = make_docs([(k, f"{words[k]} {words[k]} {words[k]}") for k in range(300)]).select("doc_id", language.predict_languages(spark, model).alias("p")).collect()
    assert sum(r["p"]["lang"] == f"l{r['doc_id']:03d}" for r in got) >= 290
    with pytest.raises(ValueError, match="more than 64 languages"):
        language.train_language_model(make_docs(rows), language.LanguageSettings(bits=13, model_bytes=1 << 23))


def test_samples_are_bounded_in_bytes(spark, make_docs):
    from pairsift.llm.common import bounded_sample

    rows = make_docs([(i, "x" * 1000) for i in range(50)] + [(99, None)]).select("text", F.xxhash64("doc_id").alias("at"))
    assert len(bounded_sample(rows, 10_500)) in (10, 11) and len(bounded_sample(rows, 1)) == 1 and len(bounded_sample(rows, 10**6)) == 51
    assert len(bounded_sample(rows.limit(0), 10)) == 0


def word_features(text, bits):
    """Hashed tokens and pairs of a text, found token by token."""
    pieces = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00\t-\r ]+", (text or "").encode())

    def token(piece):
        total = 0
        for j, b in enumerate(piece.lower()):
            total = (total + (b + 1) * pow(0x5851F42D4C957F2D, j, 1 << 64)) & M64
        return finished((total + len(piece)) & M64)

    keys = [token(p) for p in pieces]
    out = Counter(k >> (64 - bits) for k in keys)
    for a, b in zip(keys, keys[1:], strict=False):
        out[finished(1 if a == b else (a * 0x100000001B3 + finished(b)) & M64) >> (64 - bits)] += 1
    for a, b in zip(keys, keys[2:], strict=False):
        if a == b:
            out[finished(2) >> (64 - bits)] += 1
    return out


def test_quality_query_equals_brute_force(spark, make_docs, marked, tmp_path):
    rows = [*((i, t) for i, t, _ in marked[:150]), (2000, None), (2001, "A a a b?? a é"), (None, "x")]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [*((i, q) for i, _, q in marked[:150]), (7, 0), (9, None), (None, 1), (5000, 1)]
    frame = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    frame.write.parquet(str(tmp_path / "labels.parquet"))
    settings = quality.QualitySettings()
    marks = {}
    for i, q in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5 != 0:
            marks.setdefault(i, []).append(q)
    at = {r[0]: r[1] for r in frame.select("doc_id", F.xxhash64("doc_id")).collect()}
    texts = dict(rows)
    learned = sorted((at[i], sum(m) / len(m), texts[i]) for i, m in marks.items() if i in texts)
    model = PlainFtrl(1, settings.alpha, settings.beta, settings.l1, settings.l2)
    examples = [({**unit(word_features(t, settings.bits)), "bias": 1.0}, mark) for _, mark, t in learned]
    for _ in range(settings.epochs):
        for example, mark in examples:
            model.learn(example, [mark])
    got = {r["doc_id"]: r for r in quality.op8_quality(spark, str(tmp_path)).collect()}
    for i, text in rows:
        score = 1 / (1 + math.exp(-model.scores({**unit(word_features(text, settings.bits)), "bias": 1.0})[0]))
        assert got[i]["score"] == pytest.approx(score, abs=2e-3), text
