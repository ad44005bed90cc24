import math
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairsift.llm import ppm

ORDER = 4


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


class Brute:
    def __init__(self, texts):
        self.contexts = defaultdict(Counter)
        for text in texts:
            symbols = self.symbols(text)
            for i in range(ORDER, len(symbols)):
                for j in range(ORDER + 1):
                    self.contexts[tuple(symbols[i - j : i])][symbols[i]] += 1

    def symbols(self, text):
        return [257] * ORDER + list((text or "").encode()) + [256]

    def one(self, context, symbol):
        out, seen = 0.0, {}
        for j in range(ORDER, -1, -1):
            here = self.contexts.get(tuple(context[ORDER - j :]))
            if not here:
                continue
            rest = {s: c for s, c in here.items() if s not in seen}
            whole = sum(rest.values()) + len(rest)
            if symbol in rest:
                return out + math.log10(rest[symbol] / whole)
            if rest:
                out += math.log10(len(rest) / whole)
            seen = here
        return out - math.log10(257 - len(seen))

    def score(self, text):
        symbols = self.symbols(text)
        return sum(self.one(symbols[i - ORDER : i], symbols[i]) for i in range(ORDER, len(symbols)))


def corpus():
    rng = random.Random(12)
    parts = ["the ", "and ", "house ", "Wasser\n", "é", "tion ", "\t", "x", "The"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 60)))) for i in range(80)]
    return rows + [(200, None), (201, ""), (202, " "), (None, "the unknown"), (3, rows[3][1]), (203, "\xff\x00 zz"), (204, "word " * 30_000)]


def test_query_equals_brute_force(spark, make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 2000)
    rows = corpus()
    make_docs(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = ppm.op10_lm(spark, str(tmp_path)).collect()
    learned = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(x for t in learned for x in tokens(t))
    total, kinds, model = sum(counts.values()), len(counts), Brute(learned)
    want = {}
    for i, t in rows:
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in tokens(t))
        want[i] = (i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total, base, model.score(t))
    assert len(got) == len(rows)
    for r in got:
        held_out, n, known, all_, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out, n, known, all_)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_probabilities_add_up():
    model = [t for _, t in corpus() if t][:30]
    data = b"".join(t.encode() for t in model)
    grams, _ = ppm.text_grams(data, np.cumsum([0, *[len(t.encode()) for t in model]]), ORDER)
    keys, counts = np.unique(grams, return_counts=True)
    pairs = np.zeros((512, 512), np.int64)
    np.add.at(pairs, (((keys >> np.uint64(9)) & np.uint64(511)).astype(int), (keys & np.uint64(511)).astype(int)), counts)
    short, seen = Counter(), defaultdict(lambda: np.zeros(3))
    for key, count in zip(keys.tolist(), counts.tolist(), strict=True):
        short[key & (1 << 27) - 1] += count
    for key, count in short.items():
        single = int(pairs[key >> 9 & 511, key & 511])
        seen[key >> 9] += np.array([count, 1, single])
    for context in (keys[5] >> np.uint64(9), keys[-1] >> np.uint64(9), np.uint64(0x123456789)):
        every = (np.uint64(context) << np.uint64(9)) | np.arange(257, dtype=np.uint64)
        both = np.union1d(keys, every)
        n = np.zeros(len(both), np.int64)
        n[np.searchsorted(both, keys)] = counts
        shorter = np.array([[[short[k], *seen.get(k >> 9, np.zeros(3))]] for k in (both & np.uint64((1 << 27) - 1)).tolist()])
        p = 10 ** ppm.pair_log10(both, n, shorter, pairs, ORDER)[np.searchsorted(both, every)]
        assert p.sum() == pytest.approx(1.0)


def test_no_training_texts_and_no_rows(spark, make_docs, tmp_path):
    docs = make_docs([(1, "ab"), (2, None)]).selectExpr("doc_id", "text", "false AS train")
    got = {r["doc_id"]: r for r in ppm.corpus_scores(docs).collect()}
    assert got[1]["score"] == pytest.approx(-3 * math.log10(257)) and got[1]["base_score"] == pytest.approx(0.0)
    assert (got[2]["n_tokens"], got[2]["n_known"], got[2]["train_tokens"]) == (1, 0, 0)
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert ppm.op10_lm(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("order", [2, 3, 5])
def test_orders(spark, make_docs, order, monkeypatch):
    monkeypatch.setattr(sys.modules[__name__], "ORDER", order)
    monkeypatch.setattr(ppm, "GROUP_ROWS", 50)
    rows = corpus()
    docs = make_docs([(i, t) for i, t in rows if i is not None]).selectExpr("doc_id", "text", "doc_id % 2 = 0 AS train")
    model = Brute([t for i, t in rows if i is not None and i % 2 == 0])
    want = sorted(model.score(t) for i, t in rows if i is not None)
    assert sorted(r["score"] for r in ppm.corpus_scores(docs, ppm.PpmSettings(order=order)).collect()) == pytest.approx(want, rel=1e-9)


def test_adaptive_mode(spark, make_docs):
    docs = make_docs([(1, "abcabcabc" * 20), (2, "abc"), (3, None)])
    got = {r[0]: r[1] for r in docs.select("doc_id", ppm.adaptive_scores("text")).collect()}
    assert got[3] == pytest.approx(-math.log10(257))
    assert got[1] / 181 > got[2] / 4
    trie = ppm.AdaptiveTrie(2)
    first = trie.code(b"", 97)
    assert first == pytest.approx(-math.log10(257)) and trie.code(b"a", 98) == pytest.approx(math.log10(1 / 2) - math.log10(256))
