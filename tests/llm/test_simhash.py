import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairsift.llm import common, neardup, simhash
from pairsift.llm import components as cc


@pytest.fixture
def hot(monkeypatch):
    """Every key that two rows share is a hot one."""
    for module in (common, neardup):
        monkeypatch.setattr(module, "HOT_ROWS", 1)
        monkeypatch.setattr(module, "HOT_KEYS", 10**9)
    monkeypatch.setattr(neardup, "SAMPLE", 1)
    monkeypatch.setattr(neardup, "PAIR_BLOCK", 3)


def fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def close(base, rng, n):
    out = base
    for bit in rng.sample(range(64), n):
        out ^= 1 << bit
    return out


@pytest.mark.parametrize("dense", [4096, 3])
def test_links_connect_what_brute_force_connects(spark, dense):
    rng = random.Random(dense)
    bases = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = sorted({close(b, rng, rng.randint(0, 6)) for b in bases for _ in range(14)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "f0 long")
    settings = simhash.SimHashSettings(dense=dense)
    links = [tuple(r) for r in simhash.near_links(nodes, settings).collect()]
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
    if dense > 100:
        assert sorted(tuple(sorted(x)) for x in links) == sorted((a, b) for a in signed for b in signed if a < b and near(a, b))
    found = {tuple(sorted(x)) for x in links}
    assert all(near(a, b) for a, b in found)
    assert joined(signed, lambda a, b: (a, b) in found) == joined(signed, near)


def test_odd_radius_in_dense_groups(spark):
    rng = random.Random(1)
    prints = sorted({close(77, rng, rng.randint(0, 4)) for _ in range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = {tuple(sorted(r)) for r in simhash.dense_links(spark.createDataFrame([(s,) for s in signed], "f0 long"), 4).collect()}
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
    assert joined(signed, lambda a, b: (a, b) in links) == joined(signed, near)


TEXTS = [None, "", " \n", "one", "One  two\tthree", "one two three four five", "One Two three FOUR five\x0b", "a a a a a a a a", "é\xa0è x y z w", "x " * 50_000]


def test_query_equals_brute_force(spark, make_docs, tmp_path):
    rng = random.Random(9)
    long = [" ".join(rng.choices("abcdefghijklmnop", k=200)) for _ in range(6)]
    near = [t.replace(" a b", " zz b", 1) for t in long]
    rows = [(i, t) for i, t in enumerate([*TEXTS, *long, *near, *long])] + [(None, "one"), (3, "one")]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = simhash.op9_neardup(spark, str(tmp_path)).collect()
    prints = {fp(t) for _, t in rows}
    roots = joined(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 4)
    lows = {}
    for i, t in rows:
        if i is not None:
            r = roots[fp(t)]
            lows[r] = min(i, lows.get(r, i))
    want = [(i, f"{fp(t):016x}", lows.get(roots[fp(t)])) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_no_table_of_all_rows_is_broadcast(spark, make_docs, tmp_path):
    """Spark expects far fewer rows of an exploded table and fewer bytes of a compressed one than there are."""
    make_docs([(i, f"a text of five words {i}") for i in range(40)]).write.parquet(str(tmp_path / "documents.parquet"))
    nodes = spark.range(100).select((F.col("id") * 7919).alias("f0"))
    for found in (simhash.near_links(nodes, simhash.CONTRACT), simhash.dense_links(nodes, 4), simhash.op9_neardup(spark, str(tmp_path))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_parquet_is_read_in_few_rows_at_once(spark, make_docs, tmp_path):
    key, before = "spark.sql.parquet.columnarReaderBatchSize", spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    make_docs([(1, "one")]).write.parquet(str(tmp_path / "documents.parquet"))
    try:
        for given, want in ((4096, common.READ_ROWS), (16, 16)):
            spark.conf.set(key, given)
            assert simhash.op9_neardup(spark, str(tmp_path)).count() == 1
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)


def test_empty_table(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert simhash.op9_neardup(spark, str(tmp_path)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [(100, i) for i in range(101, 160)] + [(i, i) for i in (5, 300)] + [(rng.randint(400, 430), rng.randint(400, 430)) for _ in range(20)]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges + edges[:10], "a long, b long")
    got = {r["node"]: r["root"] for r in cc.components(frame).collect()}
    nodes = sorted({x for e in edges for x in e})
    pairs = {tuple(sorted(e)) for e in edges}
    assert got == joined(nodes, lambda a, b: (a, b) in pairs)
    assert cc.components(frame.limit(0)).count() == 0


def test_components_compute_the_edges_once_in_few_tasks(spark):
    calls, context, parts = spark.sparkContext.accumulator(0), spark.sparkContext, 32
    count = F.udf(lambda x: (calls.add(1), x)[1], "long").asNondeterministic()
    held = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("components", "components")
        edges = spark.range(0, 60, numPartitions=2).select(count("id").alias("a"), (F.col("id") + 1).alias("b"))
        assert {r["root"] for r in cc.components(edges).collect()} == {0}
        stages = {s for j in context.statusTracker().getJobIdsForGroup("components") for s in context.statusTracker().getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := context.statusTracker().getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert calls.value == 60
    # with checkpoints: 2,924
    assert tasks < 2000


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def changed(text, rng, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randint(0, 999)}"
    return " ".join(words)


def test_stage_keeps_one_of_each_group(spark, make_docs):
    rng = random.Random(7)
    texts = []
    for g in range(12):
        base = " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(120, 300)))
        texts += [base, base.upper(), changed(base, rng, 1), changed(base, rng, 3), changed(base, rng, 40)]
    texts += [None, "", "  ", "one two", "One Two", "one two three", "x " * 30_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0]), (None, texts[5]), (None, None), (7, "a text of its own that shares its id")]
    docs = make_docs(rows)
    kept = neardup.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    sets = {t: shingles(t) for _, t in rows}

    def similar(a, b):
        x, y = sets[a], sets[b]
        return len(x & y) >= 0.8 * len(x | y)

    order = sorted(sets, key=str)
    index = {t: i for i, t in enumerate(order)}
    roots = joined(range(len(order)), lambda a, b: similar(order[a], order[b]))
    lows = {}
    for i, t in rows:
        if i is not None:
            r = roots[index[t]]
            lows[r] = min(i, lows.get(r, i))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(lows.values())


def test_stage_without_rows_or_duplicates(spark, make_docs):
    assert neardup.near_duplicate_stage(spark, make_docs([]), "").count() == 0
    assert neardup.near_duplicate_stage(spark, make_docs([(1, "a b c"), (2, "d e f")]), "").count() == 2


def test_large_near_group_is_connected(spark):
    rng = random.Random(4)
    base = " ".join(f"w{rng.randint(0, 300)}" for _ in range(160))
    docs = spark.createDataFrame([(i, changed(base, rng, rng.randint(0, 8))) for i in range(150)], "doc_id long, text string")
    rows, links = neardup.near_duplicates(neardup.row_keys(docs).drop("row"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    node = {r["node"]: shingles(texts[r["doc_id"]]) for r in rows.collect()}
    found = {tuple(sorted(r)) for r in links.collect()}
    similar = lambda a, b: len(node[a] & node[b]) >= 0.8 * len(node[a] | node[b])
    assert all(similar(a, b) for a, b in found)
    want, got = joined(sorted(node), similar), joined(sorted(node), lambda a, b: (a, b) in found)
    assert np.mean([want[n] == got[n] for n in node]) > 0.98
    assert len(found) < sum(similar(a, b) for a in node for b in node if a < b)


def test_row_keys_tell_rows_apart(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert neardup.row_keys(rows).select("row1", "row2").distinct().count() == 5
    assert rows.select(F.xxhash64("doc_id")).distinct().count() == 3


def block_edit(words, rng, n, kind):
    """The words with one block of n added, cut or replaced."""
    at, new = rng.randint(0, len(words) - n), [f"b{rng.randint(0, 10**6)}" for _ in range(n)]
    return words[:at] + ([] if kind == "cut" else new) + words[at + (0 if kind == "add" else n) :]


def test_no_pair_that_differs_by_a_block_is_missed(spark):
    rng = random.Random(11)
    texts = []
    for g in range(150):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 300))]
        n, kind = len(base), ("add", "cut", "replace")[g % 3]
        size = {"add": n // 4 - 11, "cut": n // 5 - 9, "replace": n // 9 - 5}[kind]
        texts += [" ".join(base), " ".join(block_edit(base, rng, max(1, size), kind))]
    # one shingle of five is another: exactly 0.8, and just below it
    edge = [f"e{i}" for i in range(20)]
    texts += [" ".join(edge), " ".join(edge[:16]), "x1 x2 x3 x4 x5 x6 x7 x8 x9", "x1 x2 x3 x4 x5 x6 x7 x8", "y1 y2 y3 y4 y5 y6 y7 y8", "y1 y2 y3 y4 y5 y6 y7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, links = neardup.near_duplicates(neardup.row_keys(docs).drop("row"))
    node = {r["node"]: shingles(texts[r["doc_id"]]) for r in rows.collect()}
    similar = lambda a, b: len(node[a] & node[b]) >= 0.8 * len(node[a] | node[b])
    want = {(a, b) for a in node for b in node if a < b and similar(a, b)}
    assert len(want) > 140
    assert {tuple(sorted(r)) for r in links.collect()} == want


def test_a_family_of_unlike_texts_makes_few_pairs(spark, monkeypatch):
    """Texts of one family that share most of their shingles, few of them similar: pairs follow those, not the square of the family."""
    rng = random.Random(3)
    base, other = [f"w{i}" for i in range(300)], [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(70):
        changed = set(rng.sample(range(4, 292), 7))
        texts.append([other[i] if i in changed else base[i] for i in range(300)])
    texts += [[*t[:296], "a", "b", "c", "d"] for t in texts[:5]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    made, whole = [], neardup.cross_pairs

    def counted(*args):
        pairs = whole(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(neardup, "cross_pairs", counted)
    rows, links = neardup.near_duplicates(neardup.row_keys(docs).drop("row"))
    grams = {r["node"]: {tuple(texts[r["doc_id"]][i : i + 5]) for i in range(296)} for r in rows.collect()}
    similar = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    found = {tuple(sorted(r)) for r in links.collect()}
    want = {(a, b) for a in grams for b in grams if a < b and similar(a, b)}
    assert len(want) >= 5 and found <= want
    assert joined(sorted(grams), lambda a, b: (a, b) in found) == joined(sorted(grams), similar)
    assert 8 * made[0] <= len(grams) * (len(grams) - 1)


@pytest.mark.parametrize("dense", [4096, 3])
def test_simhash_pairs_equal_brute_force(spark, dense):
    rng = random.Random(dense)
    bases = [rng.getrandbits(63) for _ in range(10)]
    rows = [(i, close(bases[i % 10], rng, rng.randint(0, 3)) & ((1 << 63) - 1)) for i in range(120)]
    rows += [(1000 + i, bases[0]) for i in range(20)]
    got = neardup.simhash_pairs(spark.createDataFrame(rows, "node long, f0 long"), simhash.SimHashSettings(dense=dense)).collect()
    lows = {}
    for node, f0 in rows:
        lows[f0] = min(node, lows.get(f0, node))
    same = {(node, lows[f0]) for node, f0 in rows if node != lows[f0]}
    near = {f: [x for x in lows if x < f and (x ^ f).bit_count() <= 4] for f in lows}
    found = {(r["a"], r["b"]) for r in got}
    assert len(got) == len(found) and same <= found and {r["fame"] for r in got} == {0}
    if dense == 3:  # links of crowded keys connect, but need not be to the least within the radius
        pairs = {tuple(sorted(x)) for x in found}
        roots = joined(sorted(n for n, _ in rows), lambda a, b: (a, b) in pairs)
        whole = dict(rows)
        want = joined(sorted(whole), lambda a, b: (whole[a] ^ whole[b]).bit_count() <= 4)
        assert all(want[a] == want[b] for a, b in found) and all(want[n] == want[roots[n]] for n in whole)
    else:
        assert found == same | {(lows[f], lows[min(n)]) for f, n in near.items() if n}


def test_hot_keys_give_the_same(spark, make_docs, tmp_path, hot):
    test_query_equals_brute_force(spark, make_docs, tmp_path)
    test_components(spark)
    test_large_near_group_is_connected(spark)
    test_no_pair_that_differs_by_a_block_is_missed(spark)


def test_joins_of_hot_keys(spark):
    rows = spark.createDataFrame([(i % 3 if i < 900 else 10 + i, i % 2) for i in range(1000)], "k long, x int")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    found = common.hot_keys(counts, "k", "n")
    assert {r["k"]: r["salts"] for r in found.collect()} == {0: 2, 1: 2, 2: 2}
    lookup = counts.select("k", (F.col("k") * 2).alias("twice"))
    got = common.join_hot(rows, lookup, "k", found)
    assert got.count() == 1000 and got.filter("twice <> 2 * k").count() == 0 and got.columns == ["k", "x", "twice"]
    assert common.hot_keys(counts.filter("k > 2"), "k", "n") is None and common.hot_keys(counts.limit(0), "k", "n") is None
    sums = common.over_key(rows, "k", {"n": F.count("*"), "most": F.max("x")}, F.col("k") < 2)
    assert sorted(sums.select("k", "n", "most").distinct().filter("k < 11").collect()) == [(0, 300, 1), (1, 300, 1), (2, 300, 1)] and sums.count() == 1000


def test_scratch_tables_are_deleted(spark, tmp_path):
    import os

    with common.scratch(spark):
        kept = common.written(spark.range(3).toDF("x"))
        folder = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("///", "/")
        assert os.path.isdir(folder)
    assert not os.path.isdir(folder)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_root(Session())
