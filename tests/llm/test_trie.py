import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pairsift.llm import common, trie

TURNS = "conv_id long, turn long, role string, text string, hi long, owner string, total int"


def brute(rows, branch):
    """The contract's nodes as tuples, by plain dictionaries."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv, []).append(((turn is not None, turn), told, (role, text)))
    turns = {c: [x for _, _, x in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, own in turns.items():
        if branch:
            base = c - (abs(c) % 5) * (1 if c > 0 else -1)
            h = zlib.crc32(str(c).encode()) % 9
            own = turns.get(base, [])[:h] + own[h:]
        paths[c] = tuple(own)
    members, ends = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, mine in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(mine), len(node), min(members[node[:-1]]) if node else None, len(mine), len(kids.get(node, [])), leaves[node], saved[node], sha))
    return sorted(out, key=str)


def nodes(df):
    return sorted((tuple(r) for r in df.drop("hi", "lo").collect()), key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, "o", 3) for r in rows], TURNS)


def drawn(seed, convs, longest, words):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant", None]), draw.choice(words)) for c in convs for t in range(draw.randrange(1, longest))]


@pytest.mark.parametrize("branch", [True, False])
@pytest.mark.parametrize("hot", [True, False])
def test_against_brute_force(spark, monkeypatch, branch, hot):
    if hot:  # conversations of more than 6 turns go by ranges and blocks
        monkeypatch.setattr(common, "HOT_ROWS", 6)
        monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "END_RANGE", 4)
    rows = drawn(1, range(-12, 60), 5, ["a", "é", "", None, "long text"]) + drawn(2, range(100, 110), 40, ["a", "b"]) + [(c, t, "user", "a") for c in (7, 300, 301, 302, 303) for t in range(25)]
    random.Random(3).shuffle(rows)
    got = trie.prefix_trie(conversations(spark, rows).repartition(5), trie.branched if branch else trie.whole)
    assert nodes(got) == brute(rows, branch)
    assert got.groupBy("hi", "lo").count().filter("count > 1").count() == 0


def test_partial_tries_merge_in_any_number(spark, monkeypatch):
    rows = drawn(4, range(40), 6, ["a", "b", "c"])
    monkeypatch.setattr(trie, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert nodes(trie.prefix_trie(conversations(spark, rows), trie.branched)) == brute(rows, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 1, "user", "nobody"), (5, None, None, None), (5, 2, "user", "x"), (5, 2, "user", "x"), (5, 2, "a", "y"), (6, 1, "use", "rx"), (6, 1, "user", "x"), (-3, 0, "user", "x"), (-5, 0, "user", "x")]
    for branch in (True, False):
        assert nodes(trie.prefix_trie(conversations(spark, rows), trie.branched if branch else trie.whole)) == brute(rows, branch)


def test_empty_tables_and_conversations_without_turns(spark):
    empty = conversations(spark, [(None, 1, "user", "x")])
    assert trie.prefix_trie(empty.limit(0), trie.branched).collect() == []
    assert trie.prefix_trie(empty, trie.branched).collect() == []
    # conversations whose base is absent and whose own turns all come before their h
    rows = [(c, 0, "user", "x") for c in range(1, 40) if c % 5]
    got = nodes(trie.prefix_trie(conversations(spark, rows), trie.branched))
    assert got == brute(rows, True) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)


def test_deep_chain_that_changes_owners(spark):
    """Conversation i shares i turns with the one before it, as deep a trie as its rows allow."""
    rows = [(i, t, "user", f"{min(i, 40) if t >= i else 'same'}") for i in range(30) for t in range(40)]
    assert nodes(trie.prefix_trie(conversations(spark, rows), trie.whole)) == brute(rows, False)


def test_one_conversation_that_all_share(spark):
    copies = spark.range(30_000).select((F.col("id") * 7).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("ä").alias("text"))
    got = {r["depth"]: r for r in trie.prefix_trie(copies).collect()}
    ids = ",".join(str(7 * i) for i in range(30_000))
    assert got[1]["ends_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    assert (got[0]["saved_tokens"], got[1]["n_convs"], got[0]["n_leaves"]) == (2 * 29_999, 30_000, 1)
