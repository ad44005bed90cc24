import duckdb
import numpy as np
import pytest

from pairsift.llm import vectors

KIND = "vec_id long, embedding array<float>, score string, chunk int"


def brute(rows, k, every):
    good = [(n, i, np.floor(256 * np.array(v, np.float64)).astype(object)) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i % every == 0:
            scored = sorted((-int(sum(q * c)), j) for m, j, c in good if m != n and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def check(spark, rows, k=5, every=3):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)
    assert sorted(map(tuple, vectors.top_k(frame, k, every).collect())) == brute(rows, k, every)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 40)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 700)
    monkeypatch.setattr(vectors, "AT_ONCE", 3)
    monkeypatch.setattr(vectors, "PACK_CHUNKS", 2)
    monkeypatch.setattr(vectors, "CHUNKS_A_GROUP", 2)
    rng = np.random.default_rng(2)
    check(spark, [(i, rng.normal(0, 0.3, 24).astype(np.float32).tolist()) for i in range(230)])


def test_ties_copies_and_odd_vectors(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(9)] + [(3, same), (3, same), (None, same), (10, None), (11, [0.5, None, 1.0]), (12, [float("inf"), 0.0, 0.0]), (13, [float("nan")] * 3), (15, [1.0, 2.0]), (18, []), (21, [0.0, 0.0, 0.0])]
    check(spark, rows)


def test_large_components_stay_exact(spark):
    check(spark, [(0, [900_001.0, 1.0]), (3, [900_003.0, -1.0]), (4, [900_002.5, 3.0]), (5, [-1.0, 900_000.0])], k=2)


def top(spark, rows, k):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)
    return sorted(map(tuple, vectors.top_k(frame, k, 3).collect()))


def exact(rows, k):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    out = []
    for n, (i, q) in enumerate(whole):
        if i % 3 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, c, strict=True)), j) for m, (j, c) in enumerate(whole) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def test_vectors_with_very_large_components_take_part(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SPAN", 8)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in (rng.normal(0, 1, 6) * rng.choice([1.0, 1e3, 3e6])).astype(np.float32)]) for i in range(90)]
    rows += [(200, [2.0**22, 0.0, 0.0, 0.0, -1.0, 0.0]), (201, [1_048_576.0, 0.0, 1.0, 0.0, 0.0, 0.0])]
    assert sum(max(map(abs, v)) >= 2**20 for _, v in rows) > 20
    assert top(spark, rows, 5) == exact(rows, 5)
    # products near the limit that cancel, and one that does not fit but is not among the best
    rows = [(0, [2.0**40, 2.0**40]), (1, [2.0**20, -(2.0**20)]), (2, [1.0, 2.0]), (4, [-(2.0**30), 1.0])]
    assert top(spark, rows, 2) == exact(rows, 2)
    assert top(spark, [(0, [1e38, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1e38])], 2) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_many_products_that_overflow_together_are_exact_or_an_error(spark):
    same = [float(2**19)] * 1000
    for last in (1.0, -1.0):
        with pytest.raises(Exception, match="does not fit in a long"):
            top(spark, [(0, same), (1, [last * x for x in same])], 1)
    rows = [(0, same), (1, [x * (-1) ** i for i, x in enumerate(same)])]
    assert top(spark, rows, 1) == exact(rows, 1)


def test_empty_table(spark):
    check(spark, [])
    check(spark, [(1, [1.0])])


def test_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-300, 300, (40, 50)), rng.integers(-300, 300, (60, 50))
    exact = a @ b.T
    for level in vectors.LEVELS:
        assert (vectors.segment_statistics(a, level) @ vectors.segment_statistics(b, level).T >= exact - 1e-6).all()


def test_pruning_leaves_few():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (8, 64))
    data = np.floor(256 * (centres[rng.integers(0, 8, 4000)] + rng.normal(0, 0.1, (4000, 64)))).astype(np.int32)
    best = vectors.Best(np.zeros(20, np.int64), np.arange(20, dtype=np.int32), data[:20], 5)
    for span in vectors.spans(np.arange(4000), data):
        best.meet(0, *span)
    assert best.survivors < 0.6 * 20 * 4000


def test_chunks_that_no_query_needs_are_not_sent(spark, monkeypatch, request):
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 2000)
    rng = np.random.default_rng(9)
    centres = np.repeat(rng.choice([-1.0, 1.0], (12, 16)), 4, axis=1)
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.05, 64)).astype(np.float32).tolist()) for i in range(1200)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)
    spark.conf.set("spark.sql.shuffle.partitions", "24")  # a range each, so chunks of fifty
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", "4"))
    chunks = vectors.checkpointed(vectors.packed(vectors.in_order(frame.select("vec_id", "embedding")), 256.0))
    blocks = vectors.checkpointed(vectors.query_blocks(vectors.home_queries(chunks, 3, 5)))
    sent, all_ = vectors.meetings(chunks, blocks).count(), chunks.count() * blocks.count()
    assert blocks.count() > 5 and sent < 0.4 * all_
    check(spark, rows)


def test_ranges_bound_every_product():
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e3):
        data, queries = np.floor(scale * rng.normal(1, 3, (500, 37))), np.floor(scale * rng.normal(-1, 3, (20, 37)))
        stats = vectors.segment_statistics(data, 16)
        n = stats.shape[1] // 2
        ranges = np.concatenate([stats[:, :n].min(axis=0), stats[:, :n].max(axis=0), stats[:, n:].max(axis=0)])[None, :]
        top = (queries @ data.T).max(axis=1)
        assert all(vectors.may_hold(q[None, :], np.array([t]), ranges)[0] for q, t in zip(queries, top, strict=True))
    assert not vectors.may_hold(queries, top * 100 + 1e9, ranges)[0]


def test_query_equals_sql(spark):
    pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert sorted(map(tuple, vectors.op7_topk(spark, folder).select("query_id", "rank", "vec_id", "score").collect())) == sorted(connection.sql(f"SELECT query_id, rank, vec_id, score FROM ({vectors.ORACLE_OP7})").fetchall())
