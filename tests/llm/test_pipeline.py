import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairsift.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontaminate", "mix"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]
    assert out.join(docs, ["doc_id", "text"], "left_anti").count() == 0
    assert 0 < out.select("doc_id").distinct().count() < docs.count()


def test_each_stage_takes_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1)).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF).cache()
        assert kept.columns == docs.columns, name
        assert kept.exceptAll(docs).count() == 0, name
        docs = kept


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame, found = queries.QUERIES[name](spark, SF), connection.sql(queries.ORACLES[name])
    names = sorted(frame.columns)
    assert sorted(found.columns) == names
    got = sorted(repr([r[c] for c in names]) for r in frame.collect())
    assert got == sorted(repr([r[found.columns.index(c)] for c in names]) for r in found.fetchall())


def test_nothing_outside_needs_the_subpackage():
    import subprocess
    import sys

    code = "import sys; import pairsift.queries, pairsift.oracles; assert not any(m.startswith('pairsift.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
