"""Reading raw dialogue pairs from files, by split and with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import with_ids

RAW = "chosen string, rejected string"
#: Endings of the files of each format.
ENDINGS = {"json": ("jsonl", "json", "jsonl.gz", "json.gz"), "parquet": ("parquet",)}


def load_pairs(spark: SparkSession, folder: str, split: str = "train", form: str = "json") -> DataFrame:
    """dataset_index, chosen and rejected of a split: the files ``folder/split/*`` and ``folder/split.*`` and ``folder/split-*``.

    The index counts the rows from 0 in the order of the files' names and of the rows in them, however the files are cut
    into tasks. Rows that are no objects have null texts, which ingest counts as errors. ValueError for another format
    (json: one object a line, gzip or not; parquet), LookupError for a split without files.
    """
    if form not in ENDINGS:
        raise ValueError(f"format must be one of {', '.join(ENDINGS)}")
    root = folder.rstrip("/")
    jvm, found = spark._jvm, []
    for pattern in [f"{root}/{split}{sep}*.{end}" for end in ENDINGS[form] for sep in ("/", "-")] + [f"{root}/{split}.{end}" for end in ENDINGS[form]]:
        where = jvm.org.apache.hadoop.fs.Path(pattern)
        hits = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
        found += [h.getPath().toString() for h in hits]
    if not found:
        raise LookupError(f"no {form} files of split {split} in {folder}")
    rows = spark.read.schema(RAW).format(form).load(sorted(set(found)))
    # inside a file rows are read in order, block by block
    placed = rows.select("chosen", "rejected", F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"))
    return with_ids(placed, "place", 0).select(F.col("id").alias("dataset_index"), "chosen", "rejected")
