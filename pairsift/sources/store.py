"""Parquet tables: appends, overwrites, transactions, keyed latest rows, and consecutive ids.

Signals are partitioned by detector and run, so a report or a flag lookup reads only the runs it needs; their metadata is a
variant, whose fields are read by path and type. An overwrite
writes next to the table and renames twice; between the renames there is no table for a moment, and if the second one
fails the old table is put back. Appends inside a transaction are written aside and moved into their tables at its end,
or deleted if it fails.

Both first write down what they are about to move, in one file that appears whole, and delete it when all is in place. If the
driver dies in between, the next store that is opened there moves the rest: a transaction comes about whole or not at all, over
all its tables. There is one writer at a time: ids count on from the largest one, without a lock.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType, VariantType

SCHEMAS = {
    "examples": "id long, dataset_index long, chosen_full string, rejected_full string, chosen_last_assistant string, rejected_last_assistant string, prompt string, created_at timestamp_ntz",
    "quality_signals": "id long, example_id long, score double, flagged boolean, metadata variant, created_at timestamp_ntz, detector_name string, run_id long",
    "detector_runs": "id long, detector_name string, threshold double, percentile_used double, total_examples long, flagged_count long, stats string, started_at timestamp_ntz, completed_at timestamp_ntz",
    "reward_models": "id long, name string, dataset_filter string, training_config string, metrics string, model_path string, created_at timestamp_ntz",
    "evaluations": "id long, reward_model_id long, eval_type string, results string, created_at timestamp_ntz",
    "reviews": "id long, example_id long, detector_name string, label string, created_at timestamp_ntz, updated_at timestamp_ntz",
}
PARTITIONS = {"quality_signals": ["detector_name", "run_id"]}


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, where checkpoints go too: ``spark.checkpoint.dir``; in a local session without it, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = context.getConf().get("spark.checkpoint.dir")
        if root is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="pairsift-"))
    return context.getCheckpointDir().rstrip("/")


def stored(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: what is read again and again, and must outlive an executor."""
    folder = shared_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for tables, deleted when the driver ends."""
    folder = f"{shared_root(spark)}/store-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return folder


def with_ids(df: DataFrame, order: str, start: int = 1) -> DataFrame:
    """The rows with consecutive ids in the order of a column, without sorting all of them in one task.

    Rows are range-partitioned and numbered inside each partition; counts of the partitions, one row each, give the
    starts. The dealt rows are checkpointed, as another run of the sampling could deal them otherwise.
    """
    shared_root(df.sparkSession)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, order).withColumn("__part", F.spark_partition_id()).checkpoint()
    inside = F.row_number().over(W.partitionBy("__part").orderBy(order))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))
    return dealt.join(F.broadcast(starts), "__part").withColumn("id", (inside + F.col("__before") + (start - 1)).cast("long")).drop("__part", "__before")


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last event of each key."""
    return log.withColumn("__at", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__at = 1").drop("__at")


class Store:
    """The six tables under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._aside: dict[str, list[str]] | None = None  # folders of an open transaction, by table
        self.recover()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _files(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        where, files = self._files(self.path(name))
        return files.exists(where)

    def read(self, name: str) -> DataFrame:
        """The rows of a table; inside a transaction with what it has added."""
        schema = StructType.fromDDL(SCHEMAS[name])
        rows = self.spark.read.schema(schema).parquet(self.path(name)).select(*schema.names) if self.exists(name) else self.spark.createDataFrame([], schema)
        for folder in (self._aside or {}).get(name, []):
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(folder).select(*schema.names))
        return rows

    def _full(self, name: str, rows: DataFrame, order: str) -> DataFrame:
        """The rows with new ids and all columns of the table; those that are missing are null."""
        start = (self.read(name).agg(F.max("id")).first()[0] or 0) + 1
        numbered = with_ids(rows.drop("id"), order, start)
        stamped = numbered if "created_at" in numbered.columns else numbered.withColumn("created_at", F.to_timestamp_ntz(F.current_timestamp().cast("string")))
        kinds = dict(stamped.dtypes)

        def column(name: str, kind: DataType) -> Column:
            if name not in kinds:
                return F.lit(None).cast(kind)
            # a text is read as JSON; cast, it would be a variant of a text
            return F.try_parse_json(name) if isinstance(kind, VariantType) and kinds[name] == "string" else F.col(name).cast(kind)

        return stamped.select(*[column(f.name, f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS[name])])

    def append(self, name: str, rows: DataFrame, order: str) -> DataFrame:
        """Add rows with new ids. Returns the rows as written."""
        full = self._full(name, rows, order)
        folder = self.path(name)
        if self._aside is not None:
            folder = f"{self.root}/.{name}-{uuid.uuid4().hex}"
            self._aside.setdefault(name, []).append(folder)
        full.write.mode("append").partitionBy(*PARTITIONS.get(name, [])).parquet(folder)
        return full

    def replace_partitions(self, name: str, rows: DataFrame, order: str) -> None:
        """Add rows, in place of all that their partitions held, so a repeated write leaves no row twice."""
        full = self._full(name, rows, order)
        full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS[name]).parquet(self.path(name))

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Appends inside come into the tables together at the end, or not at all if something fails before."""
        if self._aside is not None:
            raise RuntimeError("a transaction is open already")
        self._aside = {}
        try:
            yield
        except BaseException:
            aside, self._aside = self._aside, None
            for folder in (f for folders in aside.values() for f in folders):
                self._delete(folder)
            raise
        aside, self._aside = self._aside, None
        self._commit([{"kind": "append", "table": name, "aside": folder} for name, folders in aside.items() for folder in folders])

    def _delete(self, path: str) -> None:
        where, files = self._files(path)
        files.delete(where, True)

    def _commit(self, steps: list[dict[str, str]]) -> None:
        """Write the steps down, take them, and forget them."""
        if not steps:
            return
        path = f"{self.root}/.intent-{uuid.uuid4().hex}"
        where, files = self._files(f"{path}.part")
        stream = files.create(where, True)
        stream.write(bytearray(json.dumps(steps).encode()))
        stream.close()
        files.rename(where, self._files(path)[0])
        self._take(path, steps)

    def _take(self, path: str, steps: list[dict[str, str]]) -> None:
        """Take the steps of an intent as far as they have not been taken, and delete it."""
        for step in steps:
            aside, files = self._files(step["aside"])
            if step["kind"] == "append":
                if files.exists(aside):
                    self._move(step["aside"], self.path(step["table"]))
                    files.delete(aside, True)
                continue
            now, old = self._files(self.path(step["table"]))[0], self._files(step["old"])[0]
            if files.exists(aside):
                if files.exists(now) and not files.rename(now, old):
                    self._delete(path)
                    raise OSError(f"could not move {self.path(step['table'])} aside")
                if not files.rename(aside, now):
                    if files.exists(old):
                        files.rename(old, now)
                    self._delete(path)
                    raise OSError(f"could not move {step['aside']} into place")
            files.delete(old, True)
        self._delete(path)

    def recover(self) -> int:
        """Take the rest of what a driver that died had written down; returns how many intents there were."""
        where, files = self._files(f"{self.root}/.intent-*")
        found = [x.getPath() for x in files.globStatus(where) or [] if not x.getPath().getName().endswith(".part")]
        for path in sorted(found, key=lambda p: p.getName()):
            stream = files.open(path)
            steps = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            self._take(path.toString(), steps)
        return len(found)

    def _move(self, source: str, target: str) -> None:
        """Move the data files of a folder into another one; their names hold a job's id, so none is there twice."""
        start, files = self._files(source)
        found, moves = files.listFiles(start, True), []
        base = files.makeQualified(start).toString()
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().startswith("part-"):
                moves.append((path, f"{target}{path.toString().removeprefix(base)}"))
        for path, to in moves:
            end = self._files(to)[0]
            files.mkdirs(end.getParent())
            if not files.rename(path, end):
                raise OSError(f"could not move {path.toString()} into place")

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """Replace a table: write aside, then rename."""
        aside, old = f"{self.root}/.{name}-{uuid.uuid4().hex}", f"{self.root}/.{name}-old-{uuid.uuid4().hex}"
        rows.write.partitionBy(*PARTITIONS.get(name, [])).parquet(aside)
        self._commit([{"kind": "replace", "table": name, "aside": aside, "old": old}])

    def update_run(self, run_id: int, **values: object) -> None:
        """Set columns of a run; ValueError if it does not exist."""
        runs = self.read("detector_runs")
        self.overwrite("detector_runs", updated(runs, run_id, values))

    def insert(self, name: str, /, **values: object) -> int:
        """Add one row; returns its id. ValueError for a column that the table does not have."""
        schema = StructType.fromDDL(SCHEMAS[name])
        unknown = set(values) - set(schema.names)
        if unknown:
            raise ValueError(f"{name} has no columns {', '.join(sorted(unknown))}")
        row = self.spark.range(1).select(*[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in schema if f.name in values], F.lit(0).alias("__order"))
        start = (self.read(name).agg(F.max("id")).first()[0] or 0) + 1
        self.append(name, row, "__order")
        return start

    def get(self, name: str, row_id: int) -> dict | None:
        """The row with this id."""
        found = self.read(name).filter(F.col("id") == row_id).first()
        return None if found is None else found.asDict()


def updated(rows: DataFrame, row_id: int, values: dict[str, object]) -> DataFrame:
    """The rows with columns of one id set; ValueError if no row has it."""
    if not rows.filter(F.col("id") == row_id).take(1):
        raise ValueError(f"id {row_id} not found")
    types = dict(rows.dtypes)
    return rows.withColumns({c: F.when(F.col("id") == row_id, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in values.items()})


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: what a unique constraint would refuse."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
