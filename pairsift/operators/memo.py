"""Judge answers that are kept: each distinct request is asked once, whatever asks it and however often.

A request is told by the SHA-256 of all that a backend gets: model, parameters, instructions and message. Answers are rows
(key, response) of a table that only grows. Pairs whose key is not there are asked, one call a key, in portions of
``portion`` keys, each appended to the table when it is done: a run that fails goes on behind its last portion.

A call that raises is tried again, ``attempts`` times in all, after waits that double (and differ by key and attempt, so that
calls do not come in waves). One that still fails is an error of its pair in this run, and no answer is stored: the
next run asks again. ``calls_per_second`` holds for all tasks together: a portion is dealt to as many tasks as the session has
cores, and each spaces its calls by its share.

Nulls and edges: null texts are empty; an answer of None is stored as JSON null, which the judge counts as an error; a key that
two runs have asked at the same time has two answers, of which the smaller counts. Executors that are lost may have asked
what is asked again.
"""

from __future__ import annotations

import threading
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backends import JudgeRequest
from .judge import judge_prompt

ANSWER = "key string, response string"


@dataclass(frozen=True)
class Asking:
    attempts: int = 4
    first_wait: float = 0.5  # seconds, doubled after each attempt
    calls_per_second: float | None = None  # over all tasks; None: no limit
    portion: int = 10_000


def request_key(message: Column, request: JudgeRequest = JudgeRequest()) -> Column:
    """The SHA-256 of a request with this message."""
    rest = f"{request.model}\n{request.temperature}\n{request.max_tokens}\n{request.json_mode}\n{request.system}\n"
    return F.sha2(F.concat(F.lit(rest), message).cast("binary"), 256)


class _Pace:
    """Lets calls of several threads through, so many a second."""

    def __init__(self, rate: float | None) -> None:
        self.gap, self.next, self.lock = 1 / rate if rate else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        time.sleep(max(0.0, at - now))


def _asked(missing: DataFrame, factory: Callable, request: JudgeRequest, asking: Asking, tasks: int) -> DataFrame:
    """key and response of all requests (key, message) that could be answered."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pace = factory(request), _Pace(asking.calls_per_second and asking.calls_per_second / tasks)

        def one(key: str, message: str) -> tuple[str, str] | None:
            for attempt in range(asking.attempts):
                pace.wait()
                try:
                    answer = model(request.messages(message))
                    return key, "null" if answer is None else answer
                except Exception:  # a failing call costs its own pair only
                    if attempt + 1 < asking.attempts:
                        spread = 0.5 + zlib.crc32(f"{key}{attempt}".encode()) / (1 << 32)
                        time.sleep(asking.first_wait * 2**attempt * spread)
            return None

        with ThreadPoolExecutor(request.concurrency) as pool:
            for batch in batches:
                found = [x for x in pool.map(one, batch["key"].to_pylist(), batch["message"].to_pylist()) if x is not None]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["key", "response"])

    return missing.repartition(tasks, "key").mapInArrow(ask, ANSWER)


def stored_answers(pairs: DataFrame, folder: str) -> DataFrame:
    """key and response, one row a key."""
    spark = pairs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    rows = spark.read.schema(ANSWER).parquet(folder) if there else spark.createDataFrame([], ANSWER)
    return rows.groupBy("key").agg(F.min("response").alias("response"))


def with_kept_responses(pairs: DataFrame, factory: Callable[[JudgeRequest], Callable[[list[dict[str, str]]], str | None]], folder: str, request: JudgeRequest = JudgeRequest(), asking: Asking = Asking()) -> DataFrame:
    """The pairs with the judge's response to each, from the answers in ``folder`` and, for requests that are not there, from the backend."""
    spark = pairs.sparkSession
    keyed = pairs.withColumn("__message", judge_prompt()).withColumn("__key", request_key(F.col("__message"), request))
    wanted = keyed.select(F.col("__key").alias("key"), F.col("__message").alias("message")).dropDuplicates(["key"])
    missing = wanted.join(stored_answers(pairs, folder).select("key"), "key", "left_anti")
    portions = -(-missing.count() // asking.portion)
    tasks = spark.sparkContext.defaultParallelism
    for k in range(portions):
        # what a portion has appended changes none of the others: they are drawn by the key alone
        mine = missing.filter(F.pmod(F.xxhash64("key"), F.lit(portions)) == k)
        _asked(mine, factory, request, asking, tasks).write.mode("append").parquet(folder)
    answers = stored_answers(pairs, folder).withColumnRenamed("key", "__key")
    return keyed.join(answers, "__key", "left").withColumn("response", F.coalesce("response", F.lit("null"))).drop("__key", "__message")
