"""Detectors from SQL: a table function over any relation of pairs.

    SELECT * FROM score_pairs(TABLE(pairs), 'repetition', 0.4)
    SELECT * FROM score_pairs(TABLE(SELECT prompt FROM pairs), 'unsafe_prompt')

The result has the relation's columns, and score and flagged behind them (with leading underscores, if these names are
taken). The relation needs the columns of the detector (any others come along), the detector's name is a constant; both are
checked when the query is analysed. The threshold is a number; without one a constant threshold holds, and where there is none
flagged is null: a percentile needs all scores, and the function sees a row at a time, wherever it stands.

Scores are those of the Columns in ``detectors``, which are the faster way from DataFrames. Null texts are empty.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, NumericType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .detectors import REFUSALS, UNSAFE, length_ratio, refusal_bias, repetition, unsafe_prompt

NAME = "score_pairs"
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS), re.I)
_UNSAFE = [re.compile("|".join(f"(?:{p})" for p in patterns), re.I) for patterns in UNSAFE.values()]


def _single(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def _length_ratio(chosen: str, rejected: str) -> float:
    a, b = sorted((len(chosen.split()), len(rejected.split())))
    return _single(a / b) if b else 1.0


def _unique(text: str) -> float:
    tokens = [w.lower() for w in text.split()]
    return len(set(tokens)) / len(tokens) if tokens else 1.0


def _repetition(chosen: str, rejected: str) -> float:
    return _single(min(_unique(chosen), _unique(rejected)))


def _refusal_bias(chosen: str, rejected: str) -> float:
    return float(len(rejected.split()) >= 20 and _REFUSAL.search(chosen) is not None)


def _unsafe_prompt(prompt: str) -> float:
    return float(sum(p.search(prompt) is not None for p in _UNSAFE))


#: What a detector is, how a score of a row comes about, and how it meets a threshold.
SCORERS: dict[str, tuple] = {d.name: (d, score) for d, score in ((length_ratio(), _length_ratio), (repetition(), _repetition), (refusal_bias(), _refusal_bias), (unsafe_prompt(), _unsafe_prompt))}
_MEETS: dict[str, Callable[[float, float], bool]] = {"ge": lambda s, t: s >= t, "le": lambda s, t: s <= t, "lt": lambda s, t: s < t}


class _Scores:
    @staticmethod
    def analyze(pairs: AnalyzeArgument, detector: AnalyzeArgument, threshold: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pairs.isTable:
            raise ValueError("the first argument is a relation: TABLE(name) or TABLE(SELECT ...)")
        if detector.value not in SCORERS:
            raise ValueError(f"the detector is one of {', '.join(map(repr, SCORERS))}, not {detector.value!r}")
        if threshold is not None and not isinstance(threshold.dataType, NumericType):
            raise ValueError("the threshold is a number")
        schema = StructType(list(pairs.dataType.fields))
        kinds = {f.name: f.dataType for f in schema}
        for need in SCORERS[detector.value][0].needs:
            if not isinstance(kinds.get(need), StringType):
                raise ValueError(f"{detector.value} needs a text column {need}")
        taken = {n.lower() for n in kinds}
        for name, kind in (("score", DoubleType()), ("flagged", BooleanType())):
            while name in taken:
                name = f"_{name}"
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    def eval(self, pairs: Any, detector: str, threshold: Any = None) -> Iterator[tuple]:
        kind, score = SCORERS[detector]
        found = score(*[pairs[c] or "" for c in kind.needs])
        limit = kind.fixed_threshold if threshold is None else float(threshold)
        yield (*pairs, found, None if limit is None else _MEETS[kind.comparison](found, limit))


def register(spark: SparkSession) -> str:
    """Make the function known to a session's SQL; returns its name."""
    spark.udtf.register(NAME, udtf(_Scores))
    return NAME
