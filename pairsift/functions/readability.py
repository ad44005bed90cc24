"""Flesch-Kincaid grade (Kincaid 1975), with syllables by letter patterns and sentences that abbreviations do not end.

A text without words has neither term, so its grade is the constant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .syllables import sentences, syllables
from .text import present


def fk_grade(text: Column | str, tokens: Column) -> Column:
    text, n = present(text), F.size(tokens)
    return F.when(n > 0, F.lit(0.39) * n / sentences(text) + F.lit(11.8) * syllables(text) / n).otherwise(0.0) - 15.59
