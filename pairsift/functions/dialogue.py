"""Two-party dialogues: ``Human:`` and ``Assistant:`` at line starts begin a turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, present, stripped

#: d: only a line feed ends a line.
SPEAKER = rf"(?md)^(Human|Assistant):{SPACE}*"


def parse_turns(text: Column | str) -> Column:
    """An array of (role, content); what stands before the first tag is dropped, contents are stripped."""
    text = present(text)
    parts = F.split(text, SPEAKER, -1)
    return F.transform(F.regexp_extract_all(text, F.lit(SPEAKER), F.lit(1)), lambda role, i: F.struct(F.lower(role).alias("role"), stripped(F.get(parts, i + 1)).alias("content")))


def _of(turns: Column, role: str) -> Column:
    return F.filter(turns, lambda t: t["role"] == role)


def last_turn(turns: Column, role: str) -> Column:
    """The content of the last turn of a role; empty if it has none."""
    return F.coalesce(F.try_element_at(_of(turns, role), F.lit(-1))["content"], F.lit(""))


def all_turns(turns: Column, role: str) -> Column:
    """The contents of a role's turns, joined by line feeds."""
    return F.array_join(F.transform(_of(turns, role), lambda t: t["content"]), "\n")


def count_turns(turns: Column) -> Column:
    return F.struct(F.size(_of(turns, "human")).alias("human"), F.size(_of(turns, "assistant")).alias("assistant"))
