"""Fill-in-the-middle: each text is cut at two drawn places and its parts are put in another order, in DataFrame operations only.

A text has n units (code points, words or lines). A unit begins at a character if it and the one before it are of given
kinds, so whether one begins there is seen from two neighbours. The cuts stand after lo and hi units, 0 <= lo <= hi <= n,
drawn from a hash of the seed and the id.

A text longer than ``chunk_bytes`` is cut into chunks of so many bytes, moved on to the next whole character, each with
the character before it. The chunks are rows that are dealt to all tasks, and each is counted alone. Prefix sums over a
text's counts (numbers, one for each chunk) tell how many units it has and which chunks hold the two cuts; only those two
are read again, to find the byte of each cut. A text of one chunk is its own owner, and is never moved.

Forms: ``psm`` is prefix, suffix, middle behind their marks, ``spm`` is suffix, prefix, middle. A text that is empty, or
holds a mark itself, or is drawn to stay, is ``plain``. As no text with a mark is cut, an output is split at its marks
without a doubt, and ``restored`` gives back the text.

Nulls and edges: a null text is empty; a null id draws as the empty id; rows of one id and text draw alike, rows of
one id and other texts by their own lengths. What stands before the first unit (spaces before the first word) goes with the
prefix, or with what follows if the prefix has no unit. Texts must be UTF-8. Columns of the input are kept whatever
they are called, and the new one, ``infill``, takes leading underscores if its name is taken.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import boxed, table

#: The kinds of the character before and of the one that a unit begins at, as regular expressions; None: any two.
UNITS = {"char": None, "word": (r"\s", r"\S"), "line": (r"\n", r"[\s\S]")}
#: Stands for the character before a text's first.
_BEFORE_ALL = "\n"


@dataclass(frozen=True)
class InfillSettings:
    seed: int = 1
    unit: str = "char"
    cut_percent: int = 90  # the rest stays plain
    spm_percent: int = 20  # of the texts that are cut
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"
    chunk_bytes: int = 1 << 16

    def __post_init__(self) -> None:
        marks = (self.prefix_mark, self.suffix_mark, self.middle_mark)
        if self.unit not in UNITS:
            raise ValueError(f"unit must be one of {', '.join(UNITS)}")
        if self.chunk_bytes < 4:
            raise ValueError("a chunk holds a whole character: 4 bytes at least")
        overlap = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b)))
        if not all(marks) or len(set(marks)) < 3 or overlap or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("marks must be three texts, none empty, that neither hold nor overlap each other or themselves")


def _starts(body: Column, chunk_bytes: int) -> Column:
    """The byte that each chunk begins at (the next one that begins a character), and the text's end."""
    size = F.octet_length(body)
    raw = F.transform(F.sequence(F.lit(0), F.ceil(size / chunk_bytes).cast("int")), lambda c: F.least(c * chunk_bytes, size).cast("int"))
    # bytes 80 to BF go on with a character
    return F.transform(raw, lambda at: at + F.shiftright(F.octet_length(F.regexp_extract(F.hex(F.substring(body, at + 1, F.lit(3))), "^(?:[89AB].)*", 0)), 1))


def _chunks(body: Column, starts: Column) -> Column:
    """For each chunk the byte of the character before it (its own, if there is none), where it begins and where it ends."""

    def one(start: Column, at: Column) -> Column:
        last = F.regexp_extract(F.hex(F.substring(body, start - 3, F.lit(4))), "^(?:..)*?([0-7C-F].(?:[89AB].)*)$", 1)
        before = F.when(start > 0, start - F.shiftright(F.octet_length(last), 1)).otherwise(0)
        return F.struct(before.alias("before"), start.alias("start"), F.get(starts, at + 1).alias("end"))

    return F.transform(F.slice(starts, 1, F.size(starts) - 1), one)


def chunk_text(body: Column, before: Column, start: Column, end: Column) -> Column:
    """A chunk's characters, and before them the one that stands there (at a text's start, a line feed)."""
    text = F.substring(body, before + 1, end - before).cast("string")
    return F.when(start > 0, text).otherwise(F.concat(F.lit(_BEFORE_ALL), text))


def boundaries(piece: Column, unit: str) -> Column:
    """How many units begin in a piece, whose first character only stands for what is before."""
    if UNITS[unit] is None:
        return F.length(piece).cast("long") - 1
    before, at = UNITS[unit]
    return F.regexp_count(piece, F.lit(f"(?<={before}){at}")).cast("long")


def boundary_byte(piece: Column, rank: Column, unit: str) -> Column:
    """The byte, from the piece's second character on, of the unit of this rank (from 0) in it."""
    rank = rank.cast("int")
    own = F.octet_length(F.substring(piece, F.lit(1), F.lit(1)))
    if UNITS[unit] is None:
        return F.octet_length(F.substring(piece, F.lit(1), rank + 1)) - own
    before, at = UNITS[unit]
    rest = F.element_at(F.split(piece, f"(?<={before})(?={at})", rank + 2), -1)
    return F.octet_length(piece) - F.octet_length(rest) - own


def drawn(seed: int, id_: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of the seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _ranks(total: Column) -> tuple[Column, Column]:
    one, two = F.col("h1") % (total + 1), F.col("h2") % (total + 1)
    return F.least(one, two), F.greatest(one, two)


def _routes(long: DataFrame, s: InfillSettings) -> DataFrame:
    """key, total, and for each cut the place of its owning chunk and the rank inside that: one row for each long text."""
    at = F.posexplode(_chunks(F.col("body"), F.col("starts"))).alias("chunk", "at")
    rows = long.withColumn("starts", _starts(F.col("body"), s.chunk_bytes)).select("key", "h1", "h2", "body", at).select("key", "h1", "h2", "chunk", "at", chunk_text(F.col("body"), F.col("at.before"), F.col("at.start"), F.col("at.end")).alias("piece"))
    # dealt out, so that one very long text is counted by many tasks; copies of one text from different places part
    dealt = rows.withColumn("spot", F.spark_partition_id()).repartition("key", "chunk", "spot")
    counted = dealt.select("key", "h1", "h2", "chunk", "at", boundaries(F.col("piece"), s.unit).alias("n"))
    counted = counted.groupBy("key", "chunk").agg(*[F.max(c).alias(c) for c in ("h1", "h2", "at", "n")])
    whole = W.partitionBy("key")
    upto = whole.orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = counted.withColumns({"base": F.sum("n").over(upto) - F.col("n"), "total": F.sum("n").over(whole)})
    routed = []
    for name, rank in zip(("lo", "hi"), _ranks(F.col("total"))):
        owns = (rank >= F.col("base")) & (rank < F.col("base") + F.col("n"))
        routed += [F.max(F.when(owns, F.col("at"))).alias(f"{name}_at"), F.max(F.when(owns, rank - F.col("base"))).alias(f"{name}_rank")]
    return summed.groupBy("key").agg(F.max("total").alias("total"), *routed)


def fill_in_middle(docs: DataFrame, settings: InfillSettings = InfillSettings()) -> DataFrame:
    """The rows of docs (doc_id, text and others) with ``infill``: n, form, prefix_units and middle_units (null if plain), and output."""
    s = settings
    name = "infill"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = boxed(docs, text.cast("binary").alias("body"), *[h.alias(f"h{k + 1}") for k, h in enumerate(drawn(s.seed, F.col("doc_id")))])
    marked = F.lit(False)
    for mark in (s.prefix_mark, s.suffix_mark, s.middle_mark):
        marked = marked | F.col("body").cast("string").contains(mark)
    form = F.when((F.octet_length("body") == 0) | marked | (F.col("h3") % 100 >= s.cut_percent), "plain").when(F.col("h4") % 100 < s.spm_percent, "spm").otherwise("psm")
    is_long = F.octet_length("body") > s.chunk_bytes
    columns = ["row", "body", "h1", "h2", "h3", "h4", "total", "lo_at", "lo_rank", "hi_at", "hi_rank"]
    size = F.octet_length("body")
    alone = F.struct(F.lit(0).alias("before"), F.lit(0).alias("start"), size.alias("end"))
    lone = rows.filter(~is_long).withColumn("total", boundaries(chunk_text(F.col("body"), F.lit(0), F.lit(0), size), s.unit))
    for cut, rank in zip(("lo", "hi"), _ranks(F.col("total"))):
        lone = lone.withColumns({f"{cut}_at": alone, f"{cut}_rank": F.when(rank < F.col("total"), rank)})
    long = rows.filter(is_long).withColumn("key", F.struct("h1", "h2", F.sha2("body", 256).alias("sha")))
    # one row a key on the right, so a key with many rows is split by adaptive execution
    long = long.join(_routes(long, s), "key")
    cut = lone.select(columns).unionByName(long.select(columns)).withColumn("form", form)
    lo, hi = _ranks(F.col("total"))
    ends = {}
    for which, rank in (("lo", lo), ("hi", hi)):
        before, start, end, inside = (F.col(f"{which}_{c}") for c in ("at.before", "at.start", "at.end", "rank"))
        found = start + boundary_byte(chunk_text(F.col("body"), before, start, end), inside, s.unit)
        # after no unit: the start; after all of them: the end
        ends[f"{which}_byte"] = F.when(F.col("form") == "plain", None).when(rank == 0, 0).when(inside.isNull(), size).otherwise(found).cast("int")
    cut = cut.withColumns(ends)
    part = lambda a, b: F.substring("body", a + 1, b - a).cast("string")
    prefix, middle, suffix = part(F.lit(0), F.col("lo_byte")), part(F.col("lo_byte"), F.col("hi_byte")), part(F.col("hi_byte"), size)
    psm = F.concat(F.lit(s.prefix_mark), prefix, F.lit(s.suffix_mark), suffix, F.lit(s.middle_mark), middle)
    spm = F.concat(F.lit(s.suffix_mark), suffix, F.lit(s.prefix_mark), prefix, F.lit(s.middle_mark), middle)
    output = F.when(F.col("form") == "plain", F.col("body").cast("string")).when(F.col("form") == "psm", psm).otherwise(spm)
    is_cut = F.col("form") != "plain"
    fields = [F.col("total").alias("n"), F.col("form"), F.when(is_cut, lo).alias("prefix_units"), F.when(is_cut, hi - lo).alias("middle_units"), output.alias("output")]
    return cut.select("row.*", F.struct(*fields).alias(name))


def restored(output: Column, form: Column, settings: InfillSettings = InfillSettings()) -> Column:
    """The text that an output was made of."""
    marks = (settings.prefix_mark, settings.suffix_mark, settings.middle_mark)
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    part = lambda *at: F.concat(*[F.get(parts, F.lit(i)) for i in at])
    return F.when(form == "plain", output).when(form == "psm", part(1, 3, 2)).otherwise(part(2, 3, 1))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut by code points, and the digests of its output and of the text rebuilt from that."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    out = fill_in_middle(docs).select("doc_id", "infill.*")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE_OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, left(text, least(a, b)) AS pre,
         substring(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid, substring(text, greatest(a, b) + 1) AS suf
  FROM r
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
