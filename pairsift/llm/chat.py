"""Chat formatting with typed content parts.

A visitor walks the parts of each turn (text, image, audio, document) and flattens them into one string: texts are
escaped, the others become numbered placeholders. It records each attachment's reference, place and the tokens its
placeholder expands to, and the code-point spans that training loss covers (the texts of assistant turns).

Template: ``<|start|>role<|message|>content<|end|>`` and a line feed for each turn. Escaping puts a backslash after
the first character of every control string (and of what looks like an escaped one), so no control string is left
inside a text and one backslash less gives the text back, whatever it holds. Text parts without an attachment between
them are escaped as the one text that they will be read as, so none can be put together from several parts.

Nulls and edges: null texts and roles are empty; turns are ordered by (turn, role, parts), nulls first, and repeated
turns stay; rows with a null conversation id are one conversation; null parts are left out; a part without a type, or of
another one than the four, is an attachment of the kind ``unknown`` and one token. A conversation is one value, so it is
put together in one task, however long; different conversations never meet.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, table

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"

_AFTER_ANGLE, _AFTER_SQUARE = r"\|", r"/?INST\]"
_AFTER_ANGLE += r"|/?s>|</?SYS>>"
_ESCAPE = re.compile(rf"<(?=\\*(?:{_AFTER_ANGLE}))|\[(?=\\*(?:{_AFTER_SQUARE}))")
_UNESCAPE = re.compile(rf"<\\(?=\\*(?:{_AFTER_ANGLE}))|\[\\(?=\\*(?:{_AFTER_SQUARE}))")
_TURN = re.compile(r"<\|start\|>(.*?)<\|message\|>(.*?)<\|end\|>\n", re.S)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document|unknown) \d+\|>")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0], text)


@dataclass(frozen=True)
class ChatSettings:
    patch: int = 28  # pixels a side of the square that makes one image token
    audio_rate: float = 25.0  # tokens a second
    page_tokens: int = 256  # tokens of a document page
    loss_roles: tuple[str, ...] = ("assistant",)
    tokenizer_file: str | None = None  # a tokenizers JSON file on every worker; without it texts have no token count


class PartVisitor:
    """Flattens the parts of one conversation; ``finish`` gives the formatted text and what was recorded."""

    def __init__(self, settings: ChatSettings, tokenizer: object | None = None) -> None:
        self.settings, self.tokenizer = settings, tokenizer
        self.pieces: list[str] = []
        self.length = self.tokens = 0
        self.text: list[str] = []  # of neighbouring text parts
        self.spans: list[dict] = []
        self.attachments: list[dict] = []

    def emit(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def turn(self, role: str | None, parts: Iterable[dict | None] | None) -> None:
        role = role or ""
        self.emit(f"{START}{escape(role)}{MESSAGE}")
        learned = role in self.settings.loss_roles
        for part in parts or ():
            if part is not None and part["type"] == "text":
                self.visit_text(part)
            elif part is not None:
                self.flush(learned)
                {"image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(part["type"], self.visit_unknown)(part)
        self.flush(learned)
        self.emit(f"{END}\n")

    def visit_text(self, part: dict) -> None:
        self.text.append(part["text"] or "")

    def flush(self, learned: bool) -> None:
        """Emit the text parts since the last attachment."""
        text = escape("".join(self.text))
        self.text.clear()
        if self.tokenizer is not None:
            self.tokens += len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if learned and text:
            self.spans.append({"start": self.length, "end": self.length + len(text)})
        self.emit(text)

    def visit_image(self, part: dict) -> None:
        patch = self.settings.patch
        self.attach("image", part, math.ceil((part["width"] or patch) / patch) * math.ceil((part["height"] or patch) / patch))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part["seconds"] or 0) * self.settings.audio_rate))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part["pages"] or 1) * self.settings.page_tokens)

    def visit_unknown(self, part: dict) -> None:
        self.attach("unknown", part, 1)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        tokens = max(1, tokens)
        self.attachments.append({"ordinal": len(self.attachments), "kind": kind, "ref": part["ref"], "place": self.length, "tokens": tokens})
        self.tokens += tokens
        self.emit(f"<|{kind} {len(self.attachments) - 1}|>")

    def finish(self) -> dict:
        return {"formatted": "".join(self.pieces), "spans": self.spans, "attachments": self.attachments, "tokens": self.tokens}


_FORMATTED = "struct<formatted:string,spans:array<struct<start:long,end:long>>,attachments:array<struct<ordinal:int,kind:string,ref:string,place:long,tokens:long>>,tokens:long>"


def _arrow(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    return to_arrow_type(DataType.fromDDL(ddl))


def format_conversations(rows: DataFrame, settings: ChatSettings = ChatSettings()) -> DataFrame:
    """conv_id, formatted, spans, attachments and tokens from rows of (conv_id, turn, role, parts)."""
    limit_batches(rows.sparkSession)
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))
    kind = _arrow(_FORMATTED)

    def run(batch: pa.Array) -> pa.Array:
        tokenizer = None
        if settings.tokenizer_file is not None:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(settings.tokenizer_file)
            tokenizer.encode_special_tokens = True
        out = []
        for i in range(len(batch)):
            visitor = PartVisitor(settings, tokenizer)
            for turn in batch[i].as_py():
                visitor.turn(turn["role"], turn["parts"])
            out.append(visitor.finish())
        return pa.array(out, kind)

    return turns.select("conv_id", F.arrow_udf(run, _FORMATTED)("turns").alias("out")).select("conv_id", "out.*")


def text_parts(text: str) -> Column:
    """The parts of a plain text column: one text part, empty for null."""
    fields = [F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    rest = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(*fields, *rest))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that a formatted conversation holds; attachments have no text."""
    return [(unescape(role), "".join(unescape(x) for x in _PLACEHOLDER.split(body))) for role, body in _TURN.findall(formatted)]


_DIGEST = "struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string,formatted_chars:long>"


def digests(formatted: Column, spans: Column) -> Column:
    """What the formatted text and its loss spans hold, read back."""
    kind = _arrow(_DIGEST)

    def run(texts: pa.Array, masks: pa.Array) -> pa.Array:
        out = []
        for i in range(len(texts)):
            text = texts[i].as_py()
            turns = read_turns(text)
            told = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest()
            learned = "".join(unescape(text[s["start"] : s["end"]]) for s in masks[i].as_py())
            out.append({"n_turns": len(turns), "turns_sha256": told, "loss_chars": len(learned), "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(), "formatted_chars": len(text)})
        return pa.array(out, kind)

    return F.arrow_udf(run, _DIGEST)(formatted, spans)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and the digests of every conversation, and of one whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    formatted = format_conversations(rows.unionByName(probe).select("conv_id", "turn", "role", text_parts("text").alias("parts")))
    return formatted.select("conv_id", digests(F.col("formatted"), F.col("spans")).alias("d")).select("conv_id", "d.*")


#: The same digests from the rows alone: what the formatted text must give back.
ORACLE_OP1 = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(regexp_replace(role || text, '<(\\\\*)(\\||/?s>|</?SYS>>)|\\[(\\\\*)(/?INST\\])', 'xx\\0', 'g')) - length(role || text) AS marks
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(text) + marks // 2 + 28) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
