"""The judge's prompts, and its recorded responses.

A response is a JSON object with three integers. As an integer counts a number (cut towards 0), a boolean, or a
string that spells an integer; a missing key counts as 3. Anything else (null, another string, a list, no object, no
JSON) makes the row an error with 3, 3, 3. An empty response is an empty object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import present

DIMENSIONS = ("helpfulness_delta", "honest_preference", "label_confidence")
TEXT_CHARS = 2000

# The instructions the judge gets.
SYSTEM_PROMPT = """You are evaluating human preference labels in RLHF training data.
Your job is to flag pairs where the human label is likely wrong,
ambiguous, or reflects bias rather than genuine quality.
Respond in JSON only. No preamble."""
USER_PROMPT = """Prompt: %s
Chosen: %s
Rejected: %s

Score each dimension 1-5:
- helpfulness_delta: Is chosen meaningfully more helpful?
- honest_preference: Is chosen better for real reasons vs. surface reasons?
- label_confidence: How confident are you the human label is correct?

Return JSON with scores and a concise reason (1-2 sentences) explaining the lowest score:
{"helpfulness_delta": int, "honest_preference": int, "label_confidence": int, "reason": str}"""


def judge_prompt(prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> Column:
    return F.format_string(USER_PROMPT, *[F.substring(present(c), 1, TEXT_CHARS) for c in (prompt, chosen, rejected)])


def _parsed(response: str) -> Column:
    return F.try_parse_json(F.when(present(response) == "", F.lit("{}")).otherwise(F.col(response)))


def _is_object(response: str) -> Column:
    return F.coalesce(F.schema_of_variant(_parsed(response)).startswith("OBJECT"), F.lit(False))


def _dimension(response: str, name: str) -> Column:
    """The integer, or null if it makes the row an error."""
    field = F.try_variant_get(_parsed(response), f"$.{name}", "variant")
    kind = F.schema_of_variant(field)
    text = F.try_variant_get(_parsed(response), f"$.{name}", "string")
    number = F.try_variant_get(_parsed(response), f"$.{name}", "double")
    spelled = F.when(F.trim(text).rlike(r"^[+-]?\d{1,9}$"), F.trim(text).try_cast("int"))
    value = F.when(kind == "STRING", spelled).when(kind == "BOOLEAN", text.try_cast("boolean").cast("int")).when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), number.try_cast("int"))
    return F.when(field.isNull(), F.lit(3)).otherwise(value)


def _verdicts(response: str) -> tuple[Column, list[Column]]:
    """Whether the row is good, and the three integers."""
    raw = [_dimension(response, name) for name in DIMENSIONS]
    good = _is_object(response)
    for value in raw:
        good = good & value.isNotNull()
    return good, [F.when(good, value).otherwise(3) for value in raw]


def judge_score(response: str) -> Column:
    return F.least(*_verdicts(response)[1]).cast("double")


def judge_metadata(response: str) -> Column:
    good, values = _verdicts(response)
    least = F.least(*values)
    reason = F.when(good, F.coalesce(F.try_variant_get(_parsed(response), "$.reason", "string"), F.lit("")))
    return F.struct(*[v.alias(n) for n, v in zip(DIMENSIONS, values, strict=True)], least.alias("min_score"), (good & (least < 3)).alias("judge_flagged"), reason.alias("reason"), F.when(~good, F.lit("response is not a verdict")).alias("error"))
