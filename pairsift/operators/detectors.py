"""Detectors of doubtful preference pairs, as Column expressions over tokenised pairs.

A detector names the columns it needs and gives a score and its metadata as Columns; thresholds are a constant or a
percentile of the scores, and each detector has its own comparison. ``tokenised`` splits the texts once for all.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.readability import fk_grade
from ..functions.text import distinct_ratio, ngram_repetition, present, single, word_hashes, words
from .judge import judge_metadata, judge_score

#: i, u and U: case and word boundaries by Unicode; d: only a line feed ends a line.
FLAGS = "(?iuUd)"

# Phrases of a refusal.
REFUSALS = (
    r"\bI can'?t help\b",
    r"\bI'?m not able to\b",
    r"\bI cannot\b",
    r"\bI'?m unable to\b",
    r"\bI don'?t think I should\b",
    r"\bI'?m sorry,? but I\b",
    r"\bI will not\b",
    r"\bI won'?t\b",
    r"\bI'?m not going to\b",
    r"\bas an AI(?: language model)?,? I\b",
    r"\bI'?m not comfortable\b",
    r"\bthat'?s not something I can\b",
    r"\bI must decline\b",
    r"\bI have to refuse\b",
)

# Patterns of unsafe prompts by category.
UNSAFE = {
    "violence": (
        r"\bhow to (kill|murder|harm|hurt|attack)\b",
        r"\bmak(?:e|ing) (a )?(bomb|explosive|weapon)\b",
        r"\bmass (shooting|casualt)",
        r"\btorture\b",
    ),
    "illegal_activity": (
        r"\b(how to )?(hack|steal|rob|break into)\b",
        r"\bmak(?:e|ing) (meth|cocaine|drugs)\b",
        r"\bforg(?:e|ing) (documents?|identit)",
        r"\bmoney launder",
    ),
    "self_harm": (
        r"\bhow to (commit suicide|kill myself|end my life)\b",
        r"\bself[- ]harm\b",
        r"\bsuicid(e|al)\b",
    ),
    "csam": (
        r"\bchild (porn|abuse|exploit)",
        r"\bminor.{0,20}(sexual|nude|naked)",
    ),
    "hate_speech": (
        r"\b(racial|ethnic) (slur|supremac)",
        r"\bgenocide.{0,20}(justif|good|right)",
    ),
}

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {"ge": lambda s, t: s >= t, "le": lambda s, t: s <= t, "lt": lambda s, t: s < t}


@dataclass(frozen=True)
class Detector:
    name: str
    needs: tuple[str, ...]  # columns of the pairs
    score: Callable[[], Column]
    metadata: Callable[[], Column]
    comparison: str = "ge"
    fixed_threshold: float | None = None
    default_percentile: float = 99.5

    def flags(self, score: Column, threshold: Column) -> Column:
        return COMPARISONS[self.comparison](score, threshold)


def tokenised(pairs: DataFrame) -> DataFrame:
    """The pairs with their responses' words as they are, in lower case, and these hashed; split once.

    They are columns, not expressions: inside a lambda an expression would be worked out again for every element.
    """
    split = pairs.withColumns({"chosen_words": words("chosen"), "rejected_words": words("rejected")})
    split = split.withColumns({f"{s}_lower": F.transform(f"{s}_words", lambda w: F.lower(w)) for s in ("chosen", "rejected")})
    return split.withColumns({f"{s}_hashes": word_hashes(F.col(f"{s}_lower")) for s in ("chosen", "rejected")})


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike(FLAGS + "|".join(f"(?:{p})" for p in patterns))


def _length_ratio() -> Column:
    a, b = F.size("chosen_words"), F.size("rejected_words")
    return F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b, F.lit(1)))


def length_ratio() -> Detector:
    meta = lambda: F.struct(F.size("chosen_words").alias("chosen_words"), F.size("rejected_words").alias("rejected_words"), _length_ratio().alias("ratio"))
    return Detector("length_ratio", ("chosen", "rejected"), lambda: single(_length_ratio()), meta, "le", default_percentile=0.5)


def repetition(ngram_size: int = 3) -> Detector:
    def score() -> Column:
        return single(F.least(distinct_ratio(F.col("chosen_lower")), distinct_ratio(F.col("rejected_lower"))))

    def metadata() -> Column:
        ratios = [distinct_ratio(F.col(f"{s}_lower")).alias(f"{s}_unique_ratio") for s in ("chosen", "rejected")]
        rates = [ngram_repetition(F.col(f"{s}_hashes"), ngram_size).alias(f"{s}_ngram_rep") for s in ("chosen", "rejected")]
        return F.struct(*ratios, *rates, F.lit(ngram_size).alias("ngram_size"))

    return Detector("repetition", ("chosen", "rejected"), score, metadata, "le", default_percentile=0.5)


def refusal_bias(min_substantive_words: int = 20) -> Detector:
    refusal = lambda: _matches(present("chosen"), REFUSALS)
    substantive = lambda: F.size("rejected_words") >= min_substantive_words

    def metadata() -> Column:
        found = F.array_compact(F.array(*[F.when(present("chosen").rlike(FLAGS + p), F.lit(p)) for p in REFUSALS]))
        return F.struct(refusal().alias("chosen_is_refusal"), substantive().alias("rejected_is_substantive"), found.alias("matched_patterns"), F.size("rejected_words").alias("rejected_word_count"))

    return Detector("refusal_bias", ("chosen", "rejected"), lambda: F.when(substantive() & refusal(), 1.0).otherwise(0.0), metadata, fixed_threshold=0.5, default_percentile=99.0)


def unsafe_categories(text: Column | str) -> Column:
    """The categories that match, in their order."""
    return F.array_compact(F.array(*[F.when(_matches(present(text), patterns), F.lit(name)) for name, patterns in UNSAFE.items()]))


def unsafe_prompt() -> Detector:
    meta = lambda: F.struct(unsafe_categories("prompt").alias("unsafe_categories"), F.size(unsafe_categories("prompt")).alias("category_count"))
    return Detector("unsafe_prompt", ("prompt",), lambda: F.size(unsafe_categories("prompt")).cast("double"), meta, fixed_threshold=1.0, default_percentile=99.0)


def readability_mismatch(min_words: int = 10) -> Detector:
    grade = lambda side: fk_grade(side, F.col(f"{side}_words"))
    enough = lambda: F.least(F.size("chosen_words"), F.size("rejected_words")) >= min_words
    score = lambda: single(F.when(enough(), grade("chosen") - grade("rejected")).otherwise(0.0))
    meta = lambda: F.struct(grade("chosen").alias("chosen_grade_level"), grade("rejected").alias("rejected_grade_level"), (grade("chosen") - grade("rejected")).alias("grade_difference"))
    return Detector("readability_mismatch", ("chosen", "rejected"), score, meta)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_similarity(model: str = "all-MiniLM-L6-v2") -> Detector:
    """Cosine of unit vectors in columns chosen_embedding and rejected_embedding (see backends.with_embeddings)."""
    cosine = lambda: single(dot("chosen_embedding", "rejected_embedding"))
    return Detector("semantic_similarity", ("chosen_embedding", "rejected_embedding"), cosine, lambda: F.struct(cosine().alias("similarity"), F.lit(model).alias("model")))


def llm_judge() -> Detector:
    """The least of three verdicts in a column response (see backends.with_responses)."""
    return Detector("llm_judge", ("response",), lambda: judge_score("response"), lambda: judge_metadata("response"), "lt", fixed_threshold=3.0)


#: How the detectors are made, by name and in order; ``register`` adds to it.
MAKERS: dict[str, Callable[[], Detector]] = {
    "semantic_similarity": semantic_similarity,
    "readability_mismatch": readability_mismatch,
    "repetition": repetition,
    "length_ratio": length_ratio,
    "refusal_bias": refusal_bias,
    "unsafe_prompt": unsafe_prompt,
    "llm_judge": llm_judge,
}


def register(name: str, make: Callable[[], Detector]) -> None:
    """Add a detector of one's own, or put another in place of one."""
    MAKERS[name] = make


def registry() -> dict[str, Detector]:
    """All detectors that can be made, in their order; one that can't be is left out with a warning."""
    made = {}
    for name, make in MAKERS.items():
        try:
            made[name] = make()
        except Exception as why:  # a detector may need what is not installed; the others run
            logging.getLogger(__name__).warning("detector %s is left out: %s", name, why)
    return made
