"""Word-level Column functions.

White space is Unicode white space, as one explicit class: the regular expressions of Spark know ASCII only.
A null text counts as empty everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def present(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(present(text), SPACE + "+", -1), lambda w: w != "")


def stripped(text: Column) -> Column:
    """The text without white space at either end."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def distinct_ratio(tokens: Column) -> Column:
    """Distinct over all words; 1.0 without words."""
    return F.when(F.size(tokens) == 0, F.lit(1.0)).otherwise(F.size(F.array_distinct(tokens)) / F.size(tokens))


def word_hashes(tokens: Column) -> Column:
    """A 64-bit hash of each word."""
    return F.transform(tokens, lambda w: F.xxhash64(w))


def ngram_hashes(hashes: Column, n: int) -> Column:
    """A 64-bit hash of every n-gram, from the words' hashes: one pass over an array of longs for each word of the n-gram."""
    most = F.greatest(F.size(hashes) - F.lit(n - 1), F.lit(0))
    grams = F.slice(hashes, F.lit(1), most)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(hashes, F.lit(k + 1), most), lambda a, b: F.xxhash64(a, b))
    return grams


def ngram_repetition(hashes: Column, n: int) -> Column:
    """The share of n-grams that occurred before; 0.0 for fewer than n words.

    ``hashes`` is a column of ``word_hashes``. Distinct n-grams are told apart by 64 bits: among 20,000 of a text two
    fall together about once in 10**11 texts.
    """
    count = F.size(hashes) - F.lit(n - 1)
    return F.when(count < 1, F.lit(0.0)).otherwise((count - F.size(F.array_distinct(ngram_hashes(hashes, n)))) / F.greatest(count, F.lit(1)))


def single(score: Column) -> Column:
    """A score rounded to 32 bits, as scores are kept, in a double."""
    return score.cast("float").cast("double")
