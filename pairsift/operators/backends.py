"""Optional scorers outside Spark: embeddings, judge responses, rewards and tokens, by callables over Arrow batches.

A callable gets a list and returns one result for each of its items. It is made once per task by a factory, so models load once.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .judge import SYSTEM_PROMPT, judge_prompt


def with_embeddings(pairs: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 32) -> DataFrame:
    """The pairs with unit vectors chosen_embedding and rejected_embedding."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            texts = batch.fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch_size) for v in np.asarray(model(texts[i : i + batch_size]), np.float32)]
            yield pd.Series([v / max(float(np.linalg.norm(v)), 1e-12) for v in vectors])

    return pairs.withColumns({"chosen_embedding": embed("chosen"), "rejected_embedding": embed("rejected")})


@dataclass(frozen=True)
class JudgeRequest:
    """What a judge's backend is asked for."""

    model: str = "gpt-4o-mini"
    system: str = SYSTEM_PROMPT
    temperature: float = 0.0
    max_tokens: int = 300
    json_mode: bool = True
    concurrency: int = 50  # calls at a time in one task

    def messages(self, prompt: str) -> list[dict[str, str]]:
        return [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]


def with_responses(pairs: DataFrame, factory: Callable[[JudgeRequest], Callable[[list[dict[str, str]]], str | None]], request: JudgeRequest = JudgeRequest()) -> DataFrame:
    """The pairs with the judge's response to each.

    The callable gets the messages of one pair; up to ``concurrency`` calls run at a time. One that fails leaves a
    response that the judge counts as an error, for its own pair only.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory(request)

        def one(prompt: str) -> str | None:
            try:
                return model(request.messages(prompt))
            except Exception:  # a failing call costs its own row only
                return "null"

        with ThreadPoolExecutor(request.concurrency) as pool:
            for batch in batches:
                yield pd.Series(list(pool.map(one, batch.tolist())), dtype=object)

    return pairs.withColumn("response", ask(judge_prompt()))


def with_rewards(pairs: DataFrame, factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch_size: int = 32) -> DataFrame:
    """The pairs with chosen_reward and rejected_reward of a model that scores (prompt, response) texts in batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for prompts, texts in batches:
            both = list(zip(prompts.fillna(""), texts.fillna(""), strict=True))
            yield pd.Series([float(x) for i in range(0, len(both), batch_size) for x in model(both[i : i + batch_size])], dtype=float)

    return pairs.withColumns({"chosen_reward": score("prompt", "chosen"), "rejected_reward": score("prompt", "rejected")})


def file_tokenizer(path: str, pattern: str | None = None) -> Callable[[], Callable[[str], list[int]]]:
    """A factory, for ``tokenised_pairs``, of a tokenizer's file: .json (tokenizers), .model (sentencepiece) or .tiktoken (ranks, split by ``pattern``).

    The driver reads the file and sends its bytes along, so workers need none. Strings of special tokens are ordinary text.
    """
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("json", "model", "tiktoken") or (kind == "tiktoken") != (pattern is not None):
        raise ValueError("a tokenizer is a .json or .model file, or a .tiktoken file with its pattern")
    body = Path(path).read_bytes()

    def make() -> Callable[[str], list[int]]:
        if kind == "json":
            from tokenizers import Tokenizer

            fast = Tokenizer.from_str(body.decode())
            fast.no_truncation()
            fast.no_padding()
            fast.encode_special_tokens = True
            return lambda text: fast.encode(text, add_special_tokens=False).ids
        if kind == "model":
            from sentencepiece import SentencePieceProcessor

            return SentencePieceProcessor(model_proto=body).encode
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, body.splitlines())}
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    return make


@dataclass(frozen=True)
class TokenSettings:
    max_length: int = 256
    pad_id: int = 0
    first: tuple[int, ...] = field(default=())  # ids before the prompt, between the texts, and at the end
    between: tuple[int, ...] = field(default=())
    last: tuple[int, ...] = field(default=())


def cut_pair(prompt: list[int], text: list[int], room: int) -> tuple[list[int], list[int]]:
    """Both cut to ``room`` ids together, one id at a time from the end of the longer one (of the text, if they are as long)."""
    a, b = len(prompt), len(text)
    over = max(0, a + b - room)
    longer = min(over, abs(a - b))
    a, b = (a - longer, b) if a > b else (a, b - longer)
    b, a = b - -(-(over - longer) // 2), a - (over - longer) // 2
    return prompt[: max(0, a)], text[: max(0, b)]


def tokenised_pairs(pairs: DataFrame, factory: Callable[[], Callable[[str], list[int]]], settings: TokenSettings = TokenSettings()) -> DataFrame:
    """The pairs with {chosen,rejected}_input_ids and _attention_mask of the prompt with each response, all of ``max_length``.

    The callable gives the ids of one text without special ones.
    """
    room = settings.max_length - len(settings.first) - len(settings.between) - len(settings.last)

    @F.pandas_udf("struct<input_ids:array<int>,attention_mask:array<int>>")
    def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = factory()
        for prompts, texts in batches:
            ids, masks = [], []
            for prompt, text in zip(prompts.fillna(""), texts.fillna(""), strict=True):
                a, b = cut_pair(list(model(prompt)), list(model(text)), room)
                row = [*settings.first, *a, *settings.between, *b, *settings.last]
                masks.append([1] * len(row) + [0] * (settings.max_length - len(row)))
                ids.append(row + [settings.pad_id] * (settings.max_length - len(row)))
            yield pd.DataFrame({"input_ids": ids, "attention_mask": masks})

    both = pairs.withColumns({f"__{s}": encode("prompt", s) for s in ("chosen", "rejected")})
    named = {f"{s}_{part}": F.col(f"__{s}.{part}") for s in ("chosen", "rejected") for part in ("input_ids", "attention_mask")}
    return both.withColumns(named).drop("__chosen", "__rejected")
