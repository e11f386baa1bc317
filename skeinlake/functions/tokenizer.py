"""Token ids of a text as strings, by a tokenizer of choice, for chunkers that measure in tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

MAX_TOKENS = 8191


class TokenIds:
    """``tokenize`` gives ids as strings; ``encode`` is any function from a text to ids, ``size`` its number of ids."""

    def __init__(self, encode: Callable[[str], list[int]], size: int, max_tokens: int = MAX_TOKENS):
        self.encode, self.size, self.max_tokens = encode, size, max_tokens

    def tokenize(self, text: str | None) -> list[str]:
        return [str(i) for i in self.encode(text or "")]

    def fits(self, text: str | None) -> bool:
        return len(self.encode(text or "")) <= self.max_tokens

    def vocabulary(self) -> dict[str, int]:
        return {str(i): i for i in range(self.size)}


def token_ids(text: Column, load: Callable[[], TokenIds]) -> Column:
    """Ids of a column's texts, in Arrow batches; ``load`` makes the tokenizer once in each task. Null is an empty text."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = load()
        for s in batches:
            yield s.map(tokens.tokenize, na_action=None)

    return run(text)
