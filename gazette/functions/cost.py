"""Tokens and what they cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_ENCODING, ENCODINGS


def encoding_of(model: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, name in reversed(list(ENCODINGS.items())):
        out = F.when(F.startswith(F.lower(model), F.lit(prefix)), name).otherwise(out)
    return F.coalesce(out, F.lit(DEFAULT_ENCODING))


def token_count(text: Column) -> Column:
    """Four characters a token, rounded up: the default where no rank file is given."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def token_counter(make: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """A token_count() by the function that make() gives, once for each worker: an encoding of a model. Null and empty texts have none."""

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = make()
        for s in texts:
            yield s.map(lambda t: count(t) if t else 0, na_action=None).astype("int64")

    return counted


def rank_counter(path: str, pattern: str) -> Callable[[], Callable[[str], int]]:
    """For token_counter(): byte-pair encoding by a local rank file, without special tokens."""

    def make() -> Callable[[str], int]:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        coder = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
        return lambda t: len(coder.encode_ordinary(t))

    return make


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> tuple[Column, Column, Column]:
    """(input, output, total) in dollars, each rounded to 6 places; the total before its parts are. Negative tokens are an error."""

    def checked(n: Column) -> Column:
        return F.when(n < 0, F.raise_error(F.lit("token counts cannot be negative")).cast("double")).otherwise(n.cast("double"))

    a, b = checked(tokens_in) / 1_000_000 * price_in, checked(tokens_out) / 1_000_000 * price_out
    return F.round(a, 6), F.round(b, 6), F.round(a + b, 6)
