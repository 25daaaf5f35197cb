"""Typed answers of a model: the value, or what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TOPICS
from .text import json_in

#: The most characters of a summary, a reasoning, a fact and a report, and the highest score.
MOST = {"summary": 2000, "reasoning": 1000, "description": 2000, "report": 5000}
MOST_SCORE = 10

_FIELDS = {"topics": "topics array<string>", "summary": "summary string", "relevance_score": "score int, reasoning string", "weekly_facts": "facts array<string>", "weekly_synthesis": "report string"}


def typed_answer(answer: Column, operation: str) -> Column:
    """struct(value, error) of a model's answer to an operation; value is null where error says why it can't be used.

    Errors: 'not JSON', 'missing' (no such field, or of another type), 'too long', 'out of bounds'. Of topics only known ones count."""
    schema = f"{_FIELDS[operation]}, _broken string"
    got = F.from_json(json_in(answer), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    broken = got.isNull() | got["_broken"].isNotNull()
    long_ = lambda c, kind: F.coalesce(F.char_length(c) > MOST[kind], F.lit(False))
    if operation == "topics":
        value, wrong = F.filter(got["topics"], lambda t: t.isin(TOPICS)), F.lit(None).cast("string")
    elif operation == "summary":
        value, wrong = got["summary"], F.when(long_(got["summary"], "summary"), "too long")
    elif operation == "relevance_score":
        value, wrong = got["score"], F.when(~got["score"].between(0, MOST_SCORE), "out of bounds").when(long_(got["reasoning"], "reasoning"), "too long")
    elif operation == "weekly_facts":
        value, wrong = got["facts"], F.when(F.exists(got["facts"], lambda f: long_(f, "description")), "too long")
    else:
        value, wrong = got["report"], F.when(long_(got["report"], "report"), "too long")
    error = F.when(broken, "not JSON").when(value.isNull(), "missing").otherwise(wrong)
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))
