"""Text as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import REDACTED, TEXT_PATTERNS, TOPIC_NAMES, URL_PATTERNS

#: What ends a line, the widest meaning: \r\n counts once.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029) + "]"


def lines(text: Column) -> Column:
    """The lines of a text; an end of line at the end opens no further line, and an empty text has no line."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def sanitize_text(text: Column, urls: list[str] = URL_PATTERNS, phrases: list[str] = TEXT_PATTERNS) -> Column:
    """Lines with a private link, and lines that are nothing but a private phrase, go."""
    url = "(?i)" + "|".join(f"(?:{p})" for p in urls)
    phrase = r"(?i)^\s*(?:" + "|".join(f"(?:{p})" for p in phrases) + r")\s*$"
    kept = F.filter(lines(text), lambda x: ~(F.rlike(x, F.lit(url)) | F.rlike(x, F.lit(phrase))))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.array_join(kept, "\n"))


def redact(text: Column, phrases: list[str]) -> Column:
    """Each phrase, as it is and in any case, is replaced, one after the other; blank phrases count for nothing."""
    out = F.coalesce(text, F.lit(""))
    for p in (p.strip() for p in phrases):
        if p:
            out = F.regexp_replace(out, "(?iu)\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E", REDACTED.replace("[", "\\[").replace("]", "\\]"))
    return out


def sender_name(sender: Column) -> Column:
    """What stands before <address>, without quotes; null if that is nothing."""
    name = F.regexp_extract(sender, r"^(.+?)\s*<", 1)
    return F.nullif(F.trim(F.regexp_replace(F.trim(name), r"""^["']+|["']+$""", "")), F.lit(""))


def truncated(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


@F.pandas_udf(StringType())
def title_case(s: pd.Series) -> pd.Series:
    """A capital after anything that is no letter; initcap knows only blanks."""
    return s.str.title()


def topic_name(topic: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in TOPIC_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, topic), title_case(F.replace(topic, F.lit("_"), F.lit(" "))))


def topic_label(topic: Column) -> Column:
    """The other way of showing a topic: blanks for underscores, a capital at each word's start, the rest as it is."""
    words = F.split(topic, "_")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def paragraphs(text: Column) -> Column:
    """Parts between blank lines as <p> elements; empty parts go."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n")


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", "_"))


def json_in(text: Column) -> Column:
    """The JSON of a wordy answer: of the first json fence, else of the first fence, then from the first { to the last }."""
    body = r"(?s)```%s\s*(.*?)```"
    fenced = F.coalesce(F.nullif(F.regexp_extract(text, body % "json", 1), F.lit("")), F.nullif(F.regexp_extract(text, body % "", 1), F.lit("")), text)
    braces = F.regexp_extract(fenced, r"(?s)\{.*\}", 0)
    return F.trim(F.coalesce(F.nullif(braces, F.lit("")), fenced))


def model_parts(model: Column) -> tuple[Column, Column]:
    """(provider, name) of provider:name; without a known provider the model is local. A short or odd prefix is part of the name."""
    prefix = F.regexp_extract(model, "^([^:]+):", 1)
    known = prefix.isin("ollama", "openai")
    odd = F.rlike(prefix, F.lit("^[a-z]{3,}$")) & ~known
    provider = F.when(odd, F.raise_error(F.concat(F.lit("unknown provider: "), prefix)).cast("string")).when(known, prefix).otherwise("ollama")
    return provider, F.when(known, F.substring(model, F.length(prefix) + 2, F.length(model))).otherwise(model)
