"""Prompts of a model, the same as text for a client and as columns for counting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TOPICS

TEMPLATES = {
    "topics": f'Which of these topics does the text discuss? {", ".join(TOPICS)}. Answer {{{{"topics": [...]}}}}.\n\n{{content}}',
    "summary": 'Summarise the text in two or three sentences. Answer {{"summary": "..."}}.\n\n{content}',
    "relevance_score": 'How relevant is the text, from 0 to 10? Topics: {topics}. Summary: {summary}. Answer {{"score": n, "reasoning": "..."}}.\n\n{content}',
    "weekly_facts": 'What does the text say about {topic}? Answer {{"facts": [...]}}.\n\n{content}',
    "weekly_synthesis": 'Write a report on {topic} from these facts: {facts}. Answer {{"report": "..."}}.',
}


def prompt(operation: str, **parts: str) -> str:
    return TEMPLATES[operation].format(**parts)


def prompt_column(operation: str, **parts: Column) -> Column:
    """The prompt as a column; parts that are null count as empty."""
    pieces = re.split(r"(?<!\{)\{(\w+)\}(?!\})", TEMPLATES[operation])
    fixed = [F.lit(p.replace("{{", "{").replace("}}", "}")) for p in pieces[::2]]
    filled = [F.coalesce(parts[p].cast("string"), F.lit("")) for p in pieces[1::2]]
    return F.concat(*(x for k, f in enumerate(fixed) for x in ([f, filled[k]] if k < len(filled) else [f])))
