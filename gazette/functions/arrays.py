"""Arrays of topics, preferences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import RENAMED_TOPICS, TOPICS
from ..schemas import PREFERENCES


def known_topics(topics: Column) -> Column:
    """Only known topics, in their order, repeats included."""
    return F.filter(topics, lambda t: t.isin(TOPICS))


def remapped(topics: Column) -> Column:
    """Topics under their present names, known ones only, each once and sorted."""
    names = F.create_map(*(F.lit(x) for kv in RENAMED_TOPICS.items() for x in kv))
    return F.array_sort(F.array_distinct(known_topics(F.transform(topics, lambda t: F.coalesce(F.try_element_at(names, t), t)))))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def is_empty(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0)) <= 0


def contains_all(a: Column, wanted: Column) -> Column:
    return F.coalesce(F.size(F.array_except(wanted, a)) == 0, F.lit(False))


def preferences(json: Column) -> Column:
    return F.from_json(json, PREFERENCES)


def enabled(json: Column) -> Column:
    """Notifications are on unless the preferences say otherwise."""
    return F.coalesce(preferences(json)["enabled"], F.lit(True))


def first_seen(items: Column, value: str) -> Column:
    """Values of structs that begin with what they are ordered by, each once, as they were first seen."""
    return F.array_distinct(F.transform(F.array_sort(items), lambda x: x[value]))
