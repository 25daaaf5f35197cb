"""A run of the weekly reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reports import active_topics, documents_of_week
from ..operators.store import upsert
from .enrich import Enricher, Lexicon, collected, report_parts


def run(docs: DataFrame, rules: DataFrame, existing: DataFrame, week: str, now: Column, make: Callable[[], Enricher] = Lexicon, force: bool = False, dry: bool = False, whole: bool = True, known: list[str] | None = None) -> dict[str, DataFrame]:
    """reports: the reports afterwards; made: those of this run; failures: to be appended to the table of failures; stats: one row
    (generated, skipped, failed) over the topics of active weekly rules.

    docs: id, received_date, topics, plain_text, ward_number. A topic that has a report of the week is skipped unless forced, and so
    is one without documents or facts; one whose synthesis failed counts as failed. A dry run stores nothing. developments and newsletters are the parts of the reports as
    rows; unless whole is set, reports are stored without them, so that no topic has to fit one row. Topics that are not known,
    where known is given, and a week that is none leave a failure."""
    topics = active_topics(rules)
    have = existing.where(F.col("week_id") == week).select("topic")
    todo = topics if force else topics.join(have, "topic", "left_anti")
    own = documents_of_week(docs, week, todo).join(docs.select("id", "plain_text", "ward_number"), "id")
    parts = report_parts(own, week, make, known)
    made = (collected(parts) if whole else parts["reports"]).withColumn("id", F.concat_ws("|", "topic", "week_id")).withColumn("created_at", now)
    failed = parts["failures"].where("step = 'weekly_synthesis'").select(F.col("key").alias("topic")).distinct().join(parts["reports"].select("topic"), "topic", "left_anti")
    outcome = topics.join(parts["reports"].select("topic", F.lit("generated").alias("a")), "topic", "left").join(failed.select("topic", F.lit("failed").alias("b")), "topic", "left")
    how = F.coalesce("a", "b", F.lit("skipped"))
    stats = outcome.agg(*(F.count_if(how == x).alias(x) for x in ("generated", "skipped", "failed")))
    after = existing if dry else upsert(existing, made.select(*(c if c in made.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in existing.columns)), ["topic", "week_id"])
    rows = {k: parts[k] for k in ("developments", "newsletters")}
    return rows | {"reports": after, "made": made, "failures": parts["failures"].withColumn("failed_at", now), "stats": stats}
