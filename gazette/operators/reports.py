"""Weekly reports by topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import same_set, remapped
from ..functions.dates import in_week, week_id


def active_topics(rules: DataFrame) -> DataFrame:
    """Topics that an active weekly rule names, sorted."""
    return rules.where("is_active and delivery_frequency = 'weekly'").select(F.explode("topics").alias("topic")).distinct().orderBy("topic")


def documents_of_week(docs: DataFrame, week: str, topics: DataFrame | None = None, whole_sunday: bool = False) -> DataFrame:
    """(topic, id) of the documents of a week; with topics, only of these."""
    own = docs.where(in_week(F.col("received_date"), F.lit(week), whole_sunday)).select("id", F.explode(F.array_distinct("topics")).alias("topic"))
    return own.select("topic", "id") if topics is None else own.join(topics, "topic", "left_semi").select("topic", "id")


def weekly_topics(docs: DataFrame) -> DataFrame:
    """(week_id, topic, newsletters) over all weeks; documents without a date are left out."""
    rows = docs.where("received_date is not null").select(week_id(F.col("received_date")).alias("week_id"), F.explode(F.array_distinct("topics")).alias("topic"))
    return rows.groupBy("week_id", "topic").agg(F.count("*").alias("newsletters"))


def weekly_sets(docs: DataFrame) -> DataFrame:
    """(week_id, topic, id): the documents of each week and topic, as rows, so that no set has to fit one task."""
    return docs.where("received_date is not null").select(week_id(F.col("received_date")).alias("week_id"), F.explode(F.array_distinct("topics")).alias("topic"), "id").distinct()


def rules_by_user(rules: DataFrame) -> DataFrame:
    """(user_id, rules): the active weekly rules of each user, by id; a user has few, as new ones are refused beyond a limit."""
    own = rules.where("is_active and delivery_frequency = 'weekly'")
    return own.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("id", "name", "topics"))).alias("rules"))


def per_week(docs: DataFrame) -> DataFrame:
    return docs.where("received_date is not null").groupBy(week_id(F.col("received_date")).alias("week_id")).agg(F.count("*").alias("newsletters"))


def queue_weekly(rules: DataFrame, reports: DataFrame, week: str, now: Column) -> DataFrame:
    """Rows of the queue for active weekly rules and the reports of a week on their topics."""
    r = rules.where("is_active and delivery_frequency = 'weekly'").select("user_id", F.col("id").alias("rule_id"), F.explode(F.array_distinct("topics")).alias("topic"))
    own = reports.where(F.col("week_id") == week).select(F.col("id").alias("report_id"), "topic", "week_id")
    return r.join(own, "topic").select("user_id", F.lit(None).cast("string").alias("newsletter_id"), "report_id", "rule_id", F.lit("pending").alias("status"), F.col("week_id").alias("digest_batch_id"), F.lit("weekly").alias("notification_type"), now.alias("created_at"))


def weekly_stats(rules: DataFrame, reports: DataFrame, existing: DataFrame, week: str) -> DataFrame:
    """(queued, skipped, users): skipped are topics without a report and rows that are there already."""
    r = rules.where("is_active and delivery_frequency = 'weekly'").select("user_id", F.col("id").alias("rule_id"), F.explode(F.array_distinct("topics")).alias("topic"))
    own = reports.where(F.col("week_id") == week).select(F.col("id").alias("report_id"), "topic")
    old = existing.where("report_id is not null").select("user_id", "report_id", "rule_id").distinct().withColumn("old", F.lit(True))
    rows = r.join(own, "topic", "left").join(old, ["user_id", "report_id", "rule_id"], "left")
    new = F.col("report_id").isNotNull() & F.col("old").isNull()
    return rows.agg(F.count_if(new).alias("queued"), F.count_if(~new).alias("skipped"), F.count_distinct(F.when(new, F.col("user_id"))).alias("users"))


def migration(docs: DataFrame) -> DataFrame:
    """id, topics as they were and under their present names, and whether the set has changed."""
    return docs.select("id", "topics", remapped(F.col("topics")).alias("new_topics")).withColumn("modified", ~same_set(F.col("topics"), F.col("new_topics")))


def migration_stats(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modified, newsletters), and how often modified documents lost or renamed a topic: (old_topic, new_topic, n), new_topic null if it is gone."""
    from ..constants import RENAMED_TOPICS, TOPICS

    counts = changes.groupBy("modified").agg(F.count("*").alias("newsletters"))
    names = F.create_map(*(F.lit(x) for kv in RENAMED_TOPICS.items() for x in kv))
    new = F.coalesce(F.try_element_at(names, F.col("old_topic")), F.col("old_topic"))
    moved = changes.where("modified").select(F.explode("topics").alias("old_topic")).select("old_topic", F.when(new.isin(TOPICS), new).alias("new_topic"))
    return counts, moved.where("new_topic is null or new_topic <> old_topic").groupBy("old_topic", "new_topic").agg(F.count("*").alias("n"))
