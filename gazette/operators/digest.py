"""Digests: what is pending for whom, and how it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import first_seen
from ..functions.dates import date_label, week_label
from ..functions.text import paragraphs, topic_name


def pending(queue: DataFrame, batch: str | None = None, kind: str | None = None) -> DataFrame:
    """kind is asked for by weekly digests only: without a batch, a daily run takes weekly rows up, too."""
    q = queue.where("status = 'pending'")
    q = q if batch is None else q.where(F.col("digest_batch_id") == batch)
    return q if kind is None else q.where(F.col("notification_type") == kind)


def with_content(queue: DataFrame, docs: DataFrame, sources: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of the queue with their newsletter (and its source) and their rule as structs, null where one is missing."""
    s = sources.select(F.col("id").alias("_sid"), F.struct("name", "ward_number").alias("_source"))
    d = docs.select("id", "subject", "summary", "topics", "received_date", "source_id").join(s, F.col("source_id") == F.col("_sid"), "left")
    d = d.select(F.col("id").alias("_did"), F.struct("id", "subject", "summary", "topics", "received_date", F.col("_source").alias("source")).alias("newsletter"))
    r = rules.select(F.col("id").alias("_rid"), F.struct("id", "name").alias("rule"))
    out = queue.join(d, F.col("newsletter_id") == F.col("_did"), "left").join(r, F.col("rule_id") == F.col("_rid"), "left")
    return out.drop("_did", "_rid")


def by_user(queue: DataFrame) -> DataFrame:
    """user_id, how many rows are pending, the first and the last, and their ids from the oldest on."""
    order = F.struct(F.col("created_at").alias("at"), F.col("id").alias("id"))
    return queue.groupBy("user_id").agg(F.count("*").alias("pending"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.transform(F.array_sort(F.collect_list(order)), lambda x: x["id"]).alias("ids"))


def rules_of_documents(queue: DataFrame) -> DataFrame:
    """(user_id, newsletter_id, matched_rules): the names of the rules that found a newsletter, each once, the first first.

    Groups are one user's matches of one document, so they are as small as a user's rules."""
    seen = F.struct(F.col("created_at").alias("at"), F.col("id").alias("id"), F.col("rule_name").alias("name"))
    return queue.groupBy("user_id", "newsletter_id").agg(first_seen(F.collect_list(seen), "name").alias("matched_rules"))


def content_ids(queue: DataFrame) -> DataFrame:
    """Distinct content and rules by user."""
    return queue.groupBy("user_id").agg(F.array_sort(F.collect_set(F.coalesce("report_id", "newsletter_id"))).alias("content_ids"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


def prepared(queue: DataFrame, base_url: str) -> DataFrame:
    """One row for each user and newsletter with what a daily digest shows; newsletters that are gone are left out."""
    rows = queue.where("newsletter.id is not null")
    seen = F.struct(F.col("created_at").alias("at"), F.col("id").alias("id"), F.coalesce("rule.name", F.lit("Unknown")).alias("name"))
    grouped = rows.groupBy("user_id", "newsletter_id").agg(F.first("newsletter").alias("n"), first_seen(F.collect_list(seen), "name").alias("matched_rules"))
    ward = F.col("n.source.ward_number")
    return grouped.select(
        "user_id",
        "newsletter_id",
        F.coalesce("n.subject", F.lit("Untitled")).alias("title"),
        F.coalesce("n.source.name", F.lit("Unknown")).alias("source_name"),
        F.when(F.coalesce(ward, F.lit("")) != "", F.concat(F.lit(" (Ward "), ward, F.lit(")"))).otherwise("").alias("ward_text"),
        F.col("n.received_date").alias("received_date"),
        date_label(F.date_format("n.received_date", "yyyy-MM-dd'T'HH:mm:ss")).alias("date_formatted"),
        F.coalesce("n.summary", F.lit("")).alias("summary"),
        F.slice(F.coalesce("n.topics", F.array().cast("array<string>")), 1, 5).alias("topics"),
        "matched_rules",
        F.concat(F.lit(f"{base_url}/newsletter/"), F.col("newsletter_id")).alias("newsletter_url"),
    )


def _when(c: Column, *parts: Column | str) -> Column:
    return F.when(c, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise("")


def _all(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _ordered(items: Column) -> Column:
    """Newest first, without a date last."""
    newest = F.filter(items, lambda x: x["received_date"].isNotNull())
    order = lambda a, b: F.when(a["received_date"] > b["received_date"], -1).when(a["received_date"] < b["received_date"], 1).when(a["newsletter_id"] < b["newsletter_id"], -1).otherwise(1)
    return F.concat(F.array_sort(newest, order), F.array_sort(F.filter(items, lambda x: x["received_date"].isNull()), lambda a, b: F.when(a["newsletter_id"] < b["newsletter_id"], -1).otherwise(1)))


def daily_digests(items: DataFrame, preferences_url: str) -> DataFrame:
    """(user_id, items, text_body, html_body) of prepared newsletters."""
    columns = [c for c in items.columns if c != "user_id"]
    grouped = items.groupBy("user_id").agg(_ordered(F.collect_list(F.struct(*columns))).alias("l"))

    def text(x: Column, i: Column) -> Column:
        return _all(
            (i + 1).cast("string"), ". ", x["title"], "\nFrom: ", x["source_name"], x["ward_text"], "\nDate: ", x["date_formatted"], "\n",
            _when(F.size(x["matched_rules"]) > 0, "✓ Matched your rules: ", F.array_join(x["matched_rules"], ", "), "\n"),
            _when(x["summary"] != "", "\n", x["summary"], "\n"),
            _when(F.size(x["topics"]) > 0, "\nTopics: ", F.array_join(x["topics"], ", "), "\n"),
            "\nRead more: ", x["newsletter_url"], "\n\n", "-" * 60, "\n\n",
        )

    def html(x: Column) -> Column:
        return _all(
            '<div class="newsletter"><h2>', x["title"], "</h2><p>From <strong>", x["source_name"], "</strong>", x["ward_text"], " • ", x["date_formatted"], "</p>",
            _when(F.size(x["matched_rules"]) > 0, "<p>✓ Matched your rules: ", F.array_join(x["matched_rules"], ", "), "</p>"),
            _when(x["summary"] != "", "<p>", x["summary"], "</p>"),
            F.array_join(F.transform(x["topics"], lambda t: _all('<span class="topic">', t, "</span>")), ""),
            '<a href="', x["newsletter_url"], '">Read full newsletter →</a></div>\n',
        )

    n = F.size("l")
    head = _all("You have ", n.cast("string"), " newsletters to review:\n\n")
    foot = f"\nChange what you get: {preferences_url}\n"
    return grouped.select(
        "user_id",
        n.alias("items"),
        _all(head, F.array_join(F.transform("l", text), ""), foot).alias("text_body"),
        _all("<html><body>", F.array_join(F.transform("l", html), ""), f'<p><a href="{preferences_url}">Preferences</a></p></body></html>').alias("html_body"),
    )


def referenced(reports: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(report_id, ward_number, id, subject, received_date, place) of the newsletters of reports; those that are gone vanish.

    place counts by ward as text, wards that are null last."""
    ids = reports.select(F.col("id").alias("report_id"), F.explode("newsletter_ids").alias("nid"))
    s = sources.select(F.col("id").alias("_sid"), "ward_number")
    d = docs.select("id", "subject", "received_date", "source_id").join(s, F.col("source_id") == F.col("_sid"), "left")
    found = ids.join(d, F.col("nid") == F.col("id")).select("report_id", "id", "subject", "received_date", "ward_number")
    item = F.struct(F.col("ward_number").isNull().alias("none"), "ward_number", "id", "subject", "received_date")
    return found.groupBy("report_id").agg(F.array_sort(F.collect_list(item)).alias("l")).select("report_id", F.posexplode("l").alias("p", "x")).select("report_id", (F.col("p") + 1).alias("place"), "x.ward_number", "x.id", "x.subject", "x.received_date")


def weekly_digests(queue: DataFrame, reports: DataFrame, rules: DataFrame, refs: DataFrame, base_url: str) -> DataFrame:
    """(user_id, items, text_body, html_body) of the weekly rows of a queue: one part for each topic, in their order."""
    r = reports.select(F.col("id").alias("_rep"), "topic", "week_id", "report_summary", F.size("newsletter_ids").alias("newsletters"))
    names = rules.select(F.col("id").alias("_rule"), F.col("name").alias("rule_name"))
    rows = queue.join(r, F.col("report_id") == F.col("_rep")).join(names, F.col("rule_id") == F.col("_rule"), "left")
    seen = F.struct(F.col("created_at").alias("at"), F.col("id").alias("id"), F.coalesce("rule_name", F.lit("Unknown")).alias("name"))
    first = F.struct(F.col("created_at").alias("at"), F.col("id").alias("id"), F.struct("_rep", "week_id", "report_summary", "newsletters").alias("r"))
    topics = rows.groupBy("user_id", "topic").agg(first_seen(F.collect_list(seen), "name").alias("matched"), F.min_by(first["r"], first).alias("r"))
    line = _all("  • ", F.when(F.coalesce("ward_number", F.lit("")) != "", F.concat(F.lit("Ward "), F.col("ward_number"))).otherwise("Citywide"), ": ", F.coalesce("subject", F.lit("")), " (", F.coalesce(F.date_format("received_date", "MMMM dd, yyyy"), F.lit("")), ")\n    ", f"{base_url}/newsletter/", F.col("id"), "\n")
    lines = refs.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))), lambda x: x["t"]), "").alias("refs"))
    full = topics.join(lines, F.col("r._rep") == F.col("report_id"), "left").withColumn("display", topic_name(F.col("topic"))).withColumn("range", week_label(F.col("r.week_id")))
    body = _all(F.col("display"), "\nWeek of ", F.col("range"), "\nBased on ", F.col("r.newsletters").cast("string"), " newsletters\n✓ Matched your rule: ", F.array_join("matched", ", "), "\n\n", F.col("r.report_summary"), "\n\n", F.coalesce(F.concat(F.lit("Referenced newsletters:\n"), F.col("refs"), F.lit("\n")), F.lit("")), "View all ", F.col("display"), " newsletters:\n", f"{base_url}/search?topic=", F.col("topic"), "\n\n", "=" * 70, "\n\n")
    html = _all('<div class="topic-report"><h2>', F.col("display"), "</h2><p>Week of ", F.col("range"), " • Based on ", F.col("r.newsletters").cast("string"), " newsletters</p>", paragraphs(F.col("r.report_summary")), "<p>✓ Matched your rule: ", F.array_join("matched", ", "), f'</p><a href="{base_url}/search?topic=', F.col("topic"), '">View all</a></div>\n')
    grouped = full.select("user_id", F.struct("topic", body.alias("t"), html.alias("h")).alias("x")).groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("l"))
    n = F.size("l")
    text = F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])), "")
    return grouped.select("user_id", n.alias("items"), _all("You have ", n.cast("string"), " topic reports this week:\n\n", "=" * 70, "\n\n", text).alias("text_body"), _all("<html><body>", F.array_join(F.transform("l", lambda x: x["h"]), ""), "</body></html>").alias("html_body"))
