"""A digest run: pending rows become sent or failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import enabled
from ..operators.digest import pending


def run(queue: DataFrame, profiles: DataFrame, contents: DataFrame, now: Column, batch: str | None = None, kind: str | None = None, refused: DataFrame | None = None, dry: bool = False) -> dict[str, DataFrame]:
    """queue: the queue afterwards; history: rows to append; stats: one row (sent, failed, skipped).

    contents (content_id): what can be shown. refused (user_id, error): users whom the mail service refused. A user whose
    notifications are off fails without history, one without any content fails with it; both count as skipped. A dry run
    counts what it would send and changes nothing. Failed rows get no time of sending. Rows of users without a profile stay
    pending; store.missing_profiles() makes the profiles they lack."""
    rows = pending(queue, batch, kind)
    content = F.coalesce("report_id", "newsletter_id")
    there = contents.select(F.col("content_id").alias("_c")).distinct().withColumn("_there", F.lit(True))
    users = rows.join(there, content == F.col("_c"), "left").groupBy("user_id").agg(F.count("_there").alias("shown"), F.array_sort(F.collect_set(content)).alias("content_ids"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.max("digest_batch_id").alias("digest_batch_id"), F.max("notification_type").alias("kind"))
    on = profiles.select(F.col("id").alias("_u"), enabled(F.col("notification_preferences")).alias("on"))
    users = users.join(on, F.col("user_id") == F.col("_u"))
    if refused is None:
        users = users.withColumn("error", F.lit(None).cast("string"))
    else:
        users = users.join(refused.select(F.col("user_id").alias("_r"), "error"), F.col("user_id") == F.col("_r"), "left")
    outcome = F.when(~F.col("on"), "off").when(F.lit(dry), "sent").when(F.col("shown") == 0, "empty").when(F.col("error").isNotNull(), "refused").otherwise("sent")
    message = F.when(F.col("outcome") == "off", "notifications disabled").when(F.col("outcome") == "empty", "Empty digest content").otherwise(F.col("error"))
    users = users.withColumn("outcome", outcome).withColumn("message", F.when(F.col("outcome") != "sent", message))
    stats = users.agg(F.count_if(F.col("outcome") == "sent").alias("sent"), F.count_if(F.col("outcome") == "refused").alias("failed"), F.count_if(F.col("outcome").isin("off", "empty")).alias("skipped"))
    history = users.where("outcome <> 'off'").select("user_id", F.col("content_ids").alias("newsletter_ids"), "rule_ids", "digest_batch_id", F.concat("kind", F.lit("_digest")).alias("delivery_type"), now.alias("sent_at"), (F.col("outcome") == "sent").alias("success"), F.col("message").alias("error_message"))
    if dry:
        return {"queue": queue, "history": history.limit(0), "stats": stats}
    marks = users.select(F.col("user_id").alias("_m"), "outcome", "message")
    own = rows.select(F.col("id").alias("_q"), F.col("user_id").alias("_qu")).join(marks, F.col("_qu") == F.col("_m")).select("_q", "outcome", "message")
    after = queue.join(own, F.col("id") == F.col("_q"), "left")
    sent = F.col("outcome") == "sent"
    status = F.when(sent, "sent").when(F.col("outcome").isNotNull(), "failed").otherwise(F.col("status"))
    columns = {"status": status, "sent_at": F.when(sent, now).otherwise(F.col("sent_at")), "error_message": F.when(F.col("outcome").isNotNull() & ~sent, F.col("message")).otherwise(F.col("error_message"))}
    return {"queue": after.select(*(columns.get(c, F.col(c)).alias(c) for c in queue.columns)), "history": history, "stats": stats}


def send(digests: DataFrame, mailer) -> None:
    """Hands every digest (user_id, text_body, html_body) to mailer(rows), once for each partition."""
    digests.foreachPartition(mailer)
