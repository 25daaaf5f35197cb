"""Readers who follow the link in a mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import enabled
from ..functions.signed import subject_of
from ..operators.store import update_ids

OFF = '{"enabled":false,"delivery_frequency":"daily"}'


def unsubscribed(profiles: DataFrame, requests: DataFrame, now: Column, secret: str) -> tuple[DataFrame, DataFrame]:
    """The profiles afterwards, and requests (token, user_id) with the user they prove to be of, or an error, and their outcome.

    A token that is broken, forged, of another kind or too old is invalid; where the request names a user, it must be the token's.
    Requests may have a method and confirm: a link that is only followed (GET) asks for confirmation, and counts with confirm
    true or as POST, which is meant where there is no method. Notifications of those that are left are turned off; their other
    preferences are the default ones. outcome: error, already (they were off), to confirm, or done."""
    who = subject_of(F.col("token"), now, secret)
    out = requests.withColumn("subject", who)
    named = F.coalesce("user_id", F.lit("")) != ""
    error = F.when(F.coalesce("subject", F.lit("")) == "", "invalid token").when(named & (F.col("user_id") != F.col("subject")), "user id mismatch")
    out = out.withColumn("error", error)
    sure = F.lit(True) if "method" not in requests.columns else F.upper(F.coalesce("method", F.lit("POST"))) == "POST"
    if "confirm" in requests.columns:
        sure = sure | F.coalesce(F.col("confirm").cast("string") == "true", F.lit(False))
    off = profiles.where(~enabled(F.col("notification_preferences"))).select(F.col("id").alias("subject"), F.lit(True).alias("was_off"))
    out = out.join(off, "subject", "left").withColumn("outcome", F.when(F.col("error").isNotNull(), "error").when(F.col("was_off"), "already").when(sure, "done").otherwise("to confirm")).drop("was_off")
    return update_ids(profiles, out.where(F.col("error").isNull() & sure).select(F.col("subject").alias("id")), notification_preferences=F.lit(OFF)), out
