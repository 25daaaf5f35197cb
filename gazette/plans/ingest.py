"""From messages and archive pages to stored newsletters and queued notifications."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import sanitize_html, text_difference
from ..functions.text import redact, sanitize_text
from ..operators.match import match_daily, new_daily, queue_rows, source_of_sender
from ..operators.search import lacking_metadata, latest
from ..operators.store import newcomers
from ..sources.mail import parsed_mail, parsed_pages
from .enrich import enriched


def ingest_mail(messages: DataFrame, existing: DataFrame, mappings: DataFrame, sources: DataFrame, rules: DataFrame, profiles: DataFrame, now: Column, enrich: Callable | None = None, phrases: list[str] | None = None) -> dict[str, DataFrame]:
    """new: newsletters to store; unmapped: mail of unknown senders; queue: rows for the daily rules that fit.

    A message seen before, by its uid, is left out. Without enrichment no topics are known, so only phrases and wards match."""
    parsed = source_of_sender(parsed_mail(messages, phrases), mappings)
    fresh = newcomers(existing, parsed, ["email_uid"], ["received_date"])
    new = fresh.where("source_id is not null").withColumn("id", F.sha2(F.col("email_uid"), 256))
    if enrich is None:
        new = new.withColumns({"topics": F.array().cast("array<string>"), "summary": F.lit(None).cast("string"), "relevance_score": F.lit(None).cast("int")})
    else:
        new = new.join(enriched(new, enrich), "id", "left")
    wards = sources.select(F.col("id").alias("_s"), "ward_number")
    queue = queue_rows(match_daily(new.join(wards, F.col("source_id") == F.col("_s"), "left"), rules, profiles), now)
    return {"new": new.withColumn("created_at", now), "unmapped": fresh.where("source_id is null").select("email_uid", "from_email", "subject", "received_date"), "queue": queue}


def ingest_pages(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """Newsletters of fetched pages whose source has none of that subject yet. They are stored as they are and match no rules."""
    return newcomers(existing, parsed_pages(pages), ["source_id", "subject"], ["received_date", "url"])


def reprocessed(docs: DataFrame, newest: int | None = None, skip: int | None = None, missing: bool = False, source_id: int | None = None, id_: str | None = None, everything: bool = False, enrich: Callable | None = None) -> DataFrame:
    """docs enriched anew: all conditions hold together; documents without text are left out."""
    own = docs.where("coalesce(plain_text, '') <> ''")
    own = lacking_metadata(own) if missing else own
    own = own if source_id is None else own.where(F.col("source_id") == source_id)
    own = own if id_ is None else own.where(F.col("id") == id_)
    own = latest(own, newest, skip, everything)
    return enriched(own, enrich) if enrich else enriched(own)


def reprocess(docs: DataFrame, sources: DataFrame, enrich: Callable[[DataFrame], DataFrame], rules: DataFrame | None = None, profiles: DataFrame | None = None, queue: DataFrame | None = None, now: Column | None = None) -> dict[str, DataFrame]:
    """docs, of those chosen, with what enrich makes of those with text; and where rules are given, queue: rows for the daily rules
    that fit now and are not in the queue yet."""
    made = enrich(docs.where("coalesce(plain_text, '') <> ''"))
    kept = [c for c in docs.columns if c not in ("topics", "summary", "relevance_score")]
    out = {"docs": docs.select(*kept).join(made.select("id", "topics", "summary", "relevance_score"), "id")}
    if rules is not None:
        wards = sources.select(F.col("id").alias("source_id"), "ward_number")
        out["queue"] = queue_rows(new_daily(out["docs"].join(wards, "source_id", "left"), rules, profiles, queue), now)
    return out


def resanitized(docs: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """(id, raw_html, plain_text, modified, difference) of all documents under the present patterns; a second time changes no text."""
    html, text = redact(sanitize_html(F.col("raw_html")), phrases or []), redact(sanitize_text(F.col("plain_text")), phrases or [])
    out = docs.select("id", F.col("raw_html").alias("h"), F.col("plain_text").alias("t"), html.alias("raw_html"), text.alias("plain_text"))
    modified = ~(F.coalesce("h", F.lit("")).eqNullSafe(F.col("raw_html")) & F.coalesce("t", F.lit("")).eqNullSafe(F.col("plain_text")))
    return out.select("id", "raw_html", "plain_text", modified.alias("modified"), text_difference(F.col("t"), F.col("plain_text")).alias("difference"))


def chosen(docs: DataFrame, sources: DataFrame, newest: int | None = None, id_: str | None = None, source_id: int | None = None) -> DataFrame:
    """Documents for a cost analysis: an id goes before a source. Names and wards of sources come along."""
    s = sources.select(F.col("id").alias("_s"), F.coalesce("name", F.lit("Unknown")).alias("source_name"), F.nullif("ward_number", F.lit("")).alias("ward_number"))
    own = docs.join(s, F.col("source_id") == F.col("_s")).drop("_s")
    if id_ is not None:
        own = own.where(F.col("id") == id_)
    elif source_id is not None:
        own = own.where(F.col("source_id") == source_id)
    return latest(own, newest)
