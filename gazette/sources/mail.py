"""From messages and pages to newsletters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parsed_date
from ..functions.html import html_to_text, page_links, sanitize_html, subject_of_page
from ..functions.text import redact, sanitize_text


def parsed_mail(messages: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """Newsletters of messages: subject with a default, first recipient, sanitized parts; text out of HTML only if there is none."""
    phrases = phrases or []
    html = redact(sanitize_html(F.col("html")), phrases)
    own_text = redact(sanitize_text(F.col("text")), phrases)
    out = messages.select("*", html.alias("raw_html"), own_text.alias("own_text"))
    return out.select(
        F.col("uid").alias("email_uid"),
        F.coalesce(F.nullif("subject", F.lit("")), F.lit("(No subject)")).alias("subject"),
        F.col("from_").alias("from_email"),
        F.coalesce(F.try_element_at("to", F.lit(1)), F.lit("")).alias("to_email"),
        F.col("date").alias("received_date"),
        "raw_html",
        F.when(F.coalesce("text", F.lit("")) != "", F.col("own_text")).otherwise(html_to_text(F.col("raw_html"))).alias("plain_text"),
    )


def archive(pages: DataFrame, url: Column, html: Column) -> DataFrame:
    """One row for each newsletter that the archive pages link to."""
    return pages.select("*", F.inline(page_links(html, url)))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Newsletters of fetched pages (source_id, url, html, title, date_str, fetched_at); they are not sanitized."""
    text = html_to_text(F.col("html"))
    return pages.select("source_id", "url", subject_of_page(F.col("html"), F.col("title")).alias("subject"), F.col("html").alias("raw_html"), text.alias("plain_text"), F.coalesce(parsed_date(F.col("date_str")), F.col("fetched_at")).alias("received_date"))
