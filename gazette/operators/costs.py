"""What enrichment and reports cost with a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_CHARS, RESPONSE_TOKENS
from ..functions.cost import cost, token_count
from ..functions.dates import week_id
from ..functions.prompts import prompt_column

#: Tokens of a prompt besides the document, and of a schema where it is part of the prompt, by operation.
PROMPT_TOKENS = {"topics": 160, "summary": 140, "relevance_score": 320, "weekly_facts": 220, "weekly_synthesis": 260}
SCHEMA_TOKENS = 90
DOCUMENT_OPERATIONS = ["topics", "summary", "relevance_score"]
#: Facts that a synthesis is assumed to read at most, and tokens of each.
FACTS, FACT_TOKENS = 10, 40


def _of(values: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def document_tokens(docs: DataFrame, schema_in_prompt: bool = False, most: int = MAX_CHARS) -> DataFrame:
    """(id, operation, input_tokens, output_tokens); documents without text are left out."""
    own = docs.where("coalesce(plain_text, '') <> ''").select("id", token_count(F.substring("plain_text", 1, most)).alias("n"), F.explode(F.array(*map(F.lit, DOCUMENT_OPERATIONS))).alias("operation"))
    extra = SCHEMA_TOKENS if schema_in_prompt else 0
    return own.select("id", "operation", (F.col("n") + _of(PROMPT_TOKENS, F.col("operation")) + extra).cast("long").alias("input_tokens"), _of(RESPONSE_TOKENS, F.col("operation")).cast("long").alias("output_tokens"))


def call_tokens(docs: DataFrame, count: Callable[[Column], Column] = token_count, schema_in_prompt: bool = False, most: int = MAX_CHARS) -> DataFrame:
    """(id, operation, input_tokens, output_tokens) by the whole prompts of each document's calls, counted by count(). docs: id,
    subject, plain_text, topics, summary; documents without text are left out."""
    content = F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.substring("plain_text", 1, most))
    parts = {"topics": {}, "summary": {}, "relevance_score": {"topics": F.array_join("topics", ", "), "summary": F.col("summary")}}
    own = docs.where("coalesce(plain_text, '') <> ''").withColumn("content", content)
    calls = own.select("id", F.explode(F.array(*(F.struct(F.lit(o).alias("operation"), prompt_column(o, content=F.col("content"), **p).alias("prompt")) for o, p in parts.items()))).alias("call")).select("id", "call.*")
    extra = SCHEMA_TOKENS if schema_in_prompt else 0
    return calls.select("id", "operation", (count(F.col("prompt")) + extra).cast("long").alias("input_tokens"), _of(RESPONSE_TOKENS, F.col("operation")).cast("long").alias("output_tokens"))


def weekly_tokens(docs: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """(week_id, topic, newsletters, input_tokens, output_tokens): facts of each document, then one synthesis."""
    own = docs.where("received_date is not null and coalesce(plain_text, '') <> ''").select(week_id(F.col("received_date")).alias("week_id"), F.explode(F.array_distinct("topics")).alias("topic"), token_count(F.substring("plain_text", 1, most)).alias("n"))
    rows = own.groupBy("week_id", "topic").agg(F.count("*").alias("newsletters"), F.sum("n").alias("n"))
    facts = F.least(F.col("newsletters"), F.lit(FACTS)) * FACT_TOKENS
    return rows.select("week_id", "topic", "newsletters", (F.col("n") + F.col("newsletters") * PROMPT_TOKENS["weekly_facts"] + facts + PROMPT_TOKENS["weekly_synthesis"]).cast("long").alias("input_tokens"), (F.col("newsletters") * RESPONSE_TOKENS["weekly_facts"] + RESPONSE_TOKENS["weekly_synthesis"]).cast("long").alias("output_tokens"))


def by_operation(tokens: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Sums by operation with averages: tokens a document rounded down, cost a document not."""
    sums = tokens.groupBy("operation").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    a, b, t = cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(price_in), F.lit(price_out))
    return sums.select("*", a.alias("input_cost"), b.alias("output_cost"), t.alias("total_cost")).select("*", F.expr("input_tokens div calls").alias("average_input"), (F.col("total_cost") / F.col("calls")).alias("average_cost"))


def projected(tokens: DataFrame, price_in: float, price_out: float, months: tuple[int, ...] = (100, 1000)) -> DataFrame:
    """Costs of so many documents a month."""
    total = tokens.agg(F.count_distinct("id").alias("documents"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    each = cost(F.col("i"), F.col("o"), F.lit(price_in), F.lit(price_out))[2] / F.col("documents")
    return total.select("documents", F.explode(F.array(*map(F.lit, months))).alias("per_month"), each.alias("each")).select("documents", F.col("per_month").cast("long").alias("per_month"), F.round(F.col("each") * F.col("per_month"), 6).alias("monthly_cost"))


def compared(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """What all tokens cost with each model, the cheapest first, and how many times the cheapest that is.

    Tokens are summed before they meet the price list, which has some hundred rows."""
    total = tokens.agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    a, b, t = cost(F.col("i"), F.col("o"), F.col("input_cost_per_1m"), F.col("output_cost_per_1m"))
    rows = prices.join(F.broadcast(total)).select("provider", "model", a.alias("input_cost"), b.alias("output_cost"), t.alias("total_cost"))
    least = rows.agg(F.min("total_cost").alias("least"))
    return rows.join(F.broadcast(least)).select("provider", "model", "input_cost", "output_cost", "total_cost", F.when(F.col("least") > 0, F.round(F.col("total_cost") / F.col("least"), 4)).alias("times_cheapest")).orderBy("total_cost", "model")


def weekly_cost(tokens: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Of weekly_tokens(): all costs, reports a week, and the cost of four weeks."""
    c = cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(price_in), F.lit(price_out))[2]
    rows = tokens.agg(F.count("*").alias("reports"), F.count_distinct("week_id").alias("weeks"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    per_week = F.col("reports") / F.greatest(F.col("weeks"), F.lit(1))
    each = F.when(F.col("reports") > 0, F.col("total_cost") / F.col("reports")).otherwise(0.0)
    return rows.withColumn("total_cost", c).select("reports", "weeks", "input_tokens", "output_tokens", "total_cost", F.round(per_week, 4).alias("reports_per_week"), F.round(per_week * 4 * each, 6).alias("monthly_cost"))


def providers(prices: DataFrame) -> DataFrame:
    return prices.select("provider").distinct().orderBy("provider")


def models(prices: DataFrame, provider: str | None = None) -> DataFrame:
    return (prices if provider is None else prices.where(F.col("provider") == provider)).select("provider", "model").orderBy("model")


def report_text(summary: DataFrame) -> DataFrame:
    """Lines of a cost report of by_operation(), for a text sink."""
    return summary.select(F.format_string("%-18s %12d in %12d out  $%.6f", "operation", "input_tokens", "output_tokens", "total_cost").alias("value"))


def save(df: DataFrame, path: str, kind: str) -> None:
    """kind: json, csv or text (one column named value)."""
    writer = df.write.mode("overwrite")
    {"json": writer.json, "text": writer.text, "csv": lambda p: writer.option("header", True).csv(p)}[kind](path)


def save_samples(docs: DataFrame, path: str) -> None:
    """A folder for each source, named after it."""
    from ..functions.text import slug

    docs.withColumn("source_slug", slug(F.col("source_name"))).write.mode("overwrite").partitionBy("source_slug").json(path)
