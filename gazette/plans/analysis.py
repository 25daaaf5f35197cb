"""A cost analysis from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import costs
from .ingest import chosen


def run(docs: DataFrame, sources: DataFrame, prices: DataFrame, price_in: float, price_out: float, newest: int | None = None, id_: str | None = None, source_id: int | None = None) -> dict[str, DataFrame]:
    """What enriching the chosen documents costs: by_operation, projection, by model (compared), weekly (week_id, topic, tokens) and
    weekly_cost. An id goes before a source; documents without text cost nothing."""
    own = chosen(docs, sources, newest, id_, source_id)
    tokens = costs.document_tokens(own)
    weekly = costs.weekly_tokens(own)
    return {
        "by_operation": costs.by_operation(tokens, price_in, price_out),
        "projection": costs.projected(tokens, price_in, price_out),
        "compared": costs.compared(tokens, prices),
        "weekly": weekly,
        "weekly_cost": costs.weekly_cost(weekly, price_in, price_out),
    }
