"""Document analytics on Spark: ingest, clean, search, match and summarise collections of newsletters."""
