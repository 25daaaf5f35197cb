"""Reading the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MAIL, PRICING


def table(spark: SparkSession, place: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{place}/{name}.parquet")


def pricing(spark: SparkSession, path: str) -> DataFrame:
    """One row for each model of a price list; a file that doesn't fit the schema, or lacks a required field, fails."""
    rows = spark.read.schema(PRICING).option("multiLine", True).option("mode", "FAILFAST").json(path)
    models = rows.select("version", F.inline("models"))
    needed = [c for c in models.columns if c not in ("notes", "version")]
    missing = F.greatest(*(F.col(c).isNull().cast("int") for c in needed)) > 0
    return models.where(F.assert_true(~missing, "a model of the price list lacks a required field").isNull())


def mail(spark: SparkSession, path: str) -> DataFrame:
    """Unread messages of a landing folder of JSON files."""
    return spark.read.schema(MAIL).json(path).where(~F.coalesce("seen", F.lit(False)))


def with_archive(sources: DataFrame) -> DataFrame:
    return sources.where("newsletter_archive_url is not null")


def streamed(spark: SparkSession, folder: str, name: str, files: int | None = None) -> DataFrame:
    """A table of a folder as a stream of its files, so many at a time."""
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{folder}/{name}.parque[t]")  # a pattern, as the table may be one file
