"""Enrichment that asks once: answers are kept by the digest of what was asked, and stored as they come.

Equal contents are asked about once, however many documents have them. What is new is asked in waves, each of which is stored
when it is done: a run that is killed loses no more than the wave it was at, and the next one goes on there. Answers with a failed
step are stored, too, but asked again by the next run. Another model, prompt or length is another version, and asked anew."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_CHARS
from ..session import shared_place
from .enrich import FAILURES, Enricher, Lexicon, enriched

#: Contents of a wave, about; files of those that are to be asked about, for the tasks of a wave.
WAVE, PIECES = 10_000, 8
ANSWERS = f"digest string, topics array<string>, summary string, relevance_score int, {FAILURES}, run long"


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """All answers so far; of a digest that was asked several times, each."""
    if not _there(spark, path):
        return spark.createDataFrame([], ANSWERS)
    return spark.read.schema(ANSWERS).option("recursiveFileLookup", True).parquet(path)


def _asked(docs: DataFrame, version: str, most: int) -> DataFrame:
    subject, text = F.coalesce("subject", F.lit("")), F.coalesce(F.substring("plain_text", 1, most), F.lit(""))
    digest = F.sha2(F.concat_ws("\u0000", F.lit(version), F.lit(most), F.length(subject), subject, text), 256)
    return docs.select("id", "subject", "plain_text", digest.alias("digest"))


def remembered(docs: DataFrame, path: str, version: str, make: Callable[[], Enricher] = Lexicon, most: int = MAX_CHARS, at_once: int = 1) -> DataFrame:
    """docs (id, subject, plain_text) with topics, summary, relevance_score and failures, like enriched(); answers that the table at
    path has for this version are taken from there, the others are asked for and added to it.

    Each row gets its answer, also of rows that share an id; null subjects and texts count as empty."""
    spark = docs.sparkSession
    asked = _asked(docs, version, most)
    good = stored_answers(spark, path).where("size(failures) = 0").select("digest")
    new = asked.join(good, "digest", "left_anti").dropDuplicates(["digest"])
    run = (stored_answers(spark, path).agg(F.max("run")).first()[0] or 0) + 1
    waves, todo = -(-new.select("digest").count() // WAVE), shared_place(spark)
    if waves:
        # the digests are spread evenly; what is to be asked is told once, and each wave reads its own part
        wave, piece = F.pmod(F.xxhash64("digest"), F.lit(waves)).alias("wave"), F.pmod(F.hash("digest"), F.lit(PIECES)).alias("piece")
        new.select("digest", "subject", F.substring("plain_text", 1, most).alias("plain_text"), wave, piece).repartition("wave", "piece").drop("piece").write.partitionBy("wave").parquet(todo)
    for k in range(waves):
        own = spark.read.schema("digest string, subject string, plain_text string").parquet(f"{todo}/wave={k}") if _there(spark, f"{todo}/wave={k}") else None
        if own is None:
            continue
        answers = enriched(own.withColumnRenamed("digest", "id"), make, most, failures=True, at_once=at_once)
        answers.select(F.col("id").alias("digest"), "topics", "summary", "relevance_score", "failures", F.lit(run).cast("long").alias("run")).write.parquet(f"{path}/{uuid.uuid4().hex}")
    if waves:
        p = spark._jvm.org.apache.hadoop.fs.Path(todo)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    what = F.struct("topics", "summary", "relevance_score", "failures")
    best = stored_answers(spark, path).groupBy("digest").agg(F.max_by(what, F.struct(F.size("failures") == 0, "run")).alias("a"))
    return asked.join(best, "digest").select("id", "a.*")
