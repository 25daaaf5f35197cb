"""From raw documents to packed sequences: quality, exact copies, near copies, repeated passages, packing.

Each stage works on all that the one before it kept; between stages the documents are a Parquet table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import exact, packing, quality, simhash, suffix
from gazette.llm.common import dropped, freed, scratch, shared_dir, stored, table, written


#: Bytes of a passage that goes where it repeats. A passage of over 50 words should go: on the check tables, 51 words in a row
#: take 245 bytes or more in 99 of 100 places (median 317), so that such a passage holds a window of this width.
PASSAGE = 240


#: Files whose names every task gets; where there are more, rows meet the names of their files by a shuffle.
NAMED = 100_000


def _unused(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def _numbered(docs: DataFrame, row: str, files: DataFrame) -> DataFrame:
    """docs with a number for each row: the number of its file in `files`, shifted left by 40 bits, and the row's place there.

    It depends on nothing but the file, so it is the same in every action, however files are cut into partitions and whichever
    executors there are."""
    place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    path, at = _unused("path", docs), _unused("at", docs)
    known = files.withColumnsRenamed({"path": _unused("of_path", docs), "n": _unused("of", docs)})
    named = docs.select("*", place[0].alias(path), place[1].alias(at))
    out = named.join(F.broadcast(known) if files.few else known, named[path] == known[known.columns[0]])
    return out.withColumn(row, F.shiftleft(known.columns[1], 40) + F.col(at)).drop(path, at, *known.columns)


def _files(docs: DataFrame) -> DataFrame:
    """(path, n) of the files that docs is read from, whose names the driver has listed anyway; few: whether they are NAMED at most."""
    paths = docs.select(F.col("_metadata.file_path").alias("path")).distinct()
    rows = [(r["path"], k) for k, r in enumerate(paths.orderBy("path").toLocalIterator())]
    files = docs.sparkSession.createDataFrame(rows, "path string, n long")
    files.few = len(rows) <= NAMED
    return files


def _of_files(docs: DataFrame) -> DataFrame:
    """docs as rows of files, which have a place there; rows that come otherwise are written to files first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return written(docs)
    return docs


def _one_each(docs: DataFrame, groups) -> DataFrame:
    """One row of docs for each group: that of the smallest doc_id, null last, and of the smallest number among its rows.

    groups: of rows (doc_id, text), where doc_id is the number of a row, the group (number of the row, group) of each."""
    row, docs = _unused("row", docs), _of_files(docs)
    numbered = _numbered(docs, row, _files(docs))
    of = groups(numbered.select(F.col(row).alias("doc_id"), "text")).toDF("n", "of")
    of = of.join(numbered.select(F.col(row).alias("k"), "doc_id"), F.col("n") == F.col("k"))
    kept = of.groupBy("of").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("first")).select(F.col("first.n").alias(_unused("kept", numbered)))
    return numbered.join(kept, numbered[row] == kept[kept.columns[0]], "left_semi").drop(row)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like any other; rows that repeat are scored alike; an empty table gives no rows, and without
    labels every score is the same. All columns stay, whatever their names."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = _unused("score", docs)
    return quality.with_score(docs, model, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of the smallest id.

    Null and empty texts are one group; null ids give way to others; of rows that repeat one stays; an empty table stays empty;
    texts of any length are read whole; all columns stay, whatever their names."""
    return _one_each(docs, lambda own: exact.exact_dedup(own).select("doc_id", "keep_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, of the smallest id.

    Texts without words, null ones too, are alike; texts of any length are read whole; null ids, repeated rows, empty tables and columns as in drop_copies."""
    return _one_each(docs, lambda own: simhash.near_dedup(own).select("doc_id", "component_id"))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of PASSAGE bytes or more that also stand elsewhere go; documents of which nothing is left go, too, null
    and empty texts among them.

    Rows that repeat are copies of each other and lose all such bytes: the stages before leave none. n_chars, where there is
    such a column, is that of what is left; texts of any length are read whole; other columns stay, whatever their names. An empty table stays empty."""
    cut = suffix.without_repeats(docs, PASSAGE)
    cut = cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut
    return cut.where("coalesce(length(trim(text)), 0) > 0")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences. Null texts count as empty: the one id that ends a document; rows that
    repeat are packed each; texts of any length are packed whole; an empty table gives no rows; columns besides doc_id and text are ignored."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_passages),
    ("packing", pack),
]

#: Neither the classifier nor the fingerprints, suffix arrays and tokens can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        with scratch():
            rows = stage(spark, docs, sf_dir)
            place = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
            rows.write.parquet(place)
        docs = stored(spark.read.schema(rows.schema).parquet(place), place)
        if before is not None:
            dropped(before)
        before = docs
        del rows
        freed(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
