"""A stored inverted index: segments of postings in Parquet, which only grow by further segments until they are merged.

A segment deals its documents to chunks by the hash of their id and its terms to buckets by theirs. A row is the postings of one
term in one chunk: ids in order and, for each, places as gaps. So no row grows with the table, however common its term is. Rows lie
in a folder for each bucket, sorted by term: a query reads the buckets of its words alone, and in these the pages that its words
are on. A manifest, whose versions are written one after another, says which segments count; a writer that fails before its
manifest is written has changed nothing, and no file is ever changed or written again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import find, parsed_queries, placed, stems, words

#: Folders of a segment; documents of a chunk, about.
BUCKETS, CHUNK = 256, 2048
#: Words of queries that are written into the plan; more are joined.
IN_PLAN = 1000

_BLOCK = "term string, chunk int, n int, first_id string, last_id string, ids array<string>, gaps array<array<int>>, bucket int"
_MANIFEST = "version int, segment string, born int, buckets int"


def _bucket(term: Column, buckets) -> Column:
    return F.pmod(F.xxhash64(term), buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _last(spark: SparkSession, path: str) -> list:
    """The rows of the newest manifest: one for each segment that counts."""
    if not _exists(spark, f"{path}/manifest"):
        return []
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()
    newest = max((r["version"] for r in rows), default=0)
    return [r for r in rows if r["version"] == newest]


def _commit(spark: SparkSession, path: str, version: int, segments: list[tuple[str, int, int]]) -> None:
    rows = [(version, *s) for s in segments] or [(version, None, 0, 0)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _blocks(postings: DataFrame, chunks: int, buckets: int) -> DataFrame:
    """Rows of a segment from postings (term, id, places)."""
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")
    spread = postings.select(_bucket(F.col("term"), buckets).alias("bucket"), "term", chunk.alias("chunk"), "id", "places").repartition("bucket")
    rows = spread.groupBy("bucket", "term", "chunk").agg(F.array_sort(F.collect_list(F.struct("id", "places"))).alias("docs"))
    gaps = F.transform("docs", lambda d: F.transform(d["places"], lambda p, k: F.when(k == 0, p).otherwise(p - F.get(d["places"], k - 1))))
    rows = rows.select("bucket", "term", "chunk", F.size("docs").alias("n"), F.col("docs")[0]["id"].alias("first_id"), F.element_at("docs", -1)["id"].alias("last_id"), F.transform("docs", lambda d: d["id"]).alias("ids"), gaps.alias("gaps"))
    return rows.sortWithinPartitions("bucket", "term", "chunk")


def _write(df: DataFrame, place: str) -> None:
    df.write.option("parquet.page.size", 64 << 10).option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(place)


def add(docs: DataFrame, path: str, id_: str, text: Column, stem: bool = False, buckets: int = BUCKETS) -> str:
    """Stores a segment for docs; those that the index has already are read from this segment from now on. Returns its name.

    Documents of null ids are left out; of null texts nothing is found, but what was stored of them before goes."""
    spark = docs.sparkSession
    before = _last(spark, path)
    version, name = max((r["version"] for r in before), default=0) + 1, uuid.uuid4().hex
    place = f"{path}/segments/{name}"
    own = docs.where(F.col(id_).isNotNull()).select(F.col(id_).cast("string").alias("id"), words(text).alias("w"))
    own = own.select("id", stems(F.col("w")).alias("w")) if stem else own
    own.select("id").write.parquet(f"{place}/documents")
    n = spark.read.parquet(f"{place}/documents").count()
    places = placed(own.select("id", F.col("w").alias("words")), "id")
    if n > spark.read.parquet(f"{place}/documents").distinct().count():  # words of an id that comes several times lie together
        places = places.groupBy("term", "id").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    _write(_blocks(places, max(1, -(-n // CHUNK)), buckets), f"{place}/postings")
    _commit(spark, path, version, [(r["segment"], r["born"], r["buckets"]) for r in before if r["segment"]] + [(name, version, buckets)])
    return name


def remove(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Documents of ids (id) are found no more."""
    add(ids.select("id", F.lit(None).cast("string").alias("nothing")), path, "id", F.col("nothing"))


def _documents(spark: SparkSession, path: str, segments: list) -> DataFrame | None:
    """(id, born): documents of all segments but the first, whose postings in segments born earlier no longer count."""
    later = [spark.read.schema("id string").parquet(f"{path}/segments/{r['segment']}/documents").select("id", F.lit(r["born"]).alias("newest")) for r in segments[1:]]
    if not later:
        return None
    out = later[0]
    for df in later[1:]:
        out = out.union(df)
    return out.groupBy("id").agg(F.max("newest").alias("newest"))


def postings(spark: SparkSession, path: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, id, places) of the documents as they were last added, for some terms (term) or for all."""
    segments = sorted((r for r in _last(spark, path) if r["segment"]), key=lambda r: r["born"])
    if not segments:
        return spark.createDataFrame([], "term string, id string, places array<int>")
    few = None
    if terms is not None:
        terms = terms.select("term").distinct()
        few = [r["term"] for r in terms.limit(IN_PLAN + 1).collect()]
    parts = []
    for r in segments:
        rows = spark.read.schema(_BLOCK).parquet(f"{path}/segments/{r['segment']}/postings")
        if few is not None and len(few) <= IN_PLAN:
            own = [x[0] for x in spark.createDataFrame([(t,) for t in few], "term string").select(_bucket(F.col("term"), r["buckets"])).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(own) & F.col("term").isin(few))
        elif terms is not None:
            rows = rows.join(terms.withColumn("bucket", _bucket(F.col("term"), r["buckets"])), ["bucket", "term"], "left_semi")
        parts.append(rows.select("term", F.inline(F.arrays_zip("ids", "gaps")).alias("id", "gaps"), F.lit(r["born"]).alias("born")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    newer = _documents(spark, path, segments)
    if newer is not None:
        newer = newer.withColumnRenamed("id", "of")
        out = out.join(newer, (F.col("id") == F.col("of")) & (F.col("newest") > F.col("born")), "left_anti")
    sums = F.aggregate("gaps", F.array().cast("array<int>"), lambda have, g: F.array_append(have, F.coalesce(F.try_element_at(have, F.lit(-1)), F.lit(0)) + g))
    return out.select("term", "id", sums.alias("places"))


def merge(spark: SparkSession, path: str, buckets: int = BUCKETS) -> str:
    """Makes one segment of all. What queries read meanwhile stays where it is; folders that no manifest names may be deleted later."""
    before = _last(spark, path)
    version, name = max((r["version"] for r in before), default=0) + 1, uuid.uuid4().hex
    place = f"{path}/segments/{name}"
    live = postings(spark, path)
    ids = [spark.read.schema("id string").parquet(f"{path}/segments/{r['segment']}/documents") for r in before if r["segment"]]
    every = spark.createDataFrame([], "id string")
    for df in ids:
        every = every.union(df)
    every.distinct().write.parquet(f"{place}/documents")
    n = spark.read.parquet(f"{place}/documents").count()
    _write(_blocks(live, max(1, -(-n // CHUNK)), buckets), f"{place}/postings")
    _commit(spark, path, version, [(name, version, buckets)])
    return name


def find_stored(spark: SparkSession, path: str, ids: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, id) like search.find(), reading those buckets of the stored index that hold words of queries (query_id, query)."""
    asked = parsed_queries(queries, stem).select(F.explode("words").alias("term"))
    return find(postings(spark, path, asked), ids, queries, stem)
