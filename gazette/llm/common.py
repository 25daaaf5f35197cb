"""Helpers shared by the operators: tables, shared folders, batches of texts, connected components."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes where Spark knows that limit, in an Arrow batch that carries texts; keeps a batch of long texts small.
TEXT_ROWS, TEXT_BYTES = 400, 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id written as text, modulo mod; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode, where that is unset, one of our own, as in tests.
    On a cluster the setting is needed, as executors don't see each other's local folders."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = os.path.join(tempfile.gettempdir(), f"gazette-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


_scratch: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch():
    """Tables that written() makes within are deleted at the end: what is made from them has to be written elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            dropped(df)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, as read from a path that dropped() may delete."""
    df._written_at = path
    return df


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no DataFrame stands for any more; it does so once the JVM has noticed."""
    gc.collect()
    spark._jvm.System.gc()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch of texts, one after another, and the n + 1 offsets; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes[offsets[0] : offsets[-1]], offsets - offsets[0]


#: A bytes -> bytes table that lower-cases A-Z.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

#: Bytes of words.
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1, modulo 2 ** 64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0], k = 1, 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word (a run of bytes outside \\x20 and \\x09-\\x0D, never across texts): start, end, number of its text, 64-bit hash."""
    if lower:
        data = LOWERED[data]
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, np.zeros(0, np.uint64)
    inside = WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < n]
    begins[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    if not len(start):
        return start, end, doc, np.zeros(0, np.uint64)
    # sum of byte * r ** place, freed of the place of its first byte
    value = (data.astype(np.uint64) + np.uint64(1)) * powers(_ODD, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    h = (total[end] - total[start]) * powers(_INVERSE, n)[start]
    return start, end, doc, mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def local_stars(batches, a: str = "a", b: str = "b"):
    """Replaces the edges of a partition by edges from each vertex to the smallest it reaches within the partition."""
    parts = [pa.table(x) if not isinstance(x, pa.RecordBatch) else x for x in batches]
    parts = [x for x in parts if x.num_rows]
    if not parts:
        return
    x = np.concatenate([p.column(a).to_numpy(zero_copy_only=False) for p in parts])
    y = np.concatenate([p.column(b).to_numpy(zero_copy_only=False) for p in parts])
    names, where = np.unique(np.concatenate([x, y]), return_inverse=True)
    root = reached(where[: len(x)], where[len(x) :], len(names))
    moved = np.flatnonzero(root != np.arange(len(names)))
    for i in range(0, len(moved), 50_000):
        part = moved[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(names[root[part]])], names=[a, b])


def reached(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For vertices 0 .. n - 1 and edges x - y: the smallest vertex that each one reaches."""
    root = np.arange(n)
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        x, y, low, high = x[open_], y[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex with an edge in edges (a, b): component is the smallest id it reaches.

    Alternating large and small stars: each round hangs the neighbours of every vertex on the smallest one, by
    aggregation and join over the shuffled edges; the partitions are contracted on their own before. Edges
    with a null end and loops count for nothing. Ends when every tree is a star."""
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = written(edges.mapInArrow(local_stars, "a long, b long").distinct())
    while True:
        # large star: every larger neighbour of u, and u's, goes to the smallest one near u
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        next_ = written(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        ends = next_.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(next_.select(F.col("b"), F.lit(0), F.lit(1)))
        open_ = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        done = open_.limit(1).count() == 0
        dropped(now)
        now = next_
        if done:
            break
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
