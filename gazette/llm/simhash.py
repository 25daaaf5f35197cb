"""Operator 5: SimHash near-dedup. Fingerprints that agree on enough blocks of bits meet; pivot distance tables discard
most of the pairs that meet, and the rest is verified by its Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, written

SHINGLE, SEED, NEAR = 4, 42, 4
#: Reference fingerprints of the pivot tables.
PIVOTS = np.random.default_rng(64).integers(0, 1 << 63, 24, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Fingerprints of a bucket that one task compares; larger buckets are dealt out as pairs of chunks.
BUCKET = 4096
#: Rows that a task takes together.
TOGETHER = 200_000


def fingerprint(text: str | bytes | None) -> int:
    """64 bits: each is set if it is set in over half of the hashes of the text's 4-word shingles, repeats included."""
    import xxhash

    raw = (text.encode() if isinstance(text, str) else text or b"").lower().split()  # A-Z only; splits at \x20 and \x09-\x0D
    if not raw:
        return 0
    whole = b" ".join(raw)
    if len(raw) <= SHINGLE:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    starts = np.concatenate([[0], ends[: -SHINGLE] + 1]).tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, len(raw) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8), bitorder="little")
        ones += part.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row; null and wordless texts have fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.astype(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def blocks(n: int, near: int) -> list[tuple[int, int]]:
    """(first bit, bits) of near + 2 blocks for up to some million fingerprints, and of one or two more beyond."""
    k = near + 2 + (n > 1 << 22) + (n > 1 << 28)
    cut = [round(64 * i / k) for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def keys(n: int, near: int) -> list:
    """Column expressions over fp: of k blocks, `near` differing bits leave k - near alike, so any choice of that many is a key."""
    of = blocks(n, near)
    out = []
    for i, chosen in enumerate(combinations(of, len(of) - near)):
        mask = sum(((1 << width) - 1) << at for at, width in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))))
    return out


def near_pairs(key: np.ndarray, fp: np.ndarray, near: int) -> np.ndarray:
    """For rows sorted by key: the smallest row that each one reaches over pairs of equal key and at most `near` differing bits."""
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    root, i, s = np.arange(n), np.arange(n), 1

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    while True:
        i = i[: np.searchsorted(i, n - s)]
        i = i[key[i] == key[i + s]]
        if not len(i):
            break
        left = i
        for p in range(table.shape[1]):  # the largest difference of coordinates is a lower bound of the distance
            left = left[np.abs(table[left, p] - table[left + s, p]) <= near]
            if not len(left):
                break
        left = left[root[left] != root[left + s]]
        left = left[np.bitwise_count(fp[left] ^ fp[left + s]) <= near]
        for x in left.tolist() if len(left) <= 5000 else ():
            a, b = find(x), find(x + s)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(left) > 5000:
            while True:
                low, high = np.minimum(root[left], root[left + s]), np.maximum(root[left], root[left + s])
                if (low == high).all():
                    break
                np.minimum.at(root, high, low)
                _flat(root)
        elif len(left):
            _flat(root)
        s += 1
    _flat(root)
    return root


def _flat(root: np.ndarray) -> None:
    while True:
        up = root[root]
        if (up == root).all():
            return
        root[:] = up


def _linked(near: int):
    """A spanning forest of the links in each bucket; rows (key, fp, id) come sorted by key."""

    def out(key, fp, id_):
        root = near_pairs(key, fp, near)
        moved = np.flatnonzero((root != np.arange(len(root))) & (id_ != id_[root]))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(id_[moved]), pa.array(id_[root[moved]])], names=["a", "b"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
            if n >= TOGETHER:
                key, fp, id_ = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                if cut:
                    yield from out(key[:cut], fp[:cut].astype(np.uint64), id_[:cut])
                held, n = [[key[cut:], fp[cut:], id_[cut:]]], len(key) - cut
        if n:
            key, fp, id_ = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from out(key, fp.astype(np.uint64), id_)

    return run


def link(classes: DataFrame, near: int = NEAR, bucket: int = BUCKET) -> DataFrame:
    """(id, component) of all fingerprints (fp, id; each fp once) that have another one within `near` bits."""
    n_parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = classes.select(F.explode(F.array(*keys(classes.count(), near))).alias("key"), "fp", "id")
    large = written(met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket))
    if large.limit(1).count():  # every pair of chunks of a large bucket meets in a bucket of its own
        chunks = F.ceil(F.col("n") / bucket).cast("int")
        own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
        met = met.join(large, "key", "left").select("key", "fp", "id", F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), chunks - 1)).alias("with"), F.when(F.col("n").isNull(), -1).otherwise(own).alias("own"))
        met = met.select("key", "fp", "id", "own", F.explode("with").alias("other"))
        met = met.select(F.when(F.col("own") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), "fp", "id")
    edges = met.repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(_linked(near), "a long, b long")
    return components(edges)


def near_dedup(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of docs.

    Null, empty and wordless texts have fingerprint 0, which links like any other. Equal fingerprints are one class, so
    copies never form pairs. Rows that repeat are alike. Texts of any length are read whole. Rows of null doc_id count only if their class has an id. An
    empty table gives no rows; columns besides doc_id and text are ignored."""
    own = written(fingerprints(docs))
    classes = written(own.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = link(classes.where("id is not null"), near).select(F.col("id").alias("k"), "component")
    classes = classes.join(found, F.col("id") == F.col("k"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "id").alias("component_id"))
    return own.join(classes, F.col("fp") == F.col("f")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
