"""Operator 9: exact dedup with a cuckoo-filter index of live digests over bucketed content."""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SLOTS, KICKS = 4, 200
#: Live digests that a task holds at once, about: digests are dealt to so many buckets as this needs.
HELD = 100_000


class CuckooFilter:
    """16-bit marks of 64-bit digests, each in one of two buckets of four; digests can go again."""

    def __init__(self, buckets: int = 256):
        self.mask, self.marks = buckets - 1, array("H", bytes(2 * SLOTS * buckets))

    def _places(self, digest: int) -> tuple[int, int, int]:
        mark = (digest >> 48) & 0xFFFF or 1
        one = digest & self.mask
        return mark, one, (one ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, bucket: int, mark: int) -> int:
        at = SLOTS * bucket
        for i in range(at, at + SLOTS):
            if self.marks[i] == mark:
                return i
        return -1

    def __contains__(self, digest: int) -> bool:
        mark, one, two = self._places(digest)
        return self._slot(one, mark) >= 0 or self._slot(two, mark) >= 0

    def insert(self, digest: int) -> bool:
        """False if no room was found; a mark is then homeless and the filter has to be made anew."""
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            if (i := self._slot(bucket, 0)) >= 0:
                self.marks[i] = mark
                return True
        bucket = two
        for k in range(KICKS):
            i = SLOTS * bucket + k % SLOTS
            mark, self.marks[i] = self.marks[i], mark
            bucket = (bucket ^ (mark * 0x5BD1E995)) & self.mask
            if (i := self._slot(bucket, 0)) >= 0:
                self.marks[i] = mark
                return True
        return False

    def delete(self, digest: int) -> bool:
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            if (i := self._slot(bucket, mark)) >= 0:
                self.marks[i] = 0
                return True
        return False


class Index:
    """Live digests of one partition. The filter answers first; its hits are verified against the content kept in the
    digest's bucket. When the filter overflows, a larger one is filled from the stored keys."""

    def __init__(self, buckets: int = 256):
        self.filter = CuckooFilter(buckets)
        self.content: dict[int, list[list]] = {}
        self.resized = 0

    def _find(self, digest: int, sha: bytes) -> list | None:
        if digest in self.filter:
            for entry in self.content.get(digest, ()):
                if entry[0] == sha:
                    return entry
        return None

    def insert(self, digest: int, sha: bytes, doc, rows: int = 1) -> None:
        digest &= (1 << 64) - 1
        entry = self._find(digest, sha)
        if entry is None:
            held = self.content.setdefault(digest, [])
            held.append([sha, doc, rows])
            if len(held) == 1 and not self.filter.insert(digest):
                self._resize()
        else:
            entry[1] = doc if entry[1] is None else entry[1] if doc is None else min(entry[1], doc)
            entry[2] += rows

    def delete(self, digest: int, sha: bytes, rows: int = 1, least=None) -> None:
        """Takes rows away, the smallest id of which is `least`; with its last row a digest is no longer live. Once the row of
        the smallest id is gone, the next one isn't known: the id is then null."""
        digest &= (1 << 64) - 1
        entry = self._find(digest, sha)
        if entry is None:
            return
        entry[2] -= rows
        entry[1] = None if least is not None and least == entry[1] else entry[1]
        if entry[2] <= 0:
            held = self.content[digest]
            held.remove(entry)
            if not held:
                del self.content[digest]
                self.filter.delete(digest)

    def _resize(self) -> None:
        buckets = self.filter.mask + 1
        while True:
            buckets *= 2
            self.resized += 1
            self.filter = CuckooFilter(buckets)
            if all(map(self.filter.insert, self.content)):
                return

    def rows(self):
        for digest, held in self.content.items():
            for sha, doc, rows in held:
                yield digest - (1 << 64) if digest >> 63 else digest, sha, doc, rows


KEYS = "digest long, sha binary, keep_id long, group_size long"


def normalised(text: Column) -> Column:
    """Every run of \\x20 and \\x09-\\x0D becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (64 bits, for the filter), sha (SHA-256, the content it is verified against)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"))
    sha = text.select("doc_id", F.unhex(F.sha2("t", 256)).alias("sha"))
    return sha.select("doc_id", F.xxhash64("sha").alias("digest"), "sha")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest", "sha", "keep_id", "group_size"])


def _summed(batches):
    """One row for each digest of a batch, so that copies of one text don't travel as many rows."""
    for b in batches:
        index = Index()
        for doc, digest, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
            index.insert(digest, sha, doc)
        if rows := list(index.rows()):
            yield _batch(rows)


def _merged(batches):
    """One bucket of digests after another, each in an index of its own; rows come sorted by bucket, deletions last."""
    index, at = Index(), None
    for b in batches:
        for bucket, sign, digest, sha, doc, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if bucket != at:
                yield from _batches(index)
                index, at = Index(), bucket
            if sign > 0:
                index.insert(digest, sha, doc, rows)
            else:
                index.delete(digest, sha, rows, doc)
    yield from _batches(index)


def _batches(index: Index):
    rows = list(index.rows())
    for i in range(0, len(rows), 10_000):
        yield _batch(rows[i : i + 10_000])


def _dealt(rows: DataFrame, entries: int) -> DataFrame:
    """rows (sign, digest, sha, keep_id, group_size) to the live digests; entries: how many there are about."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(max(8 * n, -(-entries // HELD))))
    return rows.select(bucket.alias("bucket"), "sign", "digest", "sha", "keep_id", "group_size").repartition(n, "bucket").sortWithinPartitions("bucket", F.col("sign").desc()).mapInArrow(_merged, KEYS)


def build_index(keys: DataFrame) -> DataFrame:
    """The live digests (digest, sha, keep_id, group_size) of rows (doc_id, digest, sha) as digests() makes them."""
    summed = keys.select("doc_id", "digest", "sha").mapInArrow(_summed, KEYS)
    return _dealt(summed.select(F.lit(1).alias("sign"), "digest", "sha", "keep_id", "group_size"), keys.count())


def update_index(index: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """The index after the rows of inserted came and those of deleted (both as digests() makes them) went.

    A digest without rows is gone, and may come again. Where the row of keep_id went, the next smallest id is looked up among
    live, all rows that are there afterwards (as digests() makes them); without live keep_id is null there. Insertions count
    before deletions."""
    rows = index.select(F.lit(1).alias("sign"), "digest", "sha", "keep_id", "group_size")
    for sign, keys in ((1, inserted), (-1, deleted)):
        if keys is not None:
            summed = keys.select("doc_id", "digest", "sha").mapInArrow(_summed, KEYS)
            rows = rows.union(summed.select(F.lit(sign), "digest", "sha", "keep_id", "group_size"))
    out = _dealt(rows, index.count() + (inserted.count() if inserted is not None else 0))
    if live is None:
        return out
    out = written(out)
    lost = out.where("keep_id is null").select(F.col("sha").alias("s"))
    found = live.join(lost, F.col("sha") == F.col("s"), "left_semi").groupBy(F.col("sha").alias("s")).agg(F.min("doc_id").alias("least"))
    return out.join(found, F.col("sha") == F.col("s"), "left").select("digest", "sha", F.coalesce("keep_id", "least").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Null and empty texts are one group, unless white space other than none sets them apart (" " is not ""). Rows that
    repeat with the same doc_id count each and are kept alike; null ids are kept only in groups without another id.
    Texts of any length are digested whole. An empty table gives no rows; columns besides doc_id and text are ignored."""
    keys = written(digests(docs))
    index = build_index(keys).select(F.col("sha").alias("k"), "keep_id", "group_size")
    return keys.join(index, keys.sha == index.k).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
