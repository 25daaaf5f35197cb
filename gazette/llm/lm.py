"""Operator 7: language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Words are known by 64-bit hashes, pairs of words by 48 bits. Counts travel as sorted blobs, one for each bucket of hashes,
never as a row for each word. The filter lies in segments, one for each bucket, that grow with their entries; a block of texts
sends its distinct words and pairs to the buckets and gets levels and exact counts back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, freed, mixed, remainder, small_batches, words, written

#: Tokens that a task sorts at once, and bytes of texts that it hashes at once.
TOKENS, TOGETHER = 2_000_000, 4 << 20
#: Buckets for each shuffle partition, at least: with many small ones, partitions are of like size.
BUCKETS = 4
#: Bits of the filter for each entry, at least; probes for each entry.
BITS_EACH, PROBES = 12, 2
#: Weight of pairs of words against single words.
PAIRS = 0.3
#: The end of a text, a token of its own.
END = np.uint64(0x0123456789ABCDEF)
_STEP = np.uint64(0xA0761D6478BD642F)


def _runs(texts: pa.Array):
    """(first row, bytes, offsets) of runs of texts."""
    data, offsets = buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash before it, text) of every token, with one end after each text's words, and an end before the first."""
    n = len(offsets) - 1
    _, _, doc, h = words(data, offsets)
    at = np.arange(len(h)) + doc
    all_h, all_doc = np.full(len(h) + n, END), np.empty(len(h) + n, np.int64)
    all_h[at] = h
    all_doc[at] = doc
    all_doc[np.cumsum(np.bincount(doc, minlength=n)) + np.arange(n)] = np.arange(n)
    before = np.concatenate([[END], all_h[:-1]])
    return all_h, before, all_doc


def pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """48 bits for two words, at the top of a 64-bit value."""
    return mixed(before * np.uint64(0x9FB21C651E98DF25) + h) & ~np.uint64(0xFFFF)


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h)))


def planes(x: np.ndarray, width: int = 8) -> bytes:
    """The bytes of values of `width` bytes, all first bytes first; small values compress better so."""
    return np.ascontiguousarray(x.astype(f">u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unplaned(b: bytes, width: int = 8) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(f">u{width}").ravel().astype(np.uint64)


def steps(x: np.ndarray) -> bytes:
    """Sorted values as planes of their differences, which are small and compress well."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def unstepped(b: bytes) -> np.ndarray:
    return np.cumsum(unplaned(b), dtype=np.uint64)


def _by_bucket(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2 ** bits buckets of sorted hashes begins, and the end."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(h, edges), len(h))


def _blobs(order: int, h: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    at = _by_bucket(h, bits)
    full = np.flatnonzero(np.diff(at))
    if order == 2:  # counts stand in the 16 bits below
        n = np.minimum(n, 0xFFFF).astype(np.uint64)
        a = [steps(h[at[k] : at[k + 1]] | n[at[k] : at[k + 1]]) for k in full]
        c = [b""] * len(full)
    else:
        a = [steps(h[at[k] : at[k + 1]]) for k in full]
        c = [planes(n[at[k] : at[k + 1]]) for k in full]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(full), order), pa.int32()), pa.array(full, pa.int32()), pa.array(a, pa.binary()), pa.array(c, pa.binary())], names=["order", "bucket", "h", "n"])


BLOBS = "order int, bucket int, h binary, n binary"


def _count(bits: int):
    def run(batches):
        one, two, held = [], [], 0

        def flush():
            h, n = counted(np.concatenate(one))
            yield _blobs(1, h, n, bits)
            h, n = counted(np.concatenate(two))
            while len(h):  # a count over 65535 goes in parts
                yield _blobs(2, h, n, bits)
                more = n > 0xFFFF
                h, n = h[more], n[more] - 0xFFFF

        for b in batches:
            for _, data, offsets in _runs(b.column(0)):
                h, before, _ = tokens(data, offsets)
                one.append(h)
                two.append(pair(before, h))
                held += len(h)
                if held > TOKENS:
                    yield from flush()
                    one, two, held = [], [], 0
        if held:
            yield from flush()

    return run


def level(n: np.ndarray) -> np.ndarray:
    """Quantised count of a pair: 1 + log2, rounded down."""
    return 1 + np.log2(np.maximum(n, 1)).astype(np.int64)


def pair_count(of_pair: np.ndarray) -> np.ndarray:
    """The count that a pair's level stands for; exact for none and one."""
    return np.where(of_pair > 1, 1.4 * 2.0 ** (of_pair - 1), of_pair > 0)


def word_level(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(2 * np.log2(np.maximum(n, 1)) + 1e-9).astype(np.int64)


def _sum(batches):
    """Sums the blobs of each bucket; rows come sorted by bucket and order."""
    key, hs, ns = None, [], []

    def out():
        order, bucket = key
        if order == 2:
            x = np.sort(np.concatenate(hs))
            h, n = x & ~np.uint64(0xFFFF), (x & np.uint64(0xFFFF)).astype(np.int64)
        else:
            h, n = np.concatenate(hs), np.concatenate(ns).astype(np.int64)
            o = np.argsort(h, kind="stable")
            h, n = h[o], n[o]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)
        h, n = h[at], np.add.reduceat(n, at)
        kinds, total = len(h), int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([order], pa.int32()), pa.array([bucket], pa.int32()), pa.array([steps(h)], pa.binary()), pa.array([planes(n)], pa.binary()), pa.array([kinds]), pa.array([total])], names=["order", "bucket", "h", "n", "kinds", "total"])

    for b in batches:
        for order, bucket, h, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != (order, bucket):
                if key:
                    yield from out()
                key, hs, ns = (order, bucket), [], []
            hs.append(unstepped(h))
            if order == 1:
                ns.append(unplaned(n))
    if key:
        yield from out()


def _places(h: np.ndarray, j: np.ndarray | int, segment: int) -> list[np.ndarray]:
    e = mixed(h + np.asarray(j, np.uint64) * _STEP)
    a, b = e & np.uint64(0xFFFFFFFF), (e >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(segment - 1)).astype(np.int64) for i in range(PROBES)]


def _mark(there: np.ndarray, order: int, h: np.ndarray, n: np.ndarray) -> None:
    """Sets the bits of entries (n-gram, 1 .. level)."""
    k = level(n) if order == 2 else word_level(n)
    for j in range(1, int(k.max(initial=0)) + 1):
        for at in _places(h[k >= j] + np.uint64(order), j, len(there)):
            there[at] = True


class Filter:
    """Membership of entries (n-gram, level); an n-gram's level is how many entries, from 1 on, are there."""

    def __init__(self, parts: np.ndarray, segment: int):
        self.parts, self.segment = parts, segment

    def levels(self, h: np.ndarray, order: int) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        left, j = np.arange(len(h)), 1
        while len(left):
            there = np.ones(len(left), bool)
            for at in _places(h[left] + np.uint64(order), j, self.segment):
                there &= (self.parts[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            left = left[there]
            out[left] = j
            j += 1
            if j > 100:
                break
        return out


def segment_of(counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Filter:
    """The filter's segment of one bucket from the counts (hashes, counts) of each order: as many bits as its entries need."""
    entries = sum(int((level(n) if order == 2 else word_level(n)).sum()) for order, (_, n) in counts.items())
    segment = max(64, 1 << (BITS_EACH * entries - 1).bit_length() if entries else 0)
    there = np.zeros(segment, bool)
    for order, (h, n) in counts.items():
        _mark(there, order, h, n)
    return Filter(np.packbits(there, bitorder="little"), segment)


def log10(of_words: np.ndarray, of_pairs: np.ndarray, which: np.ndarray, end: int, n: int, v: int) -> np.ndarray:
    """Of tokens: a mixture of pair and word probabilities from the filter's levels of the distinct words and of each token's
    pair. which: the word of each token; end: the word that stands before the first."""
    count = np.where(of_words > 0, 2.0 ** ((of_words - 1) / 2 + 0.25), 0.0)
    single = (count + 1) / (n + v + 1)
    ratio = np.minimum(1.0, pair_count(of_pairs) / np.maximum(count[np.append(end, which[:-1])], 1.0))
    return np.log10(np.minimum(1.0, PAIRS * ratio + (1 - PAIRS) * single[which]))


def train(docs: DataFrame, mod: int = 7, held: int = 2) -> tuple[DataFrame, int, int, int]:
    """The table of counts by bucket, log2 of the buckets, and how many tokens and different words there are, from rows whose
    crc32(doc_id) mod `mod` is not `held`."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, (BUCKETS * n_parts - 1).bit_length())
    own = docs.where(remainder(F.col("doc_id"), mod) != held).select(F.col("text").cast("string"))
    blobs = own.mapInArrow(_count(bits), BLOBS).repartition(n_parts, "bucket").sortWithinPartitions("bucket", "order")
    summed = written(blobs.mapInArrow(_sum, "order int, bucket int, h binary, n binary, kinds long, total long"))
    n, v = summed.where("`order` = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    return summed.select("order", "bucket", "h", "n"), bits, int(n), int(v)


COUNTS, ASKED, BLOCK = 0, 1, 2
ROWS = "kind int, k long, order int, bucket int, h binary, n binary, docs binary"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=["kind", "k", "order", "bucket", "h", "n", "docs"])


def _asked(bits: int):
    """Blocks of texts: a row with the tokens, as numbers of the block's distinct words, and rows that ask each bucket for
    the block's words and pairs."""
    from pyspark import TaskContext

    def run(batches):
        k = TaskContext.get().partitionId() << 32
        hs, ids, null, lens, held = [], [], [], [], 0

        def flush():
            h = np.concatenate(hs)
            kinds, which = np.unique(h, return_inverse=True)
            docs = np.concatenate(ids).tobytes() + np.concatenate(lens).tobytes() + np.concatenate(null).tobytes()
            yield _rows([(BLOCK, k, 0, int(mixed(np.array([k], np.uint64))[0] >> np.uint64(64 - bits)), steps(kinds), planes(which, 4), docs)])
            for order, x in ((1, kinds), (2, np.unique(pair(np.append(END, h[:-1]), h)))):
                at = _by_bucket(x, bits)
                yield _rows([(ASKED, k, order, int(i), steps(x[at[i] : at[i + 1]]), None, None) for i in np.flatnonzero(np.diff(at))])

        for b in batches:
            for first, data, offsets in _runs(b.column(1)):
                n = len(offsets) - 1
                h, _, doc = tokens(data, offsets)
                own = b.column(0)[first : first + n]
                hs.append(h)
                ids.append(own.fill_null(0).to_numpy(zero_copy_only=False))
                null.append(own.is_null().to_numpy(zero_copy_only=False))
                lens.append(np.bincount(doc, minlength=n))
                held += len(h)
                if held > TOKENS:
                    yield from flush()
                    hs, ids, null, lens, held = [], [], [], [], 0
                    k += 1
        if held:
            yield from flush()

    return run


def _answered(batches):
    """Levels of the words and pairs that blocks ask for, and exact counts of the words; rows come sorted by bucket, the counts
    of a bucket first."""
    at, counts, segment, out, size = None, {}, None, [], 0
    for b in batches:
        for kind, k, order, bucket, h, n, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != bucket:
                at, counts, segment = bucket, {}, None
            if kind == COUNTS:
                counts[order] = unstepped(h), unplaned(n).astype(np.int64)
                continue
            if kind == ASKED:
                segment = segment or segment_of(counts)
                seen, n = unstepped(h), None
                h = segment.levels(seen, order).astype(np.uint8).tobytes()
                if order == 1:
                    there, c = counts.get(1, (seen[:0], np.zeros(0, np.int64)))
                    p = np.minimum(np.searchsorted(there, seen), max(len(there) - 1, 0))
                    n = planes(np.where(there[p] == seen, c[p], 0) if len(there) else np.zeros(len(seen), np.int64))
            out.append((kind, k, order, bucket, h, n, docs))
            size += len(h) + len(n or b"")
            if size > TOGETHER:
                yield _rows(out)
                out, size = [], 0
    if out:
        yield _rows(out)


def _scored(n: int, v: int):
    """Scores of a block's texts; rows come sorted by block, the answers first, by order and bucket."""

    def out(answers, block):
        kinds, which = unstepped(block[0]), unplaned(block[1], 4).astype(np.int64)
        d = len(block[2]) // 17
        ids, lens, null = np.frombuffer(block[2], np.int64, d), np.frombuffer(block[2], np.int64, d, 8 * d), np.frombuffer(block[2], bool, d, 16 * d)
        h = kinds[which]
        _, own = np.unique(pair(np.append(END, h[:-1]), h), return_inverse=True)
        levels = {o: np.frombuffer(b"".join(x for x, _ in answers[o]), np.uint8).astype(np.int64) for o in (1, 2)}
        count = np.concatenate([unplaned(c) for _, c in answers[1]]).astype(np.int64)
        base = np.log10((count + 1.0) / (n + 1 * (v + 1)))
        s = log10(levels[1], levels[2][own], which, int(np.searchsorted(kinds, END)), n, v)
        doc = np.repeat(np.arange(d), lens)
        sums = [np.bincount(doc, x, minlength=d) for x in ((count > 0)[which], base[which], s)]
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(lens), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def run(batches):
        answers = {1: [], 2: []}
        for b in batches:
            for kind, _, order, _, h, c, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == ASKED:
                    answers[order].append((h, c))
                else:
                    yield out(answers, (h, c, docs))
                    answers = {1: [], 2: []}

    return run


def score(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Null counts as empty: one token, the end. Rows that repeat count each. Without training rows every word is unknown
    and N and V are 0. The filter has 12 bits for each entry at least, however many there are: one answer in 40 at most is
    falsely true, over any corpus. Texts of any length are read whole; a null id counts as the empty text for held_out. An empty
    table gives no rows; columns besides doc_id and text are ignored, whatever their names."""
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts, bits, n, v = train(docs, mod, held)
    freed(docs.sparkSession)
    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_asked(bits), ROWS)
    counts = counts.select(F.lit(COUNTS).alias("kind"), F.lit(0).cast("long").alias("k"), "order", "bucket", "h", "n", F.lit(None).cast("binary").alias("docs"))
    both = counts.union(asked).repartition(n_parts, "bucket").sortWithinPartitions("bucket", "kind")
    answers = both.mapInArrow(_answered, ROWS).repartition(n_parts, "k").sortWithinPartitions("k", "kind", "order", "bucket")
    out = answers.mapInArrow(_scored(n, v), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), mod) == held).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
