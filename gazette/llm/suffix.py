"""Operator 6: removal of repeated passages with per-shard suffix arrays.

A window is a string of `width` bytes. Its anchor is the part of it, KGRAM bytes long, with the smallest hash, so equal
windows have equal anchors at equal places. Consecutive windows around one anchor form a stretch of text. Stretches
are dealt out by the hash of their anchor: windows can only be equal within such a group. Stretches that are equal as a
whole repeat in all their windows; of the others, one of each kind goes with its bytes to a shard, where a suffix array
finds the windows that occur more than once.

Passages that are told by words, not bytes, are windows of words: stretches with an anchor that only one text holds are
left out in the same way, the windows of the others meet by their hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, buffers, dropped, freed, mixed, powers, small_batches, words, written

WIDTH, KGRAM = 400, 32
#: Words of a passage that is told where another document holds it, too (over 50), and of an anchor inside it.
PASSAGE, PASSAGE_KGRAM = 51, 16
#: Bytes of texts that are hashed together; longer texts are taken in overlapping parts.
TOGETHER = 1 << 18
#: Bytes of a shard: 21 bits, so that two ranks and a place fit into 64 bits.
SHARD = (1 << 21) - 1
#: Small groups share a shard of up to so many bytes.
SHARED = 1 << 19
#: Bytes of a group that one task takes; larger groups are dealt out as pairs of chunks.
GROUP = 8 << 20

_R = 0xD1B54A32D192ED03
_R_INVERSE = pow(_R, -1, 1 << 64)


# --- stretches ---------------------------------------------------------------------------------------------------


def running_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for every i where that many are left."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    ahead = np.minimum.accumulate(padded.reshape(-1, w), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray, width: int, kgram: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor hash, content hash) of the stretches of a run of texts; start counts from the text's."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < width:
        return none
    inverse = powers(_R_INVERSE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_R, len(data)), dtype=np.uint64, out=total[1:])
    gram = mixed((total[kgram:] - total[:-kgram]) * inverse[: len(data) - kgram + 1])
    # the leftmost of the smallest hashes of the parts of each window
    place = np.arange(len(gram), dtype=np.uint64)
    least = running_minimum((gram & ~np.uint64(0xFFFFFF)) | place, width - kgram + 1)
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.arange(len(anchor))
    text = np.searchsorted(offsets, first, side="right") - 1
    inside = first + width <= offsets[text + 1]
    first, anchor, text = first[inside], anchor[inside], text[inside]
    if not len(first):
        return none
    new = np.ones(len(first), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    windows = np.diff(np.append(at, len(first)))
    begin, text = first[at], text[at]
    end = begin + windows + width - 1
    content = mixed((total[end] - total[begin]) * inverse[begin] + windows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, begin - offsets[text], windows, gram[anchor[at]], content


def _runs(data: np.ndarray, offsets: np.ndarray, width: int):
    """(number of the text of each part, its place in that text, bytes, offsets): texts, and overlapping parts of long ones.
    Texts may be of words, too, one value for each."""
    i = 0
    while i < len(offsets) - 1:
        size = offsets[i + 1] - offsets[i]
        if size > TOGETHER:
            own = data[offsets[i] : offsets[i + 1]]
            for a in range(0, max(1, size - width + 1), TOGETHER):
                part = own[a : a + TOGETHER + width - 1]
                yield np.array([i]), np.array([a]), part, np.array([0, len(part)])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER, side="right")) - 1)
        yield np.arange(i, j), np.zeros(j - i, np.int64), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _stretches(width: int, kgram: int):
    def run(batches):
        for b in batches:
            for rows, places, data, offsets in _runs(*buffers(b.column(1)), width):
                text, start, windows, anchor, content = stretches(data, offsets, width, kgram)
                # places of the same stretch in one text are one row
                order = np.lexsort((start, content, text))
                text, start, windows, anchor, content = (x[order] for x in (text, start, windows, anchor, content))
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (content[1:] != content[:-1])
                at = np.flatnonzero(new)
                keys = b.column(0).take(pa.array(rows[text[at]]))
                starts = pa.ListArray.from_arrays(pa.array(np.append(at, len(text)).astype(np.int32)), pa.array((start + places[text]).astype(np.int32)))
                columns = [keys, starts, pa.array(windows[at].astype(np.int32)), pa.array(anchor[at].astype(np.int64)), pa.array(content[at].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["sha", "starts", "windows", "anchor", "content"])

    return run


# --- suffix arrays -----------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in their order."""
    return sorted_to(text, len(text))[0]


def sorted_to(text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `most` bytes, or of a few more, after Larsson and Sadakane: suffixes are sorted by 5
    bytes, then groups that are still equal are refined by the ranks of what follows, with twice the bytes each time.
    Sorted suffixes are not touched again. Each key holds a group, a rank and a place, so a plain sort does.

    Of each suffix, too, how many bytes at least it has in common with the one before: with h bytes they have h or more and
    under 2h in common, with 0 under 5; -1: `most` or more."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(5):
        key = (key << np.uint64(8)) | padded[i : i + n]
    # a suffix of under 5 bytes is told apart from one with zero bytes by the ranks behind its end
    order = np.sort((key << np.uint64(21)) | np.arange(n, dtype=np.uint64))
    sa = (order & np.uint64(SHARD)).astype(np.int64)
    group = order >> np.uint64(21)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    common = np.where(new, 0, -1)
    rank = np.zeros(n + 1, np.int64)  # the last one stands for the end of the text
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    h = 5
    open_ = _open(new)
    while len(open_) and h < most:
        i = sa[open_]
        own, next_ = rank[i] - 1, rank[np.minimum(i + h, n)]
        order = np.sort((own.astype(np.uint64) << np.uint64(42)) | (next_.astype(np.uint64) << np.uint64(21)) | i.astype(np.uint64))
        i = (order & np.uint64(SHARD)).astype(np.int64)
        sa[open_] = i
        differs = np.ones(len(open_), bool)
        differs[1:] = (order[1:] >> np.uint64(21)) != (order[:-1] >> np.uint64(21))
        told = open_[differs]
        rank[i] = told[np.cumsum(differs) - 1] + 1
        common[told[common[told] < 0]] = h
        open_ = open_[_open(differs)]
        h *= 2
    return sa, common


def near_before(text: np.ndarray, sa: np.ndarray, common: np.ndarray, width: int) -> np.ndarray:
    """Of each suffix as sorted_to(text, width) gives them, whether it has `width` bytes or more in common with the one before."""
    near = common < 0
    at = np.flatnonzero((common >= 0) & (np.maximum(2 * common, 5) > width))
    at = at[(at > 0) & (sa[at] + width <= len(text)) & (sa[at - 1] + width <= len(text))]
    w = words_of(text)
    for k in range(0, width, 8):
        differ = w[sa[at] + k] ^ w[sa[at - 1] + k]
        if k + 8 > width:
            differ &= np.uint64((1 << 8 * (width - k)) - 1)
        at = at[differ == 0]
    near[at] = True
    return near


def _open(new: np.ndarray) -> np.ndarray:
    """Places in groups of more than one; new marks where groups begin."""
    alone = new & np.append(new[1:], True)
    return np.flatnonzero(~alone)


def words_of(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one value, the first byte lowest; zeros behind the end."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text) + 8].copy().view("<u8").ravel()


def _same_bytes(x: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two 8-byte words, given their exclusive or."""
    low = x & (~x + np.uint64(1))
    return np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, lane: int = 64) -> np.ndarray:
    """Kasai's common prefixes with the suffix before in the array, up to `most`, in the order of the array.

    Shards need only near_before; these are what it is tested against. In the order of the text a common prefix is shorter by one at most than the one before; many lanes of the text walk on
    together, each keeping its own length."""
    n = len(sa)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    w, out = words_of(text), np.zeros(n, np.int64)
    begin = np.arange(0, n, lane)
    length = np.zeros(len(begin), np.int64)
    for step in range(lane):
        i = begin + step
        i = i[i < n]
        length = np.maximum(length[: len(i)] - 1, 0)
        j = before[i]
        length[j < 0] = 0
        go = np.flatnonzero((j >= 0) & (length < most))
        while len(go):
            a, b = i[go] + length[go], j[go] + length[go]
            same = np.minimum(_same_bytes(w[a] ^ w[b]), np.minimum(n - a, n - b))
            length[go] += same
            go = go[(same == 8) & (length[go] < most)]
        out[i] = np.minimum(length, most)
    return out[sa]


class Shard:
    """A suffix array over the stretches of one or more groups. Of each stretch only the first `windows` suffixes count."""

    def __init__(self, parts: list[tuple[int, bytes]], width: int):
        """parts: (windows, bytes) of the stretches."""
        self.width = width
        self.text = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
        n = len(self.text)
        start = np.concatenate([[0], np.cumsum([len(p) for _, p in parts])]).astype(np.int64)
        self.start = start
        self.counts = np.zeros(n + 1, np.int64)
        np.add.at(self.counts, start[:-1], 1)
        np.add.at(self.counts, start[:-1] + np.array([k for k, _ in parts], np.int64), -1)
        self.counts = np.cumsum(self.counts)[:n] > 0
        self.words = None
        sa, common = sorted_to(self.text, width)
        near = near_before(self.text, sa, common, width)
        keep = self.counts[sa]
        # windows that are equal stand together: a group ends where a common prefix is too short
        group = np.cumsum(~near)[keep]
        self.sa = sa[keep]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(group)))
        self.repeated = np.zeros(n, bool)
        self.repeated[self.sa] = np.repeat(self.size > 1, self.size)

    def merge(self, other: Shard) -> None:
        """Marks the windows that both shards hold: those of one are looked up in the array of the other by binary search."""
        heads = self.sa[self.first]
        targets = other.sa[other.first]
        if not len(heads) or not len(targets):
            return
        for s in (self, other):
            if s.words is None:
                s.words = words_of(s.text).byteswap()
        low, high = np.zeros(len(heads), np.int64), np.full(len(heads), len(targets), np.int64)
        equal = np.full(len(heads), -1)
        go = np.arange(len(heads))
        while len(go):
            mid = (low[go] + high[go]) >> 1
            sign = self._compare(heads[go], other, targets[mid])
            equal[go[sign == 0]] = mid[sign == 0]
            low[go[sign > 0]] = mid[sign > 0] + 1
            high[go[sign <= 0]] = mid[sign <= 0]
            go = go[(low[go] < high[go]) & (equal[go] < 0)]
        hit = np.flatnonzero(equal >= 0)
        self._mark(hit)
        other._mark(equal[hit])

    def _mark(self, groups: np.ndarray) -> None:
        flags = np.zeros(len(self.first), bool)
        flags[groups] = True
        self.repeated[self.sa[np.repeat(flags, self.size)]] = True

    def _compare(self, a: np.ndarray, other: Shard, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for windows of self against windows of other."""
        sign, go = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(0, self.width, 8):
            x, y = self.words[a[go] + k], other.words[b[go] + k]
            if k + 8 > self.width:
                cut = np.uint64(8 * (k + 8 - self.width))
                x, y = x >> cut, y >> cut
            sign[go] = (x > y).astype(np.int64) - (x < y)
            go = go[x == y]
            if not len(go):
                break
        return sign

    def runs(self, k: int) -> list[int]:
        """Of stretch k: first and one past the last of every run of repeated windows, one after another."""
        flags = np.concatenate([[0], self.repeated[self.start[k] : self.start[k + 1]].astype(np.int8), [0]])
        return np.flatnonzero(np.diff(flags)).tolist()


def repeated_windows(parts: list[tuple[int, bytes]], width: int, most: int = SHARD) -> list[list[int]]:
    """Runs of repeated windows of each stretch of a group, in one shard, or in several that are merged."""
    shards, at = [], 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end][1]) <= most):
            size += len(parts[end][1])
            end += 1
        shards.append((Shard(parts[at:end], width), end - at))
        at = end
    for i, (a, _) in enumerate(shards):
        for b, _ in shards[:i]:
            a.merge(b)
    return [s.runs(k) for s, n in shards for k in range(n)]


def _shards(width: int):
    """Rows (key, content, windows, chunks, bytes) sorted by key -> (content, runs). Small groups share a shard, but not pairs
    of chunks, which hold the same stretches again."""

    def run(batches):
        key, held, size, names, whole = None, [], 0, [], []

        def out():
            for name, runs in zip(names, repeated_windows(held, width), strict=True):
                if runs:
                    whole.append((name, runs))
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in whole], pa.int64()), pa.array([r for _, r in whole], pa.list_(pa.int32()))], names=["c", "runs"])
                whole.clear()

        group: list[tuple] = []
        group_size, in_chunks, alone = 0, False, False

        def add():
            nonlocal held, size, names, alone
            if held and (size + group_size > SHARED or in_chunks or alone):
                yield from out()
                held, size, names = [], 0, []
            held += [(w, p) for _, w, p in group]
            names += [c for c, _, _ in group]
            size += group_size
            alone = in_chunks

        for b in batches:
            for k, c, w, n, p in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if k != key:
                    if group:
                        yield from add()
                    key, group, group_size, in_chunks = k, [], 0, n > 1
                group.append((c, w, p))
                group_size += len(p)
        if group:
            yield from add()
        if held:
            yield from out()

    return run


# --- passages of words --------------------------------------------------------------------------------------------


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(number of the text of each piece, bytes, offsets): texts, and pieces of long ones, cut where a word ends."""
    i = 0
    while i < len(offsets) - 1:
        a, end = int(offsets[i]), int(offsets[i + 1])
        if end - a > TOGETHER:
            while a < end:
                b = min(a + TOGETHER, end)
                while b < end:
                    gap = np.flatnonzero(~WORD[data[b : b + TOGETHER]])
                    b = min(b + TOGETHER, end) if not len(gap) else b + int(gap[0])
                    if len(gap):
                        break
                yield np.array([i]), data[a:b], np.array([0, b - a])
                a = b
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER, side="right")) - 1)
        yield np.arange(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of a batch of texts, one after another, and the n + 1 offsets."""
    found, count = [np.zeros(0, np.uint64)], np.zeros(len(texts) + 1, np.int64)
    for rows, data, offsets in _pieces(*buffers(texts)):
        _, _, text, h = words(data, offsets, lower=False)
        found.append(h)
        count[rows[0] + 1 : rows[-1] + 2] += np.bincount(text, minlength=len(rows))
    return np.concatenate(found), np.cumsum(count)


def _word_stretches(n: int, kgram: int):
    def run(batches):
        for b in batches:
            for rows, places, data, offsets in _runs(*word_hashes(b.column(1)), n):
                text, start, windows, anchor, content = stretches(data, offsets, n, kgram)
                if not len(text):
                    continue
                # where words repeat, anchors follow each other that are equal: one stretch
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
                at = np.flatnonzero(new)
                turn = (np.arange(len(text)) - at[np.cumsum(new) - 1]).astype(np.uint64)
                content = np.add.reduceat(mixed(content + turn * np.uint64(_R)), at)
                windows, text, start, anchor = np.add.reduceat(windows, at), text[at], start[at], anchor[at]
                columns = [b.column(0).take(pa.array(rows[text])), pa.array(start + places[text]), pa.array(windows), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "start", "windows", "anchor", "content"])

    return run


def _window_hashes(n: int):
    """Rows (t, text, cuts) -> (t, w, n): the hash of each different window of n words that begins within the cuts, and how often."""

    def run(batches):
        for b in batches:
            h, offsets = word_hashes(b.column(1))
            cuts = b.column(2)
            of, cut = cuts.value_lengths().to_numpy(), cuts.flatten()
            start = cut.field("start").to_numpy() + np.repeat(offsets[:-1], of)
            windows = cut.field("windows").to_numpy().astype(np.int64)
            inverse, total = powers(_R_INVERSE, len(h)), np.zeros(len(h) + 1, np.uint64)
            np.cumsum((h + np.uint64(1)) * powers(_R, len(h)), dtype=np.uint64, out=total[1:])
            at = np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
            row = np.repeat(np.repeat(np.arange(len(of)), of), windows)
            w = mixed((total[at + n] - total[at]) * inverse[at]).view(np.int64)
            order = np.lexsort((w, row))
            w, row = w[order], row[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            t, w, times = b.column(0).to_numpy()[row[at]], w[at], np.diff(np.append(at, len(new)))
            for i in range(0, len(at), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (t, w, times)], names=["t", "w", "n"])

    return run


def shared_passages(docs: DataFrame, n: int = PASSAGE, kgram: int = PASSAGE_KGRAM) -> DataFrame:
    """(t, n_shared) for every different text that shares a passage: t is passage_key(text), n_shared the number of its places at
    which n words in a row begin that another row of docs holds, too.

    Words are runs of bytes outside [\\x20\\x09-\\x0D], whatever stands between them. Rows that repeat share all they hold; what
    repeats within one row only doesn't count. Texts of any length are read whole; those of under n words, null and
    empty ones among them, share nothing. Equal windows are told by 64-bit hashes."""
    spark = docs.sparkSession
    small_batches(spark)
    kgram = min(kgram, n)
    # n words take 2n - 1 bytes at least
    texts = docs.select(passage_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= 2 * n - 1)
    found = texts.mapInArrow(_word_stretches(n, kgram), "t long, start long, windows long, anchor long, content long")
    found = written(found.groupBy("t", "start", "windows", "anchor", "content").agg(F.count("*").alias("times")))
    freed(spark)
    # equal windows have equal anchors: those that one text alone holds need no further look, nor do stretches that are equal as a whole
    kinds = found.groupBy("anchor").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.min("content").alias("one"), F.max("content").alias("other")).where("low <> high")
    met = written(found.join(kinds.select(F.col("anchor").alias("a"), F.expr("one = other").alias("equal")), F.col("anchor") == F.col("a")).groupBy("t").agg(F.sum(F.when(F.col("equal"), F.col("windows"))).alias("n"), F.collect_list(F.when(~F.col("equal"), F.struct("start", "windows"))).alias("cuts")))
    wanted = met.where(F.size("cuts") > 0).select("t", "cuts")
    one_each = texts.join(wanted.hint("shuffle_hash"), F.col("key") == F.col("t")).groupBy("key").agg(F.first("text").alias("text"), F.first("cuts").alias("cuts"))
    windows = written(one_each.mapInArrow(_window_hashes(n), "t long, w long, n long"))
    del one_each, wanted, kinds
    freed(spark)
    shared = windows.groupBy("w").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select(F.col("w").alias("v"))
    with_others = windows.join(shared.hint("shuffle_hash"), F.col("w") == F.col("v")).groupBy("t").agg(F.sum("n").alias("n"))
    parts = with_others.union(met.where("n > 0").select("t", "n")).groupBy("t").agg(F.sum("n").alias("n"))
    copies = found.where("times > 1").groupBy("t").agg(F.sum("windows").alias("n"))
    out = written(parts.union(copies).groupBy("t").agg(F.max("n").alias("n_shared")))
    del with_others, parts, copies, shared
    for t in (found, met, windows):
        dropped(t)
    freed(spark)
    return out


# --- the operator ------------------------------------------------------------------------------------------------


def _cut(start, end):
    """Merges intervals (start, end), sorted by start, that touch or overlap."""
    end = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], np.append(end[at[1:] - 1], end[-1])


def _kept(raw: bytes, runs, width: int) -> tuple[bytes, int, int]:
    """(bytes kept, bytes removed, spans) of a text and its runs: first window, one past the last, in turn."""
    r = np.array(runs, np.int64).reshape(-1, 2)
    r = r[np.argsort(r[:, 0], kind="stable")]
    start, end = _cut(r[:, 0], r[:, 1] + width - 1)
    kept, at = [], 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), int((end - start).sum()), len(start)


def key(text: Column) -> Column:
    """Half of the SHA-256 of a text's bytes; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)), 1, 16)


def passage_key(text: Column) -> Column:
    """64 bits for a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """sha (key of the text) and text of every row; null counts as empty."""
    return docs.select(key(F.col("text")).alias("sha"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def repeated_runs(texts: DataFrame, width: int = WIDTH, kgram: int = KGRAM, group: int = GROUP) -> DataFrame:
    """(sha, runs): for every text with repeated windows, which of them are, as first and one past the last, in turn.

    Texts that occur as a whole more than once are repeated all over; they take part as one text."""
    spark = texts.sparkSession
    small_batches(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kgram = min(kgram, width)
    found = texts.where(F.octet_length("text") >= width).mapInArrow(_stretches(width, kgram), "sha binary, starts array<int>, windows int, anchor long, content long")
    # one row for each stretch of each different text, with its places there and how often the text occurs
    found = written(found.groupBy("sha", "starts", "windows", "anchor", "content").agg(F.count("*").alias("times")))
    freed(spark)
    kinds = written(found.groupBy("anchor", "content").agg(F.sum(F.col("times") * F.size("starts")).alias("times"), F.max("windows").alias("windows"), F.min(F.struct("sha", F.col("starts")[0].alias("start"))).alias("at")))
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("windows") + (width - 1)).alias("size")).where("kinds > 1")
    of_group = groups.select(F.col("anchor").alias("g"), F.ceil(F.col("size") / group).cast("int").alias("chunks"))
    wanted = kinds.join(of_group, kinds.anchor == of_group.g).select("anchor", "content", "windows", "chunks", F.col("at.sha").alias("s"), F.col("at.start").alias("start"))
    wanted = written(wanted.groupBy("s").agg(F.collect_list(F.struct("start", "windows", "anchor", "content", "chunks")).alias("cuts")))

    def cut_out(batches):
        for b in batches:
            out = []
            for text, cuts in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                out += [(c["anchor"], c["content"], c["windows"], c["chunks"], raw[c["start"] : c["start"] + c["windows"] + width - 1]) for c in cuts]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "content", "windows", "chunks", "part"])

    long_texts = texts.where(F.octet_length("text") >= width)
    one_each = long_texts.join(wanted.hint("shuffle_hash"), F.col("sha") == F.col("s")).groupBy("sha").agg(F.first("text").alias("text"), F.first("cuts").alias("cuts"))
    parts = one_each.select("text", "cuts").mapInArrow(cut_out, "anchor long, content long, windows int, chunks int, part binary")
    # every pair of chunks of a large group meets in a group of its own
    own = F.pmod(F.col("content"), F.col("chunks")).cast("int")
    parts = parts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    shard = F.when(F.col("chunks") == 1, F.col("anchor")).otherwise(F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")))
    dealt = parts.select(shard.alias("key"), "content", "windows", "chunks", "part").repartition(n_parts, "key").sortWithinPartitions("key", "content")
    in_shards = written(dealt.mapInArrow(_shards(width), "c long, runs array<int>"))
    del one_each, parts, dealt
    dropped(wanted)
    freed(spark)
    whole = kinds.where("times > 1").select(F.col("content").alias("c"), F.array(F.lit(0), F.col("windows")).alias("runs"))
    parted = in_shards.join(kinds.where("times > 1").select(F.col("content").alias("w")), F.col("c") == F.col("w"), "left_anti")
    # a stretch of a large group comes back from each pair of chunks it was in
    parted = parted.groupBy("c").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    runs = found.join(whole.union(parted), found.content == F.col("c")).select("sha", F.flatten(F.transform("starts", lambda p: F.transform("runs", lambda r: r + p))).alias("runs"))
    out = written(runs.groupBy("sha").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    del runs, parted, whole
    for t in (found, kinds, in_shards):
        dropped(t)
    freed(spark)
    return out


def dedup_report(docs: DataFrame, width: int = WIDTH, kgram: int = KGRAM, group: int = GROUP, passage: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs; with passage, n_shared, too.

    Every byte goes that lies in a string of `width` bytes which also starts elsewhere in the table, judged on the input.
    Null counts as empty; texts shorter than width stay whole, longer ones of any length are read whole. Rows that repeat are copies of each other like any
    texts. An empty table gives no rows; columns besides doc_id and text are ignored.

    n_shared tells passages by words, which may be shorter than width and of which nothing is removed: the number of places at
    which `passage` words in a row begin that another row holds, too (see shared_passages)."""

    def how(batches):
        for b in batches:
            each = (_kept(t.as_buffer().to_pybytes(), r.as_py(), width) for t, r in zip(b.column(1), b.column(2), strict=True))
            rows = [(hashlib.sha256(kept).hexdigest(), n, spans) for kept, n, spans in each]
            if rows:
                digest, n, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], names=["s", "n_removed", "n_spans", "digest"])

    texts = keyed(docs)
    runs = repeated_runs(texts, width, kgram, group).select(F.col("sha").alias("s"), "runs")
    # a text that occurs more than once is worked on once
    marked = texts.where(F.octet_length("text") >= width).join(runs.hint("shuffle_hash"), F.col("sha") == F.col("s")).groupBy("sha").agg(F.first("text").alias("text"), F.first("runs").alias("runs"))
    removed = marked.select("sha", "text", "runs").mapInArrow(how, "s binary, n_removed long, n_spans long, digest string")
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("hex"), key(t).alias("k"), passage_key(t).alias("p"))
    zero = F.lit(0).cast("long")
    columns = ["doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("digest", "hex").alias("kept_sha256")]
    if passage:
        own = own.join(shared_passages(docs, passage), F.col("p") == F.col("t"), "left")
        columns.append(F.coalesce("n_shared", zero).alias("n_shared"))
    return own.join(removed, F.col("k") == F.col("s"), "left").select(*columns)


def without_repeats(docs: DataFrame, width: int = WIDTH, kgram: int = KGRAM, group: int = GROUP) -> DataFrame:
    """docs with the repeated bytes cut out of text; bytes of a character that a cut leaves incomplete go, too.

    Texts without repeats, null ones included, stay as they are, and so do all other columns. Texts of any length are read whole;
    rows that repeat are copies of each other, and lose what they share; an empty table stays empty."""

    runs = repeated_runs(keyed(docs), width, kgram, group).select(F.col("sha").alias("_sha"), F.col("runs").alias("_runs"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = [None if t is None else _kept(t.encode(), r, width)[0].decode("utf-8", "ignore") for t, r in zip(texts, places, strict=True)]
        return pd.Series(out, dtype=object)

    own, text = runs["_runs"], docs["text"].cast("string")
    kept = F.when(own.isNull(), text).otherwise(cut(F.when(own.isNotNull(), F.coalesce(text, F.lit(""))), own))
    joined = docs.join(runs.hint("shuffle_hash"), key(text) == runs["_sha"], "left")
    return joined.select(*(kept.alias("text") if c == "text" else docs[c] for c in docs.columns))
