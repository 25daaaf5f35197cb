"""Operator 8: bounded-space online packing of token sequences into windows of fixed length."""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

WINDOW, OPEN, END = 2048, 16, 1
#: Entries that a worker's table of tokenised words holds; it is emptied beyond that.
CACHED = 600_000
#: Leftover pieces that one task merges: at most 8 kB of ids each.
MERGED = 20_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
#: These count as white space for str.split() but not for the tokenizer, whose white space also differs in nothing else.
_ODD_SPACE = re.compile("[\x1c-\x1f]")

# How a vocabulary file must normalise and cut texts for words to be tokenised each on its own.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISED = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
_BROKEN_UP = [("Split", _PATTERN), ("ByteLevel", None)]
_CUT = regex.compile(_PATTERN)
#: Below this character, lower-casing is a matter of single characters and nothing composes.
_PLAIN = "\u0250"

_tokenizers: dict = {}


def _byte_names() -> dict[str, str]:
    """The characters that stand for UTF-8 bytes in a byte-level vocabulary: a printable byte is itself, others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names, more = [], 256
    for b in range(256):
        names.append(chr(b) if b in own else chr(more))
        more += b not in own
    return {chr(c): "".join(names[b] for b in chr(c).encode()) for c in range(0x0400)}


def _steps(part: dict | None, inside: str) -> list[tuple]:
    """(type, pattern) of the steps of a tokenizer's normaliser or pre-tokeniser."""
    part = part or {}
    steps = part.get(inside, [part]) if part.get("type") == "Sequence" else [part]
    return [(x.get("type"), (x.get("pattern") or {}).get("Regex")) for x in steps]


def by_words(description: dict) -> bool:
    """Whether texts of a tokenizer (its file as a dict) can be tokenised word by word: it lower-cases, cuts as _PATTERN does and
    is a plain byte-level BPE model."""
    m = description.get("model") or {}
    plain = m.get("type") == "BPE" and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    cuts = _steps(description.get("pre_tokenizer"), "pretokenizers")
    last = ((description.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[-1]
    no_prefix = not last.get("add_prefix_space", True) and not last.get("use_regex", True)
    own = [t for t in description.get("added_tokens") or [] if not t.get("special")]
    return plain and no_prefix and not own and _steps(description.get("normalizer"), "normalizers") == _NORMALISED and cuts == _BROKEN_UP


class Words:
    """text -> uint32 ids as bytes. White space always ends a token, so a word's ids don't depend on what surrounds it:
    each is tokenised once and then looked up. The tables are emptied when they are full. A file that normalises or cuts
    texts in another way is used on whole texts instead, and so are texts that hold the text of an added token, which is one id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            description = json.load(f)
        self.apart = by_words(description)
        added = [t["content"] for t in description.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.model = self.tokenizer.model
        self.names = str.maketrans(_byte_names())
        self.words: dict[str, bytes] = {}
        self.cuts: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _cut_ids(self, cut: str) -> bytes:
        got = self.cuts.get(cut)
        if got is None:
            ids = [t.id for t in self.model.tokenize(cut if cut.isascii() and cut.isprintable() else cut.translate(self.names))]
            got = self.cuts[cut] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def _learn(self, new: list[str]) -> None:
        other, ids = [], self._cut_ids
        for w in new:
            if not w.isascii() and max(w) >= _PLAIN:
                other.append(w)
                continue
            low = w.lower()
            if low.isalpha():
                self.words[w] = ids(low)
            elif low[:-1].isalpha() and not low[-1].isalnum():
                self.words[w] = ids(low[:-1]) + ids(low[-1])
            else:
                self.words[w] = b"".join(map(ids, _CUT.findall(low)))
        if other:
            self.words.update(zip(other, self._whole(other), strict=True))

    def __call__(self, text: str) -> bytes:
        if not self.apart or _ODD_SPACE.search(text) or self.added.search(text):
            return self._whole([text])[0]
        parts = text.split()
        new = list({w for w in parts if w not in self.words})
        if len(self.words) + len(new) > CACHED:
            self.words.clear()
            self.cuts.clear()
            new = list(set(parts))
        self._learn(new)
        return b"".join(map(self.words.__getitem__, parts))


def word_ids(path: str) -> Words:
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    return _tokenizers[path]


class Windows:
    """At most `most` open windows. A piece goes where it leaves least room; if it fits nowhere, it is cut to top up the
    fullest window, which is then given out. Nothing else waits, so the space is bounded."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next, self.open = size, most, first, []
        self.done: list[tuple] = []

    def add(self, doc, start: int, total, ids: bytes) -> None:
        at, n = 0, len(ids) // 4
        while n - at:
            left = n - at
            if left >= self.size:
                self._give([(doc, start + at, total, ids[4 * at : 4 * (at + self.size)])])
                at += self.size
                continue
            fits = [w for w in self.open if w[0] >= left]
            if fits:
                best = min(fits, key=lambda w: w[0])
                take = left
            elif len(self.open) < self.most:
                self.open.append(best := [self.size, []])
                take = left
            else:
                best = min(self.open, key=lambda w: w[0])
                take = best[0]
            best[1].append((doc, start + at, total, ids[4 * at : 4 * (at + take)]))
            best[0] -= take
            at += take
            if not best[0]:
                self.open = [w for w in self.open if w is not best]
                self._give(best[1])

    def _give(self, pieces: list) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), total, self.next, offset, None))
            offset += n
        self.next += 1

    def leftovers(self) -> list[tuple]:
        """The pieces of the windows still open, with their ids and without a sequence."""
        return [(doc, start, len(ids) // 4, zlib.crc32(ids), total, None, None, ids) for _, held in self.open for doc, start, total, ids in held]

    def flush(self) -> None:
        for _, held in self.open:
            self._give(held)
        self.open = []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_COLUMNS)


def pack(docs: DataFrame, path: str, window: int = WINDOW, most_open: int = OPEN) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each partition packs its own texts as they come, without a shuffle; the windows still open at its end, at most
    most_open of them, are merged afterwards by fewer and fewer tasks, from the second round on with one open window each, down
    to one. Null and empty texts are one token, the end; texts of any length are read whole. Rows
    that repeat are packed each on their own. sequence_id is unique, not dense; an empty table gives no rows; columns besides
    doc_id and text are ignored, whatever their names. path is read by the driver and every executor."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        ids = word_ids(path)
        end = np.array([END], "<u4").tobytes()
        w = Windows(window, most_open, TaskContext.get().partitionId() << 32)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = ids(text or "") + end
                w.add(doc, 0, len(own) // 4, own)
            if w.done:
                yield _batch(w.done)
                w.done = []
        if left := w.leftovers():
            yield _batch(left)

    def merge(level: int, last: bool):
        def merged(batches):
            w = Windows(window, most_open if level == 1 and not last else 1, (level << 56) + (TaskContext.get().partitionId() << 32))
            for b in batches:
                for r in sorted(b.to_pylist(), key=lambda r: (-r["length"], r["doc_id"] or 0, r["start"])):
                    w.add(r["doc_id"], r["start"], r["doc_tokens"], r["ids"])
            if last:
                w.flush()
            if rows := w.done + w.leftovers():
                yield _batch(rows)

        return merged

    packed = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE))
    done, left = packed.where("sequence_id is not null"), packed.where("sequence_id is null")
    tasks, level = -(-left.count() // MERGED), 1
    while tasks > 1:  # each has MERGED pieces at most, or what two tasks before it left in their open windows
        again = written(left.repartition(tasks).mapInArrow(merge(level, False), PIECE))
        done, left = done.union(again.where("sequence_id is not null")), again.where("sequence_id is null")
        tasks, level = min(-(-left.count() // MERGED), tasks // 2), level + 1
    # one window open, so that only the last one has room left
    last = left.repartition(1).mapInArrow(merge(level, True), PIECE)
    return done.union(last).drop("ids")
