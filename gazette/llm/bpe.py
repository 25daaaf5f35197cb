"""Operator 4: byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: White space as the pattern of the rank files sees it (Unicode's White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"
#: No match of the pattern holds a white-space character after another kind, so a text may be cut between them.
SAFE = re.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")

_loaded: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The encoding of a rank file; loaded once in each worker."""
    import tiktoken

    key = (path, pattern)
    if key not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def pieces(text: str, size: int):
    """Cuts a text at safe boundaries into parts of about size characters; a run without one stays whole."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, enc, size: int) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text, size) for i in enc.encode_ordinary(part)]


def encode_documents(docs: DataFrame, path: str, pattern: str, size: int = 1 << 15) -> DataFrame:
    """doc_id, ids (array<int>) of every text; null and empty texts have no ids. Repeated rows stay repeated."""
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            ids = [encode(t or "", enc, size) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) of every row of (doc_id, ids): the raw bytes, which need not be UTF-8. Null ids give none."""
    small_batches(encoded.sparkSession)

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            raw = [enc.decode_bytes(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, size: int = 1 << 15) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again where it lies.

    Null counts as the empty text: 0 tokens and the digests of nothing. One row for each row of docs, repeated or not. Texts of
    any length are encoded whole, in pieces that no match of the pattern spans. An empty table gives no rows; columns besides
    doc_id and text are ignored, whatever their names."""
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoding(path, pattern)
        number = [b"%d," % i for i in range(enc.n_vocab)].__getitem__
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for t in b.column(1):
                ids = encode(t.as_py() or "", enc, size)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(b"".join(map(number, ids))[:-1]).hexdigest())
                of_bytes.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
