"""Operator 2: quality classifier, a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, mixed, remainder, small_batches, words

#: Buckets of hashed words; statistics come behind them, STEPS features each.
WORDS, STEPS, RANK = 1 << 14, 16, 8
#: Labelled rows that training reads at most: those with the smallest hashes of their ids.
LABELLED = 12_000
#: Texts of a batch are taken together up to so many bytes.
TOGETHER = 1 << 18
#: 1 if the score is at least this.
THRESHOLD = 0.3

_UPPER, _DIGIT, _END, _PUNCT, _SYMBOL, _HIGH = (np.zeros(256, np.float32) for _ in range(6))
_UPPER[65:91], _DIGIT[48:58], _HIGH[128:] = 1, 1, 1
_END[list(b".!?")] = 1
_PUNCT[list(b".,;:!?'\"()-")] = 1
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = 1
STATISTICS = 18
FEATURES = WORDS + STATISTICS * STEPS


def _steps(x: np.ndarray) -> np.ndarray:
    """A share from 0 to 1 as one of STEPS steps, finer towards 0."""
    return np.clip(np.sqrt(np.clip(x, 0, 1)) * STEPS, 0, STEPS - 1).astype(np.int64)


def _sizes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(x, 0) + 1), 0, STEPS - 1).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of a run of texts; each text's word values and its statistics have length 1 each."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    start, end, doc, h = words(data, offsets)
    count = np.bincount(doc, minlength=n).astype(np.float64)
    some, one = np.maximum(count, 1), np.maximum(size, 1)

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.float64)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / one

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc, mask, minlength=n) / some

    lines = share((np.arange(256) == 10).astype(np.float32)) * one + 1
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    first = data[start] if len(start) else np.zeros(0, np.uint8)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again2 = np.zeros(len(h), bool)
    again2[2:] = (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))  # 2 ** 24 texts, 40 bits of hash
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(key))).astype(np.float64)
    which = (key[at] >> np.uint64(40)).astype(np.int64)
    kinds = np.bincount(which, minlength=n) / some
    most = np.zeros(n)
    np.maximum.at(most, which, tf)
    stats = [
        _sizes(count), _sizes(n_chars), _steps((size / np.maximum(n_chars, 1) - 1) * (n_chars >= 0)), _steps((size / some - 1) / 24), _steps(share(_UPPER)), _steps(share(_DIGIT)), _steps(share(_END) * 4), _steps(share(_PUNCT) * 2), _steps(share(_SYMBOL)), _steps(share(_HIGH)), _sizes(lines),
        _steps(1 - kinds), _steps(most / some), _steps(per_word(again)), _steps(per_word(again2)), _steps(per_word(_END[last])), _steps(per_word((end - start) == 1)), _steps(per_word(_SYMBOL[last] + _SYMBOL[first]) / 2),
    ]
    value = np.log1p(tf)
    length = np.sqrt(np.bincount(which, value * value, minlength=n))
    value /= np.maximum(length, 1e-12)[which]
    index = (mixed(key[at] & np.uint64((1 << 40) - 1)) % np.uint64(WORDS)).astype(np.int64)
    text = np.concatenate([which, *[np.arange(n)] * len(stats)])
    index = np.concatenate([index, *(WORDS + k * STEPS + s for k, s in enumerate(stats))])
    value = np.concatenate([value, np.full(n * len(stats), len(stats) ** -0.5)])
    return text, index, value


class Machine:
    """y = b + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j, the pairs in linear time as half of (sum v x)^2 - sum (v x)^2."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def logits(self, text: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        y = self.bias + np.bincount(text, self.w[index] * value, minlength=n)
        for f in range(self.v.shape[1]):
            vx = self.v[index, f] * value
            y += 0.5 * (np.bincount(text, vx, minlength=n) ** 2 - np.bincount(text, vx * vx, minlength=n))
        return y

    def scores(self, *a) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*a), -30, 30)))

    @classmethod
    def trained(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, size: int = 128, rate: float = 0.1, decay: float = 1e-5) -> Machine:
        """Adagrad over rows (indices, values); the same rows always give the same model."""
        rng = np.random.default_rng(7)
        p = (labels.sum() + 1) / (len(labels) + 2)
        m = cls(float(np.log(p / (1 - p))), np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, RANK)))
        gw, gv, gb = np.full(FEATURES, 1e-6), np.full((FEATURES, RANK), 1e-6), 1e-6
        for _ in range(epochs if len(set(labels.tolist())) > 1 else 0):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), size):
                part = order[i : i + size]
                text = np.repeat(np.arange(len(part)), [len(rows[j][0]) for j in part])
                index = np.concatenate([rows[j][0] for j in part])
                value = np.concatenate([rows[j][1] for j in part]).astype(np.float64)
                vx = m.v[index] * value[:, None]
                total = np.stack([np.bincount(text, vx[:, f], minlength=len(part)) for f in range(RANK)], 1)
                y = m.bias + np.bincount(text, m.w[index] * value, minlength=len(part)) + 0.5 * ((total**2).sum(1) - np.bincount(text, (vx * vx).sum(1), minlength=len(part)))
                off = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[part]) / len(part) * 16
                at, where = np.unique(index, return_inverse=True)
                g = off[text] * value
                dw = np.bincount(where, g, minlength=len(at)) + decay * m.w[at]
                dv_each = g[:, None] * (total[text] - vx)
                dv = np.stack([np.bincount(where, dv_each[:, f], minlength=len(at)) for f in range(RANK)], 1) + decay * m.v[at]
                gw[at] += dw**2
                gv[at] += dv**2
                gb += off.sum() ** 2
                m.w[at] -= rate * dw / np.sqrt(gw[at])
                m.v[at] -= rate * 0.5 * dv / np.sqrt(gv[at])
                m.bias -= rate * off.sum() / np.sqrt(gb)
        return m


def _runs(b: pa.RecordBatch):
    """(first row, bytes, offsets, n_chars) of runs of texts of a batch (doc_id, text, n_chars, ...)."""
    data, offsets = buffers(b.column(1))
    chars = b.column(2).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.float64)
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], chars[i:j]
        i = j


def _columns(docs: DataFrame) -> list:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), chars.alias("n_chars")]


def _features(batches):
    for b in batches:
        index, value = [], []
        for _, data, offsets, chars in _runs(b):
            text, i, x = features(data, offsets, chars)
            order = np.argsort(text, kind="stable")
            cut = np.cumsum(np.bincount(text, minlength=len(chars)))[:-1]
            index += [a.astype("<i4").tobytes() for a in np.split(i[order], cut)]
            value += [a.astype("<f4").tobytes() for a in np.split(x[order], cut)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "label", "i", "x"])


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, sample: int = LABELLED) -> Machine:
    """Learns labels.quality of at most `sample` labelled rows whose crc32(doc_id) mod `mod` is not 0.

    Null labels and ids are left out; several labels of one id count as the smallest. Without labels of both kinds the
    score is the share of label 1 among them (one row of each added). The features of the sample, some 2 kB a row, are
    the only thing that comes to the driver."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("quality").cast("int").alias("q")).where("k is not null and q in (0, 1)").where(remainder(F.col("k"), mod) != 0)
    chosen = chosen.groupBy("k").agg(F.min("q").alias("label")).orderBy(F.xxhash64("k"), "k").limit(sample)
    own = docs.select(*_columns(docs))
    rows = own.join(F.broadcast(chosen), own.doc_id == chosen.k).select("doc_id", "text", "n_chars", "label")
    found = sorted(rows.mapInArrow(_features, "doc_id long, label int, i binary, x binary").collect(), key=lambda r: (r["doc_id"], bytes(r["i"])))
    return Machine.trained([(np.frombuffer(r["i"], "<i4"), np.frombuffer(r["x"], "<f4")) for r in found], np.array([r["label"] for r in found], np.float64))


def with_score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """docs and the score of each text as one more column; nothing is shuffled. Null counts as empty and is scored like
    any other text. The model has a fixed size, about 1 MB, whatever the data."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))

    @F.pandas_udf("double")
    def scores(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        m = Machine(*model.value)
        b = pa.RecordBatch.from_arrays([pa.nulls(len(text)), pa.array(text, pa.string(), from_pandas=True), pa.array(n_chars, pa.int64(), from_pandas=True)], names=["doc_id", "text", "n_chars"])
        got = [m.scores(*features(data, offsets, chars), len(chars)) for _, data, offsets, chars in _runs(b)]
        return pd.Series(np.concatenate(got) if got else np.zeros(0))

    _, text, chars = _columns(docs)
    return docs.withColumn(name, scores(text, chars))


def score(docs: DataFrame, machine: Machine, mod: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; rows that repeat are scored alike.

    Null and empty texts have the score of a text without words; texts of any length are read whole. A null id counts as the
    empty text for held_out. An empty table gives no rows; columns besides doc_id, text and n_chars are ignored, whatever their
    names."""
    rows = with_score(docs.select(*_columns(docs)), machine)
    return rows.select("doc_id", (remainder(F.col("doc_id"), mod) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
