"""Operator 13: hard negatives by exact inner products, in tiles of anchors and candidates multiplied by Strassen's recursion.

Anchors and rows are dealt to blocks by the hash of their id, and a task owns a cell (block of anchors, block of rows). Within
it tiles are multiplied on int64, and what leaves the cell are heaps of bounded size, which merge in any order: first those
of the positives, then, with the positives' scores known, those of the windows below them. No label is a key of a shuffle, so
a label that holds most rows is spread like any other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Anchors are the rows whose id is divisible by EVERY; each has POSITIVES positives, each of these NEGATIVES negatives.
EVERY, POSITIVES, NEGATIVES, SCALE = 100, 5, 5, 256
#: A negative's score is at least LOW / HIGH of the positive's, and at most the positive's.
LOW, HIGH = 4, 5
#: Numbers that the vectors of one block hold, about; and rows of a block at least, where there are tasks for more blocks.
BLOCK, LEAST = 1 << 20, 256
#: Sides of a tile: anchors, rows, components; no side of a leaf's product is halved to under LEAF.
TILE_ANCHORS, TILE_ROWS, TILE_DEPTH, LEAF = 512, 1024, 4096, 16
#: Sums of squares stay under this, so that no inner product leaves int64, five times over.
SQUARES = float(1 << 60)


def _padded(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if a.shape == (rows, columns):
        return a
    out = np.zeros((rows, columns), a.dtype)
    out[: a.shape[0], : a.shape[1]] = a
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for int64 matrices of any shape: seven products of halves at each level, odd sides padded with zeros.

    Only sums and products are used, so what overflows on the way is right again in the end if the result fits in int64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) < 2 * leaf:
        return a @ b
    i, j, l = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a, b = _padded(a, 2 * i, 2 * j), _padded(b, 2 * j, 2 * l)
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l], out[:i, l:] = m1 + m4 - m5 + m7, m3 + m5
    out[i:, :l], out[i:, l:] = m2 + m4, m1 - m2 + m3 + m6
    return out[:m, :n]


class Ragged:
    """Vectors of any lengths; dense() gives a stretch of components of some of them, with zeros where a vector has ended."""

    def __init__(self, lists: pa.Array):
        lists = lists.cast(pa.large_list(pa.int64()))
        offsets = lists.offsets.to_numpy()
        self.values, self.start, self.length = lists.values.to_numpy(), offsets[:-1], np.diff(offsets)

    def dense(self, rows: slice, begin: int, end: int) -> np.ndarray:
        start, length = self.start[rows], np.clip(self.length[rows] - begin, 0, end - begin)
        out = np.zeros((len(start), end - begin), np.int64)
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(np.arange(len(start)), length), at] = self.values[np.repeat(start + begin, length) + at]
        return out


def leaders(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first `most` allowed columns of each row: by score, the highest first, then by the smaller id."""
    row, column = np.nonzero(allowed)
    order = np.lexsort((ids[column], -score[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < most
    return row[first], column[first]


def _tiles(cell: pa.Table):
    """(anchors, rows, slice of the anchors, slice of the rows, scores) of a cell, tile by tile."""
    is_anchor = cell.column("anchor").combine_chunks()
    anchors, rows = cell.filter(is_anchor).combine_chunks(), cell.filter(pa.compute.invert(is_anchor)).combine_chunks()
    if not anchors.num_rows or not rows.num_rows:
        return
    a, b = Ragged(pa.concat_arrays(anchors.column("q").chunks)), Ragged(pa.concat_arrays(rows.column("q").chunks))
    depth = int(min(a.length.max(), b.length.max()))
    for y in range(0, rows.num_rows, TILE_ROWS):
        for x in range(0, anchors.num_rows, TILE_ANCHORS):
            of, to = slice(x, x + TILE_ANCHORS), slice(y, y + TILE_ROWS)
            score = np.zeros((len(a.start[of]), len(b.start[to])), np.int64)
            for k in range(0, depth, TILE_DEPTH):
                end = min(k + TILE_DEPTH, depth)
                score += strassen(a.dense(of, k, end), np.ascontiguousarray(b.dense(to, k, end).T))
            yield anchors, rows, of, to, score


def _longs(t: pa.Table, name: str, part: slice) -> np.ndarray:
    return t.column(name).to_numpy()[part]


POSITIVE = "anchor_id long, positive_id long, positive_score long"
WINDOW = POSITIVE + ", negative_id long, negative_score long"


def _table(columns: list[np.ndarray], schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def _positives(most: int):
    def run(cell: pa.Table) -> pa.Table:
        found = [_table([np.zeros(0, np.int64)] * 3, POSITIVE)]
        for anchors, rows, of, to, score in _tiles(cell):
            own, other = _longs(anchors, "vec_id", of), _longs(rows, "vec_id", to)
            same = (_longs(anchors, "label", of)[:, None] == _longs(rows, "label", to)) & (own[:, None] != other)
            i, j = leaders(score, same, other, most)
            found.append(_table([own[i], other[j], score[i, j]], POSITIVE))
        return pa.concat_tables(found)

    return run


def _windows(most: int):
    def run(cell: pa.Table) -> pa.Table:
        found = [_table([np.zeros(0, np.int64)] * 5, WINDOW)]
        for anchors, rows, of, to, score in _tiles(cell):
            own, other = _longs(anchors, "vec_id", of), _longs(rows, "vec_id", to)
            differ = _longs(anchors, "label", of)[:, None] != _longs(rows, "label", to)
            positives = anchors.column("positives").slice(of.start, len(own)).to_pylist()
            for k in range(max(map(len, positives))):
                has = np.array([len(p) > k for p in positives])
                least = np.array([p[k]["positive_score"] if len(p) > k else 0 for p in positives], np.int64)
                fits = differ & has[:, None] & (HIGH * score >= LOW * least[:, None]) & (score <= least[:, None])
                i, j = leaders(score, fits, other, most)
                names = np.array([p[k]["positive_id"] if len(p) > k else 0 for p in positives], np.int64)
                found.append(_table([own[i], names[i], least[i], other[j], score[i, j]], WINDOW))
        return pa.concat_tables(found)

    return run


def taking_part(vectors: DataFrame, relabel: bool = True) -> DataFrame:
    """vec_id, label, q of the rows that take part: q are the components times SCALE, rounded down.

    Not those with a null id, label, vector or component, a component that is not finite, or components whose (256 |x| + 1)
    squared add up to 2 ** 60 or more, whose products could leave int64. Of rows that share an id, that of the smallest
    label and then q stands for all. Where relabel is set and the id is divisible by 7, the label becomes (label + 1) % 10."""
    x = F.col("embedding").cast("array<double>")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).where("vec_id is not null and label is not null and x is not null")
    own = own.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    own = own.where(F.aggregate("x", F.lit(0.0), lambda s, v: s + (F.abs(v) * SCALE + 1) * (F.abs(v) * SCALE + 1)) < SQUARES)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")) if relabel else F.col("label")
    own = own.select("vec_id", label.alias("label"), F.transform("x", lambda v: F.floor(v * float(SCALE)).cast("long")).alias("q"))
    return own.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("least")).select("vec_id", "least.label", "least.q")


def _blocks(n: int, width: float, tasks: int) -> int:
    return max(1, -(-n * int(width + 1) // BLOCK), min(tasks, -(-n // LEAST)))


def _cells(anchors: DataFrame, rows: DataFrame, of_anchors: int, of_rows: int):
    """The rows of all cells, grouped by cell: anchors go to each block of rows, rows to each block of anchors."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    a = anchors.select(F.lit(True).alias("anchor"), block(of_anchors, 1).alias("of_anchor"), every(of_rows).alias("of_row"), "vec_id", "label", "q", "positives")
    b = rows.select(F.lit(False).alias("anchor"), every(of_anchors).alias("of_anchor"), block(of_rows, 2).alias("of_row"), "vec_id", "label", "q", F.lit(None).cast(anchors.schema["positives"].dataType).alias("positives"))
    return a.union(b).groupBy("of_anchor", "of_row")


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, relabel: bool = True) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label; which rows take part, and what becomes of repeated ids, taking_part() says. Vectors of
    different lengths meet as if the shorter ended in zeros. Higher scores come first, ties by the smaller vec_id. Anchors
    without positives and positives without negatives give no rows; an empty table gives none; other columns are ignored,
    whatever their names."""
    spark = vectors.sparkSession
    rows = written(taking_part(vectors, relabel))
    anchors = rows.where(F.col("vec_id") % every == 0)
    n, of_anchors, width = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.avg(F.size("q")), F.lit(1.0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a, b = max(1, -(-of_anchors * int(width + 1) // BLOCK)), _blocks(n, width, tasks)
    kind = "array<struct<positive_id: bigint, positive_score: bigint>>"
    cells = _cells(anchors.withColumn("positives", F.lit(None).cast(kind)), rows, a, b)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = cells.applyInArrow(_positives(positives), POSITIVE).withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives)
    held = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    known = written(anchors.join(held, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "q", "positives"))
    windows = _cells(known, rows, a, b).applyInArrow(_windows(negatives), WINDOW)
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = windows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS q
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {20 * LOW} * positive_score <= {20 * HIGH} * score AND score <= positive_score
QUALIFY rank <= {NEGATIVES}
"""
