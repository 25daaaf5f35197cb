"""Operator 1: embedding near-dedup with a forest of random-projection trees whose splits overlap."""

from __future__ import annotations

from math import ceil, erfc, exp, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, reached, written

COSINE = 0.95
#: Trees at least (one for each level of a tree, if that is more); vectors that trees are fitted on (those with the smallest
#: hashes); expected vectors of a leaf; sample vectors that a split needs.
TREES, SAMPLE, LEAF, FEWEST = 6, 20_000, 1000, 64
#: Copies of the vectors that a tree makes by its overlaps, about.
SPILL = 2.0
#: The share of links that a split may cut; where it would cut more, vectors lie too close together and stay one leaf.
CUT = 0.15
#: Vectors that a task compares with each other; larger leaves are dealt out as pairs of chunks.
CHUNK = 3000


def margin(dim: int, cosine: float) -> float:
    """How far a pair at the given cosine lies apart along a random direction, in the mean square."""
    return (max(0.0, 2 - 2 * cosine) / max(dim, 1)) ** 0.5


def depth(n: int, leaf: int) -> int:
    """Levels of a tree over n vectors, one to spare."""
    return ceil(log2(max(n / leaf, 1))) + 1


def overlap(n: int, leaf: int) -> float:
    """The share of a node's vectors on either side of a split that go to both, so that a tree keeps to SPILL at any n."""
    return (SPILL ** (1 / depth(n, leaf)) - 1) / 2


def cut_links(gap: float, width: float, mass: float) -> float:
    """Expected share of links that a split cuts: their ends lie gap * normal apart, and further than `width` around a place
    where the vectors' density is `mass`."""
    u = width / gap
    return mass * gap * (2 * exp(-u * u / 2) / sqrt(2 * pi) - u * erfc(u / sqrt(2)))


def grown(x: np.ndarray, scale: float, gap: float, share: float, rng: np.random.Generator, leaf: int):
    """A tree of nested lists [direction, from, to, below, above]; a leaf is (expected vectors, whether a larger sample could
    split it). scale: vectors for each one of the sample."""
    expected = len(x) * scale
    if expected <= leaf:
        return expected, False
    if len(x) < FEWEST:
        return expected, True
    best = None
    for w in rng.normal(size=(3, x.shape[1])):
        w /= np.linalg.norm(w)
        at = x @ w
        a, low, mid, high, b = np.quantile(at, [0.3, 0.5 - share, 0.5, 0.5 + share, 0.7])
        low, high = max(low, mid - gap), min(high, mid + gap)
        lost = cut_links(gap, high - low, 0.4 / max(b - a, 1e-300))
        if best is None or lost < best[0]:
            best = lost, w, low, high, at
    lost, w, low, high, at = best
    below, above = at < high, at > low
    if lost > CUT or max(below.sum(), above.sum()) > 0.8 * len(x):
        return expected, False
    return [w, low, high, grown(x[below], scale, gap, share, rng, leaf), grown(x[above], scale, gap, share, rng, leaf)]


def leaves(tree, x: np.ndarray, rows: np.ndarray, name: int = 1):
    """(name of the leaf, expected vectors, whether it is open, rows in it); a row near a split is in the leaves on both sides."""
    if not len(rows):
        return
    if isinstance(tree, tuple):
        yield name, *tree, rows
        return
    w, low, high, below, above = tree
    at = x[rows] @ w
    yield from leaves(below, x, rows[at < high], 2 * name)
    yield from leaves(above, x, rows[at > low], 2 * name + 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = x.astype(np.float64)
    with np.errstate(over="ignore"):
        square = (x * x).sum(1)
    far = ~((square > 1e-200) & (square < 1e300))  # squares that left the range
    x[far] /= np.abs(x[far]).max(1)[:, None]
    square[far] = (x[far] * x[far]).sum(1)
    return x / np.sqrt(square)[:, None]


def classes_of(vectors: DataFrame) -> DataFrame:
    """id (smallest vec_id), size, e (the vector, float or double as it came) of every different usable vector."""
    e = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
    own = own.where("vec_id is not null and size(e) > 0 and forall(e, v -> v is not null and not isnan(v) and abs(v) < double('inf')) and exists(e, v -> v <> 0)")
    return own.groupBy("e").agg(F.min("vec_id").alias("id"), F.count("*").alias("size")).select("id", "size", "e")


def by_dimension(lists: pa.Array):
    """(dimension, rows, matrix) of the vectors of a batch."""
    kind = lists.type.value_type.to_pandas_dtype()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    dims = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(dims) - dims
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield d, rows, flat[begin[rows][:, None] + np.arange(d)]


def fit(classes: DataFrame, n: int, trees: int, cosine: float, sample: int, leaf: int) -> dict[int, list]:
    """Trees by dimension, fitted on at most `sample` vectors; their size is bounded by it."""
    rows = classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "e").toArrow().combine_chunks()
    forest: dict[int, list] = {}
    if not rows.num_rows:
        return forest
    rows = rows.sort_by("id").combine_chunks()
    for dim, _, x in by_dimension(rows.column("e").chunk(0)):
        rng = np.random.default_rng(dim)
        forest[dim] = [grown(unit(x), n / rows.num_rows, margin(dim, cosine), overlap(n, leaf), rng, leaf) for _ in range(trees)]
    return forest


def vectors_of(packed: pa.Array, kind: type) -> np.ndarray:
    """The matrix of binary values of equal length."""
    at = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4)
    return np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(packed), -1)


ROUTED = "leaf long, id long, size long, v binary, expected double, open boolean, leaves array<long>"


def _packed(x: np.ndarray) -> pa.Array:
    """One binary value for each row of x."""
    x = np.ascontiguousarray(x)
    at = (np.arange(len(x) + 1) * x.shape[1] * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x)])


def _rows(found: list[tuple], ids: np.ndarray, size: np.ndarray, raw: np.ndarray, listed: bool = True):
    """Rows of the leaves found: (leaf, expected, open, rows); each with the names of all leaves of its vector, in order."""
    leaf = np.concatenate([np.full(len(r), f[0]) for f in found for r in f[3:]])
    at = np.concatenate([f[3] for f in found])
    order = np.lexsort((leaf, at))
    n = np.bincount(at, minlength=len(ids))
    names = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(leaf[order]))
    for name, expected, open_, rows in found:
        k = len(rows)
        own = names.take(pa.array(rows)) if listed else pa.nulls(k, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, name)), pa.array(ids[rows]), pa.array(size[rows]), _packed(raw[rows]), pa.array(np.full(k, float(expected))), pa.array(np.full(k, open_)), own], names=["leaf", "id", "size", "v", "expected", "open", "leaves"])


def routed(classes: DataFrame, forest: dict[int, list], unseen: float) -> DataFrame:
    """Every vector in each of its leaves. unseen: vectors to expect of a dimension that the sample had none of."""
    held = classes.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            ids, size = b.column(0).to_numpy(), b.column(1).to_numpy()
            for dim, rows, raw in by_dimension(b.column(2)):
                x, found = unit(raw), []
                for t, tree in enumerate(held.value.get(dim, [(unseen, False)])):
                    found += [(hash((dim, t, name)), *rest) for name, *rest in leaves(tree, x, np.arange(len(x)))]
                yield from _rows(found, ids[rows], size[rows], raw)

    return classes.select("id", "size", "e").mapInArrow(run, ROUTED)


def deepened(rows: DataFrame, n: int, cosine: float, sample: int, leaf: int, kind: type) -> DataFrame:
    """Open leaves split further: each is a stream of rows in the order of their hash; from the first ones, `sample` at most, a
    tree is grown that they and all that follow are routed by."""
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        key, tree, held, count = None, None, [], 0

        def out(part):
            raw = vectors_of(part.column(3), kind)
            x = unit(raw)
            found = [(hash((key, name)), *rest) for name, *rest in leaves(tree, x, np.arange(len(x)))]
            yield from _rows(found, part.column(1).to_numpy(), part.column(2).to_numpy(), raw, False)

        def grow():
            nonlocal tree, held, count
            x = unit(np.concatenate([vectors_of(p.column(3), kind) for p in held]))
            scale = max(1.0, held[0].column(4)[0].as_py() / len(x))
            tree = grown(x, scale if count >= sample else 1.0, margin(x.shape[1], cosine), overlap(n, leaf), np.random.default_rng(abs(key)), leaf)
            for p in held:
                yield from out(p)
            held, count = [], 0

        for b in batches:
            name = b.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else []
            for i, j in zip(edges, np.append(edges[1:], len(name)), strict=True):
                part = b.slice(i, j - i)
                if name[i] != key:
                    if held:
                        yield from grow()
                    key, tree = int(name[i]), None
                if tree is not None:
                    yield from out(part)
                    continue
                held.append(part)
                count += len(part)
                if count >= sample:
                    yield from grow()
        if held:
            yield from grow()

    deep = rows.where("open").repartition(n_parts, "leaf").sortWithinPartitions("leaf", F.xxhash64("id"), "id").mapInArrow(run, ROUTED)
    return rows.where("not open").union(deep)


def linked(x: np.ndarray, size: np.ndarray, earlier: tuple[np.ndarray, np.ndarray], cosine: float, side: np.ndarray | None):
    """(links owned, root) of the vectors of a leaf: how many vectors each links with over the pairs that this leaf counts, and
    the first one that it reaches here.

    earlier: (row, leaf) of the leaves that come before this one; a pair that shares one of them is counted there.
    side: only pairs of different sides are compared."""
    n = len(x)
    root, links = np.arange(n), np.zeros(n, np.int64)
    _, code, often = np.unique(earlier[1], return_inverse=True, return_counts=True)
    shared = often[code] > 1
    row, code = earlier[0][shared], np.unique(code[shared], return_inverse=True)[1]
    for i in range(0, n, 512):
        part = slice(i, min(n, i + 512))
        near = x[part] @ x[i:].T
        hit = near >= cosine
        a, b = np.nonzero(np.abs(near - cosine) < 1e-9)
        hit[a, b] = np.einsum("ij,ij->i", x[i + a], x[i + b]) >= cosine
        hit &= np.arange(n - i)[None, :] > np.arange(hit.shape[0])[:, None]
        if side is not None:
            hit &= side[part][:, None] != side[i:][None, :]
        a, b = np.nonzero(hit)
        if not len(a):
            continue
        moved = np.flatnonzero(root != np.arange(n))
        root = reached(np.concatenate([a + i, moved]), np.concatenate([b + i, root[moved]]), n)
        # rows and columns with links, and which pairs of them share a leaf that comes before
        rows, cols = np.unique(a), np.unique(b)
        own = hit[np.ix_(rows, cols)]
        at_row, at_col = np.full(n, -1), np.full(n, -1)
        at_row[rows + i], at_col[cols + i] = np.arange(len(rows)), np.arange(len(cols))
        for c in range(0, int(code.max(initial=-1)) + 1, 2048):
            here = (code >= c) & (code < c + 2048)
            r, k = row[here], code[here] - c
            left, right = np.zeros((len(rows), 2048), np.float32), np.zeros((len(cols), 2048), np.float32)
            left[at_row[r[at_row[r] >= 0]], k[at_row[r] >= 0]] = 1
            right[at_col[r[at_col[r] >= 0]], k[at_col[r] >= 0]] = 1
            own &= left @ right.T == 0
        links[rows + i] += own @ size[cols + i]
        links[cols + i] += own.T @ size[rows + i]
    return links, root


def _verified(cosine: float, kind: type):
    """Rows (key, leaf, id, size, v, leaves, side) sorted by key -> (a, b, n): a vector, the first one it reaches in its leaf,
    and the links it has there."""

    def run(batches):
        key, held = None, []

        def out():
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids, side = part.column(2).to_numpy(), part.column(6).to_numpy()
            before, n = part.column(5).flatten().to_numpy(), part.column(5).value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), n)
            early = before < part.column(1)[0].as_py()
            links, root = linked(unit(vectors_of(part.column(4), kind)), part.column(3).to_numpy(), (row[early], before[early]), cosine, None if side[0] < 0 else side)
            some = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some])], names=["a", "b", "n"])

        for b in batches:
            name = b.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else []
            for i, j in zip(edges, np.append(edges[1:], len(name)), strict=True):
                if name[i] != key:
                    if held:
                        yield from out()
                    key, held = name[i], []
                held.append(b.slice(i, j - i))
        if held:
            yield from out()

    return run


def links(classes: DataFrame, cosine: float = COSINE, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """(a, b, n): rows whose sum of n over a is how many vectors a links with; the pairs a - b connect what links connect.

    A pair is counted in the first leaf that holds both of its ends, so no table of pairs is made. Vectors of dense leaves, which
    no split can part without cutting links, meet as pairs of chunks: for m of them m / chunk copies of each."""
    spark = classes.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = np.float32 if classes.schema["e"].dataType.simpleString() == "array<float>" else np.float64
    n = classes.count()
    rows = routed(classes, fit(classes, n, max(trees, depth(n, leaf)), cosine, sample, leaf), 3 * n / max(min(n, sample), 1))
    if n > sample * leaf / FEWEST / 2:  # the sample is too small for all the splits there are to make
        rows, deep = written(rows), False
        while rows.where("open").limit(1).count():
            before, rows, deep = rows, written(deepened(rows, n, cosine, sample, leaf, kind)), True
            dropped(before)
        if deep:
            names = rows.groupBy(F.col("id").alias("i")).agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
            rows = rows.drop("leaves").join(names, F.col("id") == F.col("i"))
    chunks = F.greatest(F.ceil(F.col("expected") / chunk), F.lit(1)).cast("int")
    rows = rows.select("leaf", "id", "size", "v", "leaves", chunks.alias("chunks"), F.pmod(F.xxhash64("id"), chunks).cast("int").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = F.when(F.col("chunks") == 1, F.col("leaf")).otherwise(F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    dealt = rows.select(key.alias("key"), "leaf", "id", "size", "v", "leaves", side.alias("side")).repartition(n_parts, "key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(_verified(cosine, kind), "a long, b long, n long")


def near_dedup(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different dimension. Equal vectors are one class: its members link with each other and count as so many links of
    others, but never form pairs. A row of null vec_id links with nothing; rows that repeat count each. An empty table
    gives no rows; columns besides vec_id and embedding are ignored, whatever their names."""
    classes = written(classes_of(vectors))
    found = written(links(classes, cosine, trees))
    others = found.groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("others"))
    comp = components(found.select("a", "b")).select(F.col("id").alias("c"), "component")
    of_class = classes.join(others, F.col("id") == F.col("l"), "left").join(comp, F.col("id") == F.col("c"), "left")
    of_class = of_class.select(F.col("e").alias("of"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component"))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(classes.schema["e"].dataType).alias("e"))
    out = own.join(of_class, (F.col("e") == F.col("of")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
