"""Operator 11: how far the sources of a language diverge in their use of terms.

Sources are dealt to blocks and so are terms; a task owns a cell (block of sources, block of sources, block of terms) of the
cube, gets the two slices of counts that it needs, and sums absolute differences over its terms. The sums of all cells of a
pair of sources are then added along the axis of terms. A slice holds only what occurs; terms that neither source has add the
same difference each, which one cell of a pair accounts for."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, buffers, small_batches, written

#: A term is kept if so many documents of its language have it; it counts as if it had occurred SMOOTHED times more.
LEAST_DOCS, SMOOTHED, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Sources and terms of a block, about.
SOURCES, TERMS = 64, 256
#: Bytes of texts whose terms are counted at a time, about.
CUT = 4 << 20

#: bytes -> bytes: A-Z lower-cased, bytes of no term made a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TERMS = np.frombuffer(_TERM, np.uint8)

_COUNTED = "lang string, source string, term string, n long, docs long"


def _terms(data: bytes):
    """Lists of the terms of a long text, CUT bytes at a time."""
    data, at = data.translate(_TERM), 0
    while at < len(data):
        end = data.find(b" ", at + CUT)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _rows(lang, source, term, n, docs):
    strings = lambda x: x if isinstance(x, pa.Array) else pa.array(x, pa.string())
    columns = [strings(lang), strings(source), term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    for i in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([c.slice(i, 50_000) for c in columns], names=["lang", "source", "term", "n", "docs"])


def _of_long(lang: str, source: str, data: bytes):
    """The counts of one long text."""
    all_: Counter = Counter()
    for part in _terms(data):
        all_.update(part)
    yield from _rows([lang] * len(all_), [source] * len(all_), pa.array(list(all_), pa.binary()), list(all_.values()), [1] * len(all_))


def _of_texts(lang: pa.Array, source: pa.Array, texts: pa.Array):
    """Occurrences, and documents, of each term of each source in these texts; and a row without a term for each source."""
    data, offsets = buffers(texts)
    group = pa.StructArray.from_arrays([lang, source], names=["lang", "source"])
    names, of = np.unique(np.array([f"{len(x['lang'])}:{x['lang']}{x['source']}" for x in group.to_pylist()], object), return_index=True, return_inverse=True)[1:]
    names = group.take(pa.array(names))
    lang, source = names.field(0), names.field(1)
    yield from _rows(lang, source, pa.nulls(len(names), pa.binary()), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64))
    data = _TERMS[data]
    inside = data != 32
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return
    doc = np.searchsorted(offsets, start, side="right") - 1
    places = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - start)])
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(data[inside])])
    every = every.dictionary_encode()
    code, v = every.indices.to_numpy().astype(np.int64), len(every.dictionary)
    key, n = np.unique(of[doc] * v + code, return_counts=True)
    once = np.sort(doc * v + code)
    once = once[np.diff(once, prepend=-1) != 0]
    docs = np.unique(of[once // v] * v + once % v, return_counts=True)[1]
    g = pa.array(key // v)
    yield from _rows(lang.take(g), source.take(g), every.dictionary.take(pa.array(key % v)), n, docs)


def _counted(batches):
    """What _of_texts says, for stretches of about CUT bytes of texts; a longer text on its own."""
    held: list[tuple] = []
    size = 0

    def given():
        yield from _of_texts(*(pa.concat_arrays(c) for c in zip(*held, strict=True)))
        held.clear()

    for b in batches:
        length = pa.compute.binary_length(b.column(2))
        long = pa.compute.greater(length, CUT)
        for lang, source, text in zip(*(c.filter(long).to_pylist() for c in b.columns), strict=True):
            yield from _of_long(lang, source, text.encode())
        held.append(tuple(b.columns[:2]) + (pa.compute.if_else(long, pa.scalar("", b.column(2).type), b.column(2)),))
        size += pa.compute.sum(pa.compute.if_else(long, 0, length)).as_py() or 0
        if size > 2 * CUT:
            yield from given()
            size = 0
    if held:
        yield from given()


def share(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + SMOOTHED) / d), exactly, for n + SMOOTHED <= d < 2 ** 53; three digits at a time stay in int64."""
    out, rest = np.divmod(n + SMOOTHED, d)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, d)
        out = out * 1000 + digit
    return out + 1


def _share(n: str, d: str):
    """The same in SQL, by decimals."""
    return F.expr(f"1 + (cast({n} + {SMOOTHED} as decimal(19, 0)) * cast({UNIT} as decimal(10, 0))) div cast({d} as decimal(19, 0))")


_PARTIAL = "lang string, one string, other string, value long"


def _cell(cell: pa.Table) -> pa.Table:
    """The sums of one cell: over its terms, how much more a pair's shares differ than by the terms that neither has; in the
    first block of terms, also these, as if no term occurred."""
    left, right, block = (int(cell.column(c)[0].as_py()) for c in ("left", "right", "of_term"))
    lang = cell.column("lang")[0].as_py()
    term = cell.column("term").combine_chunks()
    marks, entries = cell.filter(term.is_null()), cell.filter(term.is_valid())
    sources = marks.column("source").to_pylist()
    place = {s: i for i, s in enumerate(sources)}
    total, kept, of = marks.column("total").to_numpy(), marks.column("kept").to_numpy(), marks.column("of_source").to_numpy()
    d = total + SMOOTHED * kept
    none = np.where(kept > 0, share(np.zeros_like(d), np.maximum(d, SMOOTHED)), 0)
    at = np.array([place[s] for s in entries.column("source").to_pylist()], np.int64)
    names, column = np.unique(entries.column("term").to_numpy(zero_copy_only=False), return_inverse=True) if len(at) else (at, at)
    p = np.repeat(none[:, None], len(names), axis=1)
    p[at, column] = share(entries.column("n").to_numpy(), d[at])
    rows = np.flatnonzero(of == left)
    out = []
    for i in rows:
        others = np.flatnonzero(of == right)
        others = others[others > i] if left == right else others
        apart = np.abs(none[others] - none[i])
        value = np.abs(p[others] - p[i]).sum(axis=1) - len(names) * apart + (kept[i] * apart if block == 0 else 0)
        out.append(pa.table({"lang": pa.array([lang] * len(others), pa.string()), "one": pa.array([sources[i]] * len(others), pa.string()), "other": pa.array([sources[j] for j in others], pa.string()), "value": pa.array(value, pa.int64())}))
    return pa.concat_tables(out) if out else pa.table({"lang": pa.array([], pa.string()), "one": pa.array([], pa.string()), "other": pa.array([], pa.string()), "value": pa.array([], pa.int64())})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part "pair": for each source of a language, each other one and the sum of differences of their shares over all kept terms.
    Part "term": the kept terms that a source has and uses more than its language does, the `top` first. Null lang, source
    and text are ''; documents without terms still make a source; texts of any length are read whole; rows that repeat
    count each; an empty table gives no rows; columns besides text, lang and source are ignored."""
    small_batches(docs.sparkSession)
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = written(own.mapInArrow(_counted, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = written(kept)
    entries = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang"))
    groups = written(counts.groupBy("lang", "source").agg(F.lit(0).alias("zero")).select("lang", "source").join(entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")))
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total")), "lang", "left")
    per_lang = written(per_lang.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.ceil(F.col("sources") / SOURCES).cast("int").alias("source_blocks"), F.greatest(F.ceil(F.coalesce("kept", F.lit(0)) / TERMS), F.lit(1)).cast("int").alias("term_blocks")))

    of_source, of_term = F.pmod(F.xxhash64("source"), F.col("source_blocks")).cast("int"), F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int")
    slices = entries.join(per_lang, "lang").select("lang", of_source.alias("of_source"), of_term.alias("of_term"), "source_blocks", "source", "term", "n", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("kept"))
    marks = groups.join(per_lang, "lang").select("lang", of_source.alias("of_source"), F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("of_term"), "source_blocks", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", "kept")
    cells = slices.union(marks).withColumn("against", F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1)))
    cells = cells.select("lang", F.least("of_source", "against").alias("left"), F.greatest("of_source", "against").alias("right"), "of_term", "of_source", "source", "term", "n", "total", "kept")
    half = cells.groupBy("lang", "left", "right", "of_term").applyInArrow(_cell, _PARTIAL).groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    both = half.select("lang", "value", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item")))).alias("x"))
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    known = entries.join(groups, ["lang", "source"]).join(per_lang.select("lang", "kept", "lang_total"), "lang")
    value = _share("n", f"(total + {SMOOTHED} * kept)") - _share("in_lang", f"(lang_total + {SMOOTHED} * kept)")
    terms = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).where("value > 0")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(first))
    return ranked(pairs).union(ranked(terms).where(F.col("rank") <= top))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT k, lang, source, unnest(words) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS in_lang FROM t GROUP BY ALL HAVING count(DISTINCT k) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(in_lang) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
e AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.in_lang FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT e.lang, source, term, e.n, 1 + {UNIT}::HUGEINT * (e.n + {SMOOTHED}) // (sum(e.n) OVER (PARTITION BY e.lang, source) + {SMOOTHED} * l.v)::HUGEINT AS p, 1 + {UNIT}::HUGEINT * (in_lang + {SMOOTHED}) // (l.n + {SMOOTHED} * l.v)::HUGEINT AS q FROM e JOIN l ON e.lang = l.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= {TOP}
"""
