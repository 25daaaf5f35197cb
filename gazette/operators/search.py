"""Search: filters, pages, facets, full text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..constants import PAGE_SIZE
from ..functions.stem import stemmed
from .store import unused

#: Words of English that say nothing by themselves.
STOP = "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()


#: Texts whose words are gathered at a time.
ROWS = 100


def words(text: Column) -> Column:
    """Lower-case words; stop words are still there, so that places count."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms(text: Column) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(STOP))


@F.pandas_udf(ArrayType(StringType()))
def stems(s: pd.Series) -> pd.Series:
    return s.map(lambda ws: [stemmed(w) for w in ws] if ws is not None else None)


def inverted(docs: DataFrame, id_: str, text: Column, stem: bool = False, everything: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(term, id, places): where each word other than a stop word stands in each document; with `everything` stop words too, which
    phrases need; with `only` (term) those words alone, before anything is grouped."""
    w = stems(words(text)) if stem else words(text)
    rows = placed(docs.select(F.col(id_), w.alias("words")), id_)
    rows = rows if everything else rows.where(~F.col("term").isin(STOP))
    rows = rows if only is None else rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", id_).agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))


def placed(docs: DataFrame, id_: str) -> DataFrame:
    """(term, id, places) of each row (id, words): the places of a word are gathered within the row, before anything is shuffled."""
    kind = docs.schema[id_].dataType.simpleString()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                terms, rows, places = [], [], []
                for k, ws in enumerate(part.column("words").to_pylist()):
                    own: dict[str, list[int]] = {}
                    for place, w in enumerate(ws or ()):
                        own.setdefault(w, []).append(place)
                    terms += own
                    rows += [k] * len(own)
                    places += own.values()
                ids = part.column(id_).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), ids, pa.array(places, pa.list_(pa.int32()))], ["term", id_, "places"])

    return docs.select(id_, "words").mapInArrow(gathered, f"term string, `{id_}` {kind}, places array<int>")


def parsed_query(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of conditions (wanted, words): "a b" is a phrase, -x a word not wanted, or between words an alternative.
    Never an error; words of a hyphenated term form a phrase."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query or ""):
        if not minus and word.lower() == "or":
            if out[-1]:
                out.append([])
            continue
        w = [x for x in re.split(r"[^\w]+|_", (phrase or word).lower()) if x]
        if w and any(x not in STOP for x in w):
            out[-1].append((not minus, w))
    return [x for x in out if x]


def fits_query(text: Column, query: str, stem: bool = False) -> Column:
    """Whether a text fits a query; a query of nothing but stop words fits none."""
    have = words(text)
    have = stems(have) if stem else have
    # bound to a variable, so that the words of a text are cut out once for all conditions
    return F.transform(F.array(have), lambda w: _fits(w, query, stem))[0]


def _fits(have: Column, query: str, stem: bool) -> Column:
    def one(ws: list[str]) -> Column:
        ws = [stemmed(w) for w in ws] if stem else ws
        needed = [w for w in ws if w not in STOP]
        if len(ws) == 1:
            return F.array_contains(have, ws[0])
        inside = F.contains(F.concat(F.lit(" "), F.array_join(have, " "), F.lit(" ")), F.lit(f" {' '.join(ws)} "))
        for w in needed:
            inside = F.array_contains(have, w) & inside
        return inside

    out = F.lit(False)
    for alternative in parsed_query(query):
        fits = F.lit(True)
        for wanted, ws in alternative:
            fits &= one(ws) if wanted else ~one(ws)
        out |= fits
    return out


PARSED = "array<struct<alternative:int,condition:int,wanted:boolean,words:array<string>>>"


def parsed_queries(queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, alternative, condition, wanted, words) of queries (query_id, query)."""

    @F.pandas_udf(PARSED)
    def parsed(s: pd.Series) -> pd.Series:
        each = lambda q: [{"alternative": a, "condition": c, "wanted": wanted, "words": [stemmed(w) for w in ws] if stem else ws} for a, conditions in enumerate(parsed_query(q)) for c, (wanted, ws) in enumerate(conditions)]
        return s.map(each, na_action=None)

    return queries.select("query_id", F.inline(parsed(F.col("query"))))


def find(index: DataFrame, ids: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, id) of the documents that fit each of many queries (query_id, query), by an index of all words (term, id, places):
    see inverted(). ids (id) are all documents; only queries with nothing but unwanted words have to look at all of them.

    Documents hold a condition if they hold its words, and these in a row; they fit an alternative if they hold all of its wanted
    conditions and none of the others. Words meet the index by equality, and no text is read."""
    conditions = parsed_queries(queries, stem)
    asked = conditions.select("query_id", "alternative", "condition", "wanted", F.size("words").alias("n"), F.posexplode("words").alias("k", "term"))
    there = asked.join(index, "term").withColumn("starts", F.transform("places", lambda p: p - F.col("k")))
    key = ["query_id", "alternative", "condition", "wanted", "n", "id"]
    rows = there.groupBy(*key).agg(F.collect_list("starts").alias("all"))
    in_a_row = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), F.col("all")[0], F.array_intersect)
    held = rows.where((F.size("all") == F.col("n")) & (F.size(in_a_row) > 0)).select("query_id", "alternative", "wanted", "condition", "id")
    needed = conditions.groupBy("query_id", "alternative").agg(F.count_if("wanted").alias("needed"))
    fits = held.groupBy("query_id", "alternative", "id").agg(F.count_if("wanted").alias("have"), F.count_if(~F.col("wanted")).alias("bad"))
    full = fits.join(needed, ["query_id", "alternative"]).where("needed > 0 and have = needed and bad = 0").select("query_id", "id")
    only_unwanted = needed.where("needed = 0").select("query_id", "alternative").join(ids.select("id"))
    rest = only_unwanted.join(fits.where("bad > 0"), ["query_id", "alternative", "id"], "left_anti").select("query_id", "id")
    return full.union(rest).distinct()


def _finder(terms):
    @F.pandas_udf(ArrayType(StringType()))
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for t in terms.value:
            machine.add_word(t, t)
        machine.make_automaton()
        for s in texts:
            yield s.map(lambda x: sorted({t for _, t in machine.iter(x)}) if x is not None else None)

    return found


def with_terms(docs: DataFrame, text: str, terms: DataFrame, name: str, block: int = 20_000) -> DataFrame:
    """docs with an array of those of terms (term) that stand somewhere in a text, each once; empty and null terms stand in none.

    The terms are a set of queries: they go to the workers in blocks, and for each block an automaton reads every text once,
    however many terms there are. The text moves through no shuffle."""
    spark, parts, held = docs.sparkSession, [], []
    for r in terms.where("term <> ''").distinct().toLocalIterator():
        held.append(r["term"])
        if len(held) == block:
            parts, held = [*parts, held], []
    found = [_finder(spark.sparkContext.broadcast(sorted(p)))(F.col(text)) for p in [*parts, *([held] if held else [])]]
    return docs.withColumn(name, F.concat(*found) if found else F.array().cast("array<string>"))


def with_phrases(docs: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """docs joined with those of phrases whose text, in any case of letters, stands in theirs. The empty phrase stands in all
    texts; null ones and null texts fit nothing."""
    low, own, found, hit = (unused(x, docs, phrases) for x in ("low", "own", "found", "hit"))
    p = phrases.where(F.col(phrase).isNotNull()).withColumn(low, F.lower(phrase))
    of = with_terms(docs.where(F.col(text).isNotNull()).withColumn(own, F.lower(text)), own, p.select(F.col(low).alias("term")), found).drop(own)
    of = of.withColumn(hit, F.explode(F.concat(F.col(found), F.array(F.lit(""))))).drop(found)
    return of.join(p.drop(phrase), F.col(hit) == F.col(low)).drop(hit, low)


def with_source(docs: DataFrame, sources: DataFrame, how: str = "left") -> DataFrame:
    """docs with their source as a struct."""
    id_ = unused("of_source", docs)
    s = sources.select(F.col("id").alias(id_), F.struct("id", "name", "ward_number", "source_type").alias("source"))
    return docs.join(s, F.col("source_id") == F.col(id_), how).drop(id_)


def search(docs: DataFrame, sources: DataFrame, query: str | None = None, ward: str | None = None, topic: str | None = None, source_type: str | None = None, stem: bool = False) -> DataFrame:
    """Documents that fit all that is asked for. Only a question about the source needs one; empty texts ask for nothing."""
    found = with_source(docs, sources, "inner" if ward or source_type else "left")
    if query:
        found = found.where(fits_query(F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("plain_text", F.lit(""))), query, stem))
    if ward:
        found = found.where(F.col("source.ward_number") == ward)
    if source_type:
        found = found.where(F.col("source.source_type") == source_type)
    if topic:
        found = found.where(F.array_contains("topics", topic))
    return found


def page(found: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Newest first; equal dates by id, documents without a date at the end."""
    return found.orderBy(F.desc_nulls_last("received_date"), "id").offset((max(number, 1) - 1) * size).limit(size)


def counted(found: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return found.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("pages"))


def page_numbers(current: int, total: int) -> list[int | str]:
    """Which page numbers to show: all up to 7, else the first, the last, the current with its neighbours, dots between."""
    if total <= 7:
        return list(range(1, total + 1))
    shown = sorted({1, total, *range(max(2, current - 1), min(total - 1, current + 1) + 1)})
    out: list[int | str] = []
    for n in shown:
        if out and n - int(out[-1] if out[-1] != "..." else out[-2]) > 1:
            out.append("...")
        out.append(n)
    return out


def topics_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("topics").alias("topic")).distinct().orderBy("topic")


def wards_of(sources: DataFrame, source_type: str | None = None) -> DataFrame:
    """Distinct wards, by number; wards that are no number come last."""
    s = sources.where("ward_number is not null")
    s = s if source_type is None else s.where(F.col("source_type") == source_type)
    n = F.expr("try_cast(ward_number as int)")
    return s.select("ward_number").distinct().orderBy(n.asc_nulls_last(), "ward_number")


def bucket(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 5, "medium").when(score.isNotNull(), "low")


def latest(docs: DataFrame, newest: int | None = None, skip: int | None = None, everything: bool = False) -> DataFrame:
    """The newest documents, after some are left out; to leave out some alone means all others."""
    ordered = docs.orderBy(F.desc_nulls_last("received_date"), "id")
    ordered = ordered.offset(skip) if skip else ordered
    return ordered if everything or newest is None else ordered.limit(newest)


def lacking_metadata(docs: DataFrame) -> DataFrame:
    return docs.where("topics is null or summary is null or relevance_score is null")


def newest_per_source(docs: DataFrame) -> DataFrame:
    """The latest document of each source by aggregation, so that a source with very many is no burden for one task."""
    order = F.struct(F.coalesce(F.col("received_date").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")), "id")
    return docs.groupBy("source_id").agg(F.max_by("id", order).alias("id"), F.max_by("received_date", order).alias("received_date"), F.max_by("subject", order).alias("subject"))
