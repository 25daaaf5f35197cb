"""Operator 12: personal identifiers by fixed forms, and by contexts learnt from these.

What the fixed forms find are seeds. The words beside them are patterns: one or two words to the left or to the right. Patterns
and instances (identifiers, and what looks like one without having its form) are the two sides of a graph that Spark scores
in rounds: a pattern is as sure as the share of *all* places of its words in the corpus that stand beside a known instance of
its kind, and an instance as sure as the patterns that it was met with, together. What becomes sure enough counts as known in the next
round, so that patterns without a seed of their own can follow. Occurrences of known instances are then added to the spans."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, mixed, small_batches, words, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: A pattern needs so many different known instances and such a share of its places; an instance such a score; rounds of scoring.
SUPPORT, PATTERN, ACCEPTED, ROUNDS = 3, 0.6, 0.8, 3
#: Sequences of words that are counted through one broadcast table of 8 bytes each; of more than that all are, by a shuffle.
FILTERED = 4_000_000
#: Longer ones don't become instances by context.
LONGEST = 254

# The forms of identifiers.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What may be a number written in another way, and what stands for @ and dots.
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().-]{0,2}[0-9])++")
_AT = re.compile(r"\x20?[\[(]\x20?[Aa][Tt]\x20?[\])]\x20?")
_SPELT = re.compile(r"[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?[Dd][Oo][Tt]\x20?[\])])\x20?[A-Za-z0-9-]++)++")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_HINT = re.compile(r"[0-9@]|[\[(]\x20?[Aa][Tt]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_AROUND = "\"'`()[]{}<>,;:!?."


def _local_start(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _emails(text: str):
    at, floor = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = _local_start(text, at, floor) if m else at
        if start < at:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(floor, at + 1))


def luhn(digits: str) -> bool:
    twice = str.maketrans("0123456789", "0246813579")
    return sum(map(int, digits[-1::-2])) % 10 == -sum(map(int, digits[-2::-2].translate(twice))) % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the identifiers by form, in order; places count code points."""
    out = [(s, EMAIL, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def instance(text: str, kind: int) -> str:
    """A name for an identifier, however it is written: digits of numbers, else lower case with @ and dots."""
    if kind in (CARD, PHONE):
        return _digits(text)
    if kind == EMAIL:
        text = re.sub(r"\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20?\.\x20?", ".", _AT.sub("@", text).lower())
    return text if len(text) <= LONGEST else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, kinds, instance) of what may be an identifier and overlaps none of base: numbers of 7 to 19 digits,
    words around an @, addresses with (at). kinds has the bit 1 << kind for each kind whose instances look like it."""
    found = []
    for m in _NUMBER.finditer(text):
        start, end, d = m.start(), m.end(), _digits(m.group())
        if not 4 <= len(d) <= 19 or text[end : end + 1].isalnum():
            continue
        if m.group()[0] == "(" and ")" not in m.group():
            start += 1
        if _QUAD.fullmatch(text, start, end):
            found.append((start, end, 1 << IP, text[start:end]))
        elif len(d) >= 7:
            found.append((start, end, (1 << PHONE) * (len(d) <= 15) | (1 << CARD) * (len(d) >= 12), d))
    at = text.find("@")
    while at >= 0:
        left, right = at, at + 1
        while left and at - left <= LONGEST and not _SPACE.match(text[left - 1]):
            left -= 1
        while right < len(text) and right - at <= LONGEST and not _SPACE.match(text[right]):
            right += 1
        own = text[left:right]
        if len(own) <= LONGEST:
            left += len(own) - len(own.lstrip(_AROUND))
            own = own.strip(_AROUND)
            if len(own) >= 4:
                found.append((left, left + len(own), 1 << EMAIL, instance(own, EMAIL)))
        at = text.find("@", right)
    for m in _AT.finditer(text):
        rest = _SPELT.match(text, m.end())
        start = _local_start(text, m.start(), max(0, m.start() - LONGEST))
        if rest and start < m.start() and rest.end() - start <= LONGEST:
            found.append((start, rest.end(), 1 << EMAIL, instance(text[start : rest.end()], EMAIL)))
    out, edge, k = [], 0, 0
    base = sorted(base)
    reach = np.maximum.accumulate([e for _, _, e in base]).tolist() if base else []
    for start, end, kinds, name in sorted(found):
        while k < len(base) and base[k][0] < end:
            k += 1
        if start >= edge and (not k or reach[k - 1] <= start):
            out.append((start, end, kinds, name))
            edge = end
    return out


_PLACE = "start: int, end: int, kind: int, kinds: int, instance: string, grams: array<struct<side: int, gram: bigint>>"
_SCANNED = f"row long, doc_id long, found array<struct<{_PLACE}>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("kinds", pa.int32()), ("instance", pa.string()), ("grams", pa.list_(pa.struct([("side", pa.int32()), ("gram", pa.int64())])))]))
LEFT, RIGHT = 0, 1


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _scan(batches):
    """For each text its places of seeds (kind 0 to 3) and of candidates (kind -1), with the words beside them."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for b in batches:
        data, offsets = buffers(b.column(1))
        texts = b.column(1).to_pylist()
        places = []
        for d, text in enumerate(texts):
            if text and _HINT.search(text):
                base = base_spans(text)
                own = [(s, e, k, 1 << k, instance(text[s:e], k)) for s, k, e in base] + [(s, e, -1, kinds, name) for s, e, kinds, name in candidates(text, base)]
                if own:
                    places.append((d, own))
        grams: dict[tuple[int, int], list] = {}
        if places:
            start, end, doc, h = words(data, offsets)
            for d, own in places:
                at = np.array([x[:2] for x in own])
                if not texts[d].isascii():
                    own_bytes = data[offsets[d] : offsets[d + 1]]
                    at = np.append(np.flatnonzero((own_bytes & 0xC0) != 0x80), len(own_bytes))[at]
                at = at + offsets[d]
                before = np.searchsorted(end, at[:, 0], side="right")
                after = np.searchsorted(start, at[:, 1], side="left")
                first, last = np.searchsorted(doc, [d, d + 1])
                for j, (i, k) in enumerate(zip(before.tolist(), after.tolist(), strict=True)):
                    near = [(LEFT, h[i - 1])] if i - 1 >= first else []
                    near += [(LEFT, _two(h[i - 2 : i - 1], h[i - 1 : i])[0])] if i - 2 >= first else []
                    near += [(RIGHT, h[k])] if k < last else []
                    near += [(RIGHT, _two(h[k : k + 1], h[k + 1 : k + 2])[0])] if k + 1 < last else []
                    grams[d, j] = [{"side": s, "gram": int(np.uint64(g).astype(np.int64))} for s, g in near]
        found = dict(places)
        rows = [[{"start": s, "end": e, "kind": k, "kinds": kinds, "instance": name, "grams": grams[d, j]} for j, (s, e, k, kinds, name) in enumerate(found.get(d, ()))] for d in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([pa.array(range(row, row + b.num_rows), pa.int64()), b.column(0), pa.array(rows, _ARROW)], names=["row", "doc_id", "found"])
        row += b.num_rows


def _grams(b: pa.RecordBatch) -> np.ndarray:
    """One and two words in a row, as hashes, of all texts of a batch."""
    _, _, doc, h = words(*buffers(b.column(0)))
    return np.concatenate([h, _two(h[:-1], h[1:])[doc[:-1] == doc[1:]]]).astype(np.int64) if len(h) else np.zeros(0, np.int64)


def _given(gram: np.ndarray, total: np.ndarray):
    for i in range(0, len(gram), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(gram[i : i + 50_000]), pa.array(total[i : i + 50_000])], names=["gram", "total"])


def _all_counted(batches):
    """Counts of all words and pairs of words, batch by batch."""
    for b in batches:
        own = np.sort(_grams(b))
        if len(own):
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            yield from _given(own[first], np.diff(np.append(first, len(own))))


def _counter(wanted):
    """Counts those of wanted, a broadcast sorted array, that a task meets; a row for each at its end."""

    def run(batches):
        known = wanted.value
        total = np.zeros(len(known), np.int64)
        for b in batches:
            if len(known):
                own = _grams(b)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                total += np.bincount(at[known[at] == own], minlength=len(known))
        met = np.flatnonzero(total)
        yield from _given(known[met], total[met])

    return run


def _totals(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, total): how often each of wanted (gram) stands in texts (text)."""
    spark = texts.sparkSession
    if wanted.count() <= FILTERED:
        known = spark.sparkContext.broadcast(np.sort(wanted.toPandas()["gram"].to_numpy(np.int64)))
        return texts.mapInArrow(_counter(known), "gram long, total long").groupBy("gram").agg(F.sum("total").alias("total"))
    every = texts.mapInArrow(_all_counted, "gram long, total long").groupBy("gram").agg(F.sum("total").alias("total"))
    return every.join(wanted, "gram", "left_semi")


def known_instances(places: DataFrame, texts: DataFrame, support: int = SUPPORT, pattern: float = PATTERN, accepted: float = ACCEPTED, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, sure) of all instances that seeds and patterns make sure; places: kind, kinds, instance, grams."""
    seeds = written(places.where("kind >= 0").select("instance", "kind").distinct().withColumn("sure", F.lit(1.0)))
    edges = places.select("instance", "kinds", F.explode("grams").alias("g")).groupBy("g.side", "g.gram", "instance").agg(F.count("*").alias("n"), F.bit_or("kinds").alias("kinds"))
    edges = written(edges)
    often = written(edges.groupBy("side", "gram").agg(F.count("*").alias("m")).where(F.col("m") >= support).select("side", "gram"))
    totals = written(_totals(texts, often.select("gram").distinct()))
    edges = written(edges.join(often, ["side", "gram"], "left_semi").join(totals, "gram"))
    known = seeds
    for _ in range(rounds):
        beside = edges.join(known, "instance").groupBy("side", "gram", "kind").agg(F.sum(F.col("n") * F.col("sure")).alias("good"), F.count_if(F.col("sure") >= accepted).alias("support"), F.max("total").alias("total"))
        patterns = beside.select("side", "gram", "kind", F.round(F.least(F.col("good") / F.col("total"), F.lit(0.999)), 9).alias("sure")).where((F.col("support") >= support) & (F.col("sure") >= pattern))
        fits = F.expr("shiftright(kinds, kind) & 1") == 1
        new = edges.join(patterns, ["side", "gram"]).where(fits).groupBy("instance", "kind").agg(F.round(1 - F.exp(F.sum(F.log1p(-F.col("sure")))), 9).alias("sure"))
        before, known = known, written(seeds.union(new.where(F.col("sure") >= pattern)).groupBy("instance", "kind").agg(F.max("sure").alias("sure")))
        if known.count() == before.count() and known.where(F.col("sure") < 1).join(before, ["instance", "kind", "sure"], "left_anti").limit(1).count() == 0:
            break
    return known.where(F.col("sure") >= accepted)


def _named(spans):
    """kind:start:end, comma-joined, of an array of (start, kind, end), by start and kind."""
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kind(s["kind"]), s["start"], s["end"])), ",")


def find_identifiers(docs: DataFrame, support: int = SUPPORT, pattern: float = PATTERN, accepted: float = ACCEPTED, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (by form), base_sha256 (of these spans), spans (all), n_added for every row of docs.

    Spans are kind:start:end in code points, by start and kind, comma-joined. Null texts count as empty; texts of any length are
    read whole, and identifiers by form may have any length; rows that repeat have a row each; an empty table gives none;
    columns besides doc_id and text are ignored, whatever their names."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = written(own.mapInArrow(_scan, _SCANNED))
    places = scanned.select("row", F.explode("found").alias("p")).select("row", "p.*")
    known = known_instances(places, own.select("text"), support, pattern, accepted, rounds)
    met = places.where("kind < 0").select("row", "start", "end", "kinds", "instance").join(known.withColumnRenamed("kind", "of"), "instance").where("shiftright(kinds, of) & 1 = 1")
    best = met.groupBy("row", "start", "end").agg(F.max_by("of", F.struct("sure", -F.col("of"))).alias("kind"))
    added = best.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    base = F.transform(F.filter("found", lambda p: p["kind"] >= 0), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    out = scanned.select("row", "doc_id", base.alias("base")).join(added, "row", "left")
    some = F.coalesce("added", F.array().cast("array<struct<start: int, kind: int, end: int>>"))
    kinds = F.transform("base", lambda p: p["kind"])
    n = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *n, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.concat("base", some)).alias("spans"), F.size(some).cast("long").alias("n_added"))
