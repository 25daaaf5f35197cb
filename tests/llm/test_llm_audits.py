"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.llm import divergence, negatives, pii
from gazette.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_hard_negatives"])
def test_sql(spark, same_rows, name):
    same_rows(QUERIES[name](spark, f"{DATA}/sf0.001"), ORACLE_SQL[name], f"{DATA}/sf0.001")


# Operator 11

DOCS = "doc_id long, text string, lang string, source string, value long, rank int, term string, item string, n long"


def docs_of(spark, rows):
    """rows: (text, lang, source)"""
    return spark.createDataFrame([(i, t, lang, s, 7, 7, "x", "x", 7) for i, (t, lang, s) in enumerate(rows)], DOCS)


def divergences(rows, least, top):
    n, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        for w in words:
            n[lang, source, w] += 1
        for w in set(words):
            docs[lang, w] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(w for of, w in docs if of == lang and docs[of, w] >= least)
        sources = sorted(s for of, s in groups if of == lang)

        def shares(count, kept=kept):
            total = sum(map(count, kept)) + 5 * len(kept)
            return {w: 1 + 10**9 * (count(w) + 5) // total for w in kept}

        p = {s: shares(lambda w, s=s, lang=lang: n[lang, s, w]) for s in sources}
        q = shares(lambda w, lang=lang, sources=sources: sum(n[lang, s, w] for s in sources))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            terms = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if n[lang, s, w] and p[s][w] > q[w])
            out |= {(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(terms[:top])}
    return out


def test_divergence(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("e", "É", "ß", "z", "")]
    rows = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "de", None]), f"s{min(rng.randrange(12), 7)}") for _ in range(300)]
    rows += [(None, "en", "silent"), ("", "en", None), ("Ae AE ae,ae-Ae_ae", "en", "s0"), ("12 34", "fr", "only"), ("one", None, None), ("x", "it", "a"), ("y", "it", "b"), (None, "it", "c")] + [("ae be", "en", "copies")] * 40
    rows.append((" ".join(rng.choice(vocabulary) for _ in range(30_000)), "en", "long"))
    for sources, terms, cut in ((64, 256, 4 << 20), (2, 3, 1000)):  # in one block, and in many with texts cut
        monkeypatch.setattr(divergence, "SOURCES", sources)
        monkeypatch.setattr(divergence, "TERMS", terms)
        monkeypatch.setattr(divergence, "CUT", cut)
        got = [tuple(r) for r in divergence.audit(docs_of(spark, rows), 20, 7).collect()]
        assert len(got) == len(set(got)) and set(got) == divergences(rows, 20, 7)
    assert divergence.audit(docs_of(spark, []), 20, 7).count() == 0


@given(st.integers(0, 2**52), st.integers(0, 2**52))
def test_share_is_exact(n, more):
    d = n + 5 + more
    assert divergence.share(np.array([n]), np.array([d]))[0] == 1 + 10**9 * (n + 5) // d


# Operator 13


@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.integers(1, 9), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_strassen(m, k, n, leaf, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**26), 2**26, (m, k)), rng.integers(-(2**26), 2**26, (k, n))
    assert (negatives.strassen(a, b, leaf) == a @ b).all()


VECTORS = "vec_id long, embedding array<float>, label int, anchor boolean, q string, positives string, rank int"


def mined(rows, every=5):
    best = {}
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in x])
            if sum((256 * abs(float(np.float32(v))) + 1) ** 2 for v in x) < 2.0**60:
                best[i] = min(best.get(i, row), row)
    score = lambda a, b: sum(p * q for p, q in zip(best[a][1], best[b][1], strict=False))
    out = []
    for a in (i for i in best if i % every == 0):
        positives = sorted((-score(a, i), i) for i in best if i != a and best[i][0] == best[a][0])[:5]
        for s, p in positives:
            fits = sorted((-score(a, i), i) for i in best if best[i][0] != best[a][0] and 80 * -s <= 100 * score(a, i) <= 100 * -s)[:5]
            out += [(a, p, k + 1, i, -s, -v) for k, (v, i) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(9)], rng.choice([0, 0, 1, 2])) for i in range(150)]
    rows += [(200 + i, rows[3][1], 0) for i in range(40)] + [(300 + i, rows[3][1], 1) for i in range(9)]  # ties
    rows += [(400, None, 1), (401, [None, 1.0], 1), (405, [math.nan] * 9, 1), (410, [math.inf] * 9, 1), (415, [1.0] * 9, None), (None, [1.0] * 9, 1), (420, [], 1), (425, [1.0, 2.0], 1), (430, [1.0] * 30, 0), (435, [1e30] * 9, 0), (3, rows[4][1], 0), (440, [-1.0] * 9, 2), (445, [0.0] * 9, 2)]
    table = spark.createDataFrame([(i, x, label, True, "x", "x", 1) for i, x, label in rows], VECTORS)
    for block, tile in ((1 << 20, 512), (200, 8)):  # in one cell, and in many of many tiles
        monkeypatch.setattr(negatives, "BLOCK", block)
        monkeypatch.setattr(negatives, "TILE_ANCHORS", tile)
        monkeypatch.setattr(negatives, "TILE_ROWS", tile)
        monkeypatch.setattr(negatives, "TILE_DEPTH", tile)
        assert sorted(tuple(r) for r in negatives.hard_negatives(table, 5).collect()) == mined(rows)
    assert negatives.hard_negatives(table.limit(0)).count() == 0


# Operator 12

_FORMS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def by_form(text):
    out = []
    for kind, form in enumerate(_FORMS):
        for m in form.finditer(text):
            d = [int(c) for c in m.group() if c.isdigit()]
            luhn = sum(c * (1 + i % 2) - 9 * (c * (1 + i % 2) > 9) for i, c in enumerate(reversed(d))) % 10 == 0
            if (kind == 0, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), kind == 2 and 14 <= len(d) <= 19 and luhn, kind == 3 and 10 <= len(d) <= 15)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@given(st.text(alphabet="12 a.@-+(é09", max_size=80))
@settings(max_examples=3000, deadline=None)
def test_identifiers_by_form(text):
    assert pii.base_spans(text) == by_form(text)


def by_context(texts, support=3, pattern=0.6, accepted=0.8, rounds=3):
    """The method once more, in plain Python with words instead of hashes."""
    totals, edges, places = Counter(), defaultdict(Counter), []
    for t, text in enumerate(texts):
        found = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        low = ["".join(c.lower() if c.isascii() else c for c in text[s:e]) for s, e in found]
        totals.update((w,) for w in low)
        totals.update(zip(low, low[1:], strict=False))
        base = pii.base_spans(text)
        own = [(s, e, k, 1 << k, pii.instance(text[s:e], k)) for s, k, e in base] + [(s, e, -1, kinds, i) for s, e, kinds, i in pii.candidates(text, base)]
        for s, e, k, kinds, i in own:
            before, after = [w for w, p in zip(low, found, strict=True) if p[1] <= s], [w for w, p in zip(low, found, strict=True) if p[0] >= e]
            for gram in [("l", *before[-n:]) for n in (1, 2) if len(before) >= n] + [("r", *after[:n]) for n in (1, 2) if len(after) >= n]:
                edges[gram][i] += 1
            places.append((t, s, e, k, kinds, i))
    may = defaultdict(int)
    for *_, kinds, i in places:
        may[i] |= kinds
    seeds = {(i, k): 1.0 for _, _, _, k, _, i in places if k >= 0}
    known = dict(seeds)
    for _ in range(rounds):
        by_kind = {}
        for gram, own in edges.items():
            for kind in range(4):
                met = {i: n for i, n in own.items() if (i, kind) in known}
                sure = min(round(sum(n * known[i, kind] for i, n in met.items()) / totals[gram[1:]], 9), 0.999)
                if len(own) >= support and sum(known[i, kind] >= accepted for i in met) >= support and sure >= pattern:
                    by_kind[gram, kind] = sure
        new = defaultdict(lambda: 1.0)
        for (gram, kind), sure in by_kind.items():
            for i in edges[gram]:
                if may[i] >> kind & 1:
                    new[i, kind] *= 1 - sure
        known = seeds | {x: max(1 - p, seeds.get(x, 0)) for x, p in new.items() if 1 - p >= pattern}
    out = []
    for t, text in enumerate(texts):
        spans = pii.base_spans(text)
        for at, s, e, k, kinds, i in places:
            best = [(-known[i, x], x) for x in range(4) if kinds >> x & 1 and known.get((i, x), 0) >= accepted]
            if at == t and k < 0 and best:
                spans.append((s, min(best)[1], e))
        out.append(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)))
    return out


def letters():
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{chr(97 + rng.randrange(26))}é" for _ in range(n))
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    texts = [f"{prose(6)} Call hotline: {phone()} thanks {prose(5)}" for _ in range(24)]
    texts += [f"{prose(4)} call HOTLINE: 555-{rng.randrange(100, 999)}-2231 thanks {prose(3)}" for _ in range(3)]  # unseen, by two contexts
    texts += [f"{prose(4)} or dial office: 312-555-{4000 + k} please {prose(3)}. Call hotline: 312-555-{4000 + k} thanks" for k in range(4)]  # teach a second pattern
    texts += [f"{prose(2)} or dial office: 773-555-0199 please"]  # found by the second pattern alone
    texts += [f"{prose(3)} write to {rng.choice('abcd')}{k}.lee@mail.example.org or {prose(3)}" for k in range(6)]
    texts += [f"write to kim{k} [at] example [dot] org or not" for k in range(2)]
    texts += [f"{prose(3)} build 1234567{k} of {prose(4)}" for k in range(9)] + ["the hotline is closed", None, "", "+", "@", "é　ü 10.0.0.1 at 10.0.0.1", "4111 1111 1111 1111 and 4111-1111-1111-1112"]
    return texts + texts[24:27] * 2 + [texts[3]] * 5 + [prose(30_000) + " call hotline: 555-777-8888 thanks"]


IDENTIFIED = "doc_id long, text string, row long, found string, kind int, gram long, instance string, spans string"


def test_identifiers_by_context(spark, monkeypatch):
    texts = letters()
    docs = spark.createDataFrame([(k if k % 9 else None, t, 1, "x", 1, 1, "x", "x") for k, t in enumerate(texts)], IDENTIFIED)
    want = by_context([t or "" for t in texts])
    for filtered in (4_000_000, 3):  # patterns' words broadcast, and all counted by a shuffle
        monkeypatch.setattr(pii, "FILTERED", filtered)
        got = pii.find_identifiers(docs).collect()
        assert Counter((r.doc_id, r.spans) for r in got) == Counter((k if k % 9 else None, s) for k, s in enumerate(want))
    for r in got:
        if r.doc_id is not None:
            base = by_form(texts[r.doc_id] or "")
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
            assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
            assert r.n_added == len([x for x in r.spans.split(",") if x]) - len(base)
    added = {r.doc_id: r.n_added for r in got}
    assert all(added[k] == 1 for k in (24, 25, 26, 31)), "unseen numbers, and one by a pattern without seeds"
    assert not any(added[k] for k, t in enumerate(texts) if k % 9 and t and ("build" in t or "closed" in t))
    assert pii.find_identifiers(docs.limit(0)).count() == 0


def test_op12_reads_all(spark):
    rows = QUERIES["op12_pii"](spark, f"{DATA}/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = by_form(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in base) for x in range(4))
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(r.spans.split(","))
