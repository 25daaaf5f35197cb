"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gazette.llm import bpe, embeddings, exact, licenses, lm, packing, quality, simhash, suffix, urls
from gazette.llm.common import buffers, components, reached, words
from gazette.llm.queries import ORACLE_SQL, QUERIES

#: Columns of documents, and some whose names operators might use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, fp string, id string, sha string, component string, label string, start int"


def docs_of(spark, rows):
    """rows: (doc_id, text)"""
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x", 0) for i, t in rows], DOCS)


def prose(rng, n, of=800):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, odd white space, nulls and a long text."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(5, 300))) for i in range(60)]
    passage = prose(rng, 150)
    rows += [(100 + i, f"{prose(rng, 40)} {passage} {prose(rng, 30)}") for i in range(12)]
    base = prose(rng, 400).split()
    for i in range(15):
        near = list(base)
        near[rng.randrange(400)] = "changed"
        rows.append((200 + i, " ".join(near)))
    rows += [(300 + i, rows[3][1]) for i in range(20)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "ONE"), (405, "one  two\tthree"), (406, "one two three"), (407, "ab" * 3000), (408, "ab" * 3000 + "x"), (409, prose(rng, 60_000)), (410, "é\u3000ü\u2028中文 e\u0301 x\x1cy \x85z"), (None, "no id"), (403, "one"), (411, passage), (412, "a" * 399), (413, "a" * 400), (414, "a" * 401)]
    return rows


def rows_of(df):
    return [r.asDict() for r in df.collect()]


EMPTY = [lambda d: bpe.round_trip(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), licenses.scan, exact.exact_dedup, simhash.near_dedup, suffix.dedup_report, suffix.without_repeats, lm.score, lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json"))]


@pytest.mark.parametrize("k", range(len(EMPTY)))
def test_empty_table(spark, k):
    assert EMPTY[k](docs_of(spark, [])).count() == 0


def test_words():
    import pyarrow as pa

    texts = ["Ab c\tab", None, "", " x", "ab", "ab\u00a0c"]
    data, offsets = buffers(pa.array(texts))
    start, end, doc, h = words(data, offsets)
    found = [bytes(data[a:b]).lower().decode() for a, b in zip(start, end, strict=True)]
    assert found == ["ab", "c", "ab", "x", "ab", "ab\u00a0c"] and doc.tolist() == [0, 0, 0, 3, 4, 5]
    assert len(set(zip(found, h.tolist(), strict=True))) == len(set(found)) == len(set(h.tolist()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, None), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    names = sorted({x for e in real for x in e})
    at = {x: k for k, x in enumerate(names)}
    root = reached(np.array([at[a] for a, _ in real]), np.array([at[b] for _, b in real]), len(names))
    assert got == {x: names[root[at[x]]] for x in names}


# --- 1 -----------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x[50:90] = x[0] + rng.normal(size=(40, 16)) * 0.12
    x[100:110] = x[99]
    x[120] = x[119] * 3
    rows = [(i, [float(np.float32(v)) for v in r], 0, "x") for i, r in enumerate(x)]
    rows += [(900, None, 0, "x"), (901, [0.0] * 16, 0, "x"), (902, [float("nan")] * 16, 0, "x"), (903, [None] + [1.0] * 15, 0, "x"), (904, [float("inf")] * 16, 0, "x"), (905, [1.0, 0.0], 0, "x"), (906, [], 0, "x"), (None, rows[0][1], 0, "x")]
    got = {r["vec_id"]: r for r in rows_of(embeddings.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")))}
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(400, dtype=bool)
    root = reached(*np.nonzero(near), 400)
    assert [got[i]["n_links"] for i in range(400)] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(400)] == root.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 907))
    assert got[None]["n_links"] == 0


def planted_vectors(spark, n, dim, noise, seed):
    """Vectors, every second one near the one before it, and how many links there are."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[1::2] = x[::2] + rng.normal(size=(n // 2, dim)).astype(np.float32) * np.float32(noise)
    u = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    real = sum(int((u[i : i + 2000] @ u[i:].T >= 0.95).sum()) for i in range(0, n, 2000)) if n <= 5000 else int(((u[::2] * u[1::2]).sum(1) >= 0.95).sum())
    real = real if n > 5000 else int(np.triu(u @ u.T >= 0.95, 1).sum())
    return embeddings.classes_of(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")), real


def counted_links(c, **how):
    return embeddings.links(c, **how).agg(F.sum("n")).first()[0] // 2


@pytest.mark.parametrize("how", [{"leaf": 150}, {"leaf": 100, "sample": 300}, {"leaf": 150, "chunk": 40}])
def test_forest_recall(spark, how):
    """With leaves far smaller than the table, with a sample too small for all splits, and with pairs of chunks: at least 0.9
    of all links are found, and none twice."""
    c, real = planted_vectors(spark, 3000, 32, 0.2, 4)
    assert 0.9 * real <= counted_links(c, **how) <= real and real > 500


def test_forest_recall_as_it_runs(spark):
    """With the parameters of the query, over 50,000 vectors: most links are barely above the threshold."""
    c, real = planted_vectors(spark, 50_000, 32, 0.32, 5)
    assert 0.9 * real <= counted_links(c) <= real and real > 5000


def test_dense_group(spark):
    """A group that no split can part: one leaf, compared in pairs of chunks, each pair counted once."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=32) + rng.normal(size=(900, 32)) * 0.2
    c = embeddings.classes_of(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    real = (u @ u.T >= 0.95) & ~np.eye(900, dtype=bool)
    assert not embeddings.overlap(900, 50) > 0.1
    for chunk in (3000, 100):
        found = embeddings.links(c, leaf=50, chunk=chunk)
        got = {r["a"]: r["n"] for r in found.groupBy("a").agg(F.sum("n").alias("n")).collect()}
        assert sum(got.values()) > 0.97 * real.sum() and all(got.get(i, 0) <= real[i].sum() for i in range(900))


# --- 2 -----------------------------------------------------------------------------------------------------------


def test_machine_in_linear_time():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 4)))
    i, x = rng.choice(quality.FEATURES, 6, replace=False), rng.normal(size=6)
    slow = 0.3 + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(6) for b in range(a))
    assert np.isclose(m.logits(np.zeros(6, int), i, x, 1)[0], slow)


def test_quality(spark):
    """Held-out accuracy, and scores that leave labels, lang, source and doc_id aside."""
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got["predicted"] == got["quality"]).mean() > 0.9) and len(got) > 40
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    same = docs.withColumns({"doc_id": F.col("doc_id") + 10**6, "lang": F.lit("x"), "source": F.lit("y")})
    a = sorted(r["score"] for r in quality.score(docs, model).collect())
    assert a == sorted(r["score"] for r in quality.score(same, model).collect())


def test_quality_odd(spark, corpus):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, corpus)
    got = rows_of(quality.score(docs, quality.fit(docs, labels)))
    assert len(got) == len(corpus) and all(0 <= r["score"] <= 1 for r in got)
    none = rows_of(quality.score(docs, quality.fit(docs, labels.limit(0))))
    assert {round(r["score"], 6) for r in none} and len(none) == len(corpus)


# --- 3 -----------------------------------------------------------------------------------------------------------


def test_licenses(spark, same_rows):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    texts = [(1, f"Copyright (c) 2020 Some One\nAll rights reserved.\n\n{mit.upper()}"), (2, mit.replace("copyright notice", "copyright, notice").replace(" ", "\n  ")), (3, mit + " more"), (4, None), (5, ""), (6, "Copyright 2020 X"), (7, "released under the MIT licence"), (7, "released under the MIT licence"), (8, licenses._ZLIB.replace("acknowledgment", "acknowledgement"))]
    got = [(r["doc_id"], r["license_id"]) for r in rows_of(licenses.scan(docs_of(spark, texts)))]
    assert sorted(got) == [(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, "MIT"), (7, "MIT"), (8, "Zlib")]


def test_notices(spark):
    """Notices that are a line of a text, in any spelling; lines that say more are none."""
    rows = [(1, "Prose.\nreleased under the MIT LICENCE\nMore."), (2, "x\nLicensed under CC BY-NC 4.0.\n\nReleased under the MIT License.\nReleased under the MIT License."), (3, "Not released under the MIT License."), (4, None), (5, "\n" * 5), (6, "Released under the MIT License. " + "x" * 400)]
    got = {r["doc_id"]: r["notices"] for r in rows_of(licenses.scan(docs_of(spark, rows)))}
    assert got == {1: "MIT", 2: "CC-BY-NC-4.0,MIT", 3: "", 4: "", 5: "", 6: ""}
    assert {r["notices"] for r in rows_of(licenses.scan(docs_of(spark, rows), [("X", "a\nb")]))} == {""}


def test_licence_files(spark, tmp_path):
    (tmp_path / "Own-1.0").write_text("Do as you like.\nBut be kind.\n")
    texts = licenses.known_files(spark, str(tmp_path))
    got = {r["doc_id"]: r["license_id"] for r in rows_of(licenses.scan(docs_of(spark, [(1, "do as YOU like -- but be kind"), (2, "Do as you like.")]), texts))}
    assert got == {1: "Own-1.0", 2: None}


# --- 4 -----------------------------------------------------------------------------------------------------------


def test_bpe(spark, corpus):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    enc = bpe.encoding(path, pattern)
    got = rows_of(bpe.round_trip(docs_of(spark, corpus), path, pattern, size=50))
    ids = [enc.encode_ordinary(t or "") for _, t in corpus]
    want = [(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), x in zip(corpus, ids, strict=True)]
    assert Counter(tuple(r.values()) for r in got) == Counter(want)
    coded = bpe.encode_documents(docs_of(spark, corpus), path, pattern, size=50)
    back = Counter((r["doc_id"], bytes(r["bytes"])) for r in rows_of(bpe.decode_documents(coded, path, pattern)))
    assert back == Counter((i, (t or "").encode()) for i, t in corpus)
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(list("ab1 \n\t'.,") + ["\x1c", "\u3000", "é", "'s", "   ", "\u200b"]) for _ in range(40))
        assert bpe.encode(t, enc, 5) == enc.encode_ordinary(t)


# --- 5 -----------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(spark, corpus):
    got = rows_of(simhash.near_dedup(docs_of(spark, corpus)))
    own = [(i, t, slow_fingerprint(t)) for i, t in corpus]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{f:016x}") for i, _, f in own)
    fps = sorted({f for i, _, f in own if i is not None})
    edges = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    root = reached(np.array([a for a, _ in edges]), np.array([b for _, b in edges]), len(fps))
    least = {}
    for i, _, f in own:
        if i is not None:
            least[root[fps.index(f)]] = min(i, least.get(root[fps.index(f)], i))
    assert all(r["component_id"] == least[root[fps.index(int(r["fingerprint"], 16))]] for r in got if r["doc_id"] is not None)


@pytest.mark.parametrize("bucket", [4096, 7])
def test_links_of_fingerprints(spark, bucket):
    """All links count, also where buckets are dealt out as pairs of chunks."""
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b for b in base}
    for b in base:
        for _ in range(15):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r["id"]: r["component"] for r in simhash.link(spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, id long"), bucket=bucket).collect()}
    edges = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    root = reached(np.array([a for a, _ in edges]), np.array([b for _, b in edges]), len(fps))
    linked = {x for e in edges for x in e}
    assert got == {i: int(root[i]) for i in linked}


# --- 6 -----------------------------------------------------------------------------------------------------------


def slow_removal(texts, width):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for trial in range(25):
        t = rng.integers(97, 99 + trial % 3, int(rng.integers(1, 300))).astype(np.uint8)
        t = np.tile(t[:7], 50)[: len(t)] if trial % 4 == 0 else t
        sa, raw = suffix.suffix_array(t), t.tobytes()
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        lcp = suffix.common_prefixes(t, sa, 50, 8)
        for k in range(1, len(raw)):
            a, b = raw[sa[k] :], raw[sa[k - 1] :]
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[k] == min(n, 50)


@pytest.mark.parametrize("width", [3, 5, 8, 12, 20, 50])
def test_near_suffixes(width):
    """Suffixes that are sorted as far as the width have the neighbours of a whole suffix array; texts may end in zero bytes."""
    rng = np.random.default_rng(width)
    for trial in range(40):
        t = rng.integers(0 if trial % 5 == 1 else 97, 99 + trial % 3, int(rng.integers(1, 300))).astype(np.uint8)
        t = np.tile(t[:7], 50)[: len(t)] if trial % 4 == 0 else t
        t = np.concatenate([t, t[:80], np.zeros(trial % 3, np.uint8)])
        sa, common = suffix.sorted_to(t, width)
        near = suffix.near_before(t, sa, common, width)
        assert sorted(sa.tolist()) == list(range(len(t)))
        cut = [t[i : i + width].tobytes() for i in sa]
        full = [len(c) == width for c in cut]
        assert [c for c, f in zip(cut, full, strict=True) if f] == sorted(c for c, f in zip(cut, full, strict=True) if f)
        for k in range(1, len(sa)):
            if full[k] or full[k - 1]:
                assert near[k] == (cut[k] == cut[k - 1])


def test_shards_merge():
    """Stretches in many small shards give the same windows as in one."""
    rng = random.Random(3)
    parts = []
    for _ in range(30):
        b = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12, 60)))
        parts.append((len(b) - 11, b))
    whole = suffix.repeated_windows(parts, 12)
    assert any(whole) and whole == suffix.repeated_windows(parts, 12, 100)


@pytest.mark.parametrize("group", [8 << 20, 1500])
def test_suffix_dedup(spark, corpus, group):
    texts = [(i, t) for i, t in corpus if t is None or len(t) < 20_000]
    got = rows_of(suffix.dedup_report(docs_of(spark, texts), group=group))
    want = slow_removal([t for _, t in texts], 400)
    assert Counter(tuple(r.values()) for r in got) == Counter((i, *w) for (i, _), w in zip(texts, want, strict=True))
    assert sum(w[1] for w in want) > 10_000


def test_suffix_dedup_short_windows(spark):
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))) for i in range(40)]
    got = rows_of(suffix.dedup_report(docs_of(spark, texts), width=12, kgram=4))
    assert Counter(tuple(r.values()) for r in got) == Counter((i, *w) for (i, _), w in zip(texts, slow_removal([t for _, t in texts], 12), strict=True))


def test_long_text_in_parts(monkeypatch):
    import pyarrow as pa

    text = prose(random.Random(9), 3000)
    whole = list(suffix._stretches(400, 32)([pa.RecordBatch.from_arrays([pa.array([b"k"]), pa.array([text])], names=["sha", "text"])]))
    monkeypatch.setattr(suffix, "TOGETHER", 1000)
    parts = list(suffix._stretches(400, 32)([pa.RecordBatch.from_arrays([pa.array([b"k"]), pa.array([text])], names=["sha", "text"])]))
    covered = lambda bs: sorted(s + k for b in bs for starts, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) for s in starts for k in range(n))
    assert covered(whole) == covered(parts) == list(range(len(text) - 399))


def test_without_repeats(spark, corpus):
    got = {r["doc_id"]: r for r in rows_of(suffix.without_repeats(docs_of(spark, [(1, "x" * 5 + "y" * 600), (2, None), (3, "é" * 300 + "q"), (4, "é" * 300 + "r"), (5, "short")])))}
    assert got[2]["text"] is None and got[5]["text"] == "short" and got[1]["text"] == "xxxxx" and got[3]["text"] == "q" and got[4]["text"] == "r" and set(got[1]) == {c.split()[0] for c in DOCS.split(", ")}


def slow_passages(texts, n):
    """Of each text: the number of places at which n words in a row begin that another row holds, too."""
    own = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    windows = [[tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for w in own]
    rows = Counter(x for ws in windows for x in set(ws))
    return [sum(rows[x] > 1 for x in ws) for ws in windows]


def test_passages_of_over_50_words(spark, corpus, monkeypatch):
    """Passages of 51 words are told though they are shorter than 400 bytes; nothing of them is removed."""
    rng = random.Random(21)
    passages = [" ".join(f"{rng.choice('abcd')}{rng.randrange(999)}" for _ in range(n)) for n in (50, 51, 70)]
    texts = [t for _, t in corpus if t is None or len(t) < 20_000]
    for p in passages:
        texts += [f"{prose(rng, 30)} {p} {prose(rng, 30)}", f"{prose(rng, 10)}\n{p.replace(' ', '  ')}\t{prose(rng, 5)}", p]
    texts += [f"{passages[0]} only here {prose(rng, 80, 5000)} "] + [" ".join([prose(rng, 60, 9000)] * 2)]
    long = prose(rng, 9000, 10**9)
    texts += [long, f"{prose(rng, 20)} {long[30_000:50_000]} {'z' * 9000} {passages[2]}", "z" * 9000]
    rows = list(enumerate(texts))
    want = slow_passages(texts, 51)
    assert 0 < sum(w > 0 for w in want) < len(want) and want[texts.index(passages[0])] == 0 and want[texts.index(passages[1])] == 1 and want[texts.index(passages[2])] == 20
    got = rows_of(suffix.dedup_report(docs_of(spark, rows), passage=51))
    assert Counter((r["doc_id"], r["n_shared"]) for r in got) == Counter(enumerate(want))
    assert [r["n_removed"] for r in sorted(got, key=lambda r: r["doc_id"]) if r["doc_id"] == texts.index(passages[1])] == [0]


def test_words_of_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = pa.array([prose(random.Random(9), 3000), None, "", "a  b\n", " " * 5000, "y" * 5000 + " x", prose(random.Random(8), 40)])
    whole = suffix.word_hashes(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["t", "text"])
    covered = lambda: sorted((t, s + k, a) for b in suffix._word_stretches(51, 16)([batch]) for t, s, n, a in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True) for k in range(n))
    once = covered()
    assert [(t, k) for t, k, _ in once] == [(0, k) for k in range(2950)]
    monkeypatch.setattr(suffix, "TOGETHER", 300)
    pieces = suffix.word_hashes(texts)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True)) and whole[1].tolist() == [0, 3000, 3000, 3000, 3002, 3002, 3004, 3044]
    assert covered() == once


def test_op6_tells_passages(spark):
    """As registered: documents that hold an item of over 50 words of `benchmark` and share it with others are told."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = slow_passages([r["text"] for r in docs], 51)
    got = {r["doc_id"]: r for r in rows_of(QUERIES["op6_suffix_dedup"](spark, f"{DATA}/sf0.01"))}
    assert {i: r["n_shared"] for i, r in got.items()} == {d["doc_id"]: w for d, w in zip(docs, want, strict=True)}
    assert any(r["n_shared"] and not r["n_removed"] for r in got.values())


# --- 7 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tokens", [lm.TOKENS, 500])
def test_lm(spark, corpus, monkeypatch, tokens):
    monkeypatch.setattr(lm, "TOKENS", tokens)
    got = rows_of(lm.score(docs_of(spark, corpus)))
    cut = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter(w for i, t in corpus if not held(i) for w in cut(t))
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(cut(t)), sum(count[w] > 0 for w in cut(t)), n, round(sum(np.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in cut(t)), 5)) for i, t in corpus)
    assert Counter((*list(r.values())[:5], round(r["base_score"], 5)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)


def test_lm_beats_words_alone(spark):
    rng = random.Random(4)
    phrases = [prose(rng, 6) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(30))) for i in range(200)]
    got = [r for r in rows_of(lm.score(docs_of(spark, rows))) if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_filter_levels():
    """No entry is missed; an entry that isn't there is seldom seen."""
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 1 << 60, 2000).astype(np.uint64))
    n = rng.integers(1, 5000, 2000)
    f = lm.segment_of({1: (h, n)})
    got = f.levels(h, 1)
    assert (got >= lm.word_level(n)).all() and (got == lm.word_level(n)).mean() > 0.9
    assert (f.levels(rng.integers(1 << 61, 1 << 62, 2000).astype(np.uint64), 1) > 0).mean() < 0.05


def test_filter_grows():
    """A segment has bits for all of its entries, beyond 2^28 in all as well."""
    rng = np.random.default_rng(3)
    for size in (1000, 23_000_000):
        h = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        f = lm.segment_of({1: (h, np.ones(len(h), np.int64))})
        assert f.segment >= lm.BITS_EACH * len(h) and (f.levels(h[:1000], 1) >= 1).all()
        assert (f.levels(rng.integers(1 << 63, (1 << 64) - 1, 20_000, np.uint64), 1) > 0).mean() < 0.03
    assert f.segment > 1 << 28


def test_pairs_seen_once(spark):
    """Scores are near brute force with every pair, those seen once too, but for the few falsely true answers."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 150)) for i in range(60)]
    got = {r["doc_id"]: r for r in rows_of(lm.score(docs_of(spark, rows)))}
    cut = {i: [None, *t.split(), None] for i, t in rows}
    train = [w for i in cut if not got[i]["held_out"] for w in zip(cut[i], cut[i][1:], strict=False)]
    pairs, count = Counter(train), Counter(w for _, w in train)
    near = lambda n: 2.0 ** ((lm.word_level(np.array(n)) - 1) / 2 + 0.25) if n else 0.0
    of_pair = lambda n: n if n < 2 else 1.4 * 2 ** int(np.log2(n))
    want = {i: sum(np.log10(0.3 * min(1, of_pair(pairs[a, b]) / max(near(count[a]), 1)) + 0.7 * (near(count[b]) + 1) / (len(train) + len(count) + 1)) for a, b in zip(c, c[1:], strict=False)) for i, c in cut.items()}
    assert sum(pairs[p] == 1 for p in pairs) > 0.9 * len(pairs)
    assert all(abs(got[i]["score"] - want[i]) < 0.05 * -want[i] for i in want)


# --- 8 -----------------------------------------------------------------------------------------------------------


def test_packing(spark, corpus, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    special = ["hello <|startoftext|> x", "<|endoftext|>", "a<|ENDOFTEXT|>b", "<|endoftext", "é <|startoftext|><|endoftext|>\x1cü"]
    texts = [(n, x) for n, (_, x) in enumerate(corpus + [(None, x) for x in special])]
    ids = {n: t.encode(x or "", add_special_tokens=False).ids + [1] for n, x in texts}
    for most in (packing.MERGED, 10):
        monkeypatch.setattr(packing, "MERGED", most)
        got = rows_of(packing.pack(docs_of(spark, texts).repartition(3), path))
        by_doc, by_seq = {}, {}
        for r in got:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_seq.setdefault(r["sequence_id"], []).append(r)
        assert set(by_doc) == set(ids)
        for n, pieces in by_doc.items():
            at = 0
            for r in sorted(pieces, key=lambda r: r["start"]):
                own = np.array(ids[n][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
                assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[n]) and r["ids_crc32"] == zlib.crc32(own)
                at += r["length"]
            assert at == len(ids[n])
        used = []
        for pieces in by_seq.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            used.append(at)
        assert max(used) <= 2048 and sum(u < 2048 for u in used) <= 1 + 3 * (most == 10)


def test_leftovers_of_many_levels(spark, monkeypatch):
    """Leftovers shrink from level to level, and what one task merges stays under the limit."""
    rng = random.Random(6)
    texts = [(n, prose(rng, rng.randrange(1, 40))) for n in range(4000)]
    monkeypatch.setattr(packing, "MERGED", 150)
    docs = docs_of(spark, texts).repartition(40)
    got = rows_of(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 64, 3))
    totals = {r["doc_id"]: r["doc_tokens"] for r in got}
    used, length = Counter(), Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
        length[r["doc_id"]] += r["length"]
    assert length == totals and len(totals) == 4000 and max(used.values()) <= 64
    assert sum(u < 64 for u in used.values()) <= 1 and {k >> 56 for k in used} > {0, 1}


def test_word_ids_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    f = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(f("hello <|startoftext|> x"), "<u4").tolist() == [3306, 49406, 343]
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x180)] + [chr(c) for c in (0x130, 0x301, 0x3A3, 0x2028, 0x3000, 0x1C, 0x4E2D, 0x1F600, 0x200B, 0xFEFF, 0x212B)] + list("'s're'll  ") + ["<|endoftext|>", "<|StartOfText|>"]
    for _ in range(2000):
        x = "".join(rng.choices(letters, k=rng.randrange(25)))
        assert np.frombuffer(f(x), "<u4").tolist() == whole.encode(x, add_special_tokens=False).ids


def test_other_vocabularies(tmp_path):
    """A file that normalises in another way is used on whole texts."""
    import json

    path = public_tokenizers.path("word_bpe_49k.json")
    told = json.load(open(path, encoding="utf-8"))
    assert packing.by_words(told)
    told["normalizer"] = {"type": "NFC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(told), encoding="utf-8")
    f = packing.word_ids(str(other))
    assert not f.apart
    for x in ("Some Words, with  Spaces", "É é", ""):
        assert np.frombuffer(f(x), "<u4").tolist() == f.tokenizer.encode(x, add_special_tokens=False).ids


# --- 9 -----------------------------------------------------------------------------------------------------------


def test_exact(spark, corpus):
    got = rows_of(exact.exact_dedup(docs_of(spark, corpus)))
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in corpus]
    groups = {}
    for (i, _), t in zip(corpus, norm, strict=True):
        groups.setdefault(t, []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(corpus, norm, strict=True))
    assert Counter(tuple(r.values()) for r in got) == want


def test_cuckoo():
    """The index against a dictionary, through resizes, deletions and equal marks."""
    rng = random.Random(7)
    index, real = exact.Index(2), {}
    for _ in range(6000):
        key = rng.randrange(1500)
        digest, sha = (key * 0x9E3779B97F4A7C15) % (1 << 64) if key % 3 else key // 30, str(key).encode()
        if rng.random() < 0.65:
            doc = rng.randrange(10**6)
            index.insert(digest, sha, doc)
            old = real.get((digest, sha))
            real[digest, sha] = [min(doc, old[0]) if old else doc, (old[1] if old else 0) + 1]
        else:
            index.delete(digest, sha)
            if (digest, sha) in real:
                real[digest, sha][1] -= 1
                if not real[digest, sha][1]:
                    del real[digest, sha]
    assert index.resized and {(d % (1 << 64), s): [k, n] for d, s, k, n in index.rows()} == real


@pytest.mark.parametrize("held", [exact.HELD, 1])
def test_index_over_time(spark, monkeypatch, held):
    monkeypatch.setattr(exact, "HELD", held)
    keys = lambda rows: exact.digests(docs_of(spark, rows))
    rows_of_index = lambda index: sorted(((r["keep_id"], r["group_size"]) for r in index.collect()), key=str)
    index = exact.build_index(keys([(1, "a"), (2, "a"), (3, "b"), (5, "a")]))
    index = exact.update_index(index, inserted=keys([(0, "b"), (4, "c")]), deleted=keys([(2, "a"), (9, "never")]))
    assert rows_of_index(index) == [(0, 2), (1, 2), (4, 1)]
    less = keys([(1, "a")])
    assert rows_of_index(exact.update_index(index, deleted=less)) == [(0, 2), (4, 1), (None, 1)]
    index = exact.update_index(index, deleted=less, live=keys([(0, "b"), (3, "b"), (4, "c"), (5, "a")]))
    assert rows_of_index(index) == [(0, 2), (4, 1), (5, 1)]
    assert rows_of_index(exact.update_index(index, deleted=keys([(5, "a")]))) == [(0, 2), (4, 1)]


# --- 10 ----------------------------------------------------------------------------------------------------------


def test_urls(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)
    rows = [
        (1, "HTTP://WWW.Example.com/en/a?x#y", link("good.org")), (2, "http://example.com/en/", None), (3, "http://a.example.com/en", ""), (4, "http://x.net/es/1", link("bad.org", "bad.org")),
        (5, None, "<a>"), (6, "no scheme", None), (7, "http://bad.org/", link("x.net")), (8, "http://good.org", None), (9, "http://other.org?a=/b", None), (10, "x://?q", None), (11, "http://x.net/en/2", None), (12, "http://com/", None), (13, "http://x.net/es/1", link("bad.org")), (13, "http://x.net/es/1", None),
    ]
    got = rows_of(urls.filter_urls(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")))
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert [by[k]["rule"] for k in (2, 3, 4, 8, 9, 12)] == ["example.com/en/", "com/", "net/es/", None, None, "com/"]
    assert [(by[k]["host"], by[k]["path"], by[k]["verdict"]) for k in (5, 6, 10)] == [("", "", "allow")] * 3
    assert by[7]["verdict"] == "block" and by[8]["verdict"] == "allow" and by[9]["verdict"] == "allow"
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_links_in_sql(spark, same_rows, tmp_path):
    """The propagation against SQL, on pages that link to each other."""
    rng = random.Random(1)
    hosts = [f"h{i}.{d}" for i in range(12) for d in ("org", "net", "com")]
    rows = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}", "".join(f"<a HREF='http://{rng.choice(hosts).upper()}/z'>" for _ in range(rng.randrange(5)))) for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    df = urls.filter_urls(spark.read.parquet(str(tmp_path / "pages.parquet")))
    same_rows(df, urls.SQL, str(tmp_path))
    assert df.where("rule is null").select("verdict").distinct().count() == 2


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, same_rows, name):
    same_rows(QUERIES[name](spark, f"{DATA}/sf0.001"), ORACLE_SQL[name], f"{DATA}/sf0.001")
