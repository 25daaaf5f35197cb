"""The pipeline stage by stage, each against brute force on its own input."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
from conftest import DATA
from pyspark.sql import functions as F
from test_llm_operators import docs_of, prose, slow_fingerprint

import corpus_pipeline as c
from gazette.llm import quality
from gazette.llm.common import reached
from gazette.llm.packing import word_ids


def test_stages(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    tables = [docs]
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, tables[-1], d)
        assert out.columns == columns
        tables.append(spark.createDataFrame(out.collect(), docs.schema))
        seen.append({r["doc_id"]: r["text"] for r in tables[-1].collect()})
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))).collect()}
    assert set(seen[1]) == {i for i in seen[0] if score[i] >= 0.3}
    first = {}
    for i in sorted(seen[1]):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", seen[1][i]), i)
    assert set(seen[2]) == set(first.values())
    ids = sorted(seen[2])
    fps = np.array([slow_fingerprint(seen[2][i]) for i in ids], np.uint64)
    root = reached(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4), len(ids))
    assert set(seen[3]) == {ids[r] for r in root}
    ids = sorted(seen[3])
    kept = dict(zip(ids, slow_kept([seen[3][i] for i in ids], c.PASSAGE), strict=True))
    assert seen[4] == {i: t for i, t in kept.items() if t.strip(" ")} and any(kept[i] != seen[3][i] for i in ids)
    packed = c.STAGES[-1][1](spark, tables[-1], d).collect()
    ids_of = word_ids(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in packed) == sum(len(ids_of(t)) // 4 + 1 for t in seen[4].values())


def slow_kept(texts, width):
    """Texts without the bytes of repeated windows; bytes of characters cut in two go, too."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_run(spark):
    """run() gives the pieces of what the stages, one after another, keep."""
    d = f"{DATA}/sf0.001"
    out = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in c.STAGES:
        out = stage(spark, out, d)
    pieces = lambda df: sorted((r["doc_id"], r["doc_tokens"]) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert pieces(c.run(spark, d)) == pieces(out) and out.count() > 100


def test_passages(spark):
    """Passages of over 50 words that two documents share go from both; texts of their own stay whole."""
    rng = random.Random(3)
    passage = prose(rng, 60)
    own = [prose(rng, 80) for _ in range(6)]
    rows = [(0, f"{own[0]} {passage} {own[1]}"), (1, f"{own[2]} {passage}"), (2, own[3]), (3, f"{own[4]} {' '.join(passage.split()[:12])}"), (4, own[5])]
    got = {r["doc_id"]: r["text"] for r in c.cut_passages(spark, docs_of(spark, rows), None).collect()}
    assert all(passage not in t for t in got.values()) and all(got[i] == t for i, t in rows[2:])


def test_odd_columns(spark):
    """Columns with the names that stages use themselves, null and empty texts, and empty tables."""
    rng = random.Random(6)
    rows = [(1, prose(rng, 90)), (2, None), (3, ""), (3, ""), (None, prose(rng, 90))]
    for docs in (docs_of(spark, rows), docs_of(spark, [])):
        docs = docs.withColumns({k: F.lit("x") for k in ("score", "_score", "row", "_row", "kept", "n", "k", "of")})
        for _, stage in c.STAGES[:-1]:
            out = stage(spark, docs, f"{DATA}/sf0.001")
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert c.STAGES[-1][1](spark, docs, None).count() == (docs.count() > 0) * len(rows)


def test_repeated_rows(spark):
    """Rows that repeat, null ids and an id with two texts: of each text one row stays."""
    rng = random.Random(12)
    a, b, d, e, g = (prose(rng, 150) for _ in range(5))
    rows = [(1, a), (1, a), (2, b), (None, b), (None, d), (None, d), (None, e), (3, g), (3, a)]
    docs = docs_of(spark, rows)
    want = [(None, d), (None, e), (1, a), (2, b), (3, g)]
    for stages in (["exact dedup"], ["simhash near-dedup"], ["exact dedup", "simhash near-dedup", "suffix-array dedup"]):
        out = docs
        for name, stage in c.STAGES:
            out = stage(spark, out, None) if name in stages else out
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_run_repeated(spark, tmp_path):
    """A table that holds every row twice packs like the table itself."""
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs.union(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = lambda at: sorted((r["doc_id"], r["doc_tokens"]) for r in c.run(spark, at).select("doc_id", "doc_tokens").distinct().collect())
    twice, once = pieces(str(tmp_path)), pieces(d)
    assert {i for i, _ in twice} <= {r["doc_id"] for r in docs.collect()} and abs(len(twice) - len(once)) <= 0.1 * len(once)
    kept = c.drop_near_copies(spark, c.drop_copies(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), d), d)
    assert sorted(kept.collect()) == sorted(c.drop_near_copies(spark, c.drop_copies(spark, docs, d), d).collect())


def test_numbers_of_rows_stay(spark, tmp_path):
    """Each row keeps its number, however its files are cut between two actions."""
    docs_of(spark, [(i, f"text {i} " * 20) for i in range(6000)]).repartition(5).write.option("parquet.block.size", 20_000).parquet(f"{tmp_path}/t")
    docs = c._of_files(spark.read.parquet(f"{tmp_path}/t"))
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"
    before, found = {n: spark.conf.get(n, None) for n in names}, []
    try:
        for few in (True, False):
            files = c._files(docs)
            files.few = few
            numbered = c._numbered(docs, "number", files)
            for values in (("128m", "1", "4m"), ("20k", "16", "1k"), ("200k", "4", "1k")):
                for n, v in zip(names, values, strict=True):
                    spark.conf.set(n, v)
                found.append({r["doc_id"]: r["number"] for r in numbered.select("doc_id", "number").collect()})
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert len(set(found[0].values())) == 6000 and all(f == found[0] for f in found)
