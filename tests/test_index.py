"""The stored index against scanning, over additions, changes, removals, merging and failures."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gazette.operators import index, search

TEXT = "id string, body string"
ASKED = [("one", "w3"), ("both", "w1 w2"), ("phrase", '"w1 w2 w3"'), ("not", "w4 -w5"), ("or", "w6 or w7"), ("none", "nothing"), ("without", "-w1"), ("stop", "the")]


def texts(rng, ids, of=400):
    return [(i, " ".join(f"w{min(rng.randrange(of), rng.randrange(of))}" for _ in range(rng.randrange(0, 60))) + " the end") for i in ids]


def wanted(docs, ids, asked):
    """Each query by reading all texts."""
    out = set()
    for k, q in ASKED:
        out |= {(k, r.id) for r in docs.where(search.fits_query(F.col("body"), q)).select("id").collect()}
    return out


def files(path):
    return {os.path.join(d, f): (os.path.getmtime(os.path.join(d, f)), os.path.getsize(os.path.join(d, f))) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_life_of_an_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "CHUNK", 50)
    path, rng = str(tmp_path), random.Random(2)
    asked = spark.createDataFrame(ASKED, "query_id string, query string")

    def same(rows):
        docs = spark.createDataFrame(rows, TEXT)
        got = [tuple(r) for r in index.find_stored(spark, path, docs.select("id"), asked).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted(docs, None, asked)

    first = texts(rng, [f"a{i}" for i in range(150)])
    index.add(spark.createDataFrame(first, TEXT), path, "id", F.col("body"), buckets=8)
    same(first)
    before = files(path)
    more = texts(rng, [f"b{i}" for i in range(40)])
    changed = [("a3", "w1 w2 w3"), ("a4", None), (None, "w1")]
    index.add(spark.createDataFrame(more + changed, TEXT), path, "id", F.col("body"), buckets=16)
    assert {k: v for k, v in files(path).items() if k in before} == before, "no old file is written again"
    now = {**dict(first), **dict(more), **dict(changed[:2])}
    same([(k, v or "") for k, v in now.items()])
    index.remove(spark, path, spark.createDataFrame([("a5",), ("b1",), ("never",)], "id string"))
    now = {k: v for k, v in now.items() if k not in ("a5", "b1")}
    same([(k, v or "") for k, v in now.items()])
    stored = {(r.term, r.id): r.places for r in index.postings(spark, path).collect()}
    scanned = {(r.term, r.id): r.places for r in search.inverted(spark.createDataFrame([(k, v or "") for k, v in now.items()], TEXT), "id", F.col("body"), everything=True).collect()}
    assert stored == scanned
    with pytest.raises(Exception, match="broken"):  # a writer that fails changes nothing
        index.add(spark.createDataFrame(texts(rng, ["a1", "c1"]), TEXT).withColumn("body", F.when(F.col("id") == "c1", F.raise_error(F.lit("broken"))).otherwise(F.col("body"))), path, "id", F.col("body"))
    same([(k, v or "") for k, v in now.items()])
    before = files(path)
    index.merge(spark, path, buckets=8)
    assert {k: v for k, v in files(path).items() if k in before} == before
    same([(k, v or "") for k, v in now.items()])
    monkeypatch.setattr(index, "IN_PLAN", 2)  # more words than are written into the plan
    same([(k, v or "") for k, v in now.items()])
    assert index.postings(spark, f"{path}/nowhere").count() == 0


def test_a_query_reads_its_own_words(spark, tmp_path):
    """Five words read under 1 % of the postings."""
    path, rng = str(tmp_path), random.Random(3)
    rows = [(f"d{i}", " ".join(f"w{rng.randrange(6000)}" for _ in range(150))) for i in range(1500)]
    index.add(spark.createDataFrame(rows, TEXT).repartition(4), path, "id", F.col("body"), buckets=600)
    sizes = {k: v[1] for k, v in files(f"{path}/segments").items() if "/postings/" in k}
    terms = spark.createDataFrame([(f"w{k}",) for k in (5, 77, 1234, 4000, 5999)], "term string")
    found = index.postings(spark, path, terms)
    read = {f.removeprefix("file://").removeprefix("file:") for f in found.inputFiles()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = found.where("true")
    assert scan.count() == sum(len(set(t.split()) & {f"w{k}" for k in (5, 77, 1234, 4000, 5999)}) for _, t in rows)
    assert "PartitionFilters: [" in plan and "PushedFilters: [In(term" in plan
    buckets = {r[0] for r in terms.select(index._bucket(F.col("term"), 600)).collect()}
    own = sum(v for k, v in sizes.items() if int(k.split("/bucket=")[1].split("/")[0]) in buckets)
    assert own < 0.01 * sum(sizes.values()) and (not read or read <= set(sizes))


def test_postings_are_shuffled_once(spark):
    """From postings to the rows of a segment there is one exchange, by bucket."""
    from gazette.operators import index

    postings = spark.createDataFrame([("a", "1", [0, 2]), ("b", "1", [1]), ("a", "2", [5])], "term string, id string, places array<int>")
    rows = index._blocks(postings, 2, 4)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted((r.term, i) for r in rows.collect() for i in r.ids) == [("a", "1"), ("a", "2"), ("b", "1")]
