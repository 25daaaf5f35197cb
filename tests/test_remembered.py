"""Answers that are kept: what is asked, how often, and after a run that was killed."""

import os
import sys
import threading
import time
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gazette.operators import match
from gazette.plans import ingest, remembered

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't import tests
DOC = "id string, subject string, plain_text string, digest string, a int"


class Noted:
    """Notes each call as a file; fails for some contents, or ends the task."""

    def __init__(self, folder, fails=None, ends=None):
        self.folder, self.fails, self.ends = folder, fails, ends

    def topics(self, content):
        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        if self.ends and self.ends in content:
            raise KeyboardInterrupt("killed")
        if self.fails and self.fails in content:
            raise ValueError("refused")
        return ["bike_lanes"]

    def summary(self, content):
        return content[-9:]

    def relevance(self, content, topics, summary):
        return len(topics)


def test_asked_once(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    n = lambda: len(os.listdir(calls))
    rows = [(f"d{i}", f"s{i % 10}", f"text {i % 20}") for i in range(60)] + [("d0", None, None), ("e", "", ""), ("d0", "s0", "text 0")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOC)
    run = lambda df, version="1", **kw: sorted((r.id, r.topics, r.summary, r.relevance_score, len(r.failures)) for r in remembered.remembered(df, path, version, lambda: Noted(str(calls), **kw)).collect())
    want = sorted((i, ["bike_lanes"], f"Subject: {s or ''}\n\n{t or ''}"[-9:], 1, 0) for i, s, t in rows)
    assert run(docs) == want and n() == 21, "equal contents are asked once"
    assert run(docs) == want and n() == 21, "a second run asks nothing"
    assert run(docs.where("id = 'e'"), "2") == [r for r in want if r[0] == "e"] and n() == 22, "another version does"
    more = spark.createDataFrame([("f", "s", "bad one", "x", 1), ("g", "s", "good", "x", 1)], DOC)
    assert [(r[0], r[4]) for r in run(more, fails="bad")] == [("f", 1), ("g", 0)] and n() == 24
    assert [(r[0], r[4]) for r in run(more)] == [("f", 0), ("g", 0)] and n() == 25, "only what failed is asked again"


def test_killed_and_resumed(spark, tmp_path, monkeypatch):
    calls, path = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    monkeypatch.setattr(remembered, "WAVE", 10)
    docs = spark.createDataFrame([(f"d{i}", "s", f"text {i}.", "x", 1) for i in range(50)], DOC).repartition(2)
    with pytest.raises(Exception):  # noqa: B017
        remembered.remembered(docs, path, "1", lambda: Noted(str(calls), ends="text 33."))
    kept = remembered.stored_answers(spark, path).count()
    before = len(os.listdir(calls))
    got = remembered.remembered(docs, path, "1", lambda: Noted(str(calls)))
    assert got.count() == 50 and len(os.listdir(calls)) - before == 50 - kept and remembered.stored_answers(spark, path).count() == 50


def test_documents_are_read_as_often_for_many_waves(spark, tmp_path, monkeypatch):
    """What is to be asked is told once, not for each wave."""
    counts = []
    for wave in (5, 40):
        monkeypatch.setattr(remembered, "WAVE", wave)
        read = spark.sparkContext.accumulator(0)

        @F.udf("string")
        def seen(x, read=read):
            read.add(1)
            return x

        docs = spark.createDataFrame([(str(i), "s", f"text {i}") for i in range(40)], "id string, subject string, plain_text string").withColumn("plain_text", seen(F.col("plain_text")))
        assert remembered.remembered(docs, str(tmp_path / f"w{wave}"), "v").count() == 40
        counts.append(read.value)
    assert counts[0] == counts[1]


def test_calls_at_once(spark, tmp_path):
    class Slow(Noted):
        def __init__(self, folder):
            super().__init__(folder)
            self.open, self.most, self.lock = 0, 0, threading.Lock()

        def summary(self, content):
            with self.lock:
                self.open += 1
                self.most = max(self.most, self.open)
            time.sleep(0.05)
            with self.lock:
                self.open -= 1
            return str(self.most)

    docs = spark.createDataFrame([(f"d{i}", "s", f"text {i}", "x", 1) for i in range(12)], DOC).coalesce(1)
    got = [int(r.summary) for r in remembered.remembered(docs, str(tmp_path / "a"), "1", lambda: Slow(str(tmp_path)), at_once=3).collect()]
    assert 2 <= max(got) <= 3


def test_reprocess_queues(spark, tmp_path):
    docs = spark.createDataFrame([("a", "s", "about bikes", ["old"], 1), ("b", "s", "x", None, 2), ("c", "s", None, None, 2)], "id string, subject string, plain_text string, topics array<string>, source_id int")
    sources = spark.createDataFrame([(1, "7"), (2, None)], "id int, ward_number string")
    rules = spark.createDataFrame([("r", "u", True, ["bike_lanes"], None, [], "daily"), ("w", "u", True, [], None, ["7"], "daily")], "id string, user_id string, is_active boolean, topics array<string>, search_term string, ward_numbers array<string>, delivery_frequency string")
    profiles = spark.createDataFrame([("u", "{}")], "id string, notification_preferences string")
    queue = match.queue_rows(spark.createDataFrame([("u", "r", "b")], "user_id string, rule_id string, newsletter_id string"), F.current_timestamp())
    (tmp_path / "calls").mkdir()
    out = ingest.reprocess(docs, sources, lambda d: remembered.remembered(d, str(tmp_path / "a"), "1", lambda: Noted(str(tmp_path / "calls"))), rules, profiles, queue, F.current_timestamp())
    assert {(r.id, tuple(r.topics)) for r in out["docs"].collect()} == {("a", ("bike_lanes",)), ("b", ("bike_lanes",))}
    assert {(r.rule_id, r.newsletter_id) for r in out["queue"].collect()} == {("r", "a"), ("w", "a")}
