import datetime as dt
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gazette.functions import answers, prompts, signed
from gazette.operators import digest, match, search, store
from gazette.plans import digests, enrich, ingest, unsubscribe, weekly
from gazette.sources.tables import pricing

DOC = "id string, topics array<string>, plain_text string, ward_number string"
RULE = "id string, user_id string, topics array<string>, search_term string, ward_numbers array<string>, is_active boolean, delivery_frequency string"
PROFILE = "id string, notification_preferences string"


def fits(spark, rule, doc):
    r = spark.createDataFrame([("r", "u", *rule, True, "daily")], RULE)
    d = spark.createDataFrame([("d", *doc)], DOC)
    return match.match_rules(d, r).count() == 1


def test_rule_fits(spark):
    full = (["bike_lanes"], "cycling", ["1"])
    assert fits(spark, full, (["bike_lanes"], "About Cycling", "1"))
    assert not fits(spark, full, (["bike_lanes"], "About Cycling", "2"))
    assert not fits(spark, full, (["bike_lanes"], "About Cycling", None))
    assert fits(spark, (["a", "city_budget", "b"], None, []), (["city_budget"], "x", None))
    assert not fits(spark, ([], "parking", []), ([], None, None))
    assert fits(spark, ([], "", []), ([], "", None))
    assert not fits(spark, ([], None, []), (None, "x", None))


def test_rules_against_brute_force(spark):
    """With rules of several topics, phrases and wards, nulls among them, and rows that repeat."""
    docs = [(f"d{i % 50}", [f"t{i % 5}", f"t{i % 3}", None][: i % 4], f"Text {i} Word{i % 7}" if i % 11 else None, str(i % 4) if i % 6 else None) for i in range(60)]
    rules = [(f"r{i % 38}", f"u{i % 6}", [f"t{i % 6}", f"t{i % 4}", None][: i % 4], [None, "", f"word{i % 9}", "TEXT", "ord"][i % 5], [str(i % 4), "2", None][: i % 3] if i % 5 else None) for i in range(40)]
    want = Counter((r[1], r[0], d[0]) for d in docs for r in rules if d[2] is not None and (not r[2] or {x for x in r[2] if x} & {x for x in d[1] if x}) and (r[3] or "").lower() in d[2].lower() and (not r[4] or d[3] is not None and d[3] in r[4]))
    got = match.match_rules(spark.createDataFrame(docs, DOC), spark.createDataFrame([(*r, True, "daily") for r in rules], RULE))
    assert Counter(tuple(r) for r in got.collect()) == want and len(want) > 50


@pytest.mark.parametrize("block", [2, 20_000])
def test_terms_in_texts(spark, block):
    texts = [(1, "abcabd"), (2, None), (3, ""), (4, "a\u00e9 bd")]
    terms = spark.createDataFrame([("ab",), ("abd",), ("b",), ("\u00e9",), ("",), (None,), ("ab",), ("zz",)], "term string")
    got = {r["id"]: r["found"] for r in search.with_terms(spark.createDataFrame(texts, "id int, text string"), "text", terms, "found", block).collect()}
    assert got[2] is None and {k: sorted(v) for k, v in got.items() if v is not None} == {1: ["ab", "abd", "b"], 3: [], 4: ["b", "\u00e9"]}
    assert [r["found"] for r in search.with_terms(spark.createDataFrame(texts[:1], "id int, text string"), "text", terms.limit(0), "found").collect()] == [[]]


def test_phrases_in_texts(spark):
    docs = spark.createDataFrame([(1, "One Two"), (2, None), (3, "two")], "id int, body string")
    phrases = spark.createDataFrame([("a", "TWO"), ("b", "two"), ("c", ""), ("d", None), ("e", "one t")], "name string, text string")
    got = sorted((r["id"], r["name"]) for r in search.with_phrases(docs, "body", phrases, "text").collect())
    assert got == [(1, "a"), (1, "b"), (1, "c"), (1, "e"), (3, "a"), (3, "b"), (3, "c")]


def test_users(spark):
    rules = spark.createDataFrame([(i, i, ["x"], None, [], True, "daily") for i in "abcd"], RULE)
    users = spark.createDataFrame([("a", None), ("b", '{"enabled": false}'), ("c", "{}")], PROFILE)
    assert {r["id"] for r in match.of_enabled_users(rules, users).collect()} == {"a", "c"}


def test_senders(spark):
    mails = spark.createDataFrame([("1", "any@ward1.org"), ("2", "info@ward25chicago.org"), ("3", "x@other.org"), ("4", "")], "email_uid string, from_email string")
    maps = spark.createDataFrame([(2, "%ward%", 20), (1, "%@ward1.org", 10), (3, "%ward25%", 30)], "id int, email_pattern string, source_id int")
    got = {r["email_uid"]: r["source_id"] for r in match.source_of_sender(mails, maps).collect()}
    assert got == {"1": 10, "2": 20, "3": None, "4": None}
    bare = spark.createDataFrame([(1, "office@ward.org", 1)], "id int, email_pattern string, source_id int")
    got = {r["email_uid"]: r["source_id"] for r in match.source_of_sender(mails, bare).collect()}
    assert got["4"] == 1  # an empty sender is part of any pattern


def test_queries_of_words():
    assert search.parsed_query('a "b c" -d or e') == [[(True, ["b", "c"]), (False, ["d"])], [(True, ["e"])]]
    assert search.parsed_query("the or -") == []


def test_full_text(spark):
    d = spark.createDataFrame([("1", "Bike lanes on Main Street"), ("2", "The street lanes"), ("3", None)], "id string, t string")
    find = lambda q, stem=False: {r["id"] for r in d.where(search.fits_query(F.col("t"), q, stem)).collect()}
    assert find("lanes") == {"1", "2"} and find("lanes -bike") == {"2"} and find('"main street"') == {"1"} and find('"street main"') == set()
    assert find("lane") == set() and find("lane", True) == {"1", "2"} and find("bike or the") == {"1"} and find("") == set()


def test_pages():
    assert search.page_numbers(1, 5) == [1, 2, 3, 4, 5]
    assert search.page_numbers(5, 10) == [1, "...", 4, 5, 6, "...", 10]
    assert search.page_numbers(1, 10) == [1, 2, "...", 10]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e"), (None, "f"), (None, "g")], "k int, v string")
    rows = lambda df: sorted((r["k"] if r["k"] is not None else -1, r["v"]) for r in df.collect())
    assert rows(store.insert_ignore(old, new, ["k"], ["v"])) == [(-1, "f"), (-1, "g"), (1, "a"), (2, "b"), (3, "d")]
    up = store.upsert(old, new.where("k is not null"), ["k"], ["v"])
    assert rows(up) == [(1, "a"), (2, "c"), (3, "e")] == rows(store.upsert(up, new.where("k is not null"), ["k"], ["v"]))
    assert rows(store.update(old, F.col("k") == 1, v=F.lit("z"))) == [(1, "z"), (2, "b")]
    assert rows(store.delete(old, old.where("k = 1"), ["k"])) == [(2, "b")]
    with pytest.raises(LookupError):
        store.exactly_one(old)


def test_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    store.swapped(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_rule_errors(spark):
    ddl = "name string, topics array<string>, search_term string, ward_numbers array<string>, delivery_frequency string, n int"
    cases = [((" ", ["a"], None, [], "daily", 0), "name is required"), (("n", [], None, [], "weekly", 0), "a weekly rule needs a topic"), (("n", ["a"], None, ["1"], "weekly", 0), "a weekly rule has no wards"), (("n", [], " ", [], "daily", 0), "a daily rule needs a topic or a search term"), (("n", [], "x" * 101, [], "daily", 0), "search term is too long"), (("n", ["a"], None, [], "daily", 5), "too many rules"), (("n", ["a"], None, [], None, 4), None)]
    got = [r["e"] for r in spark.createDataFrame([c for c, _ in cases], ddl).coalesce(1).select(store.new_rule_error(F.col("n")).alias("e")).collect()]
    assert got == [e for _, e in cases]


QUEUE = "id string, user_id string, newsletter_id string, report_id string, rule_id string, status string, digest_batch_id string, notification_type string, created_at timestamp, sent_at timestamp, error_message string"


def test_digest_run(spark):
    now = dt.datetime(2026, 1, 24)
    row = lambda i, u, n, status="pending": (i, u, n, None, "r", status, "b", "daily", now, None, None)
    q = spark.createDataFrame([row("1", "on", "x"), row("2", "on", "gone"), row("3", "off", "x"), row("4", "empty", "gone"), row("5", "no", "x"), row("6", "on", "x", "sent"), row("7", "none", "x")], QUEUE)
    users = spark.createDataFrame([("on", None), ("off", '{"enabled": false}'), ("empty", None), ("no", None)], PROFILE)
    contents = spark.createDataFrame([("x",)], "content_id string")
    refused = spark.createDataFrame([("no", "bounced")], "user_id string, error string")
    out = digests.run(q, users, contents, F.lit("2026-01-25").cast("timestamp"), "b", "daily", refused)
    assert tuple(out["stats"].first()) == (1, 1, 2)
    after = {r["id"]: (r["status"], r["error_message"], r["sent_at"] is not None) for r in out["queue"].collect()}
    assert after == {"1": ("sent", None, True), "2": ("sent", None, True), "3": ("failed", "notifications disabled", False), "4": ("failed", "Empty digest content", False), "5": ("failed", "bounced", False), "6": ("sent", None, False), "7": ("pending", None, False)}
    assert {r["user_id"]: r["success"] for r in out["history"].collect()} == {"on": True, "empty": False, "no": False}
    dry = digests.run(q, users, contents, F.current_timestamp(), "b", dry=True)
    assert dry["history"].count() == 0 and dry["queue"].where("status = 'pending'").count() == 6


def test_first_seen_names(spark):
    now = dt.datetime(2026, 1, 24)
    rows = spark.createDataFrame([("u", "n", now, "2", "b"), ("u", "n", now, "1", "z"), ("u", "n", now + dt.timedelta(1), "3", "z")], "user_id string, newsletter_id string, created_at timestamp, id string, rule_name string")
    assert digest.rules_of_documents(rows).first()["matched_rules"] == ["z", "b"]


def test_mail(spark):
    mail = spark.createDataFrame([("1", "any@ward1.org", None, dt.datetime(2026, 1, 1), "<p>Bike <a href='https://rs6.net/tn.jsp'>x</a></p>", None, [], False), ("2", "who@else.org", "Hi", dt.datetime(2026, 1, 1), None, "text", ["me@x"], False), ("1", "any@ward1.org", "again", dt.datetime(2026, 1, 2), None, "t", [], False), ("9", "any@ward1.org", "old", dt.datetime(2026, 1, 2), None, "t", [], False)], "uid string, from_ string, subject string, date timestamp, html string, text string, `to` array<string>, seen boolean")
    maps = spark.createDataFrame([(1, "%@ward1.org", 10)], "id int, email_pattern string, source_id int")
    sources = spark.createDataFrame([(10, "1")], "id int, ward_number string")
    rules = spark.createDataFrame([("r", "u", [], "bike", [], True, "daily")], RULE)
    users = spark.createDataFrame([("u", None)], PROFILE)
    seen = spark.createDataFrame([("9",)], "email_uid string")
    out = ingest.ingest_mail(mail, seen, maps, sources, rules, users, F.lit("2026-01-03 18:00:00").cast("timestamp"))
    new = out["new"].collect()
    assert [(r["email_uid"], r["subject"], r["to_email"], r["plain_text"]) for r in new] == [("1", "(No subject)", "", "Bike x")]
    assert [r["email_uid"] for r in out["unmapped"].collect()] == ["2"]
    assert [(r["user_id"], r["digest_batch_id"]) for r in out["queue"].collect()] == [("u", "2026-01-03")]


def test_pairs_are_dealt(spark):
    """Documents and rules of one kind each: their pairs are made by many tasks, none of which makes a large part."""
    docs = spark.range(4000).selectExpr("cast(id as string) id", "array('a') topics", "'x' plain_text", "cast(null as string) ward_number")
    rules = spark.range(3).selectExpr("cast(id as string) id", "'u' user_id", "array('a') topics", "'' search_term", "cast(array() as array<string>) ward_numbers", "true is_active", "'daily' delivery_frequency")
    got = match.match_rules(docs, rules).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == 12_000 and len(got) > 8 and max(r["n"] for r in got) < 12_000 / 4


def test_enrichment(spark):
    docs = spark.createDataFrame([("1", "Bike lanes", "New bike lanes. They are wide. More."), ("2", None, None)], "id string, subject string, plain_text string")
    got = {r["id"]: r for r in enrich.enriched(docs).collect()}
    assert "bike_lanes" in got["1"]["topics"] and got["1"]["relevance_score"] >= 3 and got["2"]["topics"] == []

    class Broken(enrich.Lexicon):
        def topics(self, content):
            raise ValueError

        def relevance(self, content, topics, summary):
            raise ValueError

    got = enrich.enriched(docs.where("id = '1'"), Broken).first()
    assert got["topics"] == [] and got["summary"] and got["relevance_score"] is None


def test_few_texts_at_a_time(spark, tmp_path):
    """The first answers leave a task long before it has been given thousands of texts, whatever the session's batches were."""
    asked, name = tmp_path / "asked", "spark.sql.execution.arrow.maxRecordsPerBatch"

    class Slow(enrich.Lexicon):
        def topics(self, content):
            time.sleep(0.001)
            with open(asked, "a") as f:
                f.write(".")
            return []

        def facts(self, topic, content):
            self.topics(content)
            return ["x" * 2000]

    docs = spark.range(0, 5000, 1, 1).selectExpr("cast(id as string) id", "'s' subject", "repeat('t', 3000) plain_text", "'a' topic", "'1' ward_number")
    held = spark.conf.get(name)
    try:
        for made in (lambda: enrich.enriched(docs, Slow), lambda: enrich.developments(docs, Slow)):
            spark.conf.set(name, "10000")
            asked.write_text("")
            assert made().first()["id"] == "0" and asked.stat().st_size < 3000
        spark.conf.set(name, "50")
        enrich.enriched(docs, Slow)
        assert spark.conf.get(name) == "50"
    finally:
        spark.conf.set(name, held)


def test_answers():
    waits, answers = [], iter(["", " ", "ok"])
    assert enrich.answered(lambda p: next(answers), "p", wait=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        enrich.answered(lambda p: "", "p", wait=lambda s: None)
    m = enrich.Model(lambda p: 'Sure: ```json\n{"topics": ["bike_lanes", "other"]}\n```')
    assert m.topics("x") == ["bike_lanes"]


def test_prices(spark, tmp_path):
    f = tmp_path / "p.json"
    f.write_text('{"version": "1", "updated": "x", "models": [{"provider": "a", "model": "m", "input_cost_per_1m": 1.0, "output_cost_per_1m": 2.0, "context_window": 5, "encoding": "e"}]}')
    assert pricing(spark, str(f)).first()["model"] == "m"
    f.write_text('{"version": "1", "updated": "x", "models": [{"provider": "a", "model": "m"}]}')
    with pytest.raises(Exception, match="required"):
        pricing(spark, str(f)).collect()


def test_stream(spark, tmp_path):
    from gazette.streaming import ingest as stream

    land = tmp_path / "in"
    land.mkdir()
    (land / "a.json").write_text('{"uid": "1", "from_": "a", "date": "2026-01-01T00:00:00Z"}\n{"uid": "1", "from_": "a", "date": "2026-01-01T00:00:00Z"}\n{"uid": "2", "from_": "b", "date": "2026-01-01T01:00:00Z", "seen": true}\n')
    got = []
    for _ in range(2):
        stream.start(stream.messages(spark, str(land)), str(tmp_path / "check"), lambda df, n: got.extend(r["uid"] for r in df.collect())).awaitTermination(60)
    assert got == ["1"]


def test_failures_are_kept(spark):
    """One document's failure is no other's, and each leaves a row behind."""
    docs = spark.createDataFrame([("1", "Bike lanes", "New bike lanes. They are wide."), ("2", "x", "boom")], "id string, subject string, plain_text string")

    class Broken(enrich.Lexicon):
        def summary(self, content):
            if "boom" in content:
                raise RuntimeError("no")
            return super().summary(content)

    rows = enrich.enriched(docs, Broken, failures=True)
    got = [(r["key"], r["step"], r["error"]) for r in enrich.dead_letters(rows, F.current_timestamp()).collect()]
    assert got == [("2", "summary", "RuntimeError: no")]


def test_synthesis_by_an_enricher_that_reads_few_facts(spark):
    """More than BLOCK * BLOCK documents: the first texts of all blocks make the report, in order of the blocks."""
    size, enrich.BLOCK = enrich.BLOCK, 2
    try:
        rows = [("a", f"d{i:02d}", i, f"fact {i}.") for i in range(40)]
        facts = spark.createDataFrame(rows, "topic string, id string, place int, description string")
        blocks = facts.select(enrich._block(F.col("id"), F.lit(40)).alias("b"), "id", "description").orderBy("b", "id").collect()
        got = enrich.synthesised(facts, spark.createDataFrame([("a", 40)], "topic string, n long")).collect()
    finally:
        enrich.BLOCK = size
    texts = [" ".join([x.description for x in blocks if x.b == k][:5]) for k in sorted({x.b for x in blocks})]
    assert [(r.topic, r.report_summary) for r in got] == [("a", " ".join(texts[:5]))]


def test_synthesis_in_rounds(spark):
    """Every fact is read, however many there are: blocks first, then the texts of the blocks."""

    class Counting(enrich.Lexicon):
        def facts(self, topic, content):
            return [content]

        def synthesis(self, topic, facts):
            assert len(facts) < 4 * enrich.BLOCK
            if topic == "c":
                raise ValueError("never")
            return str(sum(int(f) for f in facts))

    rows = [("a", f"d{i}", "1", "7") for i in range(300)] + [("b", "d1", "5", None), ("c", "d2", "1", None)]
    docs = spark.createDataFrame(rows, "topic string, id string, plain_text string, ward_number string")
    parts = enrich.report_parts(docs, "2024-W05", Counting)
    assert {r["topic"]: r["report_summary"] for r in parts["reports"].collect()} == {"a": "300", "b": "5"}
    assert [(r["key"], r["step"]) for r in parts["failures"].collect()] == [("c", "weekly_synthesis")]
    whole = {r["topic"]: r for r in enrich.collected(parts).collect()}
    assert len(whole["a"]["newsletter_ids"]) == len(whole["a"]["key_developments"]) == 300 and whole["a"]["key_developments"][0]["wards"] == ["7"]


def test_refused_reports(spark):
    docs = spark.createDataFrame([("bike_lanes", "d1", "Bike lanes.", None), ("odd", "d2", "Odd.", None), ("odd", "d3", "Odd.", None)], "topic string, id string, plain_text string, ward_number string")
    parts = enrich.report_parts(docs, "2024-W05", lambda: enrich.Lexicon({"bike_lanes": ["bike"], "odd": ["odd"]}), ["bike_lanes"])
    assert [r["topic"] for r in parts["reports"].collect()] == ["bike_lanes"] and [tuple(r) for r in parts["failures"].collect()] == [("odd", "topic", "unknown topic")]
    for week in ("2024", "", None, "week 5", "2024-W05x"):
        parts = enrich.report_parts(docs, week)
        assert not parts["reports"].collect() and [r["step"] for r in parts["failures"].collect()] == ["week"]


def test_weekly_run_in_rows(spark):
    docs = spark.createDataFrame([("1", dt.datetime(2024, 1, 30), ["x"], "About x. More x.", "7")], "id string, received_date timestamp_ntz, topics array<string>, plain_text string, ward_number string")
    rules = spark.createDataFrame([("r", "u", ["x"], None, [], True, "weekly")], RULE)
    old = spark.createDataFrame([], "id string, topic string, week_id string, report_summary string, newsletter_ids array<string>")
    out = weekly.run(docs, rules, old, "2024-W05", F.current_timestamp(), lambda: enrich.Lexicon({"x": ["x"]}), whole=False)
    assert [(r["report_summary"], r["newsletter_ids"]) for r in out["reports"].collect()] == [("About x. More x.", None)]
    assert [(r["id"], r["description"]) for r in out["developments"].orderBy("place").collect()] == [("1", "About x."), ("1", "More x.")] and out["newsletters"].count() == 1


def test_confirmed_unsubscription(spark):
    now = F.lit(1_700_000_000)
    users = spark.createDataFrame([("a", "{}"), ("b", "{}"), ("c", "{}"), ("d", unsubscribe.OFF), ("e", "{}")], PROFILE)
    asked = spark.createDataFrame([("a", "GET", None), ("b", "post", None), ("c", "GET", "true"), ("d", "POST", None), ("e", "GET", "yes")], "who string, method string, confirm string").select(signed.token_for(F.col("who"), now, "s").alias("token"), F.lit(None).cast("string").alias("user_id"), "method", "confirm")
    after, out = unsubscribe.unsubscribed(users, asked, now + 1, "s")
    assert {r["subject"]: r["outcome"] for r in out.collect()} == {"a": "to confirm", "b": "done", "c": "done", "d": "already", "e": "to confirm"}
    assert {r["id"] for r in after.where(F.col("notification_preferences") == unsubscribe.OFF).collect()} == {"b", "c", "d"}


def test_weekly_run(spark):
    docs = spark.createDataFrame([("1", dt.datetime(2024, 1, 30), ["x", "y"], "About x. And y.", None), ("2", dt.datetime(2024, 1, 30), ["z"], "About z.", None)], "id string, received_date timestamp_ntz, topics array<string>, plain_text string, ward_number string")
    rules = spark.createDataFrame([("r", "u", ["x", "y", "q"], None, [], True, "weekly")], RULE)
    old = spark.createDataFrame([("y|2024-W05", "y", "2024-W05", "old")], "id string, topic string, week_id string, report_summary string")
    words = lambda: enrich.Lexicon({t: [t] for t in "xyzq"})
    for force, dry, want in ((False, False, {"x": "About x.", "y": "old"}), (True, False, {"x": "About x.", "y": "And y."}), (True, True, {"y": "old"})):
        out = weekly.run(docs, rules, old, "2024-W05", F.current_timestamp(), words, force, dry)
        assert {r["topic"]: r["report_summary"] for r in out["reports"].collect()} == want
        assert tuple(out["stats"].first()) == (2 if force else 1, 1 if force else 2, 0)


def test_unsubscribe(spark):
    now = F.lit(1_700_000_000)
    users = spark.createDataFrame([("a", None), ("b", '{"enabled": true}'), ("c", "{}")], PROFILE)
    asked = spark.createDataFrame([("a", "a"), ("b", "c"), ("c", None), ("x", None)], "who string, user_id string").select(signed.token_for(F.col("who"), now, "s").alias("token"), "user_id")
    after, out = unsubscribe.unsubscribed(users, asked.union(spark.createDataFrame([("junk", None)], "token string, user_id string")), now + 1, "s")
    assert {r["id"]: r["notification_preferences"] for r in after.collect()} == {"a": unsubscribe.OFF, "b": '{"enabled": true}', "c": unsubscribe.OFF}
    assert sorted(r["error"] or "" for r in out.collect()) == ["", "", "", "invalid token", "user id mismatch"]


def test_typed_answers(spark):
    told = {"topics": [('{"topics": ["bike_lanes", "odd"]}', (["bike_lanes"], None)), ("{}", (None, "missing")), ("no", (None, "not JSON")), (None, (None, "not JSON"))], "relevance_score": [('{"score": 10}', (10, None)), ('{"score": 11}', (None, "out of bounds")), (f'{{"score": 1, "reasoning": "{"x" * 1001}"}}', (None, "too long")), ('{"score": "many"}', (None, "not JSON"))], "weekly_facts": [('```json\n{"facts": ["a"]}\n```', (["a"], None)), (f'{{"facts": ["{"x" * 2001}"]}}', (None, "too long"))], "weekly_synthesis": [(f'{{"report": "{"x" * 5000}"}}', ("x" * 5000, None))]}
    for operation, cases in told.items():
        df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string")
        got = [tuple(r["t"]) for r in df.select("i", answers.typed_answer(F.col("a"), operation).alias("t")).orderBy("i").collect()]
        assert got == [w for _, w in cases], operation


def test_swapped(spark, tmp_path):
    place = str(tmp_path / "t")
    store.swapped(spark.range(3), place)
    store.swapped(spark.read.parquet(place).union(spark.range(10, 11)), place)
    assert sorted(r["id"] for r in spark.read.parquet(place).collect()) == [0, 1, 2, 10] and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_prompts(spark):
    df = spark.createDataFrame([("a {b}", "t")], "content string, topic string")
    for o, parts in (("summary", ["content"]), ("weekly_facts", ["topic", "content"])):
        column = prompts.prompt_column(o, **{p: F.col(p) for p in parts})
        assert df.select(column.alias("p")).first()["p"] == prompts.prompt(o, **{p: dict(content="a {b}", topic="t")[p] for p in parts})


@pytest.mark.parametrize("stem", [False, True])
def test_index_finds_what_texts_hold(spark, stem):
    """Queries by the index against the same queries on the texts."""
    texts = ["new bike lanes on main street", "Bike lane: the main, street", "street main bikes", "", None, "the the the", "a lane of the lanes"]
    said = ["bike", "bike lanes", '"main street"', "-bike", "bike -street or lane", '"lane of the lanes"', "the", "", '"the main" bike', "bike-lanes", "-bike -street", "lanes lanes"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    asked = spark.createDataFrame([(str(k), q) for k, q in enumerate(said)], "query_id string, query string")
    got = {(r["query_id"], r["id"]) for r in search.find(search.inverted(docs, "id", F.col("text"), stem, True), docs, asked, stem).collect()}
    assert got == {(str(k), r["id"]) for k, q in enumerate(said) for r in docs.where(search.fits_query(F.col("text"), q, stem)).collect()}
