"""Queries over the test tables, and the same in DuckDB's SQL. Every query runs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .constants import DEFAULT_ENCODING, ENCODINGS, RENAMED_TOPICS, TEXT_PATTERNS, TOPIC_NAMES, TOPICS, URL_PATTERNS
from .functions import arrays, cost, dates, html, signed, text
from .operators import costs, digest, match, reports, search, store
from .plans import digests as digest_plan
from .plans import enrich, ingest
from .registry import ORACLE_SQL, QUERIES, WEEK, query, with_ward
from .registry import quoted as _q
from .sources import bindings as b
from .sources.tables import table

_MAP = "CASE t " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in RENAMED_TOPICS.items()) + " ELSE t END"
_KNOWN = "[" + ", ".join(map(_q, TOPICS)) + "]"
#: Which rules fit a newsletter.
FITS = """((len(r.topics) = 0 OR list_has_any(r.topics, n.topics)) AND (coalesce(r.search_term, '') = '' OR contains(lower(n.plain_text), lower(r.search_term)))
  AND (len(r.ward_numbers) = 0 OR coalesce(list_contains(r.ward_numbers, s.ward_number), false)))"""


# --- matching ----------------------------------------------------------------------------------------------------


@query(f"SELECT r.user_id, r.id AS rule_id, n.id AS newsletter_id FROM n LEFT JOIN s ON n.source_id = s.id JOIN r ON {FITS} WHERE n.topics IS NOT NULL AND n.plain_text IS NOT NULL AND r.is_active AND r.delivery_frequency = 'daily' AND r.user_id IN (SELECT id FROM on_users)")
def rule_match(spark, d):
    return match.match_daily(with_ward(spark, d), b.rules(spark, d), b.profiles(spark, d))


@query(f"SELECT r.user_id, r.id AS rule_id, n.id AS newsletter_id FROM n LEFT JOIN s ON n.source_id = s.id JOIN r ON {FITS} AND n.relevance_score >= r.min_relevance_score WHERE n.topics IS NOT NULL AND n.plain_text IS NOT NULL AND r.is_active AND r.delivery_frequency = 'daily' AND r.user_id IN (SELECT id FROM on_users)")
def rule_match_strict(spark, d):
    rules = b.rules(spark, d).withColumn("source_ids", F.lit(None).cast("array<int>"))
    return match.match_daily(with_ward(spark, d), rules, b.profiles(spark, d), strict=True)


@query("SELECT r.id, r.user_id FROM r WHERE r.is_active AND r.user_id IN (SELECT id FROM on_users)")
def enabled_rules(spark, d):
    return match.of_enabled_users(b.rules(spark, d).where("is_active"), b.profiles(spark, d)).select("id", "user_id")


@query(r"""SELECT n.id, arg_min(m.source_id, m.id)::INT AS source_id FROM n LEFT JOIN m ON CASE WHEN contains(m.email_pattern, '%') THEN regexp_matches(lower(n.from_email), replace(replace(lower(m.email_pattern), '%', '.*'), '.', '\.'))
  ELSE contains(lower(n.from_email), lower(m.email_pattern)) OR contains(lower(m.email_pattern), lower(n.from_email)) END GROUP BY n.id""")
def email_source_match(spark, d):
    return match.source_of_sender(b.newsletters(spark, d).select("id", "from_email"), b.mappings(spark, d)).select("id", "source_id")


@query("SELECT n.id, arg_min(m.source_id, m.id)::INT AS source_id FROM n LEFT JOIN m ON lower(n.from_email) LIKE lower(m.email_pattern) GROUP BY n.id")
def email_source_like(spark, d):
    return match.source_of_sender(b.newsletters(spark, d).select("id", "from_email"), b.mappings(spark, d), compat=False).select("id", "source_id")


QUEUED = f"""SELECT user_id, rule_id, newsletter_id, 'pending' AS status, '2024-01-29' AS digest_batch_id, 'daily' AS notification_type FROM (SELECT r.user_id, r.id AS rule_id, n.id AS newsletter_id FROM n LEFT JOIN s ON n.source_id = s.id JOIN r ON {FITS} WHERE n.topics IS NOT NULL AND n.plain_text IS NOT NULL AND r.is_active AND r.delivery_frequency = 'daily' AND r.user_id IN (SELECT id FROM on_users)) x
  WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.user_id = x.user_id AND q.newsletter_id = x.newsletter_id AND q.rule_id = x.rule_id)"""


@query(QUEUED)
def queue_matches(spark, d):
    old = b.queue(spark, d).where("newsletter_id is not null")
    new = match.new_daily(with_ward(spark, d), b.rules(spark, d), b.profiles(spark, d), old)
    return match.queue_rows(new, F.lit("2024-01-30 05:30:00").cast("timestamp")).select("user_id", "rule_id", "newsletter_id", "status", "digest_batch_id", "notification_type")


# --- search ------------------------------------------------------------------------------------------------------

_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("SELECT n.id, n.subject, s.name AS source_name, strftime(n.received_date, '%Y-%m-%d %H:%M:%S') AS received FROM n LEFT JOIN s ON n.source_id = s.id WHERE list_contains(n.topics, 'bike_lanes') ORDER BY n.received_date DESC NULLS LAST, n.id LIMIT 20 OFFSET 20")
def search_page(spark, d):
    found = search.search(b.newsletters(spark, d), b.sources(spark, d), topic="bike_lanes")
    return search.page(found, 2).select("id", "subject", F.col("source.name").alias("source_name"), F.date_format("received_date", "yyyy-MM-dd HH:mm:ss").alias("received"))


@query("SELECT n.id, s.name AS source_name, s.ward_number FROM n JOIN s ON n.source_id = s.id WHERE s.ward_number = '7'")
def search_ward(spark, d):
    return search.search(b.newsletters(spark, d), b.sources(spark, d), ward="7").select("id", F.col("source.name").alias("source_name"), F.col("source.ward_number").alias("ward_number"))


@query("SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS pages FROM n JOIN s ON n.source_id = s.id WHERE s.source_type = 'ASIA' AND list_contains(n.topics, 'city_budget')")
def search_count(spark, d):
    return search.counted(search.search(b.newsletters(spark, d), b.sources(spark, d), source_type="ASIA", topic="city_budget"))


@query("SELECT DISTINCT unnest(topics) AS topic FROM n ORDER BY topic")
def search_facet_topics(spark, d):
    return search.topics_of(b.newsletters(spark, d))


@query("SELECT ward_number FROM (SELECT DISTINCT ward_number FROM s WHERE ward_number IS NOT NULL AND source_type = 'ASIA') ORDER BY try_cast(ward_number AS INT)")
def search_facet_wards(spark, d):
    return search.wards_of(b.sources(spark, d), "ASIA")


_WORDS = r"regexp_split_to_array(lower(coalesce(subject, '') || ' ' || coalesce(plain_text, '')), '[^\pL\pN]+')"


@query(rf"SELECT id FROM (SELECT id, {_WORDS} AS w FROM n) WHERE list_contains(w, 'thin') AND NOT list_contains(w, 'license') OR list_contains(w, 'release') AND contains(' ' || array_to_string(w, ' ') || ' ', ' mit license ') AND list_contains(w, 'mit') AND list_contains(w, 'license') OR list_contains(w, 'des') AND list_contains(w, 'und')")
def websearch_tokens(spark, d):
    return search.search(b.newsletters(spark, d), b.sources(spark, d), query='thin -license or release "mit license" or des und').select("id")


@query(rf"SELECT id FROM (SELECT id, {_WORDS} AS w FROM n) WHERE len(list_filter(w, lambda x: regexp_matches(x, '^licens(e|es|ed|ing)?$'))) > 0 OR regexp_matches(' ' || array_to_string(list_filter(w, lambda x: x <> ''), ' ') || ' ', ' releas(e|es|ed|ing)? under ')")
def websearch_stemmed(spark, d):
    """In the SQL the forms of a word that have its stem are written out."""
    return search.search(b.newsletters(spark, d), b.sources(spark, d), query='licensing or "released under"', stem=True).select("id")


_SAID = {"a": ("thin -license", "list_contains(w, 'thin') AND NOT list_contains(w, 'license')"), "b": ('"mit license" or des und', "contains(t, ' mit license ') OR list_contains(w, 'des') AND list_contains(w, 'und')"), "c": ("-the", "NULL"), "d": ('"under the mit"', "contains(t, ' under the mit ')"), "e": ("-license", "NOT list_contains(w, 'license')")}


def asked_queries(spark):
    return spark.createDataFrame([(k, v[0]) for k, v in _SAID.items()], "query_id string, query string")


INDEXED = (
    rf"SELECT q AS query_id, id FROM (SELECT id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM (SELECT id, list_filter({_WORDS}, lambda x: x <> '') AS w FROM n)), (SELECT unnest({list(_SAID)}) AS q) WHERE CASE q " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in _SAID.items()) + " END"
)


@query(INDEXED)
def indexed_search(spark, d):
    """Many queries at once by the inverted index."""
    n = b.newsletters(spark, d)
    asked = asked_queries(spark)
    words = search.parsed_queries(asked).select(F.explode("words").alias("term"))
    index = search.inverted(n, "id", F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("plain_text", F.lit(""))), everything=True, only=words)
    return search.find(index, n.select("id"), asked)


@query(rf"SELECT term, id, string_agg(place::VARCHAR, ',' ORDER BY place) AS places FROM (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS place FROM (SELECT id, list_filter({_WORDS}, lambda x: x <> '') AS w FROM n)) WHERE NOT list_contains([{', '.join(map(_q, search.STOP))}], term) GROUP BY term, id")
def inverted_index(spark, d):
    inv = search.inverted(b.newsletters(spark, d), "id", F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("plain_text", F.lit(""))))
    return inv.select("term", "id", F.array_join(F.transform("places", lambda p: p.cast("string")), ",").alias("places"))


@query("SELECT id, CASE WHEN relevance_score >= 8 THEN 'high' WHEN relevance_score >= 5 THEN 'medium' WHEN relevance_score IS NOT NULL THEN 'low' END AS bucket FROM n")
def relevance_bucket(spark, d):
    return b.newsletters(spark, d).select("id", search.bucket(F.col("relevance_score")).alias("bucket"))


@query("SELECT source_id, id, subject FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY received_date DESC NULLS LAST, id DESC) AS k FROM n) WHERE k = 1")
def latest_per_source(spark, d):
    return search.newest_per_source(b.newsletters(spark, d)).select("source_id", "id", "subject")


@query("SELECT id FROM n WHERE topics IS NULL OR summary IS NULL OR relevance_score IS NULL")
def missing_metadata(spark, d):
    return search.lacking_metadata(b.newsletters(spark, d)).select("id")


@query("SELECT id FROM n ORDER BY received_date DESC NULLS LAST, id LIMIT 30 OFFSET 10")
def latest_skipping(spark, d):
    return search.latest(b.newsletters(spark, d), 30, 10).select("id")


@query("SELECT n.id, n.subject, s.name AS source_name, coalesce(s.ward_number, '') AS ward FROM n LEFT JOIN s ON n.source_id = s.id")
def newsletter_source_join(spark, d):
    return search.with_source(b.newsletters(spark, d), b.sources(spark, d)).select("id", "subject", F.col("source.name").alias("source_name"), F.coalesce("source.ward_number", F.lit("")).alias("ward"))


@query("SELECT n.id, n.subject, p.phrase_id FROM n JOIN (SELECT item_id AS phrase_id, text FROM benchmark) p ON contains(lower(n.plain_text), lower(p.text))")
def phrase_search(spark, d):
    phrases = table(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), "text")
    return search.with_phrases(b.newsletters(spark, d), "plain_text", phrases, "text").select("id", "subject", "phrase_id")


# --- weekly reports ----------------------------------------------------------------------------------------------


@query("SELECT DISTINCT unnest(topics) AS topic FROM r WHERE is_active AND delivery_frequency = 'weekly' ORDER BY topic")
def active_topics(spark, d):
    return reports.active_topics(b.rules(spark, d))


@query("SELECT strftime(received_date, '%G-W%V') AS week_id, count(*) AS newsletters FROM n WHERE received_date IS NOT NULL GROUP BY 1")
def iso_week_counts(spark, d):
    return reports.per_week(b.newsletters(spark, d))


@query("SELECT week_id, strftime(a, '%Y-%m-%d') AS week_start, strftime(a + to_days(6), '%Y-%m-%d') AS week_end, strftime(a, '%B %d') || ' - ' || CASE WHEN month(a) = month(a + to_days(6)) THEN strftime(a + to_days(6), '%d, %Y') ELSE strftime(a + to_days(6), '%B %d, %Y') END AS label FROM (SELECT DISTINCT strftime(o_orderdate, '%G-W%V') AS week_id, date_trunc('week', o_orderdate)::TIMESTAMP AS a FROM orders)", False)
def week_range(spark, d):
    w = table(spark, d, "orders").select(dates.week_id(F.col("o_orderdate")).alias("week_id")).distinct()
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return w.select("week_id", day(dates.week_start(F.col("week_id"))).alias("week_start"), day(dates.week_end(F.col("week_id"))).alias("week_end"), dates.week_label(F.col("week_id")).alias("label"))


_IN_WEEK = "received_date >= TIMESTAMP '2024-01-29' AND received_date <= TIMESTAMP '2024-02-04'"


@query(f"SELECT topic, id FROM (SELECT id, unnest(list_distinct(topics)) AS topic FROM n WHERE {_IN_WEEK}) WHERE topic IN (SELECT unnest(topics) FROM r WHERE is_active AND delivery_frequency = 'weekly')")
def weekly_documents(spark, d):
    return reports.documents_of_week(b.newsletters(spark, d), WEEK, reports.active_topics(b.rules(spark, d)))


@query("SELECT topic, id FROM (SELECT id, unnest(list_distinct(topics)) AS topic FROM n WHERE received_date >= TIMESTAMP '2024-01-29' AND received_date < TIMESTAMP '2024-02-05')")
def weekly_documents_inclusive(spark, d):
    return reports.documents_of_week(b.newsletters(spark, d), WEEK, whole_sunday=True)


@query("SELECT week_id, topic, count(*) AS newsletters FROM (SELECT strftime(received_date, '%G-W%V') AS week_id, unnest(list_distinct(topics)) AS topic FROM n WHERE received_date IS NOT NULL) GROUP BY 1, 2")
def weekly_topic_docs(spark, d):
    return reports.weekly_topics(b.newsletters(spark, d))


_WEEKLY = "(SELECT user_id, id AS rule_id, unnest(list_distinct(topics)) AS topic FROM r WHERE is_active AND delivery_frequency = 'weekly')"


@query(f"SELECT x.user_id, rep.id AS report_id, x.rule_id, 'pending' AS status, rep.week_id AS digest_batch_id, 'weekly' AS notification_type FROM {_WEEKLY} x JOIN rep ON x.topic = rep.topic WHERE rep.week_id = '{WEEK}'")
def weekly_queue(spark, d):
    return reports.queue_weekly(b.rules(spark, d), b.reports(spark, d), WEEK, F.current_timestamp()).select("user_id", "report_id", "rule_id", "status", "digest_batch_id", "notification_type")


@query(f"SELECT count(report_id) AS queued, count(*) - count(report_id) AS skipped, count(DISTINCT CASE WHEN report_id IS NOT NULL THEN user_id END) AS users FROM (SELECT x.user_id, y.id AS report_id FROM {_WEEKLY} x LEFT JOIN (SELECT * FROM rep WHERE week_id = '{WEEK}') y ON x.topic = y.topic)")
def weekly_run_stats(spark, d):
    return reports.weekly_stats(b.rules(spark, d), b.reports(spark, d), b.queue(spark, d), WEEK)


# --- digests -----------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS pending, strftime(min(created_at), '%Y-%m-%d') AS oldest, strftime(max(created_at), '%Y-%m-%d') AS newest, array_to_string(list(id ORDER BY created_at, id), ',') AS ids FROM q WHERE status = 'pending' GROUP BY user_id")
def pending_by_user(spark, d):
    g = digest.by_user(digest.pending(b.queue(spark, d)))
    return g.select("user_id", "pending", F.date_format("oldest", "yyyy-MM-dd").alias("oldest"), F.date_format("newest", "yyyy-MM-dd").alias("newest"), F.array_join("ids", ",").alias("ids"))


@query("SELECT q.id, q.user_id, q.newsletter_id, n.subject, s.name AS source_name, r.name AS rule_name FROM q LEFT JOIN n ON q.newsletter_id = n.id LEFT JOIN s ON n.source_id = s.id LEFT JOIN r ON q.rule_id = r.id WHERE q.status = 'pending' AND q.digest_batch_id = '1996-05'")
def queue_with_content(spark, d):
    rows = digest.with_content(digest.pending(b.queue(spark, d), "1996-05"), b.newsletters(spark, d), b.sources(spark, d), b.rules(spark, d))
    return rows.select("id", "user_id", "newsletter_id", F.col("newsletter.subject").alias("subject"), F.col("newsletter.source.name").alias("source_name"), F.col("rule.name").alias("rule_name"))


@query("""SELECT user_id, newsletter_id, array_to_string(list(name ORDER BY first_at, qid), ',') AS matched_rules FROM (SELECT user_id, newsletter_id, name, min(created_at) AS first_at, arg_min(id, (created_at, id)) AS qid FROM (SELECT q.user_id, q.newsletter_id, r.name, q.created_at, q.id FROM q JOIN r ON q.rule_id = r.id WHERE q.newsletter_id IS NOT NULL) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def digest_rules(spark, d):
    names = b.rules(spark, d).select(F.col("id").alias("_r"), F.col("name").alias("rule_name"))
    rows = b.queue(spark, d).where("newsletter_id is not null").join(names, F.col("rule_id") == F.col("_r"))
    return digest.rules_of_documents(rows).select("user_id", "newsletter_id", F.array_join("matched_rules", ",").alias("matched_rules"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT coalesce(report_id, newsletter_id))), ',') AS content_ids, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rule_ids FROM q WHERE status = 'pending' GROUP BY user_id")
def content_ids(spark, d):
    return digest.content_ids(digest.pending(b.queue(spark, d))).select("user_id", F.array_join("content_ids", ",").alias("content_ids"), F.array_join("rule_ids", ",").alias("rule_ids"))


@query("SELECT rep.id AS report_id, row_number() OVER (PARTITION BY rep.id ORDER BY ward_number NULLS LAST, n.id) AS place, s.ward_number, n.id, n.subject FROM (SELECT id, unnest(newsletter_ids) AS nid FROM rep) rep JOIN n ON rep.nid = n.id LEFT JOIN s ON n.source_id = s.id")
def report_references(spark, d):
    return digest.referenced(b.reports(spark, d), b.newsletters(spark, d), b.sources(spark, d)).select("report_id", F.col("place").cast("long").alias("place"), "ward_number", "id", "subject")


@query("""SELECT user_id, count(*) AS items, length(string_agg(k::VARCHAR || '. ' || title || chr(10) || 'From: ' || source_name || ward || chr(10) || 'Date: ' || day || chr(10) || '✓ Matched your rules: ' || matched || chr(10) || CASE WHEN summary <> '' THEN chr(10) || summary || chr(10) ELSE '' END || CASE WHEN len(topics) > 0 THEN chr(10) || 'Topics: ' || array_to_string(topics, ', ') || chr(10) ELSE '' END
  || chr(10) || 'Read more: https://example.org/newsletter/' || newsletter_id || chr(10) || chr(10) || repeat('-', 60) || chr(10) || chr(10), '' ORDER BY k)) AS characters, md5(string_agg(title || '|' || matched || '|' || day, '' ORDER BY k)) AS digest FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY received_date DESC NULLS LAST, newsletter_id) AS k FROM (SELECT q.user_id, q.newsletter_id, any_value(n.subject) AS title, any_value(s.name) AS source_name, coalesce(any_value(' (Ward ' || s.ward_number || ')'), '') AS ward, any_value(n.received_date) AS received_date, coalesce(any_value(strftime(n.received_date, '%B %d, %Y')), 'Unknown date') AS day, coalesce(any_value(n.summary), '') AS summary, coalesce(any_value(n.topics), [])[1:5] AS topics, any_value(f.matched) AS matched
  FROM q JOIN n ON q.newsletter_id = n.id LEFT JOIN s ON n.source_id = s.id JOIN (SELECT user_id, newsletter_id, array_to_string(list(name ORDER BY first_at, qid), ', ') AS matched FROM (SELECT user_id, newsletter_id, name, min(created_at) AS first_at, arg_min(id, (created_at, id)) AS qid FROM (SELECT q.user_id, q.newsletter_id, coalesce(r.name, 'Unknown') AS name, q.created_at, q.id FROM q LEFT JOIN r ON q.rule_id = r.id WHERE q.newsletter_id IS NOT NULL AND status = 'pending') GROUP BY 1, 2, 3) GROUP BY 1, 2) f ON f.user_id = q.user_id AND f.newsletter_id = q.newsletter_id WHERE q.status = 'pending' GROUP BY q.user_id, q.newsletter_id)) GROUP BY user_id""")
def daily_digest(spark, d):
    rows = digest.with_content(digest.pending(b.queue(spark, d), kind="daily"), b.newsletters(spark, d), b.sources(spark, d), b.rules(spark, d))
    items = digest.prepared(rows, "https://example.org")
    body = digest.daily_digests(items, "https://example.org/preferences")
    order = F.array_sort(F.collect_list(F.struct(F.col("received_date").isNull().alias("a"), (-F.unix_timestamp("received_date")).alias("b"), "newsletter_id", F.concat_ws("|", "title", F.array_join("matched_rules", ", "), "date_formatted").alias("t"))))
    plain = items.groupBy("user_id").agg(F.md5(F.array_join(F.transform(order, lambda x: x["t"]), "")).alias("digest"))
    # without the head and the foot, whose lengths are known
    inner = F.length("text_body") - F.length(F.concat(F.lit("You have "), F.col("items").cast("string"), F.lit(" newsletters to review:\n\n\nChange what you get: https://example.org/preferences\n")))
    return body.join(plain, "user_id").select("user_id", F.col("items").cast("long").alias("items"), inner.cast("long").alias("characters"), "digest")


@query(None)
def weekly_digest(spark, d):
    """Weekly digests in full; tests hold their parts against written-out texts."""
    rep = b.reports(spark, d).withColumn("report_summary", F.concat(F.lit("About "), F.col("topic"), F.lit("\n\nMore")))
    q = reports.queue_weekly(b.rules(spark, d), rep, WEEK, F.lit("2024-02-05").cast("timestamp")).withColumn("id", F.concat_ws("|", "user_id", "report_id", "rule_id"))
    refs = digest.referenced(rep.where(F.col("week_id") == WEEK), b.newsletters(spark, d), b.sources(spark, d))
    return digest.weekly_digests(q, rep, b.rules(spark, d), refs, "https://example.org")


@query("""SELECT count(*) FILTER (o = 'sent') AS sent, 0::BIGINT AS failed, count(*) FILTER (o <> 'sent') AS skipped FROM (SELECT CASE WHEN NOT coalesce((u.prefs::JSON ->> 'enabled')::BOOLEAN, true) THEN 'off' WHEN count(n.id) = 0 THEN 'empty' ELSE 'sent' END AS o FROM q JOIN u ON q.user_id = u.id LEFT JOIN n ON coalesce(q.report_id, q.newsletter_id) = n.id WHERE q.status = 'pending' AND q.digest_batch_id = '1996-05' GROUP BY u.id, u.prefs)""")
def digest_run_stats(spark, d):
    contents = b.newsletters(spark, d).select(F.col("id").alias("content_id"))
    q = b.queue(spark, d).withColumns({"sent_at": F.lit(None).cast("timestamp"), "error_message": F.lit(None).cast("string")})
    return digest_plan.run(q, b.profiles(spark, d), contents, F.lit("1996-06-01").cast("timestamp"), "1996-05")["stats"]


@query("""SELECT q.id, q.user_id, CASE WHEN o.o IS NULL THEN q.status WHEN o.o = 'sent' THEN 'sent' ELSE 'failed' END AS status, CASE o.o WHEN 'off' THEN 'notifications disabled' WHEN 'empty' THEN 'Empty digest content' END AS error_message FROM q LEFT JOIN (
  SELECT u.id, CASE WHEN NOT coalesce((u.prefs::JSON ->> 'enabled')::BOOLEAN, true) THEN 'off' WHEN count(n.id) = 0 THEN 'empty' ELSE 'sent' END AS o FROM q JOIN u ON q.user_id = u.id LEFT JOIN n ON coalesce(q.report_id, q.newsletter_id) = n.id WHERE q.status = 'pending' AND q.digest_batch_id = '1996-05' GROUP BY u.id, u.prefs) o ON q.user_id = o.id AND q.status = 'pending' AND q.digest_batch_id = '1996-05'""")
def digest_run_queue(spark, d):
    contents = b.newsletters(spark, d).select(F.col("id").alias("content_id"))
    q = b.queue(spark, d).withColumns({"sent_at": F.lit(None).cast("timestamp"), "error_message": F.lit(None).cast("string")})
    return digest_plan.run(q, b.profiles(spark, d), contents, F.lit("1996-06-01").cast("timestamp"), "1996-05")["queue"].select("id", "user_id", "status", "error_message")


# --- changes -----------------------------------------------------------------------------------------------------


@query("SELECT user_id, report_id, rule_id, min(id) AS id FROM q WHERE report_id IS NOT NULL AND status <> 'sent' AND (user_id, report_id, rule_id) NOT IN (SELECT (user_id, report_id, rule_id) FROM q WHERE status = 'sent' AND report_id IS NOT NULL) GROUP BY 1, 2, 3")
def insert_ignore(spark, d):
    q = b.queue(spark, d).where("report_id is not null")
    old, new = q.where("status = 'sent'"), q.where("status <> 'sent'")
    return store.newcomers(old, new, ["user_id", "report_id", "rule_id"], ["id"]).select("user_id", "report_id", "rule_id", "id")


@query("SELECT topic, week_id, CASE WHEN week_id >= '2024-W05' THEN 'new' ELSE 'old' END AS state FROM rep WHERE week_id <= '2024-W08'")
def upsert_reports(spark, d):
    rep = b.reports(spark, d).where("week_id <= '2024-W08'")
    old = rep.where("week_id <= '2024-W06'").select("topic", "week_id", F.lit("old").alias("state"), F.lit(0).alias("version"))
    new = rep.where("week_id >= '2024-W05'").select("topic", "week_id", F.explode(F.array(F.struct(F.lit("draft").alias("state"), F.lit(1).alias("version")), F.struct(F.lit("new").alias("state"), F.lit(2).alias("version")))).alias("x")).select("topic", "week_id", "x.*")
    return store.upsert(old, new, ["topic", "week_id"], ["version"]).select("topic", "week_id", "state")


@query("SELECT id, CASE WHEN newsletter_id IN (SELECT id FROM n WHERE summary IS NULL) THEN 'failed' ELSE status END AS status FROM q")
def update_by_ids(spark, d):
    lacking = b.newsletters(spark, d).where("summary is null").select("id")
    ids = b.queue(spark, d).join(lacking.withColumnRenamed("id", "_n"), F.col("newsletter_id") == F.col("_n")).select("id")
    return store.update_ids(b.queue(spark, d), ids, status=F.lit("failed")).select("id", "status")


@query("SELECT q.id FROM q WHERE rule_id IN (SELECT id FROM r WHERE is_active)")
def delete_cascade(spark, d):
    gone = b.rules(spark, d).where("not is_active")
    left = store.delete(b.rules(spark, d), gone, ["id", "user_id"])
    return store.cascade(b.queue(spark, d), left, "rule_id").select("id")


@query("SELECT id, fault FROM (SELECT id, 'second_newsletter_id' AS fault FROM (SELECT id, row_number() OVER (PARTITION BY user_id, newsletter_id, rule_id ORDER BY id) AS k FROM q WHERE newsletter_id IS NOT NULL) WHERE k > 1 UNION ALL SELECT id, 'second_report_id' FROM (SELECT id, row_number() OVER (PARTITION BY user_id, report_id, rule_id ORDER BY id) AS k FROM q WHERE report_id IS NOT NULL) WHERE k > 1)")
def constraint_audit(spark, d):
    return store.queue_faults(b.queue(spark, d))


@query("SELECT id, 'weekly_wards' AS fault FROM r WHERE delivery_frequency = 'weekly' AND len(ward_numbers) > 0")
def rule_audit(spark, d):
    return store.rule_faults(b.rules(spark, d))


@query("SELECT user_id, count(*) AS rules, count(*) < 5 AS may_add FROM r GROUP BY user_id")
def rule_limit(spark, d):
    return store.rules_per_user(b.rules(spark, d))


@query("""SELECT r.id, CASE WHEN delivery_frequency = 'weekly' AND len(topics) = 0 THEN 'a weekly rule needs a topic' WHEN delivery_frequency = 'weekly' AND len(ward_numbers) > 0 THEN 'a weekly rule has no wards' WHEN delivery_frequency = 'daily' AND len(topics) = 0 AND coalesce(trim(search_term), '') = '' THEN 'a daily rule needs a topic or a search term' WHEN c.k >= 5 THEN 'too many rules' END AS error FROM r JOIN (SELECT user_id, count(*) AS k FROM r GROUP BY 1) c USING (user_id)""")
def rule_validation(spark, d):
    r = b.rules(spark, d)
    return r.join(store.rules_per_user(r).select("user_id", "rules"), "user_id").select("id", store.new_rule_error(F.col("rules")).alias("error"))


@query("SELECT DISTINCT email_uid FROM n WHERE source_id < 10 AND email_uid NOT IN (SELECT email_uid FROM n WHERE source_id >= 10)")
def new_messages(spark, d):
    n = b.newsletters(spark, d)
    return store.newcomers(n.where("source_id >= 10"), n.where("source_id < 10"), ["email_uid"], ["id"]).select("email_uid")


# --- texts -------------------------------------------------------------------------------------------------------

_PRIVATE = ["thin", "of the"]
_ODD_ENDS = r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@query("SELECT doc_id, array_to_string(list_filter(CASE WHEN ends_with(x, chr(10)) THEN string_split(x[:-2], chr(10)) ELSE string_split(x, chr(10)) END, lambda l: NOT regexp_matches(l, " + _q("|".join(f"(?:{p})" for p in [*URL_PATTERNS, "zon"])) + ", 'i') AND NOT regexp_matches(l, " + _q(r"^\s*(?:" + "|".join(f"(?:{p})" for p in TEXT_PATTERNS) + r")\s*$") + ", 'i')), chr(10)) AS clean FROM (SELECT doc_id, regexp_replace(text, " + _q(_ODD_ENDS) + ", ' ', 'g') AS x FROM documents)", False)
def sanitize_text(spark, d):
    t = F.regexp_replace("text", _ODD_ENDS, " ")
    return table(spark, d, "documents").select("doc_id", text.sanitize_text(t, [*URL_PATTERNS, "zon"]).alias("clean"))


@query("SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), 'thin', '[REDACTED]', 'gi'), 'of the', '[REDACTED]', 'gi') AS clean FROM documents", False)
def redact(spark, d):
    return table(spark, d, "documents").select("doc_id", text.redact(F.col("text"), _PRIVATE).alias("clean"))


@query("SELECT id, nullif(regexp_replace(regexp_extract(from_email, '^(.+?)\\s*<', 1), '^[\"'']+|[\"'']+$', '', 'g'), '') AS name FROM n")
def sender_name(spark, d):
    return b.newsletters(spark, d).select("id", text.sender_name(F.col("from_email")).alias("name"))


@query("SELECT doc_id, substring(text, 1, 100000) AS cut, length(substring(text, 1, 100000))::INT AS n FROM documents", False)
def truncate_text(spark, d):
    cut = text.truncated(F.col("text"), 100_000)
    return table(spark, d, "documents").select("doc_id", cut.alias("cut"), F.length(cut).alias("n"))


@query(r"SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: '<p>' || x || '</p>'), chr(10)) AS html FROM documents", False)
def paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("html"))


_ANSWER = """'Here: ```json' || chr(10) || '{"characters": ' || length(coalesce(text, ''))::VARCHAR || ', "role": "' || coalesce(role, '') || '"}' || chr(10) || '```' || chr(10) || coalesce(text, '')"""


@query(f"SELECT conv_id, turn, regexp_extract({_ANSWER}, '\\{{[^}}]*\\}}') AS json FROM conversations", False)
def json_in_answers(spark, d):
    """The JSON before each text of a conversation, whatever the text holds."""
    told = F.coalesce("text", F.lit(""))
    answer = F.concat(F.lit('Here: ```json\n{"characters": '), F.length(told).cast("string"), F.lit(', "role": "'), F.coalesce("role", F.lit("")), F.lit('"}\n```\n'), told)
    return table(spark, d, "conversations").select("conv_id", "turn", text.json_in(answer).alias("json"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages", False)
def page_titles(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a [^>]*href="), F.lit(0))).cast("long").alias("links"))


@query('''SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages''', False)
def extract_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages", False)
def strip_html(spark, d):
    t = F.col("html")
    for p in ("(?s)<script.*?</script>", "(?s)<style.*?</style>", "<[^>]*>", r"\s+"):
        t = F.regexp_replace(t, p, " ")
    return table(spark, d, "pages").select("page_id", F.trim(t).alias("plain"))


@query(None)
def sanitize_html(spark, d):
    """An HTML tree has no counterpart in SQL; tests hold the cases of the fixtures."""
    return table(spark, d, "pages").select("page_id", html.sanitize_html(F.col("html")).alias("html"))


@query(None)
def html_to_text(spark, d):
    """Markdown of pages; see sanitize_html."""
    return table(spark, d, "pages").select("page_id", html.html_to_text(F.col("html")).alias("plain"))


# --- topics and preferences --------------------------------------------------------------------------------------

_OLD = list(RENAMED_TOPICS) + ["gone_topic"]
_OLD_SQL = "[" + ", ".join(map(_q, _OLD)) + "]"


def _old_topics(spark, d):
    names = F.array(*map(F.lit, _OLD))
    pick = lambda k: F.element_at(names, (F.col("doc_id") * k % len(_OLD) + 1).cast("int"))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array(pick(1), pick(3), pick(5)).alias("topics"))


_CHANGES = f"""WITH o AS (SELECT doc_id::VARCHAR AS id, [{", ".join(f"({_OLD_SQL})[doc_id * {k} % {len(_OLD)} + 1]" for k in (1, 3, 5))}] AS topics FROM documents),
c AS (SELECT id, topics, list_sort(list_distinct(list_filter(list_transform(topics, lambda t: {_MAP}), lambda t: list_contains({_KNOWN}, t)))) AS new_topics FROM o)
"""


@query(_CHANGES + "SELECT id, array_to_string(new_topics, ',') AS topics, list_sort(list_distinct(topics)) <> new_topics AS modified FROM c", False)
def remap_topics(spark, d):
    return reports.migration(_old_topics(spark, d)).select("id", F.array_join("new_topics", ",").alias("topics"), "modified")


@query(_CHANGES + f"SELECT old_topic, new_topic, count(*) AS n FROM (SELECT t AS old_topic, CASE WHEN list_contains({_KNOWN}, {_MAP}) THEN {_MAP} END AS new_topic FROM (SELECT unnest(topics) AS t FROM c WHERE list_sort(list_distinct(topics)) <> new_topics)) WHERE new_topic IS NULL OR new_topic <> old_topic GROUP BY 1, 2", False)
def migration_stats(spark, d):
    return reports.migration_stats(reports.migration(_old_topics(spark, d)))[1]


@query(f"SELECT id, array_to_string(list_filter(topics, lambda t: list_contains({_KNOWN}, t)), ',') AS topics FROM (SELECT doc_id::VARCHAR AS id, [{', '.join(f'({_OLD_SQL})[doc_id * {k} % {len(_OLD)} + 1]' for k in (1, 3, 5))}] AS topics FROM documents)", False)
def topic_whitelist(spark, d):
    return _old_topics(spark, d).select("id", F.array_join(arrays.known_topics(F.col("topics")), ",").alias("topics"))


@query("SELECT topic, CASE topic " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in TOPIC_NAMES.items()) + " END AS name, count(*) AS newsletters FROM (SELECT unnest(topics) AS topic FROM n) GROUP BY topic")
def topic_names(spark, d):
    return b.newsletters(spark, d).select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("newsletters")).select("topic", text.topic_name(F.col("topic")).alias("name"), "newsletters")


@query("SELECT event_id, coalesce((props::JSON ->> 'enabled')::BOOLEAN, true) AS enabled, (props::JSON ->> 'k')::INT AS k FROM events", False)
def json_pref_default(spark, d):
    return table(spark, d, "events").select("event_id", arrays.enabled(F.col("props")).alias("enabled"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago', '%Y-%m-%d') AS queued_in, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' - to_days(1), '%Y-%m-%d') AS daily, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' - to_days(7), '%G-W%V') AS weekly FROM events", False)
def chicago_batch_id(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", dates.queue_batch(ts).alias("queued_in"), dates.daily_batch(ts).alias("daily"), dates.weekly_batch(ts).alias("weekly"))


@query("SELECT id, true AS fresh, false AS expired, false AS altered, false AS foreign_key, false AS other FROM u WHERE coalesce((prefs::JSON ->> 'enabled')::BOOLEAN, true)")
def signed_tokens(spark, d):
    """Whether tokens prove to be their users': fresh ones do, those that are too old, altered, signed by others or for others don't."""
    now = F.lit(1_700_000_000)
    u = b.profiles(spark, d).where(arrays.enabled(F.col("notification_preferences")))
    token = lambda t=now, secret="secret", who="id": signed.token_for(F.col(who) if who == "id" else F.lit(who), t, secret)
    made = u.select("id", token().alias("a"), token(now - 91 * 86400).alias("b"), token(secret="stolen").alias("c"), token(who="nobody").alias("d"))
    made = made.withColumn("e", F.concat(F.substring_index("d", ".", 2), F.lit("."), F.substring_index("a", ".", -1)))
    proves = lambda c: F.coalesce(signed.subject_of(F.col(c), now + 1, "secret") == F.col("id"), F.lit(False))
    return made.select("id", proves("a").alias("fresh"), proves("b").alias("expired"), proves("e").alias("altered"), proves("c").alias("foreign_key"), proves("d").alias("other"))


# --- costs -------------------------------------------------------------------------------------------------------

_EACH = f"""t AS (SELECT id, operation, (ceil(length(substring(plain_text, 1, 100000)) / 4) + CASE operation {" ".join(f"WHEN '{k}' THEN {v}" for k, v in costs.PROMPT_TOKENS.items())} END)::BIGINT AS i, CASE operation {" ".join(f"WHEN '{k}' THEN {v}" for k, v in costs.RESPONSE_TOKENS.items())} END::BIGINT AS o FROM n, (SELECT unnest({costs.DOCUMENT_OPERATIONS}) AS operation) WHERE coalesce(plain_text, '') <> '')
"""


@query(", " + _EACH + "SELECT operation, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(i)::BIGINT::DOUBLE / 1000000 * 1.25, 6) AS input_cost, round(sum(o)::BIGINT::DOUBLE / 1000000 * 10.0, 6) AS output_cost, round(sum(i)::BIGINT::DOUBLE / 1000000 * 1.25 + sum(o)::BIGINT::DOUBLE / 1000000 * 10.0, 6) AS total_cost, (sum(i)::BIGINT // count(*))::BIGINT AS average_input, round(sum(i)::BIGINT::DOUBLE / 1000000 * 1.25 + sum(o)::BIGINT::DOUBLE / 1000000 * 10.0, 6) / count(*) AS average_cost FROM t GROUP BY operation")
def cost_by_operation(spark, d):
    return costs.by_operation(costs.document_tokens(b.newsletters(spark, d)), 1.25, 10.0)


@query(", " + _EACH + "SELECT documents, per_month, round(each * per_month, 6) AS monthly_cost FROM (SELECT count(DISTINCT id) AS documents, round(sum(i)::BIGINT::DOUBLE / 1000000 * 1.25 + sum(o)::BIGINT::DOUBLE / 1000000 * 10.0, 6) / count(DISTINCT id) AS each FROM t), (SELECT unnest([100, 1000])::BIGINT AS per_month)")
def cost_projection(spark, d):
    return costs.projected(costs.document_tokens(b.newsletters(spark, d)), 1.25, 10.0)


@query(", " + _EACH + ", a AS (SELECT sum(i)::BIGINT::DOUBLE AS i, sum(o)::BIGINT::DOUBLE AS o FROM t), x AS (SELECT provider, model, round(i / 1000000 * input_cost_per_1m, 6) AS input_cost, round(o / 1000000 * output_cost_per_1m, 6) AS output_cost, round(i / 1000000 * input_cost_per_1m + o / 1000000 * output_cost_per_1m, 6) AS total_cost FROM p, a) SELECT *, round(total_cost / (SELECT min(total_cost) FROM x), 4) AS times_cheapest FROM x")
def cost_model_comparison(spark, d):
    return costs.compared(costs.document_tokens(b.newsletters(spark, d)), b.prices(spark, d))


@query(f""", w AS (SELECT week_id, topic, count(*) AS k, (sum(c) + count(*) * {costs.PROMPT_TOKENS["weekly_facts"]} + least(count(*), 10) * 40 + {costs.PROMPT_TOKENS["weekly_synthesis"]})::BIGINT AS i, (count(*) * 200 + 800)::BIGINT AS o FROM (SELECT strftime(received_date, '%G-W%V') AS week_id, unnest(list_distinct(topics)) AS topic, ceil(length(substring(plain_text, 1, 100000)) / 4)::BIGINT AS c FROM n WHERE received_date IS NOT NULL AND coalesce(plain_text, '') <> '') GROUP BY 1, 2)
SELECT week_id, topic, k AS newsletters, i AS input_tokens, o AS output_tokens FROM w""")
def weekly_tokens(spark, d):
    return costs.weekly_tokens(b.newsletters(spark, d))


@query("SELECT provider, count(*) AS models FROM p GROUP BY provider")
def price_providers(spark, d):
    return costs.providers(b.prices(spark, d)).join(costs.models(b.prices(spark, d)), "provider").groupBy("provider").agg(F.count("*").alias("models"))


_ENCODING = "CASE " + " ".join(f"WHEN starts_with(lower(m), '{k}') THEN '{v}'" for k, v in ENCODINGS.items()) + f" ELSE '{DEFAULT_ENCODING}' END"
_MODELS = ["gpt-5", "gpt-4o", "gpt-4", "llama", "qwen"]


@query(f"SELECT p_partkey, m AS model, {_ENCODING} AS encoding FROM (SELECT p_partkey, ({_MODELS})[p_partkey % 5 + 1] || '-' || p_size::VARCHAR AS m FROM part)", False)
def model_encoding(spark, d):
    m = F.concat(F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("-"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", m.alias("model"), cost.encoding_of(m).alias("encoding"))


# --- enrichment and pipelines ------------------------------------------------------------------------------------


@query(None)
def resanitize(spark, d):
    """Sanitizes pages and texts again; tests check that a second time changes nothing."""
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("raw_html"), F.col("html").alias("plain_text"))
    return ingest.resanitized(pages).select("id", "modified", F.length("difference").cast("long").alias("difference"))


from . import plan_queries, stream_queries  # noqa: E402, F401  register their own
