"""Queries of whole plans: enrichment, weekly reports, ingest, costs, and of the small operators that they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from .constants import TOPICS
from .functions import answers, cost, dates, html, prompts, text
from .operators import costs, reports, search, store
from .plans import analysis, enrich, ingest, remembered, unsubscribe, weekly
from .plans import digests as digest_plan
from .registry import WEEK, query, quoted, with_ward
from .session import shared_place
from .sources import bindings as b
from .sources import mail as mail_source
from .sources.tables import table, with_archive

_LEXICON = dict(zip(TOPICS, ([m.strip()] for m in b.MARKERS), strict=True))


def _lexicon() -> enrich.Lexicon:
    return enrich.Lexicon(_LEXICON)


class Picky(enrich.Lexicon):
    """Fails on what it doesn't like, for the table of failures."""

    def topics(self, content: str) -> list[str]:
        if "license" in content.lower():
            raise ValueError("no topics here")
        return super().topics(content)

    def summary(self, content: str) -> str:
        if len(content) < 200:
            raise LookupError("too short")
        return super().summary(content)


# --- enrichment --------------------------------------------------------------------------------------------------

#: Sentences as the lexicon cuts them, of a content c.
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(c, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(c), {quoted(w[0])}) THEN {quoted(t)} END" for t, w in _LEXICON.items()) + "], lambda x: x IS NOT NULL)"
_CONTENT = "SELECT id, 'Subject: ' || coalesce(subject, '') || chr(10) || chr(10) || coalesce(substring(plain_text, 1, 100000), '') AS c FROM n"
_ENRICHED = f"SELECT id, topics, summary, least(10, 2 * len(topics) + CASE WHEN summary <> '' THEN 1 ELSE 0 END)::INT AS relevance_score FROM (SELECT id, {_FOUND} AS topics, substring(array_to_string({_SENTENCES}[1:2], ' '), 1, 2000) AS summary FROM ({_CONTENT}))"


@query(f"SELECT id, array_to_string(topics, ',') AS topics, summary, relevance_score FROM ({_ENRICHED})")
def enrich_documents(spark, d):
    """The shipped lexicon in one pass."""
    return enrich.enriched(b.newsletters(spark, d), _lexicon).withColumn("topics", F.array_join("topics", ","))


@query(f"SELECT id, array_to_string(topics, ',') AS topics, summary, relevance_score FROM ({_ENRICHED})")
def enrich_remembered(spark, d):
    """The same by answers kept from a first run over two documents of three, with changed subjects among them."""
    n, place = b.newsletters(spark, d), f"{shared_place(spark)}/answers"
    some = n.where(F.pmod(F.xxhash64("id"), F.lit(3)) > 0).withColumn("subject", F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 1, F.lit("other")).otherwise(F.col("subject")))
    remembered.remembered(some, place, "lexicon 1", _lexicon)
    return remembered.remembered(n, place, "lexicon 1", _lexicon, at_once=4).select("id", F.array_join("topics", ",").alias("topics"), "summary", "relevance_score")


@query(f"SELECT id AS key, unnest(CASE WHEN contains(lower(c), 'license') THEN ['topics'] ELSE [] END || CASE WHEN length(c) < 200 THEN ['summary'] ELSE [] END) AS step, CASE step WHEN 'topics' THEN 'ValueError: no topics here' ELSE 'LookupError: too short' END AS error FROM ({_CONTENT})")
def dead_letters(spark, d):
    """What an enricher that fails now and then leaves behind."""
    rows = enrich.enriched(b.newsletters(spark, d), lambda: Picky(_LEXICON), failures=True)
    return enrich.dead_letters(rows, F.current_timestamp()).select("key", "step", "error")


_OWN = f"SELECT topic, n.id, coalesce(substring(n.plain_text, 1, 100000), '') AS c FROM (SELECT id, plain_text, unnest(list_distinct(topics)) AS topic FROM n WHERE received_date >= TIMESTAMP '2024-01-29' AND received_date <= TIMESTAMP '2024-02-04') n"
_MARK = "CASE topic " + " ".join(f"WHEN {quoted(t)} THEN {quoted(w[0])}" for t, w in _LEXICON.items()) + " END"


def _synthesis(wanted: str) -> str:
    """Facts, synthesis by block and of the blocks' texts, for topics that fit a condition and have at most BLOCK * BLOCK documents."""
    block = f"(('0x' || substring(md5({{}}), 1, 8))::BIGINT % ceil({{}} / {enrich.BLOCK}.0)::BIGINT)"
    return f"""own AS ({_OWN} WHERE {wanted}),
cnt AS (SELECT topic, count(*) AS k FROM own GROUP BY topic),
facts AS (SELECT topic, id, k, list_transform(list_filter({_SENTENCES}, lambda x: contains(lower(x), {_MARK})), lambda x: substring(x, 1, 2000))[1:3] AS f FROM own JOIN cnt USING (topic)),
fact AS (SELECT topic, id, k, unnest(f) AS fact, generate_subscripts(f, 1) AS place FROM facts),
lvl1 AS (SELECT topic, any_value(k) AS k, {block.format("id", "k")} AS block, substring(array_to_string(list(fact ORDER BY id, place)[1:5], ' '), 1, 5000) AS t FROM fact GROUP BY topic, {block.format("id", "k")}),
most AS (SELECT max(k) AS m FROM cnt),
lvl2 AS (SELECT topic, substring(array_to_string(list(t ORDER BY block)[1:5], ' '), 1, 5000) AS t FROM lvl1 WHERE trim(t) <> '' GROUP BY topic),
made AS (SELECT topic, t AS report_summary FROM lvl2 WHERE trim(t) <> '')"""


@query(", " + _synthesis("true") + f" SELECT topic, '{WEEK}' AS week_id, report_summary, (SELECT count(DISTINCT id) FROM own WHERE own.topic = made.topic) AS newsletters, (SELECT count(*) FROM fact WHERE fact.topic = made.topic) AS developments FROM made")
def weekly_reports(spark, d):
    """Facts and syntheses of the shipped lexicon."""
    own = reports.documents_of_week(b.newsletters(spark, d), WEEK)
    full = own.join(with_ward(spark, d).select("id", "plain_text", "ward_number"), "id")
    return enrich.reports(full, WEEK, _lexicon).select("topic", "week_id", "report_summary", F.size("newsletter_ids").cast("long").alias("newsletters"), F.size("key_developments").cast("long").alias("developments"))


def _weekly_run(spark, d):
    old = b.reports(spark, d).where(F.col("topic").isin(TOPICS[:4])).withColumn("report_summary", F.lit("old"))
    return weekly.run(with_ward(spark, d), b.rules(spark, d), old, WEEK, F.lit("2024-02-05").cast("timestamp"), _lexicon, known=TOPICS)


_OLD4 = "topic IN (" + ", ".join(map(quoted, TOPICS[:4])) + ")"
_ACTIVE = "topic IN (SELECT unnest(topics) FROM r WHERE is_active AND delivery_frequency = 'weekly')"
_TODO = f"{_ACTIVE} AND topic NOT IN (SELECT topic FROM rep WHERE week_id = '{WEEK}' AND {_OLD4})"


@query(", " + _synthesis(_TODO) + f" SELECT id, topic, week_id, 'old' AS report_summary, len(newsletter_ids) AS newsletters FROM rep WHERE {_OLD4} UNION ALL SELECT topic || '|{WEEK}', topic, '{WEEK}', report_summary, (SELECT count(DISTINCT id) FROM own WHERE own.topic = made.topic) FROM made")
def weekly_report_run(spark, d):
    """Reports after a run: what was there stays, topics without a report of the week get one."""
    return _weekly_run(spark, d)["reports"].select("id", "topic", "week_id", "report_summary", F.size("newsletter_ids").cast("long").alias("newsletters"))


@query(", " + _synthesis(_TODO) + f" SELECT count(*) FILTER (topic IN (SELECT topic FROM made)) AS generated, count(*) FILTER (topic NOT IN (SELECT topic FROM made)) AS skipped, 0::BIGINT AS failed FROM (SELECT DISTINCT unnest(topics) AS topic FROM r WHERE is_active AND delivery_frequency = 'weekly')")
def weekly_report_stats(spark, d):
    return _weekly_run(spark, d)["stats"]


_P = {o: prompts.TEMPLATES[o].replace("{{", "{").replace("}}", "}") for o in costs.DOCUMENT_OPERATIONS}
_FILLED = {o: quoted(t).replace("{content}", "' || c || '").replace("{topics}", "' || coalesce(array_to_string(topics, ', '), '') || '").replace("{summary}", "' || coalesce(summary, '') || '") for o, t in _P.items()}
_CALLS = "SELECT id, unnest([" + ", ".join(f"{{'o': '{o}', 'p': {t}}}" for o, t in _FILLED.items()) + "]) AS x FROM (SELECT id, topics, summary, 'Subject: ' || coalesce(subject, '') || chr(10) || chr(10) || substring(plain_text, 1, 100000) AS c FROM n WHERE coalesce(plain_text, '') <> '')"


@query(f"SELECT id, x.o AS operation, ceil(length(x.p) / 4)::BIGINT AS input_tokens, CASE x.o " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in costs.RESPONSE_TOKENS.items()) + f" END::BIGINT AS output_tokens FROM ({_CALLS})")
def call_tokens(spark, d):
    """Tokens of whole prompts, four characters each."""
    return costs.call_tokens(b.newsletters(spark, d))


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE ceil(strlen(text) / 3) END::BIGINT AS tokens FROM documents", False)
def tokens_by_function(spark, d):
    """Tokens by a counting function of the caller's: three bytes each."""
    count = cost.token_counter(lambda: lambda t: -(-len(t.encode()) // 3))
    return table(spark, d, "documents").select("doc_id", count(F.col("text")).alias("tokens"))


_ANSWERED = """SELECT conv_id, turn, text, CASE WHEN turn % 5 = 4 THEN 'not JSON' WHEN text IS NULL THEN 'missing' WHEN length(text) > 2000 THEN 'too long' END AS summary_error, (length(coalesce(text, '')) % 14 - 1)::INT AS score FROM conversations"""


@query(f"SELECT conv_id, turn, CASE WHEN summary_error IS NULL THEN length(text) END::INT AS characters, summary_error, CASE WHEN score BETWEEN 0 AND 10 THEN score END AS score, CASE WHEN score NOT BETWEEN 0 AND 10 THEN 'out of bounds' END AS score_error FROM ({_ANSWERED})", False)
def typed_answers(spark, d):
    """Answers made of the texts of conversations: some broken, some too long, some with scores out of bounds."""
    c = table(spark, d, "conversations")
    whole = F.to_json(F.struct(F.col("text").alias("summary")))
    said = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("Well: {"), F.lit('"summary": '))).otherwise(F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
    scored = F.to_json(F.struct((F.length(F.coalesce("text", F.lit(""))) % 14 - 1).alias("score"), F.lit("so").alias("reasoning")))
    rows = c.select("conv_id", "turn", answers.typed_answer(said, "summary").alias("a"), answers.typed_answer(scored, "relevance_score").alias("s"))
    return rows.select("conv_id", "turn", F.length("a.value").alias("characters"), F.col("a.error").alias("summary_error"), F.col("s.value").alias("score"), F.col("s.error").alias("score_error"))


# --- ingest ------------------------------------------------------------------------------------------------------

_SENDER = "(SELECT min_by(m.source_id, m.id) FROM m WHERE CASE WHEN contains(m.email_pattern, '%') THEN regexp_matches(lower(f), replace(replace(lower(m.email_pattern), '%', '.*'), '.', '\\.')) ELSE contains(lower(m.email_pattern), lower(f)) OR contains(lower(f), lower(m.email_pattern)) END)"


def _ingested(spark, d):
    docs = b.newsletters(spark, d)
    mails = docs.select(F.col("email_uid").alias("uid"), F.col("from_email").alias("from_"), "subject", F.col("received_date").cast("timestamp").alias("date"), F.lit(None).cast("string").alias("html"), F.col("plain_text").alias("text"), F.array(F.lit("list@example.org")).alias("to"), F.lit(False).alias("seen"))
    old = docs.where("source_id >= 18").select("email_uid")
    return ingest.ingest_mail(mails, old, b.mappings(spark, d), b.sources(spark, d), b.rules(spark, d), b.profiles(spark, d), F.lit("2024-03-01").cast("timestamp"))


#: The first message of each id that wasn't there, and the source of its sender.
_FRESH = f"(SELECT email_uid, f, subject, {_SENDER} AS source FROM (SELECT email_uid, from_email AS f, coalesce(nullif(subject, ''), '(No subject)') AS subject FROM n WHERE email_uid NOT IN (SELECT email_uid FROM n WHERE source_id >= 18) QUALIFY row_number() OVER (PARTITION BY email_uid ORDER BY received_date NULLS FIRST, subject) = 1))"


@query(f"SELECT email_uid, source::INT AS source_id, subject, 'list@example.org' AS to_email FROM {_FRESH} WHERE source IS NOT NULL")
def mail_ingest(spark, d):
    """Mail made of the documents through the whole pipeline: what would be stored. Of two messages of one id the earlier stays."""
    return _ingested(spark, d)["new"].select("email_uid", "source_id", "subject", "to_email")


@query(f"SELECT email_uid, f AS from_email, subject FROM {_FRESH} WHERE source IS NULL")
def mail_unmapped(spark, d):
    """Mail of senders that no mapping fits."""
    return _ingested(spark, d)["unmapped"].select("email_uid", "from_email", "subject")


@query("SELECT DISTINCT email_uid FROM n WHERE email_uid NOT IN (SELECT email_uid FROM n WHERE source_id >= 18)")
def mail_seen_once(spark, d):
    """Each message that wasn't there, stored or of an unknown sender, once."""
    out = _ingested(spark, d)
    return out["new"].select("email_uid").union(out["unmapped"].select("email_uid"))


_TITLE = "coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), 'Untitled Newsletter')"


@query(f"SELECT source_id, subject, min(page_id) AS page_id FROM (SELECT page_id, (page_id % 7)::INT AS source_id, '<title>x' || (page_id % 90)::VARCHAR || '</title>' AS html, 'x' || (page_id % 90)::VARCHAR AS subject FROM pages) WHERE NOT (source_id = 3 AND subject IN ('x1', 'x2', 'x3')) GROUP BY 1, 2")
def scraped_pages(spark, d):
    """Pages whose source has no newsletter of that subject yet; the earliest of several."""
    p = table(spark, d, "pages")
    made = p.select((F.col("page_id") % 7).cast("int").alias("source_id"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("url"), F.concat(F.lit("<title>x"), (F.col("page_id") % 90).cast("string"), F.lit("</title>")).alias("html"), F.lit("").alias("title"), F.lit("2024-01-01").alias("date_str"), F.lit("2024-01-02").cast("timestamp").alias("fetched_at"))
    old = spark.createDataFrame([(3, "x1"), (3, "x2"), (3, "x3")], "source_id int, subject string")
    return ingest.ingest_pages(made, old).select("source_id", "subject", F.col("url").cast("long").alias("page_id"))


@query(f"SELECT page_id, {_TITLE} AS subject FROM pages", False)
def page_subjects(spark, d):
    """The subject of a fetched page by its tree."""
    return table(spark, d, "pages").select("page_id", html.subject_of_page(F.col("html"), F.lit("")).alias("subject"))


@query("SELECT page_id, 'https://campaign-archive.example/n/' || page_id AS url, 'T' || page_id AS title, '01/24/2026' AS date_str, '2026-01-24' AS day FROM pages", False)
def archive_newsletters(spark, d):
    """Newsletters that archive pages link to."""
    p = table(spark, d, "pages")
    k = F.col("page_id").cast("string")
    made = F.concat(F.lit('<a href="/elsewhere">no</a><ul id="archive-list"><li class="campaign">01/24/2026 - <a href="/n/'), k, F.lit('" title="T'), k, F.lit('">x</a></li></ul>'))
    pages = p.select("page_id", F.concat(F.lit("https://campaign-archive.example/"), k).alias("archive_url"), made.alias("made"))
    return mail_source.archive(pages, F.col("archive_url"), F.col("made")).select("page_id", "url", "title", "date_str", F.date_format(dates.parsed_date(F.col("date_str")), "yyyy-MM-dd").alias("day"))


@query(f"SELECT id, array_to_string(topics, ',') AS topics FROM ({_ENRICHED}) WHERE id IN (SELECT id FROM n WHERE coalesce(plain_text, '') <> '' AND (topics IS NULL OR summary IS NULL OR relevance_score IS NULL) AND source_id = 3 ORDER BY received_date DESC NULLS LAST, id LIMIT 20)")
def reprocess_missing(spark, d):
    """The newest documents of a source that lack something, enriched anew: all conditions hold together."""
    return ingest.reprocessed(b.newsletters(spark, d), newest=20, missing=True, source_id=3, enrich=_lexicon).select("id", F.array_join("topics", ",").alias("topics"))


@query("SELECT n.id, coalesce(s.name, 'Unknown') AS source_name FROM n JOIN s ON n.source_id = s.id WHERE n.id = '5'")
def chosen_by_id(spark, d):
    """For a cost analysis an id goes before a source."""
    return ingest.chosen(b.newsletters(spark, d), b.sources(spark, d), id_="5", source_id=99).select("id", "source_name")


@query("SELECT id FROM n WHERE topics IS NOT NULL AND len(topics) > 0 ORDER BY received_date DESC NULLS LAST, id LIMIT 10")
def latest_with_topics(spark, d):
    return search.latest(b.newsletters(spark, d).where("size(topics) > 0"), 10).select("id")


@query("SELECT id FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'https://campaign-archive.example/' || id END AS url FROM s) WHERE url IS NOT NULL")
def sources_with_archive(spark, d):
    url = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://campaign-archive.example/"), F.col("id").cast("string")))
    return with_archive(b.sources(spark, d).withColumn("newsletter_archive_url", url)).select("id")


# --- tables ------------------------------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN id = '7' THEN 'failed' ELSE status END AS status FROM q")
def update_by_key(spark, d):
    return store.update(b.queue(spark, d), F.col("id") == "7", status=F.lit("failed")).select("id", "status")


@query("SELECT id, status FROM q UNION ALL SELECT 'new' || id, NULL FROM q WHERE status = 'failed'")
def append_rows(spark, d):
    q = b.queue(spark, d)
    return store.appended(q, q.where("status = 'failed'").select(F.concat(F.lit("new"), "id").alias("id"))).select("id", "status")


@query("""SELECT q.user_id, count(n.id) > 0 AS success, 'daily_digest' AS delivery_type, CASE WHEN count(n.id) = 0 THEN 'Empty digest content' END AS error_message, array_to_string(list_sort(list(DISTINCT q.rule_id)), ',') AS rule_ids FROM q JOIN u ON q.user_id = u.id LEFT JOIN n ON q.newsletter_id = n.id WHERE q.status = 'pending' AND q.notification_type = 'daily' AND coalesce((u.prefs::JSON ->> 'enabled')::BOOLEAN, true) GROUP BY q.user_id""")
def digest_history(spark, d):
    """Rows that a digest run appends to the history."""
    contents = b.newsletters(spark, d).select(F.col("id").alias("content_id"))
    q = b.queue(spark, d).withColumns({"sent_at": F.lit(None).cast("timestamp"), "error_message": F.lit(None).cast("string")})
    h = digest_plan.run(q, b.profiles(spark, d), contents, F.lit("1996-06-01").cast("timestamp"), kind="daily")["history"]
    return h.select("user_id", "success", "delivery_type", "error_message", F.array_join("rule_ids", ",").alias("rule_ids"))


@query("SELECT id, 'relevance_score' AS fault FROM n WHERE relevance_score * 2 - 3 NOT BETWEEN 0 AND 10")
def score_audit(spark, d):
    return store.score_faults(b.newsletters(spark, d).withColumn("relevance_score", F.col("relevance_score") * 2 - 3))


@query("SELECT DISTINCT user_id AS id, user_id || '@example.org' AS email, true AS enabled FROM r WHERE user_id NOT IN (SELECT id FROM u)")
def profiles_to_make(spark, d):
    """Default profiles of users without one."""
    users = b.rules(spark, d).select(F.col("user_id").alias("id"), F.concat("user_id", F.lit("@example.org")).alias("email")).distinct()
    return store.missing_profiles(b.profiles(spark, d), users).select("id", "email", (F.get_json_object("notification_preferences", "$.enabled") == "true").alias("enabled"))


@query("SELECT id, subject FROM n WHERE id = '5'")
def single_row(spark, d):
    """The one row of an id; none or several would be an error."""
    r = store.exactly_one(b.newsletters(spark, d).where("id = '5'").select("id", "subject"))
    return spark.createDataFrame([r], "id string, subject string")


@query("SELECT id, delivery_frequency, CASE WHEN delivery_frequency = 'weekly' THEN 0 ELSE len(ward_numbers) END AS wards FROM r")
def ward_backfill(spark, d):
    """Weekly rules lose their wards."""
    return store.without_weekly_wards(b.rules(spark, d)).select("id", "delivery_frequency", F.size("ward_numbers").cast("long").alias("wards"))


@query("SELECT user_id, array_to_string(list(id || ':' || name ORDER BY id), ',') AS rules FROM r WHERE is_active AND delivery_frequency = 'weekly' GROUP BY user_id")
def rules_of_users(spark, d):
    return reports.rules_by_user(b.rules(spark, d)).select("user_id", F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["id"], r["name"])), ",").alias("rules"))


@query("SELECT id, prefs, CASE WHEN k % 5 IN (0, 1, 2) THEN prefs ELSE '{\"enabled\":false,\"delivery_frequency\":\"daily\"}' END AS after FROM (SELECT id, prefs, id::INT AS k FROM u)")
def unsubscribe_links(spark, d):
    """Links of others, old and forged ones leave preferences as they are; good ones turn notifications off."""
    from .functions import signed

    now = F.lit(1_700_000_000)
    u, k = b.profiles(spark, d), F.col("id").cast("int") % 5
    good, old, forged = signed.token_for(F.col("id"), now, "secret"), signed.token_for(F.col("id"), now - 91 * 86400, "secret"), signed.token_for(F.col("id"), now, "stolen")
    asked = u.select("id", good.alias("g"), old.alias("o"), forged.alias("f")).select(F.when(k == 1, F.col("o")).when(k == 2, F.col("f")).otherwise(F.col("g")).alias("token"), F.when(k == 0, "someone").when(k == 3, F.col("id")).alias("user_id"))
    after, _ = unsubscribe.unsubscribed(u, asked, now + 1, "secret")
    return after.join(u.select("id", F.col("notification_preferences").alias("prefs")), "id").select("id", "prefs", F.col("notification_preferences").alias("after"))


# --- weeks, dates, models ----------------------------------------------------------------------------------------


@query("SELECT DISTINCT strftime(received_date, '%G-W%V') AS week_id, unnest(topics) AS topic, id FROM n WHERE received_date IS NOT NULL")
def week_topic_documents(spark, d):
    return reports.weekly_sets(b.newsletters(spark, d))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders", False)
def fuzzy_dates(spark, d):
    """Dates written in several ways, and none."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 5
    day = F.col("o_orderdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    said = F.when(k == 0, iso).when(k == 1, F.date_format(day, "M/d/yyyy")).when(k == 2, F.date_format(day, "MMMM d, yyyy")).when(k == 3, F.concat(F.lit("sent on "), iso, F.lit(" by mail"))).otherwise("no date")
    return o.select("o_orderkey", F.date_format(dates.parsed_date(said), "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 2 AS good FROM orders", False)
def week_id_check(spark, d):
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, dates.week_id(F.col("o_orderdate"))).when(k == 1, "26-W7").otherwise("2026W07")
    return table(spark, d, "orders").select("o_orderkey", dates.is_week_id(said).alias("good"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'openai' ELSE 'ollama' END AS provider, CASE p_partkey % 3 WHEN 2 THEN 'gpt-oss:' || p_size || 'b' ELSE 'm' || p_size END AS name FROM part", False)
def model_names(spark, d):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat(F.lit("openai:m"), size)).when(k == 1, F.concat(F.lit("m"), size)).otherwise(F.concat(F.lit("gpt-oss:"), size, F.lit("b")))
    provider, name = text.model_parts(said)
    return table(spark, d, "part").select("p_partkey", provider.alias("provider"), name.alias("name"))


_WEEKLY = f"""w AS (SELECT week_id, topic, count(*) AS k, (sum(c) + count(*) * {costs.PROMPT_TOKENS["weekly_facts"]} + least(count(*), 10) * 40 + {costs.PROMPT_TOKENS["weekly_synthesis"]})::BIGINT AS i, (count(*) * 200 + 800)::BIGINT AS o FROM (SELECT strftime(received_date, '%G-W%V') AS week_id, unnest(list_distinct(topics)) AS topic, ceil(length(substring(plain_text, 1, 100000)) / 4)::BIGINT AS c FROM n JOIN s ON n.source_id = s.id WHERE received_date IS NOT NULL AND coalesce(plain_text, '') <> '') GROUP BY 1, 2),
a AS (SELECT count(*) AS reports, count(DISTINCT week_id) AS weeks, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens FROM w),
c AS (SELECT *, round(input_tokens::DOUBLE / 1000000 * 1.25 + output_tokens::DOUBLE / 1000000 * 10.0, 6) AS total_cost FROM a)"""


@query(f", {_WEEKLY} SELECT reports, weeks, input_tokens, output_tokens, total_cost, round(reports / greatest(weeks, 1), 4) AS reports_per_week, round(reports / greatest(weeks, 1) * 4 * total_cost / reports, 6) AS monthly_cost FROM c")
def weekly_cost(spark, d):
    """The weekly part of a whole cost analysis."""
    return analysis.run(b.newsletters(spark, d), b.sources(spark, d), b.prices(spark, d), 1.25, 10.0)["weekly_cost"]
