"""The domain's tables as views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TOPICS
from ..functions.dates import week_id
from .tables import table

#: What a text must contain for each topic.
MARKERS = ["the ", "and ", "ing ", "de ", "des ", "que ", "der ", "die ", "ción", "eau", "heit", "license"]
TERMS = ["tion", "The", "zzz", "ent "]


def newsletters(spark: SparkSession, d: str, documents: DataFrame | None = None) -> DataFrame:
    """The documents, or those given; one message in 50 comes twice, under the id of the one before."""
    # bound to a variable, so that a text is lower-cased once for all topics
    topics = F.transform(F.array(F.lower("text")), lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(m)), t) for m, t in zip(MARKERS, TOPICS, strict=True)))))[0]
    return (table(spark, d, "documents") if documents is None else documents).select(
        F.col("doc_id").cast("string").alias("id"),
        F.expr("concat('m', cast(if(doc_id % 50 = 1, doc_id - 1, doc_id) as string))").alias("email_uid"),
        F.expr("case when doc_id % 37 <> 0 then timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 60 as int), cast(doc_id % 24 as int)) end").alias("received_date"),
        F.expr("substring(text, 1, 30)").alias("subject"),
        F.expr("case when doc_id % 6 = 0 then concat('\"Office ', cast(doc_id % 50 as string), '\" <news@ward', cast(doc_id % 50 as string), '.example.org>') else concat('news@ward', cast(doc_id % 50 as string), '.example.org') end").alias("from_email"),
        F.expr("case when doc_id % 41 <> 0 then text end").alias("plain_text"),
        F.expr("case when doc_id % 5 <> 0 then substring(text, 1, 80) end").alias("summary"),
        F.when(F.expr("doc_id % 43 <> 0"), topics).alias("topics"),
        F.expr("cast(substring(source, 4) as int)").alias("source_id"),
        F.expr("case when doc_id % 29 <> 0 then cast(n_chars % 11 as int) end").alias("relevance_score"),
    )


def sources(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("int").alias("id"), F.col("r_name").alias("source_type"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 0, (F.col("n_nationkey") + 1).cast("string")).alias("ward_number"))


def rules(spark: SparkSession, d: str) -> DataFrame:
    topics, terms = (F.array(*map(F.lit, x)) for x in (TOPICS, TERMS))
    k = F.col("c_custkey")
    one = F.array(F.element_at(topics, (k % 12 + 1).cast("int")))
    return table(spark, d, "customer").select(
        k.cast("string").alias("id"),
        (k % 40).cast("string").alias("user_id"),
        F.concat(F.lit("rule "), (k % 7).cast("string")).alias("name"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, one).otherwise(F.concat(one, F.array(F.element_at(topics, (k * 5 % 12 + 1).cast("int"))))).alias("topics"),
        F.when(k % 4 == 0, F.element_at(terms, (k % 3 + 1).cast("int"))).when(k % 4 == 1, "").alias("search_term"),
        (k % 11).cast("int").alias("min_relevance_score"),
        F.when(k % 5 == 0, F.array(F.lit("7"), F.lit("12"), F.lit("3"))).otherwise(F.array().cast("array<string>")).alias("ward_numbers"),
        F.when(k % 2 == 0, "daily").otherwise("weekly").alias("delivery_frequency"),
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Of users 0 to 39, those of customers but the 13th."""
    u = F.col("user_id").cast("int")
    own = rules(spark, d).select("user_id").distinct().where(u != 13)
    return own.select(F.col("user_id").alias("id"), F.when(u % 7 == 0, '{"enabled": false}').when(u % 11 == 0, '{"delivery_frequency": "daily"}').when(u % 3 != 0, '{"enabled": true}').alias("notification_preferences"))


def queue(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    about_one = k % 3 != 0
    newsletters = table(spark, d, "documents").select(F.max("doc_id") + 1).scalar()
    return table(spark, d, "orders").select(
        k.cast("string").alias("id"),
        (F.col("o_custkey") % 40).cast("string").alias("user_id"),
        F.when(about_one, (k % newsletters).cast("string")).alias("newsletter_id"),
        F.when(~about_one, F.concat(F.lit("r"), (k % 50).cast("string"))).alias("report_id"),
        F.col("o_custkey").cast("string").alias("rule_id"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "sent").otherwise("failed").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM").alias("digest_batch_id"),
        F.when(about_one, "daily").otherwise("weekly").alias("notification_type"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )


def reports(spark: SparkSession, d: str) -> DataFrame:
    n = newsletters(spark, d).where("received_date is not null").select("id", week_id(F.col("received_date")).alias("week_id"), F.explode("topics").alias("topic"))
    return n.groupBy("topic", "week_id").agg(F.array_sort(F.collect_set("id")).alias("newsletter_ids")).select(F.concat_ws("|", "topic", "week_id").alias("id"), "topic", "week_id", "newsletter_ids")


def mappings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select((k + 1).cast("int").alias("id"), F.when(k % 4 == 0, F.concat(F.lit("%@ward"), k.cast("string"), F.lit(".example.org"))).when(k % 4 == 1, F.concat(F.lit("%ward"), k.cast("string"), F.lit("%"))).when(k % 4 == 2, F.concat(F.lit("ward"), k.cast("string"), F.lit(".example"))).otherwise(F.concat(F.lit("NEWS@%ward"), k.cast("string"), F.lit(".example.org"))).alias("email_pattern"), (k % 20).cast("int").alias("source_id"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.element_at(F.array(F.lit("amazon"), F.lit("openai"), F.lit("google")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("provider"), F.concat(F.lit("model-"), F.col("p_partkey").cast("string")).alias("model"), F.col("p_size").cast("double").alias("input_cost_per_1m"), (F.col("p_size") * 8).cast("double").alias("output_cost_per_1m"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_TOPICS, _TERMS = _list(TOPICS), _list(TERMS)

#: The same views in DuckDB's SQL, as the beginning of a query.
SQL = f"""
WITH n AS (SELECT doc_id::VARCHAR AS id, 'm' || (CASE WHEN doc_id % 50 = 1 THEN doc_id - 1 ELSE doc_id END)::VARCHAR AS email_uid,
  CASE WHEN doc_id % 37 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::INT) + to_hours((doc_id % 24)::INT) END AS received_date,
  substring(text, 1, 30) AS subject,
  CASE WHEN doc_id % 6 = 0 THEN '"Office ' || (doc_id % 50)::VARCHAR || '" <news@ward' || (doc_id % 50)::VARCHAR || '.example.org>' ELSE 'news@ward' || (doc_id % 50)::VARCHAR || '.example.org' END AS from_email,
  CASE WHEN doc_id % 41 <> 0 THEN text END AS plain_text, CASE WHEN doc_id % 5 <> 0 THEN substring(text, 1, 80) END AS summary,
  CASE WHEN doc_id % 43 <> 0 THEN list_filter([{", ".join(f"CASE WHEN contains(lower(text), '{m}') THEN '{t}' END" for m, t in zip(MARKERS, TOPICS, strict=True))}], lambda x: x IS NOT NULL) END AS topics,
  substring(source, 4)::INT AS source_id, CASE WHEN doc_id % 29 <> 0 THEN (n_chars % 11)::INT END AS relevance_score FROM documents),
s AS (SELECT n_nationkey::INT AS id, r_name AS source_type, n_name AS name, CASE WHEN n_regionkey > 0 THEN (n_nationkey + 1)::VARCHAR END AS ward_number FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT c_custkey::VARCHAR AS id, (c_custkey % 40)::VARCHAR AS user_id, 'rule ' || (c_custkey % 7)::VARCHAR AS name, c_acctbal > 0 AS is_active,
  CASE WHEN c_custkey % 3 = 0 THEN []::VARCHAR[] WHEN c_custkey % 3 = 1 THEN [({_TOPICS})[c_custkey % 12 + 1]] ELSE [({_TOPICS})[c_custkey % 12 + 1], ({_TOPICS})[c_custkey * 5 % 12 + 1]] END AS topics,
  CASE WHEN c_custkey % 4 = 0 THEN ({_TERMS})[c_custkey % 3 + 1] WHEN c_custkey % 4 = 1 THEN '' END AS search_term, (c_custkey % 11)::INT AS min_relevance_score,
  CASE WHEN c_custkey % 5 = 0 THEN ['7', '12', '3'] ELSE []::VARCHAR[] END AS ward_numbers, CASE WHEN c_custkey % 2 = 0 THEN 'daily' ELSE 'weekly' END AS delivery_frequency FROM customer),
u AS (SELECT user_id AS id, CASE WHEN user_id::INT % 7 = 0 THEN '{{"enabled": false}}' WHEN user_id::INT % 11 = 0 THEN '{{"delivery_frequency": "daily"}}' WHEN user_id::INT % 3 <> 0 THEN '{{"enabled": true}}' END AS prefs FROM (SELECT DISTINCT user_id FROM r) WHERE user_id::INT <> 13),
q AS (SELECT o_orderkey::VARCHAR AS id, (o_custkey % 40)::VARCHAR AS user_id, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % (SELECT max(doc_id) + 1 FROM documents))::VARCHAR END AS newsletter_id, CASE WHEN o_orderkey % 3 = 0 THEN 'r' || (o_orderkey % 50)::VARCHAR END AS report_id,
  o_custkey::VARCHAR AS rule_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'sent' ELSE 'failed' END AS status, strftime(o_orderdate, '%Y-%m') AS digest_batch_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'daily' ELSE 'weekly' END AS notification_type, o_orderdate::TIMESTAMP AS created_at FROM orders),
rep AS (SELECT topic || '|' || week_id AS id, topic, week_id, list_sort(list(DISTINCT id)) AS newsletter_ids FROM (SELECT id, strftime(received_date, '%G-W%V') AS week_id, unnest(topics) AS topic FROM n WHERE received_date IS NOT NULL) GROUP BY topic, week_id),
m AS (SELECT (n_nationkey + 1)::INT AS id, CASE n_nationkey % 4 WHEN 0 THEN '%@ward' || n_nationkey || '.example.org' WHEN 1 THEN '%ward' || n_nationkey || '%' WHEN 2 THEN 'ward' || n_nationkey || '.example' ELSE 'NEWS@%ward' || n_nationkey || '.example.org' END AS email_pattern, (n_nationkey % 20)::INT AS source_id FROM nation),
p AS (SELECT (['amazon', 'openai', 'google'])[p_partkey % 3 + 1] AS provider, 'model-' || p_partkey::VARCHAR AS model, p_size::DOUBLE AS input_cost_per_1m, (p_size * 8)::DOUBLE AS output_cost_per_1m FROM part),
on_users AS (SELECT id FROM u WHERE coalesce((prefs::JSON ->> 'enabled')::BOOLEAN, true))
"""
