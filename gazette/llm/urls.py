"""Operator 10: URL filter by rules and, where none fits, by propagation over the link graph of hosts.

Only DataFrame operations. Trust flows from hosts with allowed pages along links (personalised PageRank), distrust from
hosts with blocked pages against them. Both count in pages: a seed weighs as many pages as a rule judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, written

#: (verdict, rule); a rule is a host and a path from its first slash on.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
DAMPING, ROUNDS, CUT, BLAME = 0.85, 10, 5, 0.5
#: Hosts of the absolute links of a page; relative ones stay on its own host.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _ordered(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, path), the longest rule first; of equally long ones the first by name."""
    out = [(v, r, r[: r.index("/")], r[r.index("/") :]) for v, r in rules]
    return sorted(out, key=lambda x: (-len(x[1]), x[1]))


def judged_by_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, html, host, path, rule, said (the rule's verdict); rule and said are null if none fits."""
    host, path = split_url(F.col("url").cast("string"))
    html = F.col("html").cast("string") if "html" in pages.columns else F.lit(None).cast("string")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("html"), host.alias("host"), path.alias("path"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, name, h, p in reversed(_ordered(rules)):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, said = F.when(fits, name).otherwise(rule), F.when(fits, verdict).otherwise(said)
    return own.select("*", rule.alias("rule"), said.alias("said"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, mass): seeds (kind, host, mass) and what flows on over edges (kind, src, dst, share) in so many rounds.

    Mass at hosts without edges goes no further. Links between two hosts are one edge, so a host that holds many pages
    is one row among its neighbours'; joins that are still uneven are split by adaptive execution."""
    if edges.limit(1).count() == 0:
        return seeds
    now = seeds
    for k in range(1, rounds + 1):
        flow = now.join(edges.withColumnRenamed("kind", "k"), (F.col("kind") == F.col("k")) & (F.col("host") == F.col("src")))
        moved = flow.select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        now = seeds.union(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if k % CUT == 0:
            now = written(now)
    return now


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, blame: float = BLAME, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url, html).

    Without a fitting rule, a host is blocked if its distrust is at least `blame` of distrust, trust and its pages that no
    rule judged together. Null urls and urls without :// have an empty host, which is never part of the graph and allowed.
    Null html has no links; html and urls of any length are read whole. Rows that repeat are judged alike and count each; an
    empty table gives no rows; columns besides page_id, url and html are ignored, whatever their names."""
    rules = RULES if rules is None else rules
    judged = judged_by_rules(pages, rules)
    facts = judged.where("host <> ''").select("host", "said", F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("links"))
    seeds_of = written(facts.groupBy("host").agg(F.count(F.when(F.col("said") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("said") == "block", 1)).alias("blocked"), F.count("*").alias("pages")))
    links = facts.select(F.col("host").alias("src"), F.explode("links").alias("link")).select("src", ascii_lower(F.col("link")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    both = written(links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n")))
    total = both.groupBy(F.col("kind").alias("k"), F.col("src").alias("s")).agg(F.sum("n").alias("total"))
    edges = written(both.join(total, (F.col("kind") == F.col("k")) & (F.col("src") == F.col("s"))).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")))
    seeds = seeds_of.where("allowed > 0").select(F.lit("trust").alias("kind"), "host", F.col("allowed").cast("double").alias("mass"))
    seeds = seeds.union(seeds_of.where("blocked > 0").select(F.lit("distrust"), "host", F.col("blocked").cast("double")))
    mass = spread(edges, seeds, damping, rounds)
    per_host = mass.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))), F.lit(0.0)).alias("distrust"))
    blocked = per_host.join(seeds_of.select(F.col("host").alias("h"), "allowed", "blocked", "pages"), F.col("host") == F.col("h"), "left")
    own = F.coalesce(F.col("pages") - F.col("allowed") - F.col("blocked"), F.lit(0))
    blocked = blocked.where((F.col("distrust") > 0) & (F.round(F.col("distrust") - blame * (F.col("distrust") + F.col("trust") + own), 9) >= 0)).select(F.col("host").alias("bad"))
    out = judged.select("page_id", "host", "path", "rule", "said")
    out = out.join(blocked, out.host == blocked.bad, "left")
    verdict = F.coalesce(F.col("said"), F.when(F.col("bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cases = [(f"(host = {q(h)} OR suffix(host, {q('.' + h)})) AND prefix(path, {q(p)})", q(name), q(v)) for v, name, h, p in _ordered(RULES)]
    rule = "CASE " + " ".join(f"WHEN {c} THEN {n}" for c, n, _ in cases) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, _, v in cases) + " END"
    steps = ", ".join(f"m{k} AS MATERIALIZED (SELECT kind, host, sum(mass) AS mass FROM (SELECT kind, host, mass FROM seeds UNION ALL SELECT m.kind, e.dst, m.mass * e.share * {DAMPING} FROM m{k - 1} m JOIN edges e ON m.kind = e.kind AND m.host = e.src) GROUP BY kind, host)" for k in range(1, ROUNDS + 1))
    return rf"""
WITH r AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT page_id, html, host, path, {rule} AS rule, {said} AS said FROM p),
h AS (SELECT host, count(*) FILTER (said = 'allow') AS allowed, count(*) FILTER (said = 'block') AS blocked, count(*) AS pages FROM j WHERE host <> '' GROUP BY host),
l AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, {q(LINK)}, 1)), '{UPPER}', '{LOWER}') AS dst FROM j WHERE host <> '') WHERE src <> dst GROUP BY src, dst),
b AS (SELECT 'trust' AS kind, src, dst, n FROM l UNION ALL SELECT 'distrust', dst, src, n FROM l),
edges AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM b),
seeds AS MATERIALIZED (SELECT 'trust' AS kind, host, allowed::DOUBLE AS mass FROM h WHERE allowed > 0 UNION ALL SELECT 'distrust', host, blocked::DOUBLE FROM h WHERE blocked > 0),
m0 AS (SELECT * FROM seeds), {steps},
t AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM m{ROUNDS} GROUP BY host),
bad AS (SELECT t.host AS bad FROM t LEFT JOIN h ON t.host = h.host WHERE distrust > 0 AND round(distrust - {BLAME} * (distrust + trust + coalesce(pages - allowed - blocked, 0)), 9) >= 0)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bad IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN bad ON j.host = bad.bad
"""


SQL = _sql()
