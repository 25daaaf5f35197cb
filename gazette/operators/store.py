"""Changes to tables as new tables, and checks of their constraints. A table is never overwritten while it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..constants import MAX_RULES, MAX_TERM
from ..functions.arrays import is_empty


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[k])
    return out


def unused(name: str, *dfs: DataFrame) -> str:
    """A column name that none of these has."""
    have = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def newcomers(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of new whose key is neither in existing nor earlier in new. Keys with a null never clash, as in SQL.

    Earlier: by order, and of equal ones the smallest by the other columns, as far as these have an order; without order any one
    of the rows of a key stays. Rows of a key are reduced in each task before they meet."""
    clash = F.lit(True)
    for k in keys:
        clash &= F.col(k).isNotNull()
    own = new.where(clash)
    if order:
        by = [*order, *(c for c, kind in new.dtypes if c not in order and "map<" not in kind and kind != "variant")]
        own = own.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(*by)).alias("first")).select("first.*")
    else:
        own = own.dropDuplicates(keys)
    return own.join(existing.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new.where(~clash))


def appended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new as they come; columns that they lack are null."""
    return existing.unionByName(new, allowMissingColumns=True)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    return existing.unionByName(newcomers(existing, new, keys, order), allowMissingColumns=True)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of new take the place of those with the same key; of several the last by order counts."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in (order or keys)))
    last = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    old = existing.join(last.select(*keys), _same(existing, last, keys), "left_anti")
    return old.unionByName(last, allowMissingColumns=True)


def update(existing: DataFrame, where: Column, touch: str | None = None, **values: Column) -> DataFrame:
    """Sets columns in rows that fit; touch names a column that gets the present time in these rows."""
    if touch:
        values = {**values, touch: F.current_timestamp()}
    fits = F.coalesce(where, F.lit(False))
    return existing.select(*(F.when(fits, values[c].cast(existing.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in existing.columns))


def update_ids(existing: DataFrame, ids: DataFrame, key: str = "id", **values: Column) -> DataFrame:
    """Sets columns in the rows whose key is among ids (a column of that name)."""
    id_, hit = unused("hit_id", existing), unused("hit", existing)
    own = ids.select(F.col(key).alias(id_)).distinct().withColumn(hit, F.lit(True))
    joined = existing.join(own, F.col(key) == F.col(id_), "left")
    return update(joined, F.col(hit), **values).drop(id_, hit)


def delete(existing: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(ids.select(*keys).distinct(), keys, "left_anti").select(*existing.columns)


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is still there, or that have none."""
    name = unused("parent", child)
    p = parent.select(F.col(parent_key).alias(name)).distinct()
    kept = child.where(F.col(child_key).isNotNull()).join(p, F.col(child_key) == F.col(name), "left_semi")
    return kept.unionByName(child.where(F.col(child_key).isNull()))


def missing_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Profiles with default preferences for users (id, email) without one."""
    new = users.join(profiles.select("id"), "id", "left_anti")
    return new.select("id", "email", F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"), F.lit('{"enabled":true,"delivery_frequency":"daily"}').alias("notification_preferences"))


def owned(df: DataFrame, user: str, column: str = "user_id") -> DataFrame:
    """What a user may see."""
    return df.where(F.col(column) == user)


def exactly_one(df: DataFrame):
    """The only row; an error if there is none or another."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"expected one row, found {'none' if not rows else 'more'}")
    return rows[0]


def swapped(df: DataFrame, path: str) -> None:
    """Writes df beside path and puts it in its place, so that df may read from path."""
    spark = df.sparkSession
    jvm = spark._jvm
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = fs.exists(place(path))
    if there and not fs.rename(place(path), place(old)):
        raise OSError(f"{path} can't be set aside")
    try:
        done = fs.rename(place(new), place(path))
    except Exception:
        done = False
        raise
    finally:
        if not done and there:
            fs.rename(place(old), place(path))
    if not done:
        raise OSError(f"{new} can't take the place of {path}")
    fs.delete(place(old), True)


def queue_faults(queue: DataFrame) -> DataFrame:
    """id and the constraint it breaks: one content id, known values, no second notification of a user about the same."""
    one = F.when(F.col("newsletter_id").isNull() == F.col("report_id").isNull(), "one_content")
    status = F.when(~F.coalesce(F.col("status").isin("pending", "sent", "failed"), F.lit(False)), "status")
    kind = F.when(~F.coalesce(F.col("notification_type").isin("daily", "weekly"), F.lit(False)), "notification_type")
    rows = queue.select("id", F.explode(F.array_compact(F.array(one, status, kind))).alias("fault"))
    for c in ("newsletter_id", "report_id"):
        w = Window.partitionBy("user_id", c, "rule_id").orderBy("id")
        again = queue.where(F.col(c).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n > 1")
        rows = rows.union(again.select("id", F.lit(f"second_{c}").alias("fault")))
    return rows


def rule_faults(rules: DataFrame) -> DataFrame:
    weekly = F.when((F.col("delivery_frequency") == "weekly") & ~is_empty(F.col("ward_numbers")), "weekly_wards")
    long_ = F.when(F.char_length("search_term") > MAX_TERM, "term_length")
    kind = F.when(~F.coalesce(F.col("delivery_frequency").isin("daily", "weekly"), F.lit(False)), "delivery_frequency")
    return rules.select("id", F.explode(F.array_compact(F.array(weekly, long_, kind))).alias("fault"))


def without_weekly_wards(rules: DataFrame) -> DataFrame:
    """Rules as the constraint wants them: weekly ones have no wards."""
    return update(rules, F.col("delivery_frequency") == "weekly", ward_numbers=F.array().cast("array<string>"))


def score_faults(docs: DataFrame) -> DataFrame:
    return docs.where("relevance_score not between 0 and 10").select("id", F.lit("relevance_score").alias("fault"))


def new_rule_error(have: Column | None = None) -> Column:
    """Why a rule to be written is refused, or null. have: how many rules the user has; None for a change."""
    name = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "name is required")
    long_ = F.when(F.char_length("search_term") > MAX_TERM, "search term is too long")
    weekly = F.col("delivery_frequency") == "weekly"
    topics = F.when(weekly & is_empty(F.col("topics")), "a weekly rule needs a topic")
    wards = F.when(weekly & ~is_empty(F.col("ward_numbers")), "a weekly rule has no wards")
    daily = F.when(~F.coalesce(weekly, F.lit(False)) & is_empty(F.col("topics")) & (F.coalesce(F.trim("search_term"), F.lit("")) == ""), "a daily rule needs a topic or a search term")
    most = [] if have is None else [F.when(have >= MAX_RULES, "too many rules")]
    return F.coalesce(name, long_, topics, wards, daily, *most)


def with_frequency(rules: DataFrame) -> DataFrame:
    """As a new rule is stored: unknown frequencies become daily, weekly rules lose their search term."""
    f = F.when(F.col("delivery_frequency") == "weekly", "weekly").otherwise("daily")
    return rules.withColumns({"delivery_frequency": f, "search_term": F.when(f == "weekly", F.lit(None)).otherwise(F.col("search_term"))})


def rules_per_user(rules: DataFrame) -> DataFrame:
    return rules.groupBy("user_id").agg(F.count("*").alias("rules")).withColumn("may_add", F.col("rules") < MAX_RULES)
