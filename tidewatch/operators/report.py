"""Aggregates of alerts for reports. Only their few rows go to whoever prints them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import BASE_YEAR, bar, bucket_label, bucket_start, bucket_unit, capped, clock, duration_words, plain_json, severity_rank, unit_name, users_clause

TIERS = ("critical", "warning", "normal")


def display_order() -> list[Column]:
    """Worst first, then in order of time."""
    return [severity_rank(F.col("severity")).desc(), F.col("attempts").desc(), F.col("first_us"), F.col("source")]


def header(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("alerts"), F.count_distinct("source").alias("sources"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def severity_counts(alerts: DataFrame, width: int = 40) -> DataFrame:
    """(severity, alerts, percent, bar): all three tiers, worst first; percent is cut to a whole number."""
    per = [F.count_if(F.col("severity") == t) for t in TIERS]
    one = alerts.agg(F.count("*").alias("total"), F.greatest(*per).alias("most"), F.array(*[F.struct(F.lit(t).alias("severity"), n.alias("alerts")) for t, n in zip(TIERS, per)]).alias("rows"))
    return one.select("total", "most", F.explode("rows").alias("r")).select("r.severity", "r.alerts", F.expr("r.alerts * 100 div greatest(total, 1)").alias("percent"), bar(F.col("r.alerts"), F.col("most"), width).alias("bar"))


def histogram(alerts: DataFrame, width: int = 40) -> DataFrame:
    """(start_us, label, alerts, unit, bar) of the buckets that have alerts, by first_us."""
    span = alerts.agg(bucket_unit(F.max("last_us") - F.min("first_us")).alias("unit_us"))
    rows = alerts.crossJoin(F.broadcast(span))  # one row
    counts = rows.groupBy("unit_us", bucket_start(F.col("first_us"), F.col("unit_us")).alias("start_us")).agg(F.count("*").alias("alerts"))
    most = counts.agg(F.max("alerts").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("start_us", bucket_label(F.col("start_us"), F.col("unit_us")).alias("label"), "alerts", unit_name(F.col("unit_us")).alias("unit"), bar(F.col("alerts"), F.col("most"), width).alias("bar"))


def top_offenders(alerts: DataFrame, n: int = 10) -> DataFrame:
    return alerts.orderBy(*display_order()).limit(n)


def top_per_tier(alerts: DataFrame, n: int = 5) -> DataFrame:
    """The n largest alerts of each tier, with their place; a tier's rows are cut down in parallel before they meet."""
    order = [F.col("attempts").desc(), F.col("first_us"), F.col("source")]
    dealt = alerts.withColumn("_part", F.pmod(F.xxhash64("source", "first_us"), F.lit(64)))
    few = dealt.withColumn("_k", F.row_number().over(W.partitionBy("severity", "_part").orderBy(*order))).where(F.col("_k") <= n)
    return few.withColumn("place", F.row_number().over(W.partitionBy("severity").orderBy(*order))).where(F.col("place") <= n).drop("_k", "_part")


def beyond_top(alerts: DataFrame, n: int = 5) -> DataFrame:
    """The alerts that top_per_tier() leaves: those after a tier's n-th in its order. The n-th is one row a tier."""
    key = F.struct((-F.col("attempts")).alias("a"), "first_us", "source")
    top = top_per_tier(alerts, n).withColumn("_last", F.max(key).over(W.partitionBy("severity")))
    last = top.groupBy("severity", "_last").agg(F.count("*").alias("_n"), F.count_if(key == F.col("_last")).alias("_same")).where(F.col("_n") == n)
    after = alerts.join(F.broadcast(last), "severity").where(key >= F.col("_last"))
    alike = after.where(key == F.col("_last"))  # rows that cannot be told from the n-th
    alike = alike.withColumn("_k", F.row_number().over(W.partitionBy("severity").orderBy("source"))).where(F.col("_k") > F.col("_same"))
    return after.where(key > F.col("_last")).select(alerts.columns).unionByName(alike.select(alerts.columns))


def top_users(alerts: DataFrame, n: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, user, alerts): the users that most alerts mention; ties by name. Users are cut down in parallel before a group's meet."""
    counts = alerts.select(*by, F.explode("users").alias("user")).groupBy(*by, "user").agg(F.count("*").alias("alerts"))
    order = [F.col("alerts").desc(), F.col("user")]
    if not by:
        return counts.orderBy(*order).limit(n)
    dealt = counts.withColumn("_part", F.pmod(F.xxhash64("user"), F.lit(64)))
    few = dealt.withColumn("_k", F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))).where(F.col("_k") <= n)
    return few.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k", "_part")


def tier_rollup(alerts: DataFrame, n: int = 5, users: int = 3) -> DataFrame:
    """(severity, alerts, commonly): of the alerts beyond the n largest of a tier, how many, and their commonest users."""
    rest = beyond_top(alerts, n)
    named = top_users(rest, users, ("severity",)).groupBy("severity").agg(F.sort_array(F.collect_list(F.struct((-F.col("alerts")).alias("m"), "user"))).alias("u"))
    text = F.array_join(F.transform("u", lambda x: F.concat(x["user"], F.lit(" ("), (-x["m"]).cast("string"), F.lit(")"))), ", ")
    return rest.groupBy("severity").agg(F.count("*").alias("alerts")).join(named, "severity", "left").select("severity", "alerts", F.coalesce(text, F.lit("unknown accounts")).alias("commonly"))


def alert_json(base_year: int = BASE_YEAR) -> Column:
    """An alert as one compact JSON object; years count from 0000."""
    t = lambda c: F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col(c) / 1_000_000).cast("decimal(18,6)"))
    stamp = lambda c: F.concat(F.lpad((F.year(t(c)) - base_year).cast("string"), 4, "0"), F.date_format(t(c), "-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return plain_json(F.struct(F.col("source").alias("Source"), F.col("attempts").alias("Attempts"), stamp("first_us").alias("FirstSeen"), stamp("last_us").alias("LastSeen"), F.col("users").alias("Users"), F.col("severity").alias("Severity")))


def shown() -> list[Column]:
    """Columns that text reports need beside the alert's own."""
    return [clock(F.col("first_us")).alias("first_text"), clock(F.col("last_us")).alias("last_text")]


def told() -> list[Column]:
    """Columns that a sentence about an alert needs beside the alert's own."""
    return [*shown(), users_clause(F.col("users")).alias("clause"), duration_words(F.col("last_us") - F.col("first_us")).alias("lasted")]


def listed(most: int = 8) -> list[Column]:
    """The users of an alert for a table's cell and for a line, the first of them and how many more there are."""
    return [capped(F.col("users"), most, ", ").alias("users_text"), capped(F.col("users"), most, ",").alias("users_list")]
