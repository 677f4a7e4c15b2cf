"""Bursts: runs of one source's events whose gaps stay within a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SECOND, BurstConfig
from ..functions.scalars import micros, severity

LEVEL = 256  # slices of one level that make a slice of the next


def events_of(df: DataFrame, source: str, ts: str, user: str | Column | None = None, seq: str | None = None) -> DataFrame:
    """Any table as events: source, us (microseconds), user, seq, rep_idx, rep_count."""
    user = F.lit("") if user is None else F.col(user) if isinstance(user, str) else user
    return df.select(
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), micros(df, ts).alias("us"), F.coalesce(user.cast("string"), F.lit("")).alias("user"),
        (F.col(seq).cast("long") if seq else F.lit(0).cast("long")).alias("seq"), (F.col("rep_idx").cast("long") if "rep_idx" in df.columns else F.lit(0).cast("long")).alias("rep_idx"),
        (F.col("rep_count").cast("long") if "rep_count" in df.columns else F.lit(1).cast("long")).alias("rep_count"),
    ).where("us is not null")


def _chained(rows: DataFrame, keys: list[str], gap: int, start: str, end: str) -> DataFrame:
    """Adds chain: a new one where the gap from the previous row's end is larger than `gap`."""
    w = W.partitionBy(*keys).orderBy(start, "seq", "rep_idx")
    fresh = F.coalesce(F.col(start) - F.lag(end).over(w) > gap, F.lit(True))
    return rows.withColumn("chain", F.sum(fresh.cast("int")).over(w))


def slice_of(config: BurstConfig, slice_us: int | None) -> int:
    """The length of the first slices of time: some windows, so that few chains cross a border."""
    return slice_us or max(SECOND, 16 * abs(config.window))


def merged(parts: DataFrame, gap: int, size: int, carried: list[Column]) -> DataFrame:
    """Whole chains from parts of chains (source, first, last, seq, rep_idx, ...) within slices of length `size`.

    A part that keeps more than the gap from both borders of its slice is whole. The others, two a slice at most, meet within
    slices LEVEL times as long, and what still touches a border there meets within its source: two rows for each long slice.
    carried: aggregates of the columns that parts have beside these five.
    """
    whole = []
    every = [F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.struct("first", "seq", "rep_idx")).alias("head"), *carried]
    for longer in (size, size * LEVEL, None):
        if longer != size:
            keys = ["source"] if longer is None else ["source", "slice"]
            dealt = parts if longer is None else parts.withColumn("slice", F.floor(F.col("first") / longer))
            parts = _chained(dealt, keys, gap, "first", "last").groupBy(*keys, "chain").agg(*every).withColumn("seq", F.col("head.seq")).withColumn("rep_idx", F.col("head.rep_idx")).drop("chain", "slice", "head")
        if longer is None:
            whole.append(parts)
        else:
            inside = (F.pmod("first", F.lit(longer)) > gap) & (F.lit(longer) - F.pmod("last", F.lit(longer)) > gap)
            whole.append(parts.where(inside))
            parts = parts.where(~inside)
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    return out


def fragments(events: DataFrame, gap: int, slice_us: int) -> DataFrame:
    """Chains within slices of time, so that a busy source is dealt to as many tasks as it has slices."""
    sliced = events.withColumn("slice", F.floor(F.col("us") / slice_us))
    local = _chained(sliced, ["source", "slice"], gap, "us", "us")
    named = F.when(F.col("user") != "", F.struct("us", "seq", "rep_idx", "user"))
    each = local.groupBy("source", "slice", "chain", "user").agg(F.sum("rep_count").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"), F.min(F.struct("us", "seq", "rep_idx")).alias("head"), F.min(named).alias("u"))
    return each.groupBy("source", "slice", "chain").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("head").alias("head"), F.collect_list("u").alias("us_"))


def bursts(events: DataFrame, config: BurstConfig = BurstConfig(), slice_us: int | None = None) -> DataFrame:
    """Alerts: source, attempts, first_us, last_us, users, severity.

    Chains are found within slices of time and then joined where the gap over a border is small enough. Users come in
    order of first appearance; ties by seq and rep_idx. Threshold 0 or less keeps every chain; a negative window makes
    each instant's events chains of their own.
    """
    if config.window < 0:  # equal times no longer chain; every event stands alone
        alone = events.select("source", F.explode(F.expr("sequence(1L, rep_count)")).alias("_"), "us", "user").select("source", F.lit(1).cast("long").alias("attempts"), F.col("us").alias("first_us"), F.col("us").alias("last_us"), F.when(F.col("user") != "", F.array("user")).otherwise(F.array().cast("array<string>")).alias("users"))
        whole = alone
    else:
        size = slice_of(config, slice_us)
        parts = fragments(events, config.window, size).select("source", "n", "first", "last", F.col("head.seq").alias("seq"), F.col("head.rep_idx").alias("rep_idx"), "us_")
        chains = merged(parts, config.window, size, [F.sum("n").alias("n"), F.flatten(F.collect_list("us_")).alias("us_")])
        whole = chains.select("source", F.col("n").alias("attempts"), F.col("first").alias("first_us"), F.col("last").alias("last_us"), F.array_distinct(F.transform(F.sort_array("us_"), lambda x: x["user"])).alias("users"))
    return whole.where(F.col("attempts") >= config.threshold).withColumn("severity", severity(F.col("attempts"), config.threshold))


def first_crossings(events: DataFrame, config: BurstConfig = BurstConfig(), slice_us: int | None = None) -> DataFrame:
    """What a live detector would have raised: one alert per chain, as of the event that first makes it long enough.

    Events are taken in order of time; repeated events must be expanded. The same columns as bursts(). As there, chains are
    found within slices of time; of each part of a chain only as many events as an alert needs are carried on.
    """
    need = max(config.threshold, 1)
    size = slice_of(config, slice_us)
    local = _chained(events.withColumn("slice", F.floor(F.col("us") / size)), ["source", "slice"], config.window, "us", "us")
    event = F.struct("us", "seq", "rep_idx", "user")
    nth = F.row_number().over(W.partitionBy("source", "slice", "chain").orderBy("us", "seq", "rep_idx"))
    parts = local.withColumn("k", nth).groupBy("source", "slice", "chain").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.min(event).alias("head"), F.sort_array(F.collect_list(F.when(F.col("k") <= need, event))).alias("es"))
    parts = parts.select("source", "first", "last", "head.seq", "head.rep_idx", "es")
    taken = merged(parts, config.window, size, [F.slice(F.sort_array(F.flatten(F.collect_list("es"))), 1, need).alias("es")]).where(F.size("es") >= need)
    return taken.select(
        "source", F.size("es").cast("long").alias("attempts"), F.col("es")[0]["us"].alias("first_us"), F.element_at("es", -1)["us"].alias("last_us"),
        F.array_distinct(F.transform(F.filter("es", lambda e: e["user"] != ""), lambda e: e["user"])).alias("users"),
    ).withColumn("severity", severity(F.col("attempts"), config.threshold))
