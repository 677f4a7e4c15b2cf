"""Which sources deserve a closer look, and when: trailing counts, critical alerts, and a cooldown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import TriggerConfig
from ..functions.scalars import DAY
from ..sources.stored import stored

REPEAT, CRITICAL = "repeat_offender", "critical_severity"


def trailing_repeats(events: DataFrame, config: TriggerConfig = TriggerConfig(), slice_us: int | None = None) -> DataFrame:
    """Events that are at least the `repeats`-th within the half-open trailing window (t - window, t]; peers count one by one.

    A source is dealt by slices of time; each slice also sees, as context, the last window of the slice before it.
    """
    if config.repeats <= 1:
        return events
    if config.window <= 0:  # nothing lies within (t - window, t]
        return events.limit(0)
    size = max(slice_us or max(DAY, 16 * config.window), config.window)
    own = F.floor(F.col("us") / size)
    near_end = F.col("us") > (own + 1) * size - config.window
    dealt = events.withColumn("_at", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
    w = W.partitionBy("source", "_at").orderBy("us", "seq", "rep_idx")
    return dealt.withColumn("_back", F.lag("us", config.repeats - 1).over(w)).where((F.col("_back") > F.col("us") - config.window) & (F.col("_at") == own)).drop("_back", "_at")


def candidates(events: DataFrame, alerts: DataFrame, config: TriggerConfig = TriggerConfig()) -> DataFrame:
    """(source, us, kind, seq, rep_idx, reason): what would fire without a cooldown; events (kind 0) before alerts (1)."""
    repeats = trailing_repeats(events, config).select("source", "us", F.lit(0).alias("kind"), "seq", "rep_idx", F.lit(REPEAT).alias("reason"))
    critical = alerts.where("severity = 'critical'").select("source", F.col("last_us").alias("us"), F.lit(1).alias("kind"), F.col("first_us").alias("seq"), F.lit(0).cast("long").alias("rep_idx"), F.lit(CRITICAL).alias("reason"))
    return repeats.unionByName(critical)


def pointers(hits: DataFrame, cooldown: int, slice_us: int | None = None) -> DataFrame:
    """(source, us, reason, root, next) of hits, of which a source has one an instant.

    root: the hit before it, if any, is a cooldown or more away, so it fires whatever was before. next: the first hit a cooldown
    or more later, unless that is a root. Both are found within slices of time of a source; a slice only needs to know the last
    time before it and the first one after it.
    """
    size = max(slice_us or max(DAY, 16 * cooldown), cooldown)
    own = hits.select("source", "us", "reason", F.floor(F.col("us") / size).alias("slice"))
    ends = own.groupBy("source", "slice").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    w = W.partitionBy("source").orderBy("slice")  # a row per slice that has hits
    after = F.struct(F.lead("first").over(w).alias("us"), (F.lead("first").over(w) - F.col("last") >= cooldown).alias("root"))
    known = ends.select("source", "slice", F.lag("last").over(w).alias("before"), F.when(after["us"].isNotNull(), after).alias("after"))
    back = F.coalesce(F.lag("us").over(W.partitionBy("source", "slice").orderBy("us")), F.col("before"))
    rooted = own.join(known, ["source", "slice"]).withColumn("root", F.coalesce(F.col("us") - back >= cooldown, F.lit(True)))
    # each hit asks at its own time plus a cooldown, in the slice where that lies
    at = F.col("us") + cooldown
    asked = F.explode(F.array(
        F.struct("slice", F.col("us").alias("at"), F.lit(0).alias("asks"), F.struct("us", "root").alias("hit"), "after"),
        F.struct(F.floor(at / size).alias("slice"), at.alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("struct<us:bigint,root:boolean>").alias("hit"), F.lit(None).cast("struct<us:bigint,root:boolean>").alias("after")),
    ))
    both = rooted.select("source", "us", "reason", "root", F.col("after").alias("otherwise"), asked.alias("a")).select("source", "us", "reason", "root", "otherwise", "a.*")
    later = F.min("hit").over(W.partitionBy("source", "slice").orderBy(F.col("at").desc(), "asks").rowsBetween(W.unboundedPreceding, W.currentRow))
    beyond = F.max("after").over(W.partitionBy("source", "slice"))
    found = both.withColumn("next", F.coalesce(later, beyond, F.when(F.col("otherwise.us") >= F.col("at"), F.col("otherwise")))).where("asks = 1")
    return found.select("source", "us", "reason", "root", F.when(~F.col("next.root"), F.col("next.us")).alias("next"))


def cool_down(hits: DataFrame, cooldown: int, slice_us: int | None = None) -> DataFrame:
    """(source, us, reason) of the hits that fire: each at least `cooldown` after the last that fired, in greedy order.

    Of a source's hits of one instant the first can fire. A hit points at the first one a cooldown or more later, which is the next
    to fire if it fires itself. Roots fire; from then on pointers are doubled: what the fired hits point at fires, and each pointer
    goes on to where the hit it points at points, so that r rounds reach 2**r hits of a run. Rows are joined by source and instant,
    so that one busy source is dealt to every task. A cooldown of 0 or less lets all hits fire.
    """
    if cooldown <= 0:
        return hits.select("source", "us", "reason")
    one = hits.groupBy("source", "us").agg(F.min(F.struct("kind", "seq", "rep_idx", "reason")).alias("h")).select("source", "us", F.col("h.reason").alias("reason"))
    linked = stored(pointers(one, cooldown, slice_us))
    fired, jumps = linked.where("root").select("source", "us"), linked.where("next is not null").select("source", "us", "next")
    while not jumps.isEmpty():
        reached = fired.join(jumps, ["source", "us"]).select("source", F.col("next").alias("us"), F.lit(None).cast("long").alias("next"))
        further = jumps.join(jumps.select("source", F.col("us").alias("next"), F.col("next").alias("far")), ["source", "next"]).select("source", "us", F.col("far").alias("next"))
        step = stored(reached.unionByName(further))  # of what fires no pointer is kept
        fired, jumps = fired.unionByName(step.where("next is null").select("source", "us")), step.where("next is not null")
    return linked.join(fired, ["source", "us"], "left_semi").select("source", "us", "reason")


def triggers(events: DataFrame, alerts: DataFrame, config: TriggerConfig = TriggerConfig()) -> DataFrame:
    return cool_down(candidates(events, alerts, config), config.cooldown)
