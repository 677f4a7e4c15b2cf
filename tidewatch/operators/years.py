"""Years of a log that names none: a new one begins where a matched line's month is less than the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import stored


def years_by_block(events: DataFrame, block: str, order: tuple[str, ...], log: str | None = None) -> DataFrame:
    """Adds year_seq in two steps: within blocks in parallel, then over one row per block.

    block must be the leading key of the order of the lines, such as the start of a file's split. log names the column that
    tells logs apart, each of which has years of its own (None: there is one log). Events are read once: their blocks are stored,
    and both the ends of the blocks and the rows are taken from there.
    """
    keys = [block] if log is None else [log, block]
    w = W.partitionBy(*keys).orderBy(*order)
    local = events.withColumn("_n", F.sum(F.coalesce((F.col("month") < F.lag("month").over(w)).cast("int"), F.lit(0))).over(w))
    local = stored(local)
    ends = local.groupBy(*keys).agg(F.min_by("month", F.struct(*order)).alias("first"), F.max_by("month", F.struct(*order)).alias("last"), F.max("_n").alias("n"))
    b = W.orderBy(block) if log is None else W.partitionBy(log).orderBy(block)
    before = F.coalesce(F.sum("n").over(b.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    turns = F.sum(F.coalesce((F.col("first") < F.lag("last").over(b)).cast("int"), F.lit(0))).over(b)
    offsets = ends.select(*keys, (before + turns).alias("_before"))
    return local.join(offsets, keys).withColumn("year_seq", F.col("_n") + F.col("_before")).drop("_n", "_before")
