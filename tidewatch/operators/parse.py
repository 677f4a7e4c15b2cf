"""Lines to failed-login events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.scalars import BASE_YEAR, MONTHS, clean

_MONTH = {m.lower(): i for i, m in enumerate(MONTHS, 1)}
# days of each month in a leap year: the year of a log begins as one
_DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _once(value: Column) -> Column:
    """The value, computed once: what stands above cannot be pushed into it."""
    return F.explode(F.array(value))


def parse_lines(lines: DataFrame, order: tuple[str, ...] = ("block_start", "line_id")) -> DataFrame:
    """The columns of `order`, month..second, source, user, rep_count, raw: one row per line that is a failed login.

    A repeat envelope gives one row whose rep_count is N. The first form that matches and has a date wins. Control
    characters go from source and user; raw stays as read. Null lines match nothing.
    """
    names = ("day", "hour", "minute", "second")
    v, one = F.col("value"), F.lit(1).cast("long")
    near = lines.where(v.contains("authentication failure") | v.contains("Failed password"))
    cut = near.select(*order, "value", _once(F.regexp_extract(v, P.PREFIX, 0)).alias("prefix")).where("prefix != ''")
    words = cut.select(*order, "value", _once(F.struct(F.split("prefix", P.WS + "+").alias("w"), F.expr("substring(value, length(prefix) + 1)").alias("body"))).alias("p"))
    months = F.create_map(*[x for m, i in _MONTH.items() for x in (F.lit(m), F.lit(i))])
    at = lambda k: F.element_at("p.w", k)
    number = [at(2).cast("int").alias("day"), *(F.substring(at(3), k, 2).cast("int").alias(n) for k, n in ((1, "hour"), (4, "minute"), (7, "second")))]
    dated = words.select(*order, "value", F.col("p.body").alias("body"), at(5).startswith("sshd(pam_unix)").alias("pam"), F.try_element_at(months, F.lower(at(1))).alias("month"), *number)
    most = F.element_at(F.lit(list(_DAYS)), F.col("month"))
    good = F.col("month").isNotNull() & F.col("day").between(1, most) & (F.col("hour") < 24) & (F.col("minute") < 60) & (F.col("second") < 60)
    body, again = F.col("body"), F.col("body").startswith("message repeated ")
    inner = F.when(again, F.regexp_extract(body, P.REPEATED, 2)).otherwise(body)
    count = F.when(again, F.regexp_extract(body, P.REPEATED, 1).try_cast("bigint")).otherwise(one)

    def pick(pattern: str, source: int, user: int) -> Column:
        return F.struct(F.regexp_extract("inner", pattern, source).alias("source"), F.regexp_extract("inner", pattern, user).alias("user"))

    # a form is tested by how it begins; what an envelope holds may be of either daemon
    pam = F.col("inner").startswith("authentication failure;") & (F.col("pam") | again)
    ssh = F.col("inner").startswith("Failed password for ") & (~F.col("pam") | again)
    opened = dated.where(good).select(*order, "value", "body", "pam", "month", *names, _once(F.struct(inner.alias("inner"), count.alias("n"))).alias("o")).select("*", F.col("o.inner").alias("inner"), F.col("o.n").alias("rep_count"))
    found = opened.where("rep_count > 0").select(*order, "month", *names, "rep_count", _once(F.when(pam, pick(P.PAM, 1, 2)).when(ssh, pick(P.SSH, 2, 1))).alias("who"), v.alias("raw")).where("who.source != ''")
    return found.select(*order, "month", *names, clean(F.col("who.source")).alias("source"), clean(F.col("who.user")).alias("user"), "rep_count", "raw")


def with_time(events: DataFrame, base_year: int = BASE_YEAR) -> DataFrame:
    """Adds ts from year_seq and the parsed fields. The 29th of February of a common year is the 1st of March."""
    t = F.make_timestamp_ntz(F.col("year_seq") + base_year, F.col("month"), F.lit(1), F.col("hour"), F.col("minute"), F.col("second").cast("decimal(16,6)"))
    return events.withColumn("ts", t + F.make_dt_interval(F.col("day") - 1))


def expand(events: DataFrame) -> DataFrame:
    """One row per repeated event, numbered by rep_idx."""
    return events.withColumn("rep_idx", F.explode(F.expr("sequence(0L, rep_count - 1)"))).drop("rep_count")
