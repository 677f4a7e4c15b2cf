"""Column functions: time, severity, wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3600 * 1_000_000
DAY = 24 * HOUR
BASE_YEAR = 2000  # stands for year 0 of a log without years: both begin a 400-year cycle
ANCHOR = 978_307_200 * 1_000_000  # 2001-01-01, the Monday that buckets count from; it stands for 0001-01-01
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column of either kind, or of one that is a number already."""
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name)) if kind == "timestamp" else F.col(name).cast("long")


def severity(attempts: Column, threshold: int) -> Column:
    return F.when(attempts >= 4 * threshold, "critical").when(attempts >= 2 * threshold, "warning").otherwise("normal")


def severity_rank(name: Column) -> Column:
    return F.when(name == "critical", 2).when(name == "warning", 1).otherwise(0)


def per_minute(attempts: Column, span: Column) -> Column:
    """Attempts a minute over a span of microseconds, which counts as a second at least."""
    return attempts / (F.greatest(span, F.lit(1_000_000)) / F.lit(60_000_000.0))


def clean(value: Column) -> Column:
    """Without ASCII control characters."""
    return F.regexp_replace(value, "[\\x00-\\x1F\\x7F]", "")


def capped(values: Column, most: int, between: str) -> Column:
    """The first values joined, then how many more there are."""
    head = F.array_join(F.slice(values, 1, most), between)
    return F.when(F.size(values) <= most, head).otherwise(F.concat(head, F.lit(between + "+"), (F.size(values) - most).cast("string"), F.lit(" more")))


def users_clause(users: Column) -> Column:
    n = F.size(users)
    return (
        F.when(n <= 0, "")
        .when(n == 1, F.concat(F.lit(" against "), users[0]))
        .when(n == 2, F.concat(F.lit(" against "), users[0], F.lit(" and "), users[1]))
        .otherwise(F.concat(F.lit(" against "), users[0], F.lit(", "), users[1], F.lit(", and "), (n - 2).cast("string"), F.lit(" other account(s)")))
    )


def duration_words(span: Column) -> Column:
    seconds = F.floor(span / 1_000_000)
    return F.when(span < 1_000_000, "under a second").when(span < 60_000_000, F.concat(seconds.cast("string"), F.lit(" seconds"))).otherwise(F.concat(F.floor(span / 60_000_000).cast("string"), F.lit(" minute(s)")))


def clock(us: Column) -> Column:
    """'Mar  4 09:00:01' of microseconds, in UTC whatever the session's zone."""
    t = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.floor(us / 1_000_000)).cast("decimal(18,6)"))
    return F.concat(F.element_at(F.lit(list(MONTHS)), F.month(t)), F.lit(" "), F.lpad(F.dayofmonth(t).cast("string"), 2, " "), F.lit(" "), F.date_format(t, "HH:mm:ss"))


def bucket_unit(span: Column) -> Column:
    """The bucket length for a span: an hour, a day, a week or 30 days, so that about 20 suffice; else more months."""
    out = 30 * DAY * (F.floor(span / (600 * DAY)) + 1)
    for unit in (30 * DAY, 7 * DAY, DAY, HOUR):
        out = F.when(F.floor(span / unit) <= 20, F.lit(unit)).otherwise(out)
    return F.when(span <= 0, F.lit(HOUR)).otherwise(out).cast("long")


def unit_name(unit: Column) -> Column:
    return F.when(unit < DAY, "hour").when(unit < 7 * DAY, "day").when(unit < 30 * DAY, "week").otherwise("month")


def bucket_start(us: Column, unit: Column) -> Column:
    return (F.lit(ANCHOR) + F.floor((us - ANCHOR) / unit) * unit).cast("long")


def bucket_label(start: Column, unit: Column) -> Column:
    text = clock(start)
    return F.when(unit < DAY, F.substring(text, 1, 12)).otherwise(F.substring(text, 1, 6))


def bar(count: Column, most: Column, width: int = 40, block: str = "█") -> Column:
    n = F.when((count <= 0) | (most <= 0), 0).otherwise(F.greatest(F.lit(1), F.floor(count * width / most)))
    return F.repeat(F.lit(block), n.cast("int"))


def location(city: Column, country: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(city) & has(country), F.concat(city, F.lit(", "), country)).when(has(country), country).otherwise("")


def plain_json(value: Column) -> Column:
    """JSON in which <, > and & are escaped, so that it may stand in markup."""
    out = F.to_json(value)
    for sign, escape in (("<", r"\u003c"), (">", r"\u003e"), ("&", r"\u0026")):
        out = F.replace(out, F.lit(sign), F.lit(escape))
    return out
