"""Registered queries over the star-schema tables, each with the SQL that must give the same rows.

events: user_id is the source, event_type the user label. orders: every order is rendered as a log line and parsed back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BurstConfig, TriggerConfig
from ..functions.scalars import DAY, HOUR, clock, duration_words, per_minute, users_clause
from ..operators import report
from ..operators.bursts import bursts, events_of, first_crossings
from ..operators.intel import enrich, intel_line
from ..operators.parse import expand, parse_lines, with_time
from ..operators.triggers import trailing_repeats, triggers
from ..operators.years import years_by_block
from ..sources.stored import stored

CONFIG = BurstConfig(threshold=2, window=6 * HOUR)
LIVE = BurstConfig(threshold=3, window=6 * HOUR)
TRIGGER = TriggerConfig(repeats=3, window=24 * HOUR, cooldown=2 * DAY)
MONTH_LIST = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return events_of(spark.read.parquet(f"{d}/events.parquet"), "user_id", "ts", "event_type", "event_id")


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    return bursts(_events(spark, d), CONFIG)


def _flat(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("users", F.array_join("users", ","))


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as log lines: PAM, OpenSSH, repeat envelopes, and lines that match nothing; years and quarters are blocks."""
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderdate is not null and o_orderkey is not null")
    secs = F.col("o_orderkey") % 86400
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    stamp = F.concat(F.element_at(F.array(*[F.lit(m) for m in MONTH_LIST.strip("[]").replace("'", "").split(",")]), F.month("o_orderdate")), F.lit(" "), F.lpad(F.dayofmonth("o_orderdate").cast("string"), 2, " "), F.lit(" "), two(secs / 3600), F.lit(":"), two(secs % 3600 / 60), F.lit(":"), two(secs % 60))
    host = F.concat(F.lit("c"), F.coalesce(F.col("o_custkey").cast("string"), F.lit("0")))
    user = F.concat(F.lit("u\u001b"), F.coalesce(F.lower(F.substring("o_orderpriority", 1, 1)), F.lit("0")))
    ssh = F.concat(F.lit("Failed password for "), F.when(F.col("o_orderkey") % 2 == 0, "invalid user ").otherwise(""), user, F.lit(" from "), host, F.lit(" port 22 ssh2"))
    k = F.col("o_orderkey") % 7
    body = (
        F.when(k == 0, F.lit(" h sshd(pam_unix)[1]: check pass; user unknown"))
        .when(k == 1, F.concat(F.lit(" h sshd(pam_unix)[1]: authentication failure; logname= uid=0 rhost="), host, F.lit("  user="), user))
        .when(k == 2, F.concat(F.lit(" h sshd[2]: message repeated "), (F.col("o_orderkey") % 4).cast("string"), F.lit(" times: [ "), ssh, F.lit("]")))
        .when(k == 3, F.concat(F.lit(" h sshd(pam_unix)[1]: authentication failure; rhost="), host, F.lit(" ")))
        .otherwise(F.concat(F.lit(" h sshd[2]: "), ssh))
    )
    return o.select((F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("block_start"), (F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") * 10_000_000_000 + F.col("o_orderkey")).alias("line_id"), F.year("o_orderdate").alias("true_year"), F.explode(F.array(F.concat(stamp, body))).alias("value"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d)
    return parse_lines(lines, ("block_start", "line_id"))


def _lines_sql() -> str:
    return f"""o as (select *, o_orderkey % 7 as k, (year(o_orderdate)::bigint * 4 + quarter(o_orderdate)) as block_start,
        date_diff('day', timestamp '1970-01-01', o_orderdate)::bigint * 10000000000 + o_orderkey as line_id,
        'c' || coalesce(o_custkey::varchar, '0') as source, 'u' || coalesce(lower(substr(o_orderpriority, 1, 1)), '0') as label,
        month(o_orderdate) as month, day(o_orderdate) as day, (o_orderkey % 86400)::bigint as secs from orders where o_orderdate is not null and o_orderkey is not null),
      p as (select *, case when k = 2 then o_orderkey % 4 else 1 end::bigint as rep_count, case when k = 3 then '' else label end as usr from o where k <> 0 and not (k = 2 and o_orderkey % 4 = 0)),
      y as (select *, sum(case when month < pm then 1 else 0 end) over (order by block_start, line_id) as year_seq from (select *, lag(month) over (order by block_start, line_id) as pm from p))"""


_US = "epoch_us(ts)"


def _chain_sql(gap: int = CONFIG.window) -> str:
    return f"""e as (select coalesce(user_id::varchar, '') as source, epoch_us(ts) as us, coalesce(event_type, '') as usr, event_id as seq from events where ts is not null),
      g as (select *, case when us - lag(us) over (partition by source order by us, seq) <= {gap} then 0 else 1 end as fresh from e),
      c as (select *, sum(fresh) over (partition by source order by us, seq rows unbounded preceding) as chain from g)"""


def _alerts_sql(threshold: int = CONFIG.threshold, gap: int = CONFIG.window) -> str:
    return f"""{_chain_sql(gap)},
      f as (select source, chain, usr, min((us, seq)) as pos from c where usr <> '' group by all),
      u as (select source, chain, string_agg(usr, ',' order by pos) as users from f group by all),
      n as (select source, chain, count(*) as attempts, min(us) as first_us, max(us) as last_us from c group by all having count(*) >= {threshold}),
      alerts as (select n.source, n.attempts, n.first_us, n.last_us, coalesce(u.users, '') as users, case when attempts >= {4 * threshold} then 'critical' when attempts >= {2 * threshold} then 'warning' else 'normal' end as severity,
        case when attempts >= {4 * threshold} then 2 when attempts >= {2 * threshold} then 1 else 0 end as sev from n left join u using (source, chain))"""


def parse_fields(spark, d):
    """P1-P10: which lines are failed logins, whose, and how often."""
    return _parsed(spark, d).select("line_id", "source", "user", "rep_count", F.col("month").cast("long").alias("month"), F.col("day").cast("long").alias("day"), (F.col("hour") * 3600 + F.col("minute") * 60 + F.col("second")).cast("long").alias("secs"))


def parse_expanded(spark, d):
    """P9: a repeat envelope as so many events."""
    return expand(_parsed(spark, d)).groupBy("source").agg(F.count("*").alias("events"), F.max("rep_idx").alias("most"))


def year_inference(spark, d):
    """W2: years recovered from months alone."""
    return with_time(years_by_block(_parsed(spark, d), "block_start", ("block_start", "line_id"))).select("line_id", F.col("year_seq").cast("long").alias("year_seq"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"))


def log_bursts(spark, d):
    """The whole log path over rendered orders: parse, years, weighted repeats, bursts."""
    timed = with_time(years_by_block(_parsed(spark, d), "block_start", ("block_start", "line_id")))
    return _flat(bursts(events_of(timed, "source", "ts", "user", "line_id"), BurstConfig(3, 60 * DAY)))


def bursts_query(spark, d):
    """W1, A1-A3, P11."""
    return _flat(_alerts(spark, d))


def live_first_crossing(spark, d):
    """W3."""
    return _flat(first_crossings(_events(spark, d), LIVE))


def severity_counts(spark, d):
    """A7, P30."""
    return report.severity_counts(_alerts(spark, d)).select("severity", "alerts", "percent", F.length("bar").cast("long").alias("bar"))


def stats_header(spark, d):
    """A4, A8."""
    return report.header(_alerts(spark, d))


def activity_histogram(spark, d):
    """A9, P20-P23."""
    return report.histogram(stored(_alerts(spark, d))).select("start_us", "label", "alerts", "unit", F.length("bar").cast("long").alias("bar"))


def top_offenders(spark, d):
    """O2, O4."""
    return _flat(report.top_offenders(_alerts(spark, d), 10))


def top_per_tier(spark, d):
    """O3."""
    return report.top_per_tier(_alerts(spark, d), 5).select("severity", F.col("place").cast("long").alias("place"), "source", "attempts", "first_us")


def tier_rollup(spark, d):
    """O3, A6: what lies beyond the top of each tier."""
    return report.tier_rollup(stored(_alerts(spark, d)), 5)


def top_users(spark, d):
    """A6, O5."""
    return report.top_users(_alerts(spark, d), 3)


def burst_rate(spark, d):
    """P12."""
    return _alerts(spark, d).select("source", "first_us", F.round(per_minute(F.col("attempts"), F.col("last_us") - F.col("first_us")), 6).alias("rate"))


def alert_lines(spark, d):
    """K4-K6 wording: clock, users clause, duration."""
    a = _alerts(spark, d)
    return a.select("source", "first_us", clock(F.col("last_us")).alias("last_text"), users_clause(F.col("users")).alias("clause"), duration_words(F.col("last_us") - F.col("first_us")).alias("lasted"))


def trailing_repeat(spark, d):
    """W4."""
    return trailing_repeats(_events(spark, d), TRIGGER).select("source", "us", "seq")


def trigger_cooldown(spark, d):
    """U1, O6, W4, W5."""
    return triggers(_events(spark, d), _alerts(spark, d), TRIGGER)


def _lookups(spark, d):
    nation, region = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    registry = nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("ip"), F.col("n_name").alias("org"), F.lit(None).cast("string").alias("network"))
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).where("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("string").alias("ip"), F.col("n_name").alias("country"), F.col("r_name").alias("city"), F.lit(None).cast("string").alias("asn"), F.lit(None).cast("string").alias("isp"))
    return registry, geo


def intel_join(spark, d):
    """J2, P25, K8."""
    found = enrich(trigger_cooldown(spark, d), *_lookups(spark, d))
    return found.select("source", "us", "reason", "org", "country", "city", intel_line().alias("line"))


QUERIES = {
    "parse_fields": parse_fields, "parse_expanded": parse_expanded, "year_inference": year_inference, "log_bursts": log_bursts, "bursts": bursts_query,
    "live_first_crossing": live_first_crossing, "severity_counts": severity_counts, "stats_header": stats_header, "activity_histogram": activity_histogram,
    "top_offenders": top_offenders, "top_per_tier": top_per_tier, "tier_rollup": tier_rollup, "top_users": top_users, "burst_rate": burst_rate,
    "alert_lines": alert_lines, "trailing_repeat": trailing_repeat, "trigger_cooldown": trigger_cooldown, "intel_join": intel_join,
}

_ALERT_COLUMNS = "source, attempts, first_us, last_us, users, severity"
_CLOCK = f"list_element({MONTH_LIST}, month(make_timestamp({{0}}))::int) || ' ' || lpad(day(make_timestamp({{0}}))::varchar, 2, ' ') || ' ' || strftime(make_timestamp({{0}}), '%H:%M:%S')"
_BASE = 2000
_TIME = f"epoch_us(make_timestamp({_BASE} + year_seq::bigint, month, 1, 0, 0, 0.0) + to_days((day - 1)::int)) + secs * 1000000"


def _triggers_sql() -> str:
    t = TRIGGER
    return f"""with recursive {_alerts_sql()},
      r as (select source, us, 0 as kind, seq, 'repeat_offender' as reason, lag(us, {t.repeats - 1}) over (partition by source order by us, seq) as back from e),
      cand as (select source, us, kind, seq, reason from r where back > us - {t.window} union all select source, last_us, 1, first_us, 'critical_severity' from alerts where severity = 'critical'),
      ord as (select *, row_number() over (partition by source order by us, kind, seq, reason) as i from cand),
      walk as (select source, us, reason, i, us as last, true as fired from ord where i = 1
        union all select o.source, o.us, o.reason, o.i, case when o.us - w.last >= {t.cooldown} then o.us else w.last end, o.us - w.last >= {t.cooldown} from walk w join ord o on o.source = w.source and o.i = w.i + 1),
      fired as (select source, us, reason from walk where fired)"""


ORACLE_SQL = {
    "parse_fields": f"with {_lines_sql()} select line_id, source, usr as \"user\", rep_count, month, day, secs from p",
    "parse_expanded": f"with {_lines_sql()} select source, sum(rep_count)::bigint as events, max(rep_count) - 1 as most from p group by source",
    "year_inference": f"with {_lines_sql()} select line_id, year_seq::bigint as year_seq, {_TIME} as us from y",
    "log_bursts": f"""with {_lines_sql()}, t as (select source, usr, rep_count, line_id, {_TIME} as us from y),
      g as (select *, case when us - lag(us) over (partition by source order by us, line_id) <= {60 * DAY} then 0 else 1 end as fresh from t),
      c as (select *, sum(fresh) over (partition by source order by us, line_id rows unbounded preceding) as chain from g),
      f as (select source, chain, usr, min((us, line_id)) as pos from c where usr <> '' group by all),
      u as (select source, chain, string_agg(usr, ',' order by pos) as users from f group by all),
      n as (select source, chain, sum(rep_count)::bigint as attempts, min(us) as first_us, max(us) as last_us from c group by all having sum(rep_count) >= 3)
      select source, attempts, first_us, last_us, coalesce(users, '') as users, case when attempts >= 12 then 'critical' when attempts >= 6 then 'warning' else 'normal' end as severity from n left join u using (source, chain)""",
    "bursts": f"with {_alerts_sql()} select {_ALERT_COLUMNS} from alerts",
    "live_first_crossing": f"""with {_chain_sql(LIVE.window)}, k as (select *, row_number() over (partition by source, chain order by us, seq) as i from c),
      h as (select * from k where i <= {LIVE.threshold}), f as (select source, chain, usr, min((us, seq)) as pos from h where usr <> '' group by all),
      u as (select source, chain, string_agg(usr, ',' order by pos) as users from f group by all)
      select source, count(*) as attempts, min(us) as first_us, max(us) as last_us, coalesce(any_value(users), '') as users, 'normal' as severity from h left join u using (source, chain) group by source, chain having count(*) = {LIVE.threshold}""",
    "severity_counts": f"""with {_alerts_sql()}, t as (select unnest(['critical', 'warning', 'normal']) as severity), q as (select t.severity, count(alerts.source) as alerts from t left join alerts using (severity) group by t.severity)
      select severity, alerts, alerts * 100 // greatest((select sum(alerts)::bigint from q), 1) as percent, case when alerts = 0 then 0 else greatest(1, alerts * 40 // (select max(alerts) from q)) end::bigint as bar from q""",
    "stats_header": f"with {_alerts_sql()} select count(*) as alerts, count(distinct source) as sources, coalesce(sum(attempts), 0)::bigint as attempts, min(first_us) as first_us, max(last_us) as last_us from alerts",
    "activity_histogram": f"""with {_alerts_sql()}, s as (select max(last_us) - min(first_us) as span from alerts),
      w as (select case when span <= 0 or span // {HOUR} <= 20 then {HOUR} when span // {DAY} <= 20 then {DAY} when span // {7 * DAY} <= 20 then {7 * DAY} when span // {30 * DAY} <= 20 then {30 * DAY} else {30 * DAY} * (span // {600 * DAY} + 1) end::bigint as unit from s),
      b as (select 978307200000000 + (floor((first_us - 978307200000000) / unit)::bigint) * unit as start_us, unit, count(*) as alerts from alerts, w group by all)
      select start_us, left({_CLOCK.format('start_us')}, case when unit < {DAY} then 12 else 6 end) as label, alerts, case when unit < {DAY} then 'hour' when unit < {7 * DAY} then 'day' when unit < {30 * DAY} then 'week' else 'month' end as unit,
        greatest(1, alerts * 40 // (select max(alerts) from b))::bigint as bar from b""",
    "top_offenders": f"with {_alerts_sql()} select {_ALERT_COLUMNS} from alerts order by sev desc, attempts desc, first_us, source limit 10",
    "top_per_tier": f"with {_alerts_sql()}, r as (select *, row_number() over (partition by severity order by attempts desc, first_us, source) as place from alerts) select severity, place, source, attempts, first_us from r where place <= 5",
    "tier_rollup": f"""with {_alerts_sql()}, r as (select *, row_number() over (partition by severity order by attempts desc, first_us, source) as place from alerts), rest as (select * from r where place > 5),
      cu as (select severity, usr, count(*) as n from (select severity, unnest(string_split(users, ',')) as usr from rest where users <> '') group by all),
      ku as (select *, row_number() over (partition by severity order by n desc, usr) as i from cu), tu as (select severity, string_agg(usr || ' (' || n || ')', ', ' order by i) as commonly from ku where i <= 3 group by severity)
      select severity, count(*) as alerts, coalesce(any_value(commonly), 'unknown accounts') as commonly from rest left join tu using (severity) group by severity""",
    "top_users": f"with {_alerts_sql()} select usr as \"user\", count(*) as alerts from (select unnest(string_split(users, ',')) as usr from alerts where users <> '') group by usr order by alerts desc, usr limit 3",
    "burst_rate": f"with {_alerts_sql()} select source, first_us, round(attempts / (greatest(last_us - first_us, 1000000) / 60000000.0::double), 6) as rate from alerts",
    "alert_lines": f"""with {_alerts_sql()}, x as (select *, string_split(users, ',') as l, last_us - first_us as span from alerts)
      select source, first_us, {_CLOCK.format('last_us')} as last_text,
        case when users = '' then '' when len(l) = 1 then ' against ' || l[1] when len(l) = 2 then ' against ' || l[1] || ' and ' || l[2] else ' against ' || l[1] || ', ' || l[2] || ', and ' || (len(l) - 2) || ' other account(s)' end as clause,
        case when span < 1000000 then 'under a second' when span < 60000000 then (span // 1000000) || ' seconds' else (span // 60000000) || ' minute(s)' end as lasted from x""",
    "trailing_repeat": f"with {_chain_sql()}, r as (select source, us, seq, lag(us, {TRIGGER.repeats - 1}) over (partition by source order by us, seq) as back from e) select source, us, seq from r where back > us - {TRIGGER.window}",
    "trigger_cooldown": f"{_triggers_sql()} select source, us, reason from fired",
    "intel_join": f"""{_triggers_sql()}, reg as (select n_nationkey::varchar as ip, n_name as org from nation where n_nationkey % 2 = 0),
      geo as (select n_nationkey::varchar as ip, n_name as country, r_name as city from nation join region on n_regionkey = r_regionkey where n_nationkey % 3 = 0)
      select source, us, reason, org, country, city, concat_ws(' ', '[CTI] source=' || source, 'org="' || org || '"', 'location="' || city || ', ' || country || '"', 'trigger=' || reason) as line
      from fired left join reg on reg.ip = source left join geo on geo.ip = source""",
}
