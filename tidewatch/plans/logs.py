"""From a log file to alerts and triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BurstConfig, TriggerConfig
from ..operators.bursts import bursts, events_of
from ..operators.parse import expand, parse_lines, with_time
from ..operators.triggers import triggers
from ..operators.years import years_by_block
from ..sources.lines import read_lines


ORDER = ("log_path", "block_start", "line_id")


def dated(lines: DataFrame) -> DataFrame:
    """Ordered lines to failed logins with year_seq. The lines are read here, once; what follows reads what is stored of them."""
    return years_by_block(parse_lines(lines, ORDER), "block_start", ORDER[1:], "log_path")


def events_from(rows: DataFrame) -> DataFrame:
    """dated() rows to events with times; repeats stay weighted (rep_count)."""
    return events_of(with_time(rows).withColumn("seq", F.col("line_id")), "source", "ts", "user", "seq")


def log_events(lines: DataFrame) -> DataFrame:
    return events_from(dated(lines))


def scan(spark: SparkSession, path: str, config: BurstConfig = BurstConfig(), strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, alerts) of a log file, or of several that each have their own years. strict: too long lines are an error."""
    events = log_events(read_lines(spark, path, strict))
    return events, bursts(events, config)


def scan_triggers(events: DataFrame, alerts: DataFrame, config: TriggerConfig = TriggerConfig()) -> DataFrame:
    single = events.withColumnRenamed("rep_idx", "_r").select("*", F.explode(F.expr("sequence(0L, rep_count - 1)")).alias("rep_idx")).drop("_r")
    return triggers(single, alerts, config)


def last_month(rows: DataFrame) -> tuple[int, int]:
    """(year_seq, month) of the last of dated() rows, for a stream that goes on from there; (0, 0) without one."""
    last = rows.agg(F.max_by(F.struct("year_seq", "month"), F.struct(*ORDER)).alias("m")).first().m
    return (int(last.year_seq), int(last.month)) if last else (0, 0)
