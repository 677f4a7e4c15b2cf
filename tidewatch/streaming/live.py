"""Live detection: years carried along each log, then bursts and triggers per source, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import BurstConfig, TriggerConfig
from ..functions.scalars import BASE_YEAR, DAY
from ..operators.parse import expand, parse_lines, with_time
from ..operators.triggers import CRITICAL, REPEAT
from .watch import observed

YEARS = "log_path string, line_id long, month int, day int, hour int, minute int, second int, source string, user string, rep_count long, raw string, year_seq long"
EVENT = "source string, us long, user string, seq long, rep_idx long"
FOUND = "source string, kind string, us long, attempts long, first_us long, last_us long, users array<string>, severity string, reason string"


class YearCarry(StatefulProcessor):
    """Per log: the year so far and the last matched month. A log that was scanned before goes on from there."""

    def __init__(self, start: tuple[int, int] = (0, 0)):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "year long, month int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        year, month = self.at.get() if self.at.exists() else self.start
        for pdf in [pd.concat(list(rows)).sort_values("line_id")]:
            years = []
            for m in pdf["month"]:
                year, month = year + (m < month), int(m)
                years.append(year)
            yield pdf.assign(year_seq=years)
        self.at.update((int(year), int(month)))

    def close(self) -> None:
        pass


class Detector(StatefulProcessor):
    """Per source, in the order of arrival: look for a repeat offender, feed the running chain, look at its alert.

    State: the chain's last and first time, its length and whether it has alerted; its users so far (fewer than an alert needs);
    the trailing times that can still count (fewer than `repeats`); the last trigger. All of it goes when a source has been quiet
    for `keep` microseconds of the clock on the wall: by then no event can still join its chain, its window or its cooldown.
    """

    def __init__(self, bursts: BurstConfig, triggers: TriggerConfig, keep: int):
        self.b, self.t, self.keep = bursts, triggers, max(1, keep // 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chain = handle.getValueState("chain", "last long, first long, n long, alerted boolean, hit long", self.keep)
        self.times = handle.getListState("times", "us long", self.keep)
        self.users = handle.getListState("users", "user string", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, first, n, alerted, hit = self.chain.get() if self.chain.exists() else (None, None, 0, False, None)
        times = [t for (t,) in self.times.get()] if self.times.exists() else []
        users = [u for (u,) in self.users.get()] if self.users.exists() else []
        events = pd.concat(list(rows)).sort_values(["seq", "rep_idx"])
        us, need, out, fires = events["us"].to_numpy(np.int64), max(self.b.threshold, 1), [], []

        repeats, times = trailing(np.array(times, np.int64), us, self.t.repeats, self.t.window)
        fires += [(int(i), 0, int(us[i]), REPEAT) for i in np.flatnonzero(repeats)]

        # chains: a new one where the gap from the event before is larger than the window
        gap = np.diff(us, prepend=us[0] if last is None else last)
        fresh = gap > self.b.window
        fresh[0] |= last is None
        starts = np.flatnonzero(fresh)
        if not len(starts) or starts[0] > 0:
            starts = np.append(0, starts)
        who = events["user"].to_numpy(object)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(us)]):
            if fresh[s]:
                first, n, alerted, users = int(us[s]), 0, False, []
            if not alerted:
                at = s + need - n  # one after the event that makes the chain long enough
                users = list(dict.fromkeys(users + [u for u in who[s : min(e, at)] if u]))
                if at <= e:
                    alerted, when = True, int(us[at - 1])
                    tier = "critical" if need >= 4 * self.b.threshold else "warning" if need >= 2 * self.b.threshold else "normal"
                    out.append((at - 1, 1, (key[0], "alert", when, need, first, when, users, tier, None)))
                    if tier == "critical":
                        fires.append((at - 1, 1, when, CRITICAL))
                    users = []
            n += e - s
        for i, kind, when, reason in sorted(fires):
            if hit is None or when - hit >= self.t.cooldown:
                hit = when
                out.append((i, 2 * kind, (key[0], "trigger", when, None, None, None, None, None, reason)))

        self.chain.update((int(us[-1]), first, int(n), bool(alerted), hit))
        self.times.put([(int(t),) for t in times])
        if users:
            self.users.put([(u,) for u in users])
        else:
            self.users.clear()
        if out:
            pdf = pd.DataFrame([row for _, _, row in sorted(out, key=lambda x: x[:2])], columns=[x.split()[0] for x in FOUND.split(", ")])
            for c in ("attempts", "first_us", "last_us"):
                pdf[c] = pdf[c].astype("Int64")
            yield pdf

    def close(self) -> None:
        pass


def trailing(held: np.ndarray, us: np.ndarray, repeats: int, window: int) -> tuple[np.ndarray, list[int]]:
    """(is the `repeats`-th or a later one within (t - window, t], of each event; the times that may count for the next one).

    Times are as they arrive. A time that has once fallen out of a window does not come back, should the clock go backwards.
    """
    k = max(1, repeats)
    every = np.concatenate([held, us])
    if (np.diff(every) >= 0).all():
        back = np.concatenate([np.full(k - 1, np.iinfo(np.int64).min // 2), every])[len(held) : len(held) + len(us)]
        many = (back > us - window) | (k == 1)
        left = every[every > us[-1] - window][-k:]
        return many, left.tolist() or [int(us[-1])]
    many, times = np.zeros(len(us), bool), held.tolist()
    for i, t in enumerate(us.tolist()):
        times = ([x for x in times if x > t - window] + [t])[-k:]
        many[i] = len(times) >= repeats
    return many, times


def live_events(lines: DataFrame, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """A stream of (log_path, line_id, value) to expanded events with years carried along each log; start: year and month it goes on from."""
    parsed = observed(parse_lines(observed(lines, "lines"), ("log_path", "line_id")), "events")
    dated = with_time(parsed.groupBy("log_path").transformWithStateInPandas(YearCarry(start), YEARS, "Append", "None"), BASE_YEAR)
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return expand(dated).select("source", us.alias("us"), "user", F.col("line_id").alias("seq"), F.col("rep_idx").cast("long").alias("rep_idx"))


def detect(events: DataFrame, bursts: BurstConfig = BurstConfig(), triggers: TriggerConfig = TriggerConfig(), grace: int = DAY) -> DataFrame:
    """A stream of events (EVENT) to alerts and triggers (FOUND). Needs the RocksDB state store.

    A source's state goes once it has been quiet for the longest of both windows and the cooldown, and `grace` for late lines.
    """
    keep = max(bursts.window, triggers.window, triggers.cooldown, 0) + grace
    return events.groupBy("source").transformWithStateInPandas(Detector(bursts, triggers, keep), FOUND, "Append", "ProcessingTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
