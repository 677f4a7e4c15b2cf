"""python -m tidewatch.cli -file auth.log [-json | -summary | -stats] [-follow] [-cti] ..."""

from __future__ import annotations

import argparse
import re
import signal
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .config import SECOND, BurstConfig, TriggerConfig
from .operators import report
from .operators.bursts import bursts
from .operators.intel import enrich, intel_json, intel_line
from .plans.logs import dated, events_from, last_month, scan_triggers
from .sources import lookups
from .sources.lines import read_lines
from .sources.tail import follow, read_until, whole_until
from .streaming.live import detect, live_events, use_rocksdb
from .streaming.sinks import Shown, Written, to_each
from .streaming.watch import Watch

_UNIT = {"ms": 1000, "s": SECOND, "m": 60 * SECOND, "h": 3600 * SECOND}


def duration(text: str) -> int:
    """'1h30m' in microseconds."""
    sign, parts = (-1 if text.startswith("-") else 1), re.findall(r"([0-9.]+)(ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("+-"):
        raise argparse.ArgumentTypeError(f"not a duration: {text}")
    return sign * round(sum(float(a) * _UNIT[b] for a, b in parts))


def duration_text(us: int) -> str:
    """60 seconds as '1m0s'."""
    hours, rest = divmod(us, _UNIT["h"])
    minutes, rest = divmod(rest, _UNIT["m"])
    seconds = f"{rest / SECOND:g}s"
    return f"{hours}h{minutes}m{seconds}" if hours else f"{minutes}m{seconds}" if minutes else seconds


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidewatch", prefix_chars="-")
    p.add_argument("-file", required=True)
    for flag in ("json", "summary", "stats", "follow", "quiet-startup", "cti"):
        p.add_argument(f"-{flag}", action="store_true", dest=flag.replace("-", "_"))
    p.add_argument("-threshold", type=int, default=5)
    p.add_argument("-window", type=duration, default=60 * SECOND)
    p.add_argument("-cti-threshold", type=int, default=3)
    p.add_argument("-cti-window", type=duration, default=3600 * SECOND)
    p.add_argument("-cti-cooldown", type=duration, default=24 * 3600 * SECOND)
    p.add_argument("-checkpoint", help="folder that keeps how far -follow has come")
    p.add_argument("-registry", help="Parquet table ip, org, network")
    p.add_argument("-geo", help="Parquet table ip, country, city, asn, isp")
    p.add_argument("-registry-client", help="module:function, or a URL with {ip}, that is asked for what registries know")
    p.add_argument("-geo-client", help="the same for locations")
    p.add_argument("-hosts", action="store_true", help="names of the sources in -summary")
    p.add_argument("-resolver", default="tidewatch.sources.lookups:reverse_dns", help="module:function that gives the names of an address")
    p.add_argument("-cache", help="folder that keeps what clients and resolver have answered")
    p.add_argument("-out", help="folder that gets what -follow finds, as JSON lines by batch")
    a = p.parse_args(argv)
    if a.json and a.summary or a.stats and (a.json or a.summary or a.follow):
        p.error("these outputs exclude each other")
    return a


def _cache(a: argparse.Namespace, name: str) -> str | None:
    return f"{a.cache}/{name}" if a.cache else None


def _hosts(a: argparse.Namespace):
    """A function that adds names to addresses, if they are asked for."""
    return (lambda ips: lookups.hostnames(ips, lookups.named(a.resolver), _cache(a, "hosts"))) if a.hosts else None


def _enriched(spark: SparkSession, fired: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Triggers with what tables, or else clients, know about their sources."""
    ips = fired.select(F.col("source").alias("ip")).where("source != ''")
    known = [spark.read.parquet(p) if p else None for p in (a.registry, a.geo)]
    if a.registry_client and not a.registry:
        known[0] = lookups.registry_fields(lookups.answers(ips, lookups.named(a.registry_client, lookups.REGISTRY_FIELDS), lookups.REGISTRY, _cache(a, "registry")))
    if a.geo_client and not a.geo:
        known[1] = lookups.geo_fields(lookups.answers(ips, lookups.named(a.geo_client, lookups.GEO_FIELDS), lookups.GEO, _cache(a, "geo")))
    return enrich(fired, *known)


def _notes(spark: SparkSession, fired: DataFrame, a: argparse.Namespace) -> None:
    fired = fired.cache()
    for r in _enriched(spark, fired, a).orderBy("us", "source").select((intel_json() if a.json else intel_line()).alias("t")).collect():
        print(r.t, file=sys.stderr)
    fired.unpersist()


def main(argv: list[str] | None = None, spark: SparkSession | None = None, wait: bool = True):
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("tidewatch").getOrCreate()
    burst, trigger = BurstConfig(a.threshold, a.window), TriggerConfig(a.cti_threshold, a.cti_window, a.cti_cooldown)
    colour = sys.stdout.isatty()
    # the scan ends where following begins, so that every line is read once, whatever is written meanwhile
    begin = whole_until(a.file) if a.follow else 0
    lines = read_until(spark, a.file, begin, strict=True) if a.follow else read_lines(spark, a.file, strict=True)
    rows = dated(lines)
    if not (a.follow and a.quiet_startup):
        events = events_from(rows)
        alerts = bursts(events, burst).cache()
        if a.json:
            sys.stdout.writelines(render.json_array(alerts))
            print()
        elif a.summary:
            print(render.summary(alerts, _hosts(a)), end="")
        elif a.stats:
            print(render.stats(alerts, colour), end="")
        else:
            sys.stdout.writelines(render.table(alerts, colour))
        if a.cti:
            _notes(spark, scan_triggers(events, alerts, trigger), a)
        alerts.unpersist()
    if not a.follow:
        return None
    use_rocksdb(spark)
    print(f"Watching {a.file} for new activity (threshold={a.threshold}, window={duration_text(a.window)})... press Ctrl+C to stop", file=sys.stderr)

    def show(found: DataFrame) -> None:
        alerts = found.orderBy("us", "source")
        if a.json:
            for r in alerts.select(report.alert_json().alias("j")).collect():
                print(r.j, flush=True)
        elif a.summary:
            for r in render.with_hosts(alerts, _hosts(a)).orderBy("us", "source").select("*", *report.told()).collect():
                print(render.sentence(r, r.host), flush=True)
        else:
            for r in render.rows_of(alerts):
                print(render.line(r, colour), flush=True)

    marks = lambda name: f"{a.checkpoint}/{name}" if a.checkpoint else None
    alert, trigger_ = "kind = 'alert'", "kind = 'trigger'"
    sinks = [(alert, Shown(spark, show, marks("shown")))]
    if a.cti:
        sinks.append((trigger_, Shown(spark, lambda found: _notes(spark, found.select("source", "us", "reason"), a), marks("noted"))))
    if a.out:
        sinks += [(alert, Written(f"{a.out}/alerts")), (trigger_, Written(f"{a.out}/triggers"))]
    found = detect(live_events(follow(spark, a.file, str(begin)), last_month(rows)), burst, trigger)
    # state that ages lets batches follow each other without end: one a second is enough
    writer = found.writeStream.outputMode("append").trigger(processingTime="1 second").foreachBatch(to_each(*sinks))
    spark.streams.addListener(watch := Watch())
    query = (writer.option("checkpointLocation", a.checkpoint) if a.checkpoint else writer).start()
    query.watch = watch
    if wait:
        signal.signal(signal.SIGTERM, lambda *_: query.stop())
        try:
            query.awaitTermination()
        except KeyboardInterrupt:
            query.stop()
    return query


if __name__ == "__main__":
    main()
