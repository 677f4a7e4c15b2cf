"""Reports as text. Spark aggregates; only the rows that are printed come here, and of long reports one partition at a time."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import bucket_unit, unit_name
from .operators import report

# fixed values: wording, widths and colours of the reports
NOTHING = "No brute-force activity detected.\n"
HEADERS = ("SOURCE", "ATTEMPTS", "RATE", "FIRST SEEN", "LAST SEEN", "USERS TRIED")
TIER_LABELS = {"critical": "Severe attacks", "warning": "Moderate attacks", "normal": "Minor attempts"}
COLOURS = {"critical": "\x1b[31m", "warning": "\x1b[33m"}
RESET = "\x1b[0m"
USERS_SHOWN, DETAILED, BAR = 8, 5, 40


def rows_of(alerts: DataFrame) -> Iterator:
    """Alerts with what lines need beside their columns, partition by partition: no more than one is held here."""
    return alerts.select("*", *report.shown(), *report.listed(USERS_SHOWN)).toLocalIterator()


def rate(a) -> str:
    return rate_text(a.attempts, a.last_us - a.first_us)


def rate_text(attempts: int, span: int) -> str:
    return f"{attempts / (max(span, 1_000_000) / 60_000_000):.1f}/min"


def coloured(text: str, severity: str, colour: bool) -> str:
    return f"{COLOURS[severity]}{text}{RESET}" if colour and severity in COLOURS else text


def line(a, colour: bool = False) -> str:
    return coloured(f"[ALERT] {a.last_text}  source={a.source}  attempts={a.attempts}  rate={rate(a)}  users={a.users_list or '-'}", a.severity, colour)


def cells(alerts: DataFrame) -> DataFrame:
    """Alerts with the six texts of their table row as the array `cells`."""
    def rates(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([rate_text(n, z - a) for n, a, z in zip(*(b.column(c).to_pylist() for c in ("attempts", "first_us", "last_us")))], pa.string())], names=[*b.schema.names, "rate"])

    texts = alerts.select("*", *report.shown(), *report.listed(USERS_SHOWN))
    fields = ", ".join(f"{n} {t}" for n, t in texts.dtypes)
    rated = texts.mapInArrow(rates, f"{fields}, rate string")
    return rated.withColumn("cells", F.array("source", F.col("attempts").cast("string"), "rate", "first_text", "last_text", "users_text"))


def table(alerts: DataFrame, colour: bool = False) -> Iterator[str]:
    """All alerts as lines, worst first; the last column is not padded. Widths are an aggregate; rows pass one partition at a time."""
    rows = cells(alerts).select(*alerts.columns, "cells").persist()
    try:
        columns = range(len(HEADERS) - 1)
        widest = rows.agg(*[F.max(F.octet_length(F.col("cells")[i])).alias(f"w{i}") for i in columns]).first()
        if widest.w0 is None:
            yield NOTHING
            return
        widths = [max(len(HEADERS[i]), widest[i]) + 2 for i in columns]
        padded = lambda c: "".join(x.ljust(w) for x, w in zip(c, widths)) + c[-1]
        yield padded(HEADERS) + "\n"
        for a in rows.orderBy(*report.display_order()).toLocalIterator():
            yield coloured(padded(a.cells), a.severity, colour) + "\n"
    finally:
        rows.unpersist()


def sentence(a, host: str | None = None) -> str:
    who = f"{a.source} ({host})" if host else a.source
    return f"{who} tried {a.attempts} password(s){a.clause} over {a.lasted} ({rate(a)}) — last seen {a.last_text}"


def summary(alerts: DataFrame, hosts: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """An outline by severity. hosts: addresses (ip) to names (ip, host); only the sources told in detail are asked for."""
    head = report.header(alerts).select("*", *report.shown()).first()
    if not head.alerts:
        return NOTHING
    top = with_hosts(report.top_per_tier(alerts, DETAILED), hosts).orderBy("severity", "place").select("*", *report.told()).collect()
    rest = {r.severity: r for r in report.tier_rollup(alerts, DETAILED).collect()}
    out = ["SSH Brute-Force Summary", f"{head.alerts} source(s) flagged, {head.first_text} to {head.last_text}", ""]
    for tier, label in TIER_LABELS.items():
        own = [a for a in top if a.severity == tier]
        if own:
            more = rest.get(tier)
            out.append(f"{label} ({len(own) + (more.alerts if more else 0)}):")
            out += [f"  - {sentence(a, a.host)}" for a in own]
            if more:
                out.append(f"  ...and {more.alerts} more, most commonly targeting: {more.commonly}")
            out.append("")
    return "\n".join(out) + "\n"


def with_hosts(alerts: DataFrame, hosts: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Adds host, the name of the source, where there is one."""
    if hosts is None:
        return alerts.withColumn("host", F.lit(None).cast("string"))
    names = hosts(alerts.select(F.col("source").alias("ip")).where("source != ''"))
    return alerts.join(names.withColumnRenamed("ip", "source"), "source", "left")


def stats(alerts: DataFrame, colour: bool = False) -> str:
    """Severity bars, activity over time, and the top ten. The unit named is the one that was chosen."""
    head = report.header(alerts).select("*", *report.shown(), unit_name(bucket_unit(F.col("last_us") - F.col("first_us"))).alias("unit")).first()
    if not head.alerts:
        return NOTHING
    out = [f"=== {head.alerts} alerts, {head.sources} sources, {head.attempts} attempts | {head.first_text} - {head.last_text} ===", "", "SEVERITY"]
    out += [coloured(f"  {r.severity:<8} {r.bar:<{BAR}} {r.alerts:>4} ({r.percent:>3}%)", r.severity, colour and r.alerts > 0) for r in report.severity_counts(alerts).collect()]
    out += ["", f"ACTIVITY (by {head.unit})"]
    out += [f"  {r.label:<14} {r.bar:<{BAR}} {r.alerts}" for r in report.histogram(alerts).orderBy("start_us").collect()]
    out += ["", "TOP OFFENDERS"]
    top = list(rows_of(report.top_offenders(alerts)))
    out += [coloured(f"  {i:>2}. {a.source:<15} {a.attempts:>5} attempts  {a.severity:<8} {a.users_text or '-'}", a.severity, colour) for i, a in enumerate(top, 1)]
    if head.alerts > len(top):
        out.append(f"  ...and {head.alerts - len(top)} more sources")
    return "\n".join(out) + "\n"


def json_array(alerts: DataFrame) -> Iterator[str]:
    """All alerts as one JSON array, element by element, in order of time."""
    before = "["
    for r in alerts.orderBy("first_us", "source").select(report.alert_json().alias("j")).toLocalIterator():
        one = json.dumps(json.loads(r.j), indent=2, ensure_ascii=False).replace("\n", "\n  ")
        yield before + "\n  " + one.replace("<", r"\u003c").replace(">", r"\u003e").replace("&", r"\u0026")
        before = ","
    yield "[]" if before == "[" else "\n]"
