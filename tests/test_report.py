import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch import render
from tidewatch.config import SECOND
from tidewatch.functions import scalars as S
from tidewatch.operators import report

SCHEMA = "source string, attempts long, first_us long, last_us long, users array<string>, severity string"
T0 = 946_684_800 * SECOND  # year 0 of a log


def alerts(spark, rows):
    return spark.createDataFrame([(s, n, T0 + a * SECOND, T0 + z * SECOND, u, v) for s, n, a, z, u, v in rows], SCHEMA)


def test_nothing(spark):
    none = alerts(spark, [])
    assert "".join(render.table(none)) == render.summary(none) == render.stats(none) == render.NOTHING
    assert "".join(render.json_array(none)) == "[]"


def test_table_order_and_padding(spark):
    text = "".join(render.table(alerts(spark, [("n", 5, 0, 60, [], "normal"), ("c", 20, 0, 0, [f"u{i}" for i in range(50)], "critical"), ("w", 10, 5, 9, ["root"], "warning")])))
    lines = text.splitlines()
    assert [x[0] for x in lines[1:]] == ["c", "w", "n"]
    assert lines[1].endswith("u7, +42 more") and not any(x.endswith(" ") for x in lines[:3])
    assert "1200.0/min" in lines[1] and "Jan  1 00:00:05" in lines[2]


def test_summary_rolls_up(spark):
    text = render.summary(alerts(spark, [(f"s{i}", 5 + i, i, i + 90, ["root", "admin"][: i % 3], "normal") for i in range(8)]), lambda ips: spark.createDataFrame([("s7", "host"), ("s0", "unseen")], "ip string, host string"))
    assert "8 source(s) flagged" in text and "Minor attempts (8):" in text
    assert "  ...and 3 more, most commonly targeting: root (2), admin (1)" in text
    assert "s7 (host) tried 12 password(s) against root over 1 minute(s) (8.0/min)" in text


def test_rows_that_cannot_be_told_apart_are_counted(spark):
    rows = [("a", 9, 0, 9, ["x"], "normal")] + [("s", 5, 0, 9, ["x"], "normal")] * 7 + [("z", 1, 3, 9, ["y"], "normal")] * 2 + [("c", 9, 0, 1, [], "critical")] * 5
    got = {r.severity: (r.alerts, r.commonly) for r in report.tier_rollup(alerts(spark, rows), 5).collect()}
    assert got == {"normal": (5, "x (3), y (2)")}


def test_users_per_group(spark):
    rng = random.Random(2)
    rows = [("s", 5, i, i, rng.sample([f"u{k}" for k in range(200)], 3), rng.choice(["normal", "warning"])) for i in range(400)]
    got = {(r.severity, r.user): r.alerts for r in report.top_users(alerts(spark, rows), 4, ("severity",)).collect()}
    want = {}
    for tier in ("normal", "warning"):
        n = Counter(u for r in rows if r[5] == tier for u in r[4])
        want |= {(tier, u): n[u] for u in sorted(n, key=lambda u: (-n[u], u))[:4]}
    assert got == want


def test_stats(spark):
    day = 86400
    rows = [(f"s{i}", 5, d * day + i * 60, d * day + i * 60 + 5, ["root"], "normal") for i, d in enumerate((0, 0, 1, 2, 2, 2))]
    text = render.stats(alerts(spark, rows))
    assert "ACTIVITY (by day)" in text and "6 alerts, 6 sources, 30 attempts" in text
    got = report.histogram(alerts(spark, rows)).orderBy("start_us").collect()
    assert [(r.label, r.alerts) for r in got] == [("Jan  1", 2), ("Jan  2", 1), ("Jan  3", 3)]


@pytest.mark.parametrize("hours, want", [(0.5, 1), (20, 1), (21, 24), (9 * 24, 24), (20 * 24, 24), (21 * 24, 168), (42 * 24, 168), (264 * 24, 720), (1000 * 24, 1440), (0, 1)])
def test_bucket_unit(spark, hours, want):
    assert spark.range(1).select(S.bucket_unit(F.lit(int(hours * S.HOUR))).alias("u")).first().u == want * S.HOUR


def test_small_functions(spark):
    one = spark.range(1)
    bars = one.select(*[F.length(S.bar(F.lit(a), F.lit(b))).alias(f"b{i}") for i, (a, b) in enumerate(((0, 10), (10, 10), (5, 10), (1, 100)))]).first()
    assert tuple(bars) == (0, 40, 20, 1)
    users = one.select(*[S.users_clause(F.lit(u) if u else F.array().cast("array<string>")).alias(f"u{i}") for i, u in enumerate(([], ["a"], ["a", "b"], ["a", "b", "c"]))]).first()
    assert tuple(users) == ("", " against a", " against a and b", " against a, b, and 1 other account(s)")
    spans = one.select(*[S.duration_words(F.lit(int(s * SECOND))).alias(f"d{i}") for i, s in enumerate((0, 0.5, 12, 90))]).first()
    assert tuple(spans) == ("under a second", "under a second", "12 seconds", "1 minute(s)")


def test_json(spark):
    a = alerts(spark, [("s", 5, 0, 60, ["root"], "normal"), ("t", 5, -1, 60, [], "normal")]).where("source = 's'")
    assert json.loads("".join(render.json_array(a))) == [{"Source": "s", "Attempts": 5, "FirstSeen": "0000-01-01T00:00:00Z", "LastSeen": "0000-01-01T00:01:00Z", "Users": ["root"], "Severity": "normal"}]


def test_a_json_array_is_written_element_by_element(spark):
    rows = alerts(spark, [(f"s<{i}>", 5 + i, i, 60 + i, ["a&b"], "normal") for i in range(40)]).repartition(5)
    pieces = list(render.json_array(rows))
    text = "".join(pieces)
    assert len(pieces) == 41 and not set("<>&") & set(text) and [x["Attempts"] for x in json.loads(text)] == list(range(5, 45))
    assert text == json.dumps(json.loads(text), indent=2).replace("<", r"\u003c").replace(">", r"\u003e").replace("&", r"\u0026")


def test_rate_ties(spark):
    row = alerts(spark, [("s", 5, 0, 48, [], "normal")]).first()
    assert render.rate(row) == "6.2/min"
