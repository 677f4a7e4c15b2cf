import random

import pytest

from tidewatch.config import SECOND, BurstConfig, TriggerConfig
from tidewatch.operators.bursts import bursts, events_of, first_crossings, fragments, slice_of
from tidewatch.operators.intel import enrich, intel_json, intel_line
from tidewatch.operators.triggers import cool_down, pointers, trailing_repeats, triggers

SCHEMA = "source string, us long, user string, seq long, rep_idx long, rep_count long"
ALERT = "source string, attempts long, first_us long, last_us long, users array<string>, severity string"


def events(spark, rows):
    """(source, second, user) in order."""
    return spark.createDataFrame([(s, int(t * SECOND), u, i, 0, 1) for i, (s, t, u) in enumerate(rows)], SCHEMA)


def cfg(threshold, window):
    return BurstConfig(threshold, window * SECOND)


def found(df):
    return sorted((r.source, r.attempts, r.first_us // SECOND, r.last_us // SECOND, tuple(r.users), r.severity) for r in df.collect())


def model(rows, threshold, window, live=False):
    out, chains = [], {}
    for s, t, u in sorted(rows, key=lambda r: (r[0], r[1])):
        c = chains.get(s)
        if c is None or t - c[-1][0] > window:
            c = chains[s] = []
            out.append((s, c))
        c.append((t, u))
    got = []
    for s, c in out:
        if live:
            c = c[: max(threshold, 1)] if len(c) >= max(threshold, 1) else []
        if c and len(c) >= threshold:
            n = len(c)
            got.append((s, n, c[0][0], c[-1][0], tuple(dict.fromkeys(u for _, u in c if u)), "critical" if n >= 4 * threshold else "warning" if n >= 2 * threshold else "normal"))
    return sorted(got)


@pytest.mark.parametrize(
    "rows, threshold, window",
    [
        ([("s", t, u) for t, u in zip((0, 5, 10, 15, 20), "rraat")], 5, 60), ([("s", t, "") for t in (0, 5, 10, 15)], 5, 60), ([("s", t, "") for t in (0, 100, 200, 300, 400)], 5, 60),
        ([("s", t, "") for t in (0, 2, 4, 100, 102, 104)], 3, 10), ([("s1", 0, ""), ("s1", 1, ""), ("s1", 2, ""), ("s2", 0, ""), ("s2", 1, "")], 3, 60), ([("s", 0, "x")] * 10, 5, 60),
        ([("s", t, "") for t in range(20)], 5, 60), ([("s", 0, ""), ("s", 60, ""), ("s", 121, "")], 1, 60), ([("s", 0, ""), ("", 0, "")], 0, 0), ([("s", 0, ""), ("s", 0, ""), ("s", 1, "")], 1, 0),
    ],
)
def test_bursts(spark, rows, threshold, window):
    assert found(bursts(events(spark, rows), cfg(threshold, window))) == model(rows, threshold, window)
    assert found(first_crossings(events(spark, rows), cfg(threshold, window))) == model(rows, threshold, window, live=True)


@pytest.mark.parametrize("seed", range(3))
def test_bursts_at_random_and_across_slices(spark, seed):
    rng = random.Random(seed)
    rows = sorted([(f"s{rng.randint(0, 4)}", rng.randint(0, 3000), rng.choice(["", "a", "b", "c"])) for _ in range(400)], key=lambda r: r[1])
    for threshold, window in ((2, 5), (3, 20), (1, 0)):
        want = model(rows, threshold, window)
        assert found(bursts(events(spark, rows), cfg(threshold, window), slice_us=50 * SECOND)) == want
        for size in (None, 50 * SECOND):
            assert found(first_crossings(events(spark, rows), cfg(threshold, window), slice_us=size)) == model(rows, threshold, window, live=True)


@pytest.mark.parametrize("size", [20])
def test_chains_over_levels_of_slices(spark, monkeypatch, size):
    """Chains as long as many slices and lone events, of a source without a name as well; slices meet three by three."""
    monkeypatch.setattr("tidewatch.operators.bursts.LEVEL", 3)
    rng = random.Random(size)
    rows = [("", t, "a") for t in range(-400, 900, 7)] + [("lone", t, rng.choice("abc")) for t in range(0, 4000, 30)] + [("gaps", t + g, "x") for g in (0, 500, 505, 1300) for t in range(0, 300, 9)]
    rows = sorted(rows + [("any", rng.randint(0, 3000), rng.choice(["", "u", "v"])) for _ in range(250)], key=lambda r: r[1])
    for threshold, window in ((1, 10), (5, 8), (2, 0)):
        assert found(bursts(events(spark, rows), cfg(threshold, window), slice_us=size * SECOND)) == model(rows, threshold, window)
        assert found(first_crossings(events(spark, rows), cfg(threshold, window), slice_us=size * SECOND)) == model(rows, threshold, window, live=True)


def test_few_parts_of_a_source_meet(spark):
    """A source of 100,000 lone events: those inside a slice are whole, so that no step sees them together."""
    df = spark.range(100_000).selectExpr("'' as source", "id * 120000000 as us", "'' as user", "id as seq", "0L as rep_idx", "1L as rep_count")
    out = bursts(df, cfg(1, 60))
    assert out.count() == 100_000
    node = out._jdf.queryExecution().executedPlan().toString()
    assert node.count("Window") >= 3
    parts = fragments(df, 60 * SECOND, slice_of(cfg(1, 60), None))
    size = 16 * 60 * SECOND
    steps = parts.where(f"not (pmod(first, {size}) > {60 * SECOND} and {size} - pmod(last, {size}) > {60 * SECOND})").count()
    assert steps < 100_000 / 4


def test_trailing_repeats_across_slices(spark):
    rng = random.Random(5)
    rows = [(f"s{rng.randint(0, 2)}", rng.randint(-300, 900), "") for _ in range(300)]
    for k, window in ((2, 4), (3, 10), (5, 30)):
        times = {s: sorted(t for x, t, _ in rows if x == s) for s, _, _ in rows}
        want = sorted((s, t) for s, ts in times.items() for i, t in enumerate(ts) if i >= k - 1 and ts[i - k + 1] > t - window)
        for size in (None, 40 * SECOND, SECOND):
            got = trailing_repeats(events(spark, rows), TriggerConfig(k, window * SECOND, 0), slice_us=size)
            assert sorted((r.source, r.us // SECOND) for r in got.collect()) == want


def test_negative_window_and_weights(spark):
    df = spark.createDataFrame([("s", 0, "a", 0, 0, 3)], SCHEMA)
    assert [r.attempts for r in bursts(df, BurstConfig(1, -1)).collect()] == [1, 1, 1]
    assert [r.attempts for r in bursts(df, BurstConfig(1, 0)).collect()] == [3]
    assert bursts(df.limit(0)).count() == 0


def test_events_of_ignores_rows_without_time(spark):
    df = spark.createDataFrame([(None, None, "x"), (None, 5, None)], "k string, t long, chain string")
    assert [(r.source, r.us, r.user) for r in events_of(df, "k", "t", "chain").collect()] == [("", 5, "")]


def fire(spark, items, k=3, window=3600, cooldown=86400):
    """items: (kind, source, second, severity)."""
    ev = events(spark, [(s, t, "") for kind, s, t, _ in items if kind == "event"])
    al = spark.createDataFrame([(s, 9, t * SECOND, t * SECOND, [], sev) for kind, s, t, sev in items if kind == "alert"], ALERT)
    return sorted((r.source, r.us // SECOND, r.reason) for r in triggers(ev, al, TriggerConfig(k, window * SECOND, cooldown * SECOND)).collect())


E_ = lambda *ts, s="s": [("event", s, t, None) for t in ts]
C_ = lambda *ts: [("alert", "s", t, "critical") for t in ts]


@pytest.mark.parametrize(
    "items, options, want",
    [
        (E_(0, 60, 120), {}, [("s", 120, "repeat_offender")]), (E_(0, 90, 180), {}, [("s", 180, "repeat_offender")]), (E_(0, 60, 7260), {}, []), (C_(0), {}, [("s", 0, "critical_severity")]),
        ([("alert", "s", 0, "warning")], {}, []), (C_(0, 60, 3700), {"k": 1, "cooldown": 3600}, [("s", 0, "critical_severity"), ("s", 3700, "critical_severity")]),
        (C_(0) + E_(60), {"k": 1, "cooldown": 3600}, [("s", 0, "critical_severity")]), (E_(0) + E_(1, s="s2"), {"k": 2}, []), (E_(0, 10, 3600), {}, []), (E_(0, 0, 0), {"cooldown": 0}, [("s", 0, "repeat_offender")]),
        (C_(0) + E_(0), {"k": 1, "cooldown": 10}, [("s", 0, "repeat_offender")]), (C_(0, 10), {"cooldown": 10}, [("s", 0, "critical_severity"), ("s", 10, "critical_severity")]),
    ],
)
def test_triggers(spark, items, options, want):
    assert fire(spark, items, **options) == want


def test_triggers_at_random(spark):
    rng = random.Random(8)
    for k, window, cooldown in ((1, 10, 0), (2, 15, 40), (3, 30, 100)):
        items = [("event", f"s{rng.randint(0, 5)}", rng.randint(0, 400), None) for _ in range(200)]
        items += [("alert", f"s{rng.randint(0, 5)}", rng.randint(0, 400), rng.choice(["critical", "normal"])) for _ in range(30)]
        want = []
        for s in {i[1] for i in items}:
            times, last = [], None
            for kind, _, t, sev in sorted((i for i in items if i[1] == s), key=lambda i: (i[2], i[0] == "alert")):
                hit = None
                if kind == "event":
                    times = [x for x in times if x > t - window] + [t]
                    hit = "repeat_offender" if len(times) >= k else None
                elif sev == "critical":
                    hit = "critical_severity"
                if hit and (last is None or t - last >= cooldown):
                    want.append((s, t, hit))
                    last = t
        assert fire(spark, items, k, window, cooldown) == sorted(want)


def greedy(times, cooldown):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= cooldown:
            out.append(t)
            last = t
    return out


HIT = "source string, us long, kind int, seq long, rep_idx long, reason string"


@pytest.mark.parametrize("size", [None, 7])
def test_cooldown_over_slices(spark, size):
    """Dense and sparse hits, empty slices in between, times before 1970, ties; slices of any length."""
    rng = random.Random(size)
    times = {"dense": range(-50, 400), "sparse": range(0, 5000, 97), "mixed": [rng.randint(-900, 900) for _ in range(300)], "lone": [3], "steps": [k * 10 for k in range(60)], "far": [0, 4, 9, 10**6, 10**6 + 5, 10**6 + 12]}
    rows = [(s, t, t % 2, n, 0, f"r{t % 3}") for s, ts in times.items() for n, t in enumerate(ts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, HIT)
    for cooldown in (1, 10 if size else 45):
        got = cool_down(df, cooldown, size).collect()
        assert {s: sorted(r.us for r in got if r.source == s) for s in times} == {s: greedy(set(ts), cooldown) for s, ts in times.items()}
        assert all(r.reason == f"r{r.us % 3}" for r in got)
    assert cool_down(df, 0).count() == cool_down(df, -5).count() == len(rows) and cool_down(df.limit(0), 10).count() == 0


def test_cooldown_of_a_million_hits_of_one_source(spark):
    """One source, a hit a second: pointers and rounds are dealt by slice and instant, so every task has its share."""
    hits = spark.range(1_000_000).selectExpr("'s' as source", "id * 1000000 + pmod(id * 7919, 1000) as us", "0 as kind", "id as seq", "0L as rep_idx", "'x' as reason")
    cooldown = 3600 * SECOND
    plan = pointers(hits.select("source", "us", "reason"), cooldown)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "slice" in plan
    slices = hits.selectExpr(f"floor(us / {16 * cooldown}) as slice").groupBy("slice").count().agg({"count": "max"}).first()[0]
    assert slices < 100_000
    got = [r.us for r in cool_down(hits, cooldown, 16 * cooldown).orderBy("us").collect()]
    assert got == greedy([i * 1_000_000 + i * 7919 % 1000 for i in range(1_000_000)], cooldown)


def test_intel(spark):
    t = spark.createDataFrame([("a", 0, "repeat_offender"), ("b", 0, "critical_severity")], "source string, us long, reason string")
    reg = spark.createDataFrame([("a", 'Big "Net"', "")], "ip string, org string, network string")
    geo = spark.createDataFrame([("a", "", "Town", "AS1", "isp"), ("b", "Land", "", None, None)], "ip string, country string, city string, asn string, isp string")
    rows = {r.source: r for r in enrich(t, reg, geo).select("source", intel_line().alias("t"), intel_json().alias("j")).collect()}
    assert rows["a"].t == '[CTI] source=a org="Big \\"Net\\"" asn="AS1" trigger=repeat_offender'
    assert rows["b"].t == '[CTI] source=b location="Land" trigger=critical_severity'
    assert rows["b"].j == '{"type":"cti","trigger":"critical_severity","ip":"b","country":"Land"}'
    assert enrich(t, None, None).count() == 2
