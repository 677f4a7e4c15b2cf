import json
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.parse import expand, parse_lines, with_time
from tidewatch.operators.years import years_by_block
from tidewatch.plans.logs import scan
from tidewatch.sources.lines import read_lines

PAM = "Mar  4 09:00:01 h1 sshd(pam_unix)[77]: authentication failure; logname= uid=0 rhost=203.0.113.9 "
SSH = "Mar 14 09:00:04 h1 sshd[80]: Failed password for root from 203.0.113.9 port 4001 ssh2"


def years_by_order(events, order):
    """year_seq over one global order, in one task."""
    w = W.orderBy(*order)
    return events.withColumn("year_seq", F.sum(F.coalesce((F.col("month") < F.lag("month").over(w)).cast("int"), F.lit(0))).over(w))


def parsed(spark, *lines):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "block_start long, line_id long, value string")
    return parse_lines(df)


@pytest.mark.parametrize(
    "line, source, user, n",
    [
        (PAM, "203.0.113.9", "", 1),
        ("Mar  4 09:00:02 h1 sshd(pam_unix)[78]: authentication failure; uid=0 rhost=a.example.net  user=root", "a.example.net", "root", 1),
        ("Mar  4 09:00:03 h1 sshd[79]: Failed password for invalid user eve from 203.0.113.9 port 4000 ssh2", "203.0.113.9", "eve", 1),
        (SSH, "203.0.113.9", "root", 1),
        (SSH.replace("root", "eve\x1b[2J"), "203.0.113.9", "eve[2J", 1),
        (SSH.replace("root", "root" + "\x0b" * 8), "203.0.113.9", "root", 1),
        ("Mar  4 09:00:01 h1 sshd[81]: message repeated 4 times: [ Failed password for root from 203.0.113.9 port 4002 ssh2]", "203.0.113.9", "root", 4),
        ("Mar  4 09:00:01 h1 sshd(pam_unix)[81]: message repeated 2 times: [ authentication failure; uid=0 rhost=203.0.113.7 ]", "203.0.113.7", "", 2),
        ("feb 29 23:59:59 h1 sshd[80]: Failed password for root from x port 1 ssh2", "x", "root", 1),
    ],
)
def test_lines_that_are_failed_logins(spark, line, source, user, n):
    row = parsed(spark, line).collect()
    assert [(r.source, r.user, r.rep_count, r.raw) for r in row] == [(source, user, n, line)]
    assert expand(parsed(spark, line)).count() == n


@pytest.mark.parametrize(
    "line",
    [
        "", None, "Mar  4 09:00:01 h1 sshd(pam_unix)[77]: check pass; user unknown", "Mar  4 09:00:01 h1 logrotate: done", "Mar  4 09:00:01 h1 sshd[1]: message repeated 2 times: [ Invalid user x from y]",
        SSH.replace("Mar 14", "Mar 32"), SSH.replace("09:00:04", "24:00:04"), SSH.replace("09:00:04", "09:00:60"), SSH.replace("Mar 14", "Mar\t14"), SSH.replace("Mar", "Abc"), SSH.replace("Mar 14", "Feb 30"),
        SSH.replace("root", "a b"), SSH.replace("root", "invalid user "), PAM.strip() + " user=",
        "Mar  4 09:00:01 h1 sshd[81]: message repeated 0 times: [ Failed password for root from 203.0.113.9 port 4002 ssh2]",
        "Mar  4 09:00:01 h1 sshd[81]: message repeated 99999999999999999999 times: [ Failed password for root from 203.0.113.9 port 4002 ssh2]",
    ],
)
def test_lines_that_are_not(spark, line):
    assert parsed(spark, line).count() == 0


def dated(months):
    return [f"{m} 09:00:00 h sshd[1]: Failed password for root from x port 1 ssh2" for m in months]


@pytest.mark.parametrize(
    "months, years",
    [(["Dec 30", "Dec 31", "Jan  1", "Jan  2"], [0, 0, 1, 1]), (["Jan  1", "Jun  1", "Dec  1"], [0, 0, 0]), (["Dec  1", "Jan  1", "Dec  1", "Jan  1"], [0, 1, 1, 2])],
)
def test_years(spark, months, years):
    lines = dated(months)
    lines.insert(1, "Jan  1 09:00:00 h other: nothing")  # lines that do not match change no year
    got = years_by_block(parsed(spark, *lines), "block_start", ("block_start", "line_id")).orderBy("line_id").collect()
    assert [r.year_seq for r in got] == years


def test_events_are_read_once(spark, tmp_path):
    """Neither the blocks' ends nor the rows go back to the log."""
    p = tmp_path / "a.log"
    p.write_text("\n".join(dated(["Dec 30", "Jan  1", "Mar  1"])))
    from tidewatch.plans.logs import log_events

    plan = log_events(read_lines(spark, str(p)))._jdf.queryExecution().toString()
    assert "a.log" not in plan and "FileScan text" not in plan


def test_leap_day_of_a_common_year_is_the_first_of_march(spark):
    got = with_time(years_by_order(parsed(spark, *dated(["Feb 29", "Jan  1", "Feb 29"])), ("line_id",))).orderBy("line_id").collect()
    assert [str(r.ts)[:10] for r in got] == ["2000-02-29", "2001-01-01", "2001-03-01"]


def test_years_by_block_equal_years_by_order(spark):
    rng = random.Random(4)
    rows = [(i // 7 if i % 50 else i // 7, i, rng.randint(1, 12)) for i in range(700)]
    df = spark.createDataFrame(rows, "b long, i long, month int")
    a = years_by_order(df, ("b", "i")).select("i", "year_seq").collect()
    b = years_by_block(df, "b", ("b", "i")).select("i", "year_seq").collect()
    assert sorted(a) == sorted(b)


def test_file_scan(spark, tmp_path):
    p = tmp_path / "auth.log"
    p.write_bytes(("\r\n".join([f"Dec 31 23:59:5{i} h sshd[1]: Failed password for u{i} from 198.51.100.4 port 1 ssh2" for i in range(4)]) + "\nlone\rcr\nJan  1 00:00:01 h sshd[1]: Failed password for u0 from 198.51.100.4 port 1 ssh2").encode())
    assert read_lines(spark, str(p)).where(F.col("value").contains("lone\rcr")).count() == 1
    _, alerts = scan(spark, str(p))
    assert [(r.source, r.attempts, r.users, r.severity) for r in alerts.collect()] == [("198.51.100.4", 5, ["u0", "u1", "u2", "u3"], "normal")]


def test_years_of_several_logs_are_their_own(spark, tmp_path):
    from tidewatch.plans.logs import log_events
    from tidewatch.sources.lines import read_lines

    line = "{} sshd[1]: Failed password for root from {} port 22 ssh2\n".format
    for name, days in (("a", ("Dec 30 01:00:00 h", "Jan  2 01:00:00 h")), ("b", ("Nov  1 01:00:00 h", "Dec 31 01:00:00 h"))):
        (tmp_path / f"{name}.log").write_text("".join(line(d, name) for d in days))
    got = {(r.source, r.us) for r in log_events(read_lines(spark, str(tmp_path))).select("source", "us").collect()}
    year = {s: {str(np.datetime64(us, "us"))[:4] for x, us in got if x == s} for s in "ab"}
    assert len(year["a"]) == 2 and len(year["b"]) == 1


def test_json_escapes_markup(spark):
    from tidewatch.functions.scalars import plain_json

    df = spark.createDataFrame([("<a>&\"b\"",)], "s string")
    out = df.select(plain_json(F.struct("s")).alias("j")).first().j
    assert not set("<>&") & set(out) and out.count("\\u00") == 3 and json.loads(out) == {"s": '<a>&"b"'}


def test_tail_of_long_lines_and_ends(tmp_path, monkeypatch):
    from tidewatch.sources import tail

    monkeypatch.setattr(tail, "MOST", 64)
    path = tmp_path / "x.log"
    path.write_bytes(b"one\n" + b"x" * 500 + b"\ntwo\nhalf")
    reader = tail.TailReader(str(path), "begin")
    at, seen = reader.initialOffset(), []
    for _ in range(5):
        end = reader.latestOffset()
        seen += [x.decode() for r in reader.partitions(at, end) for b in reader.read(r) for x in b.column("value").to_pylist()]
        at = end
    assert seen == ["one", "x" * 500, "two"] and tail.whole_until(str(path)) == 509 and tail.whole_until(str(tmp_path / "none")) == 0
    path.write_bytes(b"no newline" * 20_000)
    assert tail.whole_until(str(path)) == 0


def test_duration_text():
    from tidewatch.cli import duration, duration_text

    assert [duration_text(duration(x)) for x in ("60s", "90s", "1h", "5s", "1500ms")] == ["1m0s", "1m30s", "1h0m0s", "5s", "1.5s"]
