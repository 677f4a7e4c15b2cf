import json
import os
import random
import threading
import time

import pytest

from tidewatch import cli
from tidewatch.config import SECOND, BurstConfig, TriggerConfig
from tidewatch.operators.bursts import first_crossings
from tidewatch.plans.logs import log_events
from tidewatch.sources.lines import read_lines
from tidewatch.sources import tail
from tidewatch.sources.tail import TailReader, follow
from tidewatch.streaming.live import detect, live_events


def line(second, user="root", source="198.51.100.4"):
    return f"Dec 31 23:59:{second:02d} h sshd[1]: Failed password for {user} from {source} port 1 ssh2\n"


def drain(reader, offset):
    end = reader.latestOffset()
    return texts(reader, offset, end), end


def texts(reader, start, end):
    return [x.decode() for p in reader.partitions(start, end) for b in reader.read(p) for x in b.column("value").to_pylist()]


def test_tail_follows_appends_partial_lines_and_rotation(tmp_path):
    p = tmp_path / "a.log"
    p.write_text("one\ntwo\n")
    r = TailReader(str(p), "begin")
    got, at = drain(r, r.initialOffset())
    assert got == ["one", "two"]
    with p.open("a") as f:
        f.write("thr")
    assert drain(r, at) == ([], at)
    with p.open("a") as f:
        f.write("ee\r\nfour\n")
    got, at = drain(r, at)
    assert got == ["three", "four"]
    os.rename(p, tmp_path / "a.log.1")
    assert drain(r, at) == ([], at)
    p.write_text("new\n")
    got, at = drain(r, at)
    assert got == ["new"]
    p.write_text("x\n")  # shorter
    got, at = drain(r, at)
    assert got == ["x"]
    p.write_text("longer than before\n")
    got, at2 = drain(r, at)
    assert got == ["longer than before"]
    assert texts(r, at, at2) == got
    again = TailReader(str(p), "begin")  # a query that starts again has offsets, but a new reader
    assert texts(again, at2, again.latestOffset()) == []
    assert TailReader(str(p), "end").initialOffset()["pos"] == p.stat().st_size
    os.rename(p, tmp_path / "a.log.2")
    p.write_text("other\n")
    assert texts(r, at, at2) == []  # its file has gone: a warning, no end of the query


def test_a_file_that_cannot_be_read_is_a_warning(tmp_path, capsys):
    p = tmp_path / "a.log"
    p.write_text("one\n")
    r = TailReader(str(p), "begin")
    got, at = drain(r, r.initialOffset())
    os.rename(p, tmp_path / "kept")
    p.mkdir()
    assert drain(r, at)[0] == [] and "warning:" in capsys.readouterr().err
    p.rmdir()
    os.rename(tmp_path / "kept", p)
    with p.open("a") as f:
        f.write("two\n")
    assert got == ["one"] and drain(r, at)[0] == ["two"]
    end = r.latestOffset()
    os.rename(p, tmp_path / "kept")  # unreadable while the batch is under way
    p.mkdir()

    def back():
        time.sleep(1.2)
        p.rmdir()
        os.rename(tmp_path / "kept", p)

    thread = threading.Thread(target=back)
    thread.start()
    with pytest.warns(UserWarning):
        assert [x.decode() for part in tail.ranges(str(p), 0, end["pos"], inode=end["inode"]) for b in r.read(part) for x in b.column("value").to_pylist()] == ["one", "two"]
    thread.join()
    with pytest.raises(IsADirectoryError):
        list(tail.batches_of(tail.Range(str(tmp_path), 0, 5, 5)))


def test_ranges_give_every_line_once(tmp_path, monkeypatch):
    rng = random.Random(6)
    for trial in range(60):
        monkeypatch.setattr(tail, "SPLIT", rng.randint(1, 40))
        monkeypatch.setattr(tail, "BLOCK", rng.randint(1, 50))
        data = b"".join(rng.choice([b"", b"x" * rng.randint(1, 90), b"ab\r", b"c\rd"]) + b"\n" for _ in range(rng.randint(0, 25))) + rng.choice([b"", b"tail"])
        p = tmp_path / f"{trial}.log"
        p.write_bytes(data)
        for end in (None, tail.whole_until(str(p)), tail.last_line_end(p.open("rb"), len(data) // 2)):
            reader = tail.LogReader(str(p), None if end is None else str(end))
            got = [(i, x) for r in reader.partitions() for b in reader.read(r) for i, x in zip(b.column("line_id").to_pylist(), b.column("value").to_pylist())]
            lines = data[:end].split(b"\n")
            lines = lines[:-1] if end is not None or not lines[-1] else lines
            assert [x for _, x in got] == [x.removesuffix(b"\r") for x in lines]
            assert all(data[i:].startswith(x) and (i == 0 or data[i - 1 : i] == b"\n") for i, x in got)


def test_each_line_is_shown_once_though_the_log_grows_during_the_scan(spark, tmp_path, capsys, monkeypatch):
    """Lines of the new year come while the scan runs: the scan stops where following begins, and the year goes on from there."""
    p = tmp_path / "auth.log"
    p.write_text("".join(line(i, f"u{i}") for i in range(0, 10, 2)))
    new = "".join(line(i, f"u{i}") for i in range(20, 30, 2)) + "".join(line(i, "v", "203.0.113.7").replace("Dec 31 23:59", "Jan  1 00:05") for i in range(0, 10, 2))
    real = cli.dated

    def growing(lines):
        with p.open("a") as f:
            f.write(new)
        return real(lines)

    monkeypatch.setattr(cli, "dated", growing)
    q = cli.main(["-file", str(p), "-follow", "-json", "-checkpoint", str(tmp_path / "cp")], spark, wait=False)
    settled(q, 10)
    q.stop()
    until = time.time() + 20
    while q.watch.counted.get("lines.rows") != 10 and time.time() < until:
        time.sleep(0.2)
    assert q.watch.counted == {"lines.rows": 10, "events.rows": 10}
    out = capsys.readouterr().out
    scanned, live = out[: out.index("]\n") + 2], out[out.index("]\n") + 2 :].strip().splitlines()
    assert [(a["Source"], a["Attempts"], a["LastSeen"]) for a in json.loads(scanned)] == [("198.51.100.4", 5, "0000-12-31T23:59:08Z")]
    assert sorted((a["Source"], a["LastSeen"]) for a in map(json.loads, live)) == [("198.51.100.4", "0000-12-31T23:59:28Z"), ("203.0.113.7", "0001-01-01T00:05:08Z")]


def test_stream_equals_replay(spark, tmp_path):
    p = tmp_path / "auth.log"
    text = "".join(line(i, f"u{i % 3}", f"198.51.100.{i // 2 % 2}") for i in range(0, 40, 2))
    text += "Jan  1 00:00:05 h sshd[1]: message repeated 3 times: [ Failed password for z from 198.51.100.9 port 1 ssh2]\n"
    p.write_text(text)
    q = detect(live_events(follow(spark, str(p))), BurstConfig(3, 60 * SECOND), TriggerConfig(3, 3600 * SECOND, 86400 * SECOND)).writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = spark.sql("select * from live").collect()
    flat = lambda rows: sorted((r.source, r.attempts, r.first_us, r.last_us, tuple(r.users)) for r in rows)
    events = log_events(read_lines(spark, str(p)))
    single = events.selectExpr("source", "us", "user", "seq", "explode(sequence(0L, rep_count - 1)) as rep_idx", "1L as rep_count")
    assert flat([r for r in got if r.kind == "alert"]) == flat(first_crossings(single, BurstConfig(3, 60 * SECOND)).collect())
    assert len([r for r in got if r.kind == "trigger"]) == 3


def plain_live(rows, b, t):
    """One source's events, one by one, as they arrive: (kind, second, attempts, users, reason)."""
    last = first = hit = None
    n, alerted, users, times, out = 0, False, [], [], []
    for us, user in rows:
        def fire(reason):
            nonlocal hit
            if hit is None or us - hit >= t.cooldown:
                hit = us
                out.append(("trigger", us, None, None, reason))

        times = [x for x in times if x > us - t.window] + [us]
        times = times[-max(1, t.repeats) :]
        if len(times) >= t.repeats:
            fire("repeat_offender")
        if last is None or us - last > b.window:
            first, n, alerted, users = us, 0, False, []
        last, n = us, n + 1
        if user and user not in users and not alerted:
            users.append(user)
        if not alerted and n >= b.threshold:
            alerted = True
            out.append(("alert", us, n, tuple(users), None))
            if n >= 4 * b.threshold:
                fire("critical_severity")
    return out


def settled(q, rows):
    """Wait until a query has read so many rows and one more batch has run: with state that ages there is always another batch."""
    until, seen = time.time() + 60, {}
    while time.time() < until:
        seen |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
        if sum(seen.values()) >= rows and q.lastProgress["numInputRows"] == 0:
            return
        time.sleep(0.2)
    raise TimeoutError(str(seen))


def stream(spark, folder, batches, b, t, grace=None, pause=0):
    """What the detector finds in batches of (source, us, user), and the rows its state has held."""
    at = folder / "in"
    at.mkdir()
    events = spark.readStream.schema("source string, us long, user string, seq long, rep_idx long").option("maxFilesPerTrigger", 1).parquet(str(at))
    q = detect(events, b, t, **({} if grace is None else {"grace": grace})).writeStream.format("memory").queryName(folder.name).outputMode("append").option("checkpointLocation", str(folder / "cp")).start()
    held, seq = [], 0
    for n, rows in enumerate(batches):
        if n:
            time.sleep(pause)
        spark.createDataFrame([(s, us, u, seq + i, 0) for i, (s, us, u) in enumerate(rows)], "source string, us long, user string, seq long, rep_idx long").coalesce(1).write.mode("append").parquet(str(at))
        seq += len(rows)
        settled(q, seq)
        held += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    return spark.sql(f"select * from {folder.name}").collect(), held


def test_batches_equal_events_one_by_one(spark, tmp_path):
    """Batches of any cut, clocks that go backwards, thresholds of 0 and 1."""
    rng = random.Random(9)
    for n, (b, t) in enumerate(((BurstConfig(3, 20), TriggerConfig(3, 30, 60)), (BurstConfig(0, 5), TriggerConfig(1, 10, 25)), (BurstConfig(6, 50), TriggerConfig(4, 8, 0)))):
        per = {}
        for s in "abc":
            at = 0
            per[s] = [(at := at + rng.choice([0, 1, 3, 9, 30, -4 if s == "c" else 2]), rng.choice(["", "u", "v", "w"])) for _ in range(150)]
        batches = [[(s, *per[s][i]) for i in range(k, min(k + 37, 150)) for s in "abc"] for k in range(0, 150, 37)]
        folder = tmp_path / f"plain{n}"
        folder.mkdir()
        got, _ = stream(spark, folder, batches, b, t)
        for s in "abc":
            mine = sorted((r.kind, r.us, r.attempts, tuple(r.users) if r.users is not None else None, r.reason) for r in got if r.source == s)
            assert mine == sorted(plain_live(per[s], b, t), key=lambda x: x[:2]), (n, s)


def test_quiet_sources_leave_the_store(spark, tmp_path):
    b, t = BurstConfig(3, 1000), TriggerConfig(3, 1000, 1000)
    folder = tmp_path / "quiet"
    folder.mkdir()
    many = [(f"s{i}", k * 100_000, f"u{k}") for i in range(40) for k in range(9)]
    _, held = stream(spark, folder, [many, [("late", 5, "x")], [("late", 6, "x")]], b, t, grace=2_000_000, pause=4)
    assert 40 <= max(held) <= 40 * 8 and held[-1] <= 10


def test_command_line(spark, tmp_path, capsys):
    p = tmp_path / "auth.log"
    p.write_text("".join(line(i) for i in range(6)))
    cli.main(["-file", str(p), "-cti"], spark)
    out = capsys.readouterr()
    assert "198.51.100.4" in out.out and "trigger=repeat_offender" in out.err
    for flag in ("-json", "-summary", "-stats"):
        cli.main(["-file", str(p), flag], spark)
        assert "198.51.100.4" in capsys.readouterr().out
    assert cli.duration("1h30m") == 5400 * SECOND
