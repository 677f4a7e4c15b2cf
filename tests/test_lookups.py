"""Lookups: limits, failures, the cache, and how the command line reaches them."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from test_live import settled

from tidewatch import cli
from tidewatch.sources import lookups as L
from tidewatch.streaming.sinks import Shown, Written, to_each


def ips(spark, *some):
    return spark.createDataFrame([(x,) for x in some], "ip string").repartition(2)


def client(folder):
    """Answers from a function that notes every call; addresses in s hang, those in f fail, those in n know nothing."""

    def ask(ip):
        with open(f"{folder}/{ip}", "a") as f:
            f.write("x")
        if ip.startswith("s"):
            time.sleep(60)
        if ip.startswith("f"):
            raise OSError("no route")
        return None if ip.startswith("n") else {"name": f"net {ip}", "handle": "H", "start": "1", "end": "2"}

    return ask


def asked(folder):
    return {x: len(open(f"{folder}/{x}").read()) for x in sorted(os.listdir(folder))}


def test_a_slow_a_failing_and_a_repeated_address(spark, tmp_path):
    began = time.time()
    some = ips(spark, "a", "b", "a", "slow1", "slow2", "f", "n", None, "a", "c")
    got = L.registry_fields(L.ask(some, client(str(tmp_path)), L.REGISTRY, limit=1.0, at_once=2)).collect()
    assert sorted((r.ip, r.org, r.network) for r in got) == [(x, f"net {x}", "1 - 2") for x in "abc"]
    assert asked(tmp_path) == dict.fromkeys(["a", "b", "c", "f", "n", "slow1", "slow2"], 1) and time.time() - began < 30


def test_the_cache_asks_for_what_it_lacks(spark, tmp_path):
    calls, cache = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()
    first = L.remembered(ips(spark, "a", "f", "b"), client(str(calls)), L.REGISTRY, cache, limit=1.0)
    assert sorted(r.ip for r in first.collect()) == ["a", "b"]
    again = L.remembered(ips(spark, "b", "c", "f", "b"), client(str(calls)), L.REGISTRY, cache, limit=1.0)
    assert sorted((r.ip, r.name) for r in again.collect()) == [("b", "net b"), ("c", "net c")]
    assert asked(calls) == {"a": 1, "b": 1, "c": 1, "f": 2}
    spark.read.parquet(cache).where("ip = 'a'").write.mode("append").parquet(cache)  # two runs at once
    assert L.remembered(ips(spark, "a"), client(str(calls)), L.REGISTRY, cache).count() == 1
    assert L.remembered(ips(spark, "f"), client(str(calls)), L.REGISTRY, str(tmp_path / "none"), limit=1.0).count() == 0


def test_fields(spark):
    raw = spark.createDataFrame([("a", "", "H", "1", ""), ("b", None, None, None, None)], L.REGISTRY)
    assert [tuple(r) for r in L.registry_fields(raw).orderBy("ip").collect()] == [("a", "H", None), ("b", None, None)]
    raw = spark.createDataFrame([("a", "success", "Land", "Town", "AS1", "isp"), ("b", "fail", "x", "x", "x", "x")], L.GEO)
    assert [tuple(r) for r in L.geo_fields(raw).collect()] == [("a", "Land", "Town", "AS1", "isp")]


def test_hostnames(spark):
    def names(ip):
        if ip == "10.0.0.3":
            raise OSError
        return {"10.0.0.1": ["resolved.example.com.", "other"]}.get(ip, [])

    got = L.hostnames(ips(spark, "10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.1"), names).collect()
    assert [tuple(r) for r in got] == [("10.0.0.1", "resolved.example.com")]


@pytest.fixture
def service():
    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            ip = self.path.rsplit("/", 1)[1]
            self.send_response(404 if ip == "gone" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"status": "success", "country": "Land", "city": "Town", "as": "AS1 " + ip, "isp": "I", "name": "Net", "startAddress": "1", "endAddress": "9"}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/{{ip}}"
    server.shutdown()


def test_a_service_by_its_url(spark, service):
    got = L.geo_fields(L.ask(ips(spark, "a", "gone"), L.named(service, L.GEO_FIELDS), L.GEO))
    assert [tuple(r) for r in got.collect()] == [("a", "Land", "Town", "AS1 a", "I")]


def test_the_command_line_shows_names_and_notes(spark, tmp_path, capsys, service):
    p = tmp_path / "auth.log"
    p.write_text("".join(f"Mar  4 09:00:{i:02d} h sshd[1]: Failed password for root from 198.51.100.4 port 1 ssh2\n" for i in range(6)))
    (tmp_path / "names_for_test.py").write_text("def names(ip):\n    return [f'host-{ip}.example.']\n")
    import sys

    sys.path.insert(0, str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "names_for_test.py"))
    more = ["-cti", "-hosts", "-resolver", "names_for_test:names", "-cache", str(tmp_path / "cache"), "-registry-client", service, "-geo-client", service]
    for _ in range(2):
        cli.main(["-file", str(p), "-summary", *more], spark)
        out = capsys.readouterr()
        assert "198.51.100.4 (host-198.51.100.4.example) tried 6 password(s) against root over 5 seconds" in out.out
        assert 'org="Net" location="Town, Land" asn="AS1 198.51.100.4" network="1 - 9"' in out.err
    assert {x for x in os.listdir(tmp_path / "cache")} == {"hosts", "registry", "geo"}
    p.write_text("x\n")
    q = cli.main(["-file", str(p), "-follow", "-summary", "-out", str(tmp_path / "out"), "-checkpoint", str(tmp_path / "cp"), *more], spark, wait=False)
    with p.open("a") as f:
        f.write("".join(f"Mar  4 09:00:{i:02d} h sshd[1]: Failed password for root from 198.51.100.4 port 1 ssh2\n" for i in range(6)))
    settled(q, 6)
    q.stop()
    assert "(host-198.51.100.4.example) tried 5 password(s) against root over 4 seconds" in capsys.readouterr().out
    assert spark.read.json(str(tmp_path / "out/alerts")).count() == 1 and spark.read.json(str(tmp_path / "out/triggers")).count() == 1


def test_a_batch_that_runs_again_leaves_one_copy(spark, tmp_path):
    seen = []
    sinks = to_each(("k = 'a'", Written(str(tmp_path / "out"))), ("k = 'b'", Shown(spark, lambda rows: seen.extend(r.v for r in rows.collect()), str(tmp_path / "marks"))))
    one, two = (spark.createDataFrame([("a", v), ("b", v), ("b", v + 1)], "k string, v int") for v in (1, 5))
    sinks(one, 0)
    sinks(two, 1)
    sinks(two, 1)  # the last batch runs again after a restart
    assert seen == [1, 2, 5, 6] and sorted(r.v for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 5]
    assert os.listdir(tmp_path / "marks") and not [x for x in os.listdir(tmp_path / "marks") if x == "batch-0"]
    Shown(spark, lambda rows: seen.append("again"), None)(one, 0)
    assert seen[-1] == "again"
