"""What is known about addresses: tables, a cache that grows, and clients that are asked for what it lacks.

A client is a function of one address. It runs on executors, for distinct addresses only, each call within a time limit; what it
answers is kept in the cache, so that an address is asked for once.
"""

from __future__ import annotations

import importlib
import json
import socket
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import discard, stored

REGISTRY = "ip string, name string, handle string, start string, end string"
GEO = "ip string, status string, country string, city string, asn string, isp string"
HOSTS = "ip string, host string"
HOST_LIMIT, CLIENT_LIMIT = 1.5, 3.0  # seconds of a call


def registry_fields(raw: DataFrame) -> DataFrame:
    """(ip, org, network) of registry answers: the name, else the handle; a range only with both ends."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return raw.select("ip", F.when(has("name"), F.col("name")).when(has("handle"), F.col("handle")).alias("org"), F.when(has("start") & has("end"), F.concat("start", F.lit(" - "), "end")).alias("network"))


def geo_fields(raw: DataFrame) -> DataFrame:
    """(ip, country, city, asn, isp) of the answers that report success."""
    return raw.where(F.col("status") == "success").select("ip", "country", "city", "asn", "isp")


def calls(client: Callable[[str], dict | None], ips: list[str], limit: float, at_once: int) -> Iterator[tuple[str, dict | None]]:
    """(ip, answer) of each address, some at a time. A call that fails, or takes longer than `limit` seconds, has no answer.

    Calls have threads of their own, which nobody waits for once their time is up, so that one that hangs holds up nothing else.
    """
    for at in range(0, len(ips), at_once):
        some = ips[at : at + at_once]
        answers: dict[str, dict] = {}

        def call(ip: str, answers: dict = answers) -> None:
            try:
                got = client(ip)
                if got:
                    answers[ip] = got
            except Exception:  # noqa: BLE001  a lookup is best effort
                pass

        threads = [threading.Thread(target=call, args=(ip,), daemon=True) for ip in some]
        for t in threads:
            t.start()
        until = time.monotonic() + limit
        for t in threads:
            t.join(max(0.0, until - time.monotonic()))
        done = dict(answers)  # what comes later is not looked at
        yield from ((ip, done.get(ip)) for ip in some)


def ask(ips: DataFrame, client: Callable[[str], dict | None], schema: str, limit: float = CLIENT_LIMIT, at_once: int = 16) -> DataFrame:
    """Answers of a client for the distinct column ip; addresses without one are left out, and so are null ones."""
    kinds = dict(f.split() for f in schema.split(", "))

    def run(batches):
        for b in batches:
            rows = [{**answer, "ip": ip} for ip, answer in calls(client, b.column(0).to_pylist(), limit, at_once) if answer]
            yield pa.RecordBatch.from_arrays([pa.array([None if r.get(k) is None else str(r[k]) for r in rows], pa.string()) for k in kinds], names=list(kinds))

    return ips.select("ip").where("ip is not null").distinct().mapInArrow(run, schema)


def remembered(ips: DataFrame, client: Callable[[str], dict | None], schema: str, cache: str, limit: float = CLIENT_LIMIT, at_once: int = 16) -> DataFrame:
    """Answers for the distinct column ip, from the Parquet table `cache`, which first learns what it lacks.

    Only addresses that the table does not have are asked for, and their answers are added to it; those that fail are asked for
    again the next time. Where two runs have added the same address, one answer counts.
    """
    spark = ips.sparkSession
    wanted = stored(ips.select("ip").where("ip is not null").distinct())
    known = _cached(spark, schema, cache)
    fresh = stored(ask(wanted if known is None else wanted.join(known, "ip", "left_anti"), client, schema, limit, at_once))
    if not fresh.isEmpty():
        fresh.write.mode("append").parquet(cache)
    names = [f.split()[0] for f in schema.split(", ")]
    known = _cached(spark, schema, cache)
    known = fresh if known is None else known
    one = known.groupBy("ip").agg(F.min(F.struct(*names[1:])).alias("a")).select("ip", "a.*")
    out = stored(one.join(wanted, "ip", "left_semi"))
    discard(wanted, fresh)
    return out


def _cached(spark: SparkSession, schema: str, path: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else None


def answers(ips: DataFrame, client: Callable[[str], dict | None], schema: str, cache: str | None = None, limit: float = CLIENT_LIMIT) -> DataFrame:
    """remembered() where there is a cache, else ask()."""
    return remembered(ips, client, schema, cache, limit) if cache else ask(ips, client, schema, limit)


def hostnames(ips: DataFrame, resolver: Callable[[str], list[str]], cache: str | None = None, limit: float = HOST_LIMIT) -> DataFrame:
    """(ip, host): the first name a resolver gives, without its trailing dot."""

    def first(ip: str) -> dict | None:
        names = resolver(ip)
        return {"host": names[0].removesuffix(".")} if names else None

    return answers(ips, first, HOSTS, cache, limit)


def reverse_dns(ip: str) -> list[str]:
    """Names of an address, from the system's resolver."""
    return [socket.gethostbyaddr(ip)[0]]


def json_client(url: str, fields: dict[str, str], limit: float = CLIENT_LIMIT) -> Callable[[str], dict | None]:
    """A client of a service that answers a GET of `url`, in which {ip} stands for the address, with a JSON object.

    fields: our name -> the object's. Anything but status 200 is an error.
    """

    def get(ip: str) -> dict:
        with urllib.request.urlopen(url.replace("{ip}", ip), timeout=limit) as answer:
            if answer.status != 200:
                raise OSError(f"status {answer.status}")
            got = json.load(answer)
        return {ours: got.get(theirs) for ours, theirs in fields.items()}

    return get


# fixed values: the objects' names in answers of registries (RDAP) and of the usual location services
REGISTRY_FIELDS = {"name": "name", "handle": "handle", "start": "startAddress", "end": "endAddress"}
GEO_FIELDS = {"status": "status", "country": "country", "city": "city", "asn": "as", "isp": "isp"}


def named(text: str, fields: dict[str, str] | None = None) -> Callable:
    """A client by its name: 'module:function', or a URL with {ip}."""
    if "{ip}" in text:
        return json_client(text, fields or {})
    module, name = text.rsplit(":", 1)
    return getattr(importlib.import_module(module), name)
