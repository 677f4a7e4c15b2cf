"""Triggers joined with what is known about their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import location, plain_json


def enrich(triggers: DataFrame, registry: DataFrame | None, geo: DataFrame | None) -> DataFrame:
    """triggers with org, network, country, city, asn, isp; each lookup may be missing. Lookups have one row per ip."""
    out = triggers
    for known, names in ((registry, ("org", "network")), (geo, ("country", "city", "asn", "isp"))):
        if known is None:
            for n in names:
                out = out.withColumn(n, F.lit(None).cast("string"))
        else:
            out = out.join(known.select(F.col("ip").alias("_ip"), *names), F.col("source") == F.col("_ip"), "left").drop("_ip")
    return out


def _quoted(name: str, value: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', '\\\\"')
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f'{name}="'), text, F.lit('"')))


def intel_line() -> Column:
    """The one-line note of an enriched trigger; fields without a value are left out."""
    c = F.col
    return F.concat_ws(
        " ", F.concat(F.lit("[CTI] source="), c("source")), _quoted("org", c("org")), _quoted("location", location(c("city"), c("country"))), _quoted("asn", c("asn")), _quoted("network", c("network")),
        F.concat(F.lit("trigger="), c("reason")),
    )


def intel_json() -> Column:
    """The same as one JSON object with every known field."""
    full = lambda n: F.when(F.coalesce(F.col(n), F.lit("")) != "", F.col(n)).alias(n)
    return plain_json(F.struct(F.lit("cti").alias("type"), F.col("reason").alias("trigger"), F.col("source").alias("ip"), *map(full, ("org", "network", "country", "city", "asn", "isp"))))
