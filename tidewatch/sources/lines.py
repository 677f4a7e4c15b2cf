"""Log files as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 1 << 20


def read_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(log_path, block_start, line_id, value): one row per line, one trailing carriage return taken off.

    (block_start, line_id) is the order of the lines of a file. strict: a line of a megabyte or more is an error.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("log_path"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("line_id"), "value"
    )
    if strict:
        raw = raw.where(F.assert_true(F.octet_length("value") < LONGEST).isNull())
    return raw.withColumn("value", F.regexp_replace("value", "\r\\z", ""))
