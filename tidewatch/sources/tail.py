"""Log files by ranges of bytes, read by executors: a scan up to a fixed end, and a growing file as a stream that survives rotation.

Offsets are byte positions of whole lines, and so is a line's id. A file that was replaced (another inode), became shorter than
what was read, or no longer holds the bytes that were read last, is read again from its start. The driver only looks at a file's
state, its last line end and 4096 bytes before the position; every line is read on executors, one range each.
"""

from __future__ import annotations

import hashlib
import os
import sys
import time
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .lines import LONGEST

CHECKED = 4096  # bytes before the position that must still be there
SPLIT = 64 << 20  # bytes of a range
MOST = 1 << 30  # bytes of one micro-batch, or one line if that is longer
BLOCK = 1 << 20  # bytes read at once
PATIENCE = 30.0  # seconds that a followed file may be unreadable while a batch is under way
SCHEMA = "log_path string, block_start bigint, line_id bigint, value binary"


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, stop) of a file; nothing is read at or beyond end. tail: a last line without a newline counts."""

    path: str
    start: int
    stop: int
    end: int
    tail: bool = False
    inode: int = 0  # 0: any


def ranges(path: str, start: int, end: int, tail: bool = False, inode: int = 0) -> list[Range]:
    return [Range(path, at, min(at + SPLIT, end), end, tail, inode) for at in range(start, end, SPLIT)]


def lines_of(file, r: Range) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(positions, lines without their newlines) of a range, some at once."""
    at, rest = max(0, r.start - 1), b""  # what is under way at start - 1 belongs to the range before
    first = r.start == 0
    file.seek(at)
    while at < r.stop:
        block = file.read(max(0, min(BLOCK, r.end - at - len(rest))))
        data = rest + block
        if not block:
            if first and data and r.tail:
                yield np.array([at]), [data]
            return
        size = whole_lines(data, 0)
        lines = data[:size].split(b"\n")[:-1]
        begins = at + np.cumsum([0, *(len(x) + 1 for x in lines)])[:-1]
        skip = int(not first and bool(lines))
        first = first or bool(lines)
        last = int(np.searchsorted(begins, r.stop))
        if last > skip:
            yield begins[skip:last], lines[skip:last]
        at, rest = at + size, data[size:]


def opened(path: str, patience: float):
    """An open file; what can't be opened for the moment is tried again until `patience` seconds have gone."""
    until = time.monotonic() + patience
    while True:
        try:
            return open(path, "rb", buffering=0)
        except FileNotFoundError:
            raise
        except OSError as e:
            if time.monotonic() > until:
                raise
            warnings.warn(str(e), stacklevel=2)
            time.sleep(0.5)


def batches_of(r: Range) -> Iterator[pa.RecordBatch]:
    try:
        with opened(r.path, PATIENCE if r.inode else 0) as f:
            if r.inode and os.fstat(f.fileno()).st_ino != r.inode:
                raise FileNotFoundError(f"{r.path} was replaced before it was read")
            for begins, lines in lines_of(f, r):
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.path] * n), pa.array([r.start] * n, pa.int64()), pa.array(begins.astype(np.int64)), pa.array([x.removesuffix(b"\r") for x in lines], pa.binary())], names=["log_path", "block_start", "line_id", "value"]
                )
    except FileNotFoundError as e:
        if not r.inode:
            raise
        warnings.warn(str(e), stacklevel=2)  # bytes of an old file that were not read yet are lost


class LogSource(DataSource):
    """Batch options: path; end (a byte position, or as long as the file is). Stream options: path; start ('begin', 'end' or a position)."""

    @classmethod
    def name(cls) -> str:
        return "log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "LogReader":
        return LogReader(self.options["path"], self.options.get("end"))

    def streamReader(self, schema) -> "TailReader":
        return TailReader(self.options["path"], self.options.get("start", "begin"))


class LogReader(DataSourceReader):
    def __init__(self, path: str, end: str | None):
        self.path, self.end = path, end

    def partitions(self) -> list[Range]:
        if self.end is None:
            return ranges(self.path, 0, os.path.getsize(self.path), tail=True)
        return ranges(self.path, 0, int(self.end))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from batches_of(partition)


class TailReader(DataSourceStreamReader):
    """Offsets: {pos, inode, print}: a position, the file it is in, and a hash of the bytes before it."""

    def __init__(self, path: str, start: str):
        self.path, self.start = path, start
        self.last: dict | None = None  # what was reported last, if this reader has reported anything

    def initialOffset(self) -> dict:
        try:
            with open(self.path, "rb") as f:
                at = 0 if self.start == "begin" else last_line_end(f) if self.start == "end" else int(self.start)
                self.last = _offset(f, at)
        except FileNotFoundError:
            self.last = {"pos": 0, "inode": 0, "print": ""}
        return self.last

    def latestOffset(self) -> dict:
        """Where whole lines end now. A file that is away or can't be read for now is a warning, and nothing new."""
        last = self.last or {"pos": 0, "inode": 0, "print": ""}
        try:
            with open(self.path, "rb") as f:
                begin = _from(f, last)
                end = os.fstat(f.fileno()).st_size
                if end - begin > MOST:
                    end = last_line_end(f, begin + MOST)
                    end = end if end > begin else first_line_end(f, begin + MOST)
                else:
                    end = last_line_end(f)
                    end = end if end > begin else begin
                self.last = _offset(f, end)
        except FileNotFoundError:  # between a rename and the new file
            self.last = last
        except OSError as e:
            print(f"warning: {e}", file=sys.stderr)
            self.last = last
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Range]:
        begin = start["pos"] if start["inode"] in (0, end["inode"]) and end["pos"] >= start["pos"] else 0
        try:
            with open(self.path, "rb") as f:
                if os.fstat(f.fileno()).st_ino == end["inode"]:
                    begin = _from(f, start)
        except OSError as e:
            print(f"warning: {e}", file=sys.stderr)
        self.last = self.last or end
        return ranges(self.path, begin, end["pos"], inode=end["inode"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from batches_of(partition)

    def commit(self, end: dict) -> None:
        pass


def _offset(file, at: int) -> dict:
    file.seek(max(0, at - CHECKED))
    return {"pos": at, "inode": os.fstat(file.fileno()).st_ino, "print": hashlib.sha256(file.read(min(at, CHECKED))).hexdigest()}


def _from(file, offset: dict) -> int:
    """Where to go on reading: the offset's position, or 0 if this is not the file that was read."""
    if not offset["inode"]:
        return offset["pos"]
    same = os.fstat(file.fileno()).st_size >= offset["pos"] and _offset(file, offset["pos"]) == offset
    return offset["pos"] if same else 0


def whole_lines(data: bytes, at: int) -> int:
    """Bytes up to and with the last newline."""
    return data.rfind(b"\n", at) + 1


def last_line_end(file, before: int | None = None) -> int:
    """The position after the last newline of a binary file, or of its first `before` bytes, found block by block from the end."""
    at = file.seek(0, os.SEEK_END)
    at = at if before is None else min(at, before)
    while at:
        size = min(at, 1 << 16)
        file.seek(at - size)
        if found := whole_lines(file.read(size), 0):
            return at - size + found
        at -= size
    return 0


def first_line_end(file, at: int) -> int:
    """The position after the first newline at or after `at`, or `at`'s own line start if there is none yet."""
    file.seek(at)
    while block := file.read(BLOCK):
        if found := block.find(b"\n") + 1:
            return at + found
        at += len(block)
    return last_line_end(file)


def whole_until(path: str) -> int:
    """Where a log's whole lines end now; 0 without a file."""
    try:
        with open(path, "rb") as f:
            return last_line_end(f)
    except FileNotFoundError:
        return 0


def _text(raw: DataFrame) -> DataFrame:
    return raw.withColumn("value", F.col("value").cast("string"))


def read_until(spark: SparkSession, path: str, end: int | None = None, strict: bool = False) -> DataFrame:
    """(log_path, block_start, line_id, value) of the lines that end at byte `end` or before (None: of the whole file as it is now).

    line_id is the line's exact position. Ranges of the file are read side by side. strict as for read_lines().
    """
    spark.dataSource.register(LogSource)
    reader = spark.read.format("log").option("path", path)
    raw = _text((reader if end is None else reader.option("end", str(end))).load())
    return raw.where(F.assert_true(F.octet_length("value") < LONGEST).isNull()) if strict else raw


def follow(spark: SparkSession, path: str, start: str = "begin") -> DataFrame:
    spark.dataSource.register(LogSource)
    return _text(spark.readStream.format("log").option("path", path).option("start", start).load())
