"""Benchmark passages in documents, found by Wu-Manber search with shift tables over eight-byte blocks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, batch, blobs, settle

WORDS = 10
BLOCK = 8  # bytes of a block
SLOTS = 1 << 18  # of a shift table
LANE = 1 << 12  # bytes that a lane scans; all lanes of a batch move together
TOGETHER = 1 << 22  # bytes of text scanned as one
ITEMS = 200_000  # windows of benchmark items in one broadcast; beyond that the documents are scanned part by part
BYTES = 32 << 20  # bytes of windows in one broadcast, likewise


def normal(data: bytes) -> tuple[bytes, int]:
    """(words with one space between and around, number of words)."""
    words = data.translate(ALNUM).split()
    return (b" " + b" ".join(words) + b" ", len(words)) if words else (b"", 0)


def windows(text: str | None) -> list[bytes]:
    words = (text or "").encode().translate(ALNUM).split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(max(1, len(words) - WORDS + 1))]


def _slot(block: np.ndarray) -> np.ndarray:
    return (block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


class Searcher:
    """Patterns of similar length share a shift table; patterns shorter than a block are looked up word by word."""

    def __init__(self, patterns: dict[bytes, set[str]]):
        self.items = patterns
        self.short = {p for p in patterns if len(p) < BLOCK + 4}
        self.groups = []
        rest = sorted((p for p in patterns if p not in self.short), key=lambda p: (len(p), p))
        lo = 0
        while lo < len(rest):
            hi = lo
            while hi < len(rest) and len(rest[hi]) < 2.5 * len(rest[lo]):
                hi += 1
            own, m = rest[lo:hi], len(rest[lo])
            lo = hi
            shift = np.full(SLOTS, m - BLOCK + 1, np.int32)
            heads = np.array([np.frombuffer(p[:m] + b"", np.uint8) for p in own])
            for at in range(m - BLOCK + 1):  # how far the end of a block is from the end of the first m bytes
                block = np.ascontiguousarray(heads[:, at : at + BLOCK]).view("<u8").ravel()
                np.minimum.at(shift, _slot(block).astype(np.int64), m - BLOCK - at)
            last = np.ascontiguousarray(heads[:, m - BLOCK :]).view("<u8").ravel()
            first = np.ascontiguousarray(heads[:, :BLOCK]).view("<u8").ravel()
            order = np.lexsort((first, last))
            self.groups.append((m, shift, last[order], first[order], [own[i] for i in order.tolist()]))

    def find(self, text: bytes):
        """(place, pattern) of every occurrence in a text that normal() made."""
        for p in self.short:
            at = text.find(p)
            while at >= 0:
                yield at, p
                at = text.find(p, at + 1)
        size = len(text)
        for m, shift, last, first, own in self.groups:
            if size < m:
                continue
            whole = np.frombuffer(text + b"\0" * BLOCK, np.uint8)
            blocks = np.ndarray((size + 1,), "<u8", whole, 0, (1,))  # the eight bytes from each place on
            ends = size - m  # the last place where a pattern can start
            start = np.arange(0, ends + 1, LANE, dtype=np.int64)
            stop = np.minimum(start + LANE, ends + 1)
            hits = []
            while len(start):
                tail = blocks[start + (m - BLOCK)]
                jump = shift[_slot(tail).astype(np.int64)]
                zero = jump == 0
                if zero.any():
                    hits.append(start[zero])
                start = start + np.maximum(jump, 1)
                live = start < stop
                if not live.all():
                    start, stop = start[live], stop[live]
            if not hits:
                continue
            at = np.concatenate(hits)
            tail = blocks[at + (m - BLOCK)]
            a, z = np.searchsorted(last, tail, "left"), np.searchsorted(last, tail, "right")
            keep = np.flatnonzero(z > a)  # the bucket of that suffix block
            for i in keep.tolist():
                place = int(at[i])
                head = blocks[place]
                for k in range(int(a[i]) + int(np.searchsorted(first[a[i] : z[i]], head, "left")), int(z[i])):
                    if first[k] != head:
                        break
                    p = own[k]
                    if text[place : place + len(p)] == p:
                        yield place, p


def parts(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(window, item, part) of all items, and how many parts there are: each has some ITEMS windows and BYTES bytes at most."""

    def run(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = list(dict.fromkeys(windows(t)))
                for at in range(0, len(own), 10_000):
                    some = own[at : at + 10_000]
                    yield batch(window=pa.array(some, pa.binary()), item=pa.array([i] * len(some), pa.string()))

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    rows = settle(items.mapInArrow(run, "window binary, item string").distinct())
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("window") + F.octet_length("item")).alias("b")).first()
    count = max(1, -(-size.n // ITEMS), -(-(size.b or 0) // BYTES))
    return rows.withColumn("part", F.pmod(F.xxhash64("window", "item"), F.lit(count)).cast("int")), count


def searcher(rows: DataFrame, part: int) -> Searcher:
    """One part of the windows, which is small by its definition."""
    found: dict[bytes, set[str]] = {}
    for w, i in rows.where(F.col("part") == part).select("window", "item").toLocalIterator():
        found.setdefault(bytes(w), set()).add(i)
    return Searcher(found)


def hits(search: Searcher, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text (words, places of benchmark windows in its normal form, items with windows in it). Many texts are scanned as one.

    A line feed, which no pattern holds, keeps them apart.
    """
    out: list[tuple[int, list[tuple[int, int]], set[str]]] = []
    held: list[tuple[bytes, int]] = []
    size = 0
    for data in texts:
        held.append(normal(data))
        size += len(held[-1][0]) + 1
        if size > TOGETHER:
            out += _scan(search, held)
            held, size = [], 0
    return out + _scan(search, held)


def _scan(search: Searcher, held: list[tuple[bytes, int]]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    whole = b"\n".join([t for t, _ in held])
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t, _ in held])])
    items: dict[int, set[str]] = {}
    spans: dict[int, set[tuple[int, int]]] = {}
    for place, p in search.find(whole):
        k = int(np.searchsorted(first, place, "right")) - 1
        at = place - int(first[k])
        items.setdefault(k, set()).update(search.items[p])
        spans.setdefault(k, set()).add((at, at + len(p) - 1))
    return [(n, sorted(spans.get(k, ())), items.get(k, set())) for k, (_, n) in enumerate(held)]


def _covered(text: bytes, spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, z in spans:  # from the space before the first word to the space after the last: one space a word
        a = max(a, end)
        if z > a:
            total += text.count(b" ", a, z)
            end = z
    return total


KIND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _result(ids, got) -> pa.RecordBatch:
    """got: (words, words hit, items) of each row."""
    return batch(
        doc_id=ids, n_words=pa.array([n for n, _, _ in got], pa.int64()), n_hit=pa.array([h for _, h, _ in got], pa.int64()), n_items=pa.array([len(i) for _, _, i in got], pa.int64()),
        items_sha256=pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, _, i in got], pa.string()), contaminated=pa.array([h > 0 for _, h, _ in got], pa.bool_()),
    )


def _found(docs: DataFrame, rows: DataFrame, count: int) -> DataFrame:
    """(_row_id, _row_hash, spans, items) of the rows that hold a window, part by part: one broadcast at a time, then the next."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("_row_id"), F.xxhash64("text").alias("_row_hash"), F.col("text").cast("binary").alias("t"))
    out = None
    for part in range(count):
        shared = spark.sparkContext.broadcast(searcher(rows, part))

        def run(batches, shared=shared):
            for b in batches:
                got = hits(shared.value, blobs(b.column(2)))
                some = [k for k, g in enumerate(got) if g[1]]
                kind = pa.list_(pa.list_(pa.int64()))
                yield batch(_row_id=b.column(0).take(pa.array(some, pa.int64())), _row_hash=b.column(1).take(pa.array(some, pa.int64())), spans=pa.array([[list(s) for s in got[k][1]] for k in some], kind), items=pa.array([sorted(got[k][2]) for k in some], pa.list_(pa.string())))

        found = settle(own.mapInArrow(run, "_row_id long, _row_hash long, spans array<array<long>>, items array<string>"))
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)  # noqa: E731  of one text
    return out.groupBy("_row_id", "_row_hash").agg(flat("spans"), flat("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    Null and empty texts have no words. Items without words never occur; null item ids or texts are no items. Items that
    repeat count once by id. No documents: no rows; rows that repeat each get a row; other columns are not read. A benchmark
    of more than one part (see ITEMS and BYTES) is scanned for part by part, each part being broadcast alone.
    """
    rows, count = parts(benchmark)
    if count == 1:
        shared = docs.sparkSession.sparkContext.broadcast(searcher(rows, 0))

        def run(batches):
            for b in batches:
                texts = blobs(b.column(1))
                yield _result(b.column(0), [(n, _covered(normal(x)[0], s) if s else 0, i) for x, (n, s, i) in zip(texts, hits(shared.value, texts))])

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, KIND)

    def join(batches):
        for b in batches:
            got = []
            for x, s, i in zip(blobs(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                text, n = normal(x)
                got.append((n, _covered(text, sorted(map(tuple, s or ()))), i or ()))
            yield _result(b.column(0), got)

    mine = F.col("doc_id").cast("long").eqNullSafe(F.col("_row_id")) & (F.xxhash64("text") == F.col("_row_hash"))
    own = docs.select("doc_id", "text").join(_found(docs, rows, count), mine, "left")
    return own.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t"), "spans", "items").mapInArrow(join, KIND)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark window; columns stay as they are.

    Null and empty texts hold none and stay. Rows are judged one by one, whatever ids repeat; an empty table stays empty.
    """
    rows, count = parts(benchmark)
    if count > 1:
        mine = F.col("doc_id").cast("long").eqNullSafe(F.col("_row_id")) & (F.xxhash64("text") == F.col("_row_hash"))
        return docs.join(_found(docs, rows, count).select("_row_id", "_row_hash"), mine, "left_anti")
    shared, names = docs.sparkSession.sparkContext.broadcast(searcher(rows, 0)), docs.columns

    def run(batches):
        for b in batches:
            clean = [not s for _, s, _ in hits(shared.value, blobs(b.column(len(names))))]
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=names).filter(pa.array(clean, pa.bool_()))

    return docs.select("*", F.col("text").cast("binary").alias("_bytes_of_text")).mapInArrow(run, docs.schema)
