"""Removal of repeated byte strings, decided by merged Burrows-Wheeler transforms.

A string of `length` bytes is repeated if it starts anywhere else as well. All strings cannot be sorted together at any
size, so what can differ is narrowed down first, without losing a string:

1. Each window of `length` bytes picks an anchor, the place in it whose rolling hash is least. Equal windows pick the same
   anchor at the same place. Neighbouring windows with one anchor make a segment. Segments that occur twice as a whole
   are repeated; anchors that occur once lead to nothing.
2. What is left, segments that share an anchor and differ, is cut into blocks of BLOCK window starts. The bytes that all
   windows of a block share, its core, become one symbol; only blocks with equal cores can hold equal windows.
3. The flanks around the cores, as strings over bytes and core symbols, are split into shards; each shard has its own
   transform. The transforms are merged by interleave refinement: round k orders the interleave by k symbols, and a
   border between two suffixes that appears in round k tells that their common prefix is k - 1 symbols long. Suffixes
   with no border between them after BLOCK rounds are equal windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blobs, discard, stored

PROBE = 32  # bytes that an anchor's hash covers
BLOCK = 24  # window starts in a block
PIECE = 1 << 20  # bytes of a text handled at once
SHARD = 1 << 16  # symbols of a shard whose transform is built at once
MERGE = 1 << 21  # symbols merged at once, or one group if that is larger
LARGE = 1 << 16  # flanks of one core from which its windows are counted on Spark, as they should not meet in one task
ROWS = 1 << 17  # rows of segments or blocks handed on at once

_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_POWERS: list = []


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor of one piece of text; windows start at 0."""
    n, reach = len(data), length - PROBE + 1
    if not _POWERS:
        _POWERS.extend(_powers(PIECE + 4096))
    up, down = _POWERS
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * up[:n], out=sums[1:])
    h = (sums[PROBE:] - sums[:-PROBE]) * down[: n - PROBE + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    m = len(h)
    key = np.full(-(-m // reach) * reach, 2**64 - 1, np.uint64)
    key[:m] = (h & ~np.uint64(0xFFFFFF)) | np.arange(m, dtype=np.uint64)  # of equal hashes the first place
    rows = key.reshape(-1, reach)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    k = n - length + 1
    place = (np.minimum(behind[:k], ahead[reach - 1 : reach - 1 + k]) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], k) - 1
    return h[place[first]], place[first], first, last


def segments(data: bytes, length: int):
    """(anchor hash, anchor place, first window, last window) over a whole text, piece by piece."""
    step = PIECE - length + 1
    for at in range(0, len(data) - length + 1, step):
        piece = data[at : at + PIECE]
        for h, q, s, e in zip(*(x.tolist() for x in anchors(piece, length))):
            yield h, at + q, at + s, at + e


def refine(shards: list[list[np.ndarray]], depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Merge the shards' transforms; (each shard's suffix order, run number along the merged order).

    Each string is an array of symbols from 1 up. Suffixes of one run share `depth` symbols.
    """
    orders, transforms = [], []
    for strings in shards:
        text = np.concatenate([np.append(s, 0) for s in strings]).astype(np.int64)
        n = len(text)
        end = np.flatnonzero(text == 0)
        rank = text + len(end)
        rank[end] = np.arange(len(end))  # ends of strings differ, so the order is total
        k, place = 1, np.arange(n)
        while True:
            ahead = np.minimum(place + k, n - 1)
            second = np.where(place + k < n, rank[ahead] + 1, 0)
            pair = rank * (int(second.max()) + 1) + second
            order = np.argsort(pair, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.diff(pair[order], prepend=pair[order[0]]) != 0)
            rank, k = new, k * 2
            if rank[order[-1]] == n - 1:
                break
        orders.append(order)
        transforms.append(text[order - 1])  # the symbol before; before a string's first is the end of another
    wide = np.uint16 if max(int(t.max()) for t in transforms) < 1 << 16 else np.uint32
    transforms = [t.astype(wide) for t in transforms]
    sizes = [len(t) for t in transforms]
    interleave = np.repeat(np.arange(len(shards), dtype=np.int16), sizes)
    run = np.zeros(len(interleave), np.int64)
    symbols = np.concatenate(transforms)
    for _ in range(depth):
        row = np.empty(len(interleave), np.int64)  # shard by shard, where each row of the transform stands now
        row[:] = np.argsort(interleave, kind="stable")
        here = np.empty(len(interleave), wide)
        here[row] = symbols
        back = np.argsort(here, kind="stable")  # the suffix one symbol longer, sorted by that symbol, then as before
        sorted_symbols, old = here[back], run[back]
        interleave = interleave[back]
        border = np.empty(len(back), bool)
        border[0] = False
        border[1:] = (sorted_symbols[1:] != sorted_symbols[:-1]) | (old[1:] != old[:-1])
        border[1:] |= sorted_symbols[1:] == 0  # ends of strings are equal to nothing
        run = np.cumsum(border)
    place = [np.flatnonzero(interleave == i) for i in range(len(shards))]
    return orders, [run[p] for p in place]


def repeated_windows(lefts: list[bytes], cores: np.ndarray, rights: list[bytes]) -> list[np.ndarray]:
    """For each row, flags of the windows that start at its left bytes and at its core: does it occur in another row too?

    A window is BLOCK symbols long, the core being one of them; a row has len(right) + 1 windows that begin at its first
    symbols, or fewer where its left flank is shorter.
    """
    strings = [np.concatenate([np.frombuffer(a, np.uint8).astype(np.int64) + 1, [257 + c], np.frombuffer(b, np.uint8).astype(np.int64) + 1]) for a, c, b in zip(lefts, cores.tolist(), rights)]
    shards, size = [[]], 0
    for i, s in enumerate(strings):
        if size > SHARD:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(s) + 1
    orders, runs = refine([[strings[i] for i in ids] for ids in shards], BLOCK)
    counts = np.bincount(np.concatenate(runs))
    out: list[np.ndarray] = [None] * len(strings)
    for ids, order, run in zip(shards, orders, runs):
        twice = np.empty(len(order), bool)
        twice[order] = counts[run] > 1
        at = 0
        for i in ids:
            n = len(strings[i])
            out[i] = twice[at : at + max(0, n - BLOCK + 1)]
            at += n + 1
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """(doc_id, h, t, more): an id, 0 for null, and a hash of id and text, which tells rows apart that share an id."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).cast("binary").alias("t"), *more)


def repeats(texts: DataFrame, length: int = 400) -> DataFrame:
    """(keys, first, last) of (keys, t): runs of window starts, in bytes, that are repeated. keys, of type long, tell rows apart."""
    keys = [c for c in texts.columns if c != "t"]
    named = "".join(f"{k} long, " for k in keys)
    texts = texts.where(F.octet_length("t") >= length)

    def cut(batches):
        cols: dict[str, list] = {k: [] for k in (*keys, "anchor", "digest", "q", "s", "e")}

        def rows():
            whole = {k: pa.array(v, pa.int32() if k in "qe" else pa.int64()) for k, v in cols.items() if k != "anchor"}
            out = batch(**whole | {"anchor": pa.array(np.array(cols["anchor"], np.uint64).view(np.int64))}).select(list(cols))
            for v in cols.values():
                v.clear()
            return out

        for b in batches:
            for *own, x in zip(*(b.column(k).to_pylist() for k in keys), blobs(b.column("t"))):
                for a, p, f, l in segments(x, length):
                    digest = int.from_bytes(hashlib.blake2b(x[f : l + length], digest_size=8).digest(), "little", signed=True)
                    for k, v in zip(cols, (*own, a, digest, p - f, f, l - f)):
                        cols[k].append(v)
                    if len(cols["s"]) >= ROWS:
                        yield rows()
        if cols["s"]:
            yield rows()

    every = stored(texts.mapInArrow(cut, named + "anchor long, digest long, q int, s long, e int"))
    # anchor and digest together are 128 bits of a segment; e and q count from s
    kinds = stored(every.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct(*keys, "s", "e", "q")).alias("one")))
    whole = stored(every.join(kinds.where("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select(*keys, F.col("s").alias("first"), (F.col("s") + F.col("e")).alias("last")))
    discard(every)
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor")
    open_ = kinds.join(mixed, "anchor").select("anchor", (F.col("n") > 1).alias("known"), "one.*")
    per_doc = stored(open_.groupBy(*keys).agg(F.collect_list(F.struct("anchor", "known", "s", "e", "q")).alias("segs")))  # of one text
    discard(kinds)

    def blocks(batches):
        cols: dict[str, list] = {k: [] for k in (*keys, "core", "known", "start", "left", "right")}
        types = dict.fromkeys(keys, pa.int64()) | dict(core=pa.binary(), known=pa.bool_(), start=pa.int64(), left=pa.binary(), right=pa.binary())

        def rows():
            out = batch(**{k: pa.array(v, types[k]) for k, v in cols.items()})
            for v in cols.values():
                v.clear()
            return out

        for b in batches:
            for *own, x, segs in zip(*(b.column(k).to_pylist() for k in keys), blobs(b.column("t")), b.column("segs").to_pylist()):
                for g in segs:
                    s, e, q = g["s"], g["s"] + g["e"], g["s"] + g["q"]
                    for k in range((s - q) // BLOCK, (e - q) // BLOCK + 1):
                        lo, hi = q + k * BLOCK, q + k * BLOCK + BLOCK - 1  # window starts of the block
                        f, l = max(lo, s), min(hi, e)
                        core = hashlib.blake2b(x[hi : lo + length], digest_size=16, key=(g["anchor"] & (2**64 - 1)).to_bytes(8, "little"), salt=(k & 0xFFFF).to_bytes(2, "little")).digest()
                        for name, v in zip(cols, (*own, core, g["known"], f, x[f:hi], x[lo + length : l + length])):
                            cols[name].append(v)
                    if len(cols["core"]) >= ROWS:
                        yield rows()
        if cols["core"]:
            yield rows()

    kind = named + "core binary, known boolean, start long, left binary, right binary"
    rows = stored(texts.join(per_doc, keys).mapInArrow(blocks, kind))
    discard(per_doc)
    # equal rows become one; a core with one flank left needs no sorting: its windows all repeat or none does
    flanks = stored(rows.groupBy("core", "left", "right").agg(F.count("*").alias("n")))
    cores = flanks.groupBy("core").agg(F.count("*").alias("flanks"), F.max("n").alias("most"))
    alike = cores.where("flanks = 1 and most > 1").select("core")
    whole_blocks = stored(rows.where("not known").join(alike, "core", "left_semi").select(*keys, F.col("start").alias("first"), (F.col("start") + _windows(length)).alias("last")))
    many = flanks.join(cores.where(f"flanks > 1 and flanks <= {LARGE}").select("core"), "core")
    large = flanks.join(cores.where(f"flanks > {LARGE}").select("core"), "core")

    def merge(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                cut_ = b.slice(at, 8192)
                held.append(cut_)
                size += cut_.num_rows * BLOCK * 2
                if size >= MERGE:
                    t = pa.Table.from_batches(held)
                    core = t["core"].to_pylist()
                    end = len(core) - 1
                    while end and core[end - 1] == core[-1]:
                        end -= 1
                    if end:  # the last core may go on in the next batch
                        yield _merged(t.slice(0, end))
                        held = t.slice(end).to_batches()
                        size = (len(core) - end) * BLOCK * 2
        if held:
            yield _merged(pa.Table.from_batches(held))

    kind = "core binary, left binary, right binary, runs array<struct<a:int,z:int>>"
    runs = many.repartition("core").sortWithinPartitions("core").mapInArrow(merge, kind).unionByName(_counted(large))
    part = rows.where("not known").join(runs, ["core", "left", "right"]).select(*keys, "start", F.explode("runs").alias("r"))
    part = stored(part.select(*keys, (F.col("start") + F.col("r.a")).alias("first"), (F.col("start") + F.col("r.z")).alias("last")))
    discard(rows, flanks)
    return whole.unionByName(whole_blocks).unionByName(part)


def _counted(flanks: DataFrame) -> DataFrame:
    """(core, left, right, runs) as _merged() gives them, for cores of any number of flanks: each window is a row and is counted."""
    last = F.octet_length("left") + 1 + F.octet_length("right") - BLOCK
    starts = flanks.where(last >= 0).select("core", "left", "right", "n", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    own = F.octet_length("left") - F.col("k")  # bytes of the window before the core
    ends = starts.select("*", F.substring("left", F.col("k") + 1, own).alias("a"), F.substring("right", F.lit(1), F.lit(BLOCK - 1) - own).alias("b"))
    twice = ends.groupBy("core", "a", "b").agg(F.sum("n").alias("times")).where("times > 1").select("core", "a", "b")
    found = ends.join(twice, ["core", "a", "b"]).groupBy("core", "left", "right").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    return found.select("core", "left", "right", F.transform("ks", lambda k: F.struct(k.cast("int").alias("a"), k.cast("int").alias("z"))).alias("runs"))


def _windows(length: int):
    """Window starts after the first that a row of flanks holds."""
    return (F.octet_length("left") + 1 + F.octet_length("right") - BLOCK).cast("long")


def _merged(t: pa.Table) -> pa.RecordBatch:
    core = t["core"].to_pylist()
    left, right = t["left"].to_pylist(), t["right"].to_pylist()
    number = {c: i for i, c in enumerate(dict.fromkeys(core))}
    several = t["n"].to_numpy() > 1
    flags = repeated_windows(left, np.array([number[c] for c in core]), right)
    runs = []
    for x, all_ in zip(flags, several):
        if all_:
            x = np.ones(len(x), bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], x, [False]]).astype(np.int8)))
        runs.append([{"a": a, "z": z - 1} for a, z in zip(edge[::2].tolist(), edge[1::2].tolist())])
    return batch(core=pa.array(core, pa.binary()), left=pa.array(left, pa.binary()), right=pa.array(right, pa.binary()), runs=pa.array(runs, pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))))


def joined(runs, length: int) -> list[tuple[int, int]]:
    """Sorted runs of window starts, those that touch or overlap as one: (first start, end of the last window)."""
    out: list[list[int]] = []
    for f, l in sorted(runs):
        if out and f <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], l)
        else:
            out.append([f, l])
    return [(f, l + length) for f, l in out]


def strip_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): each text without the bytes that repeated strings cover.

    Matches never cross documents; the input alone decides. Null texts are empty; texts shorter than `length` stay whole.
    Every row counts as a document, whether its id is null or repeated; a row that occurs twice is repeated as a whole. No
    documents: no rows. Other columns are not read.
    """
    keys = ["doc_id", "h"]
    own = _keyed(docs, "doc_id", "text", F.col("doc_id").cast("long").alias("id"))
    runs = repeats(own.select(*keys, "t"), length).groupBy(*keys).agg(F.collect_set(F.struct("first", "last")).alias("runs"))  # of one text

    def run(batches):
        for b in batches:
            n, removed, spans, kept = [], [], [], []
            for x, r in zip(blobs(b.column(1)), b.column(2).to_pylist()):
                found, out, at = [], [], 0
                for f, e in joined(((y["first"], y["last"]) for y in r or ()), length):
                    if found and f <= found[-1][1]:  # windows that overlap or touch are one span
                        found[-1][1] = e
                    else:
                        found.append([f, e])
                for f, e in found:
                    out.append(x[at:f])
                    at = e
                out.append(x[at:])
                n.append(len(x))
                removed.append(sum(e - f for f, e in found))
                spans.append(len(found))
                kept.append(b"".join(out))
            yield batch(doc_id=b.column(0), n_bytes=pa.array(n, pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(spans, pa.int64()), kept=pa.array(kept, pa.binary()))

    return own.join(runs, keys, "left").select("id", "t", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
