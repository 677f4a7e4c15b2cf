"""Packing of tokenised documents into windows: non-negative least squares over shallow length combinations.

Whole windows of long documents need no partner. What is left of each document has a length below the window; lengths are
counted over all documents in units, combinations of few units that fill a window are enumerated, and repeat counts that use
up the counts best are solved for once. Each task rounds them to its own documents, fills the small gaps and packs what the
combinations leave greedily, cutting where a window ends.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import groups
from .common import batch, stored
from .encoders import byte_level, content

UNIT = 32  # tokens of a unit in which lengths are counted
DEPTH = 5  # documents of a combination at most
CHUNK = 1 << 22  # tokens that a task packs at once, or one document if that is longer


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Every way to write `units` as a sum of 1 to `depth` numbers, larger ones last."""

    def grow(left: int, least: int, room: int):
        if room and left >= least:
            yield (left,)
        if room > 1:
            for first in range(least, left // 2 + 1):
                for rest in grow(left - first, first, room - 1):
                    yield (first, *rest)

    return list(grow(units, 1, depth))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets: columns join while one would lower the error, and leave at zero."""
    x = np.zeros(a.shape[1])
    free: list[int] = []
    small = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[0] + 30):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= small:
            break
        free.append(best)
        while free:
            s = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[free] = s
                break
            old = x[free]
            low = s <= 0
            step = float((old[low] / np.maximum(old[low] - s[low], 1e-300)).min())
            old = old + step * (s - old)
            x[:] = 0
            x[free] = np.maximum(old, 0)
            free = [c for c, v in zip(free, old.tolist()) if v > 1e-12]
    return x


def mixture(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], float]]:
    """(combination of units, repeats a document), the most frequent first, from how many documents leave each length."""
    units = -(-window // UNIT)
    b = np.zeros(units)
    for length, n in counts.items():
        if length:
            b[-(-length // UNIT) - 1] += n
    if not b.any():
        return []
    every = combinations(units, DEPTH)
    a = np.zeros((units, len(every)))
    for k, c in enumerate(every):
        np.add.at(a[:, k], np.array(c) - 1, 1.0)
    x = nnls(a, b / b.sum())
    return [(every[k], float(x[k])) for k in np.argsort(-x, kind="stable") if x[k] > 0]


def pack_lengths(n: np.ndarray, mix: list[tuple[tuple[int, ...], float]], window: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset) of every piece of documents of n tokens each, one array each.

    Every sequence is full, but for the last few, whose sizes are different powers of two.
    """
    out: list[tuple] = []
    whole = n // window
    of = np.repeat(np.arange(len(n)), whole)
    made = len(of)
    out.append((of, (np.arange(made) - np.repeat(np.cumsum(whole) - whole, whole)) * window, np.full(made, window), np.arange(made), np.zeros(made, np.int64)))
    rest = n % window
    stacks: list[list[int]] = [[] for _ in range(-(-window // UNIT) + 1)]
    for i in np.argsort(rest, kind="stable").tolist():  # the longest of a unit goes first
        if rest[i]:
            stacks[-(-int(rest[i]) // UNIT)].append(i)
    total = sum(map(len, stacks))
    taken: list[list[int]] = []
    for again in (False, True):  # as often as the mixture says, then as often as the rest allows
        for c, share in mix:
            need = Counter(c)
            times = min(len(stacks[u]) // m for u, m in need.items())
            for _ in range(times if again else min(times, round(share * total))):
                taken.append([stacks[u].pop() for u in c])
    used = np.array([int(rest[t].sum()) for t in taken], np.int64)
    left = sorted((int(rest[i]), i) for s in stacks for i in s)
    # where the rest can't fill the gaps, some sequences become rest again
    lack = int((window - used).sum()) - sum(r for r, _ in left)
    while taken and lack > 0:
        back = taken.pop()
        left = sorted(left + [(int(rest[i]), i) for i in back])
        lack -= window  # its gap goes, and its documents fill others
    used = used[: len(taken)]
    gaps = []
    for k, t in enumerate(taken):
        at = 0
        gap = window - int(used[k])
        while left and left[0][0] <= gap:  # whole documents first
            r, i = left.pop(bisect_right(left, (gap, len(n))) - 1)
            t.append(i)
            gap -= r
        for i in t:
            out.append(([i], [whole[i] * window], [rest[i]], [made + k], [at]))
            at += int(rest[i])
        if gap:
            gaps.append((gap, made + k, at))
    stream = [i for _, i in reversed(left)]
    lengths = rest[stream].astype(np.int64)
    more = int(lengths.sum()) - sum(g for g, *_ in gaps)
    count, tail = divmod(max(more, 0), window)
    sizes = [window] * count + [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    slots = gaps + [(s, made + len(taken) + k, 0) for k, s in enumerate(sizes)]
    if stream:
        ends, closes = np.cumsum(lengths), np.cumsum([s for s, *_ in slots])
        marks = np.union1d(ends, closes)
        marks = marks[marks <= ends[-1]]
        begins = np.concatenate([[0], marks[:-1]])
        d, s = np.searchsorted(ends, begins, "right"), np.searchsorted(closes, begins, "right")
        slot = np.array(slots, np.int64)
        of = np.array(stream)[d]
        out.append((of, whole[of] * window + begins - (ends - lengths)[d], marks - begins, slot[s, 1], slot[s, 2] + begins - (closes - slot[:, 0])[s]))
    return tuple(np.concatenate([np.asarray(o[k], np.int64) for o in out]) for k in range(5))


def tokenised(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids binary) of every row, stored: ids as little-endian unsigned integers of two bytes, or four where the file has more ids."""
    shared = docs.sparkSession.sparkContext.broadcast(content(tokenizer))
    kind = "<u2" if max(end, byte_level(shared.value, True).size - 1) < 1 << 16 else "<u4"

    def run(batches):
        encoder = byte_level(shared.value, True)
        for b in batches:
            at = 0
            for group in groups(b.column(1).to_pylist()):
                ids = [np.append(encoder.encode(x), end).astype(kind) for x in group]
                yield batch(doc_id=b.column(0).slice(at, len(group)), n=pa.array([len(x) for x in ids], pa.int64()), ids=pa.array([x.tobytes() for x in ids], pa.binary()))
                at += len(group)

    return stored(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n long, ids binary")), kind


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row per piece of a document's ids and `end`.

    Each id lies in one piece; a sequence's pieces follow each other from 0 without gaps. Sequences hold `window` ids, but for at
    most log2(window) of each chunk of a task, whose sizes are powers of two, so nothing is padded. Null texts are empty and have
    `end` alone; rows that repeat, in id or text, are packed each on their own; other columns are not read; no documents, no rows.
    """
    held, kind = tokenised(docs, tokenizer, end)
    counts = held.groupBy((F.col("n") % window).alias("length")).agg(F.count("*").alias("n")).collect()  # `window` rows at most
    mix = mixture({r["length"]: r["n"] for r in counts}, window)

    def run(batches):
        sequence = TaskContext.get().partitionId() << 33
        ids_of, doc_ids, size = [], [], 0

        def packed():
            nonlocal sequence
            n = np.array([len(x) for x in ids_of], np.int64)
            doc, start, length, seq, offset = pack_lengths(n, mix, window)
            order = np.lexsort((offset, seq))
            for at in range(0, len(order), 4096):
                some = order[at : at + 4096]
                cut = [ids_of[d][s : s + k].astype("<u4") for d, s, k in zip(doc[some].tolist(), start[some].tolist(), length[some].tolist())]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int32)
                yield batch(
                    doc_id=pa.array([doc_ids[d] for d in doc[some].tolist()], pa.int64()), start=pa.array(start[some]), length=pa.array(length[some]), ids_crc32=pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()),
                    doc_tokens=pa.array(n[doc[some]]), sequence_id=pa.array(sequence + seq[some]), offset=pa.array(offset[some]), ids=pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cut).view(np.int32))),
                )
            sequence += int(seq.max()) + 1

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc_ids.append(i)
                ids_of.append(np.frombuffer(x, kind))
                size += len(ids_of[-1])
                if size >= CHUNK:
                    yield from packed()
                    ids_of, doc_ids, size = [], [], 0
        if ids_of:
            yield from packed()

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    return held.select("doc_id", "ids").mapInArrow(run, kinds)
