"""Alignment of two tokenizers over a corpus: each distinct text is tokenised and aligned once, and counts for all its copies.

1. Texts are shuffled whole and counted, so that copies meet; a distinct text is encoded by both tokenizers, and the byte offsets
   where tokens of both end cut them into groups. The two tokens that end a group are linked.
2. Linked pairs are counted over the corpus, each text's as often as it has copies, and marked if no pair of the same second
   token is more frequent.
3. Each distinct text looks its pairs up, in parts of bounded size, and what comes of it is joined to the documents by text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import groups
from .common import batch, discard, stored
from .encoders import byte_level, content, pieces

PAIRS = 1 << 21  # pairs that are sent to the tasks at once: 17 bytes each; more are looked up part by part
HELD = 1 << 21  # links that a task counts at once, or one text's if those are more
SHARE = 1000  # a text is hot if one row in so many is a copy of it: no more than so many texts can be


class Aligner:
    """Both encoders, and the bytes and decimal forms of their tokens."""

    def __init__(self, first: str, second: bytes):
        self.a, self.b = byte_level(first, False), pieces(second)
        self.len_a, self.len_b = (np.array([len(x) for x in e.bytes_of], np.int64) for e in (self.a, self.b))
        # what a token is written as: inside a side, at its end, for either side
        self.written = np.array([f"{i}{sep}".encode() for n, seps in ((self.a.size, ",|"), (self.b.size, ",;")) for sep in seps for i in range(n)], object)

    def align(self, texts: list[str]) -> list[tuple]:
        """For each text (first ids, second ids, group of each first token, of each second token, linked pairs); None if bytes differ.

        A pair is first id * second size + second id, in order of the groups that it ends.
        """
        out = []
        for text, ids_b in zip(texts, self.b.encode(texts)):
            spaced = " " + text
            whole = spaced.encode()
            ids_a, ids_b = self.a.encode(spaced), np.array(ids_b, np.int64)
            bytes_of = self.a.bytes_of.__getitem__, self.b.bytes_of.__getitem__
            if not text or any(b"".join(map(f, x.tolist())) != whole for f, x in zip(bytes_of, (ids_a, ids_b))):
                out.append(None)
                continue
            ids_a = ids_a.astype(np.int64)
            end_a, end_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
            last_a, last_b = _in(end_a, end_b), _in(end_b, end_a)
            out.append((ids_a, ids_b, np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b, ids_a[last_a] * self.b.size + ids_b[last_b]))
        return out

    def digest(self, ids_a, ids_b, group_a, group_b, _) -> str:
        """SHA-256 of the groups: ids joined by commas, sides by a bar, groups by semicolons."""
        ends = lambda g: np.append(g[1:] != g[:-1], True)
        n, m = self.a.size, self.b.size
        what = np.concatenate([ids_a + n * ends(group_a), 2 * n + ids_b + m * ends(group_b)])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        return hashlib.sha256(b"".join(self.written[what[order]].tolist())[:-1]).hexdigest()


def _in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the rising x are in the rising y, which is not empty."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


@lru_cache(2)
def aligner_of(first: str, second: bytes) -> Aligner:
    """One for a worker, whose tasks follow each other in it."""
    return Aligner(first, second)


def aligned_texts(docs: DataFrame, first: str, second: str) -> DataFrame:
    """(key, copies, n_a, n_b, n_groups, groups_sha256, links binary) of every distinct text that is not empty, stored.

    key is the text's SHA-256; links are the pairs in order, as little-endian integers of eight bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast((content(first), content(second, True)))
    distinct = docs.where("text != ''").groupBy("text").agg(F.count("*").alias("copies"))

    def run(batches):
        aligner = aligner_of(*shared.value)
        for b in batches:
            at = 0
            for group in groups(b.column(2).to_pylist()):
                found = aligner.align(group)
                size = lambda k: pa.array([len(x[k]) if x else 0 for x in found], pa.int64())
                yield batch(
                    key=b.column(0).slice(at, len(group)), copies=b.column(1).slice(at, len(group)), n_a=size(0), n_b=size(1), n_groups=size(4),
                    groups_sha256=pa.array([aligner.digest(*x) if x else "" for x in found], pa.string()), links=pa.array([x[4].astype("<i8").tobytes() if x else b"" for x in found], pa.binary()),
                )
                at += len(group)

    kind = "key binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
    return stored(distinct.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text").mapInArrow(run, kind))


def pair_counts(texts: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best) over the corpus, stored. best: no pair of the same second id has more. Links of a text count once a copy."""

    def run(batches):
        links, n, held = [], [], 0

        def partial():
            pair, of = np.unique(np.concatenate(links), return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, of, np.concatenate(n))
            return batch(pair=pa.array(pair), n=pa.array(total))

        for b in batches:
            for x, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                links.append(np.frombuffer(x, "<i8"))
                n.append(np.full(len(links[-1]), copies, np.int64))
                held += len(links[-1])
                if held >= HELD:
                    yield partial()
                    links, n, held = [], [], 0
        if links:
            yield partial()

    counts = texts.select("links", "copies").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(W.partitionBy(F.col("pair") % size_b))  # a second id has as many pairs as there are first ids at most
    return stored(counts.select("pair", "count", (F.col("count") == most).alias("best")))


def looked_up(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """texts without links, with n_best and count_sum: pairs are looked up part by part. A part has PAIRS pairs, give or take chance."""
    own = [c for c in texts.columns if c != "links"]
    kind = ", ".join(f"{n} {t}" for n, t in texts.dtypes if n != "links") + ", n_best long, count_sum long"
    number = max(1, -(-counts.count() // PAIRS))
    parts = []
    for part in range(number):
        known = counts.where(F.pmod(F.xxhash64("pair"), F.lit(number)) == part).orderBy("pair").toArrow()
        # a last entry that fits no pair, so that every place exists
        shared = texts.sparkSession.sparkContext.broadcast(tuple(np.append(known.column(k).to_numpy(), end) for k, end in enumerate((-1, 0, False))))

        def run(batches, shared=shared):
            pair, count, best = shared.value
            for b in batches:
                n, total = [], []
                for x in b.column("links").to_pylist():
                    links = np.frombuffer(x, "<i8")
                    at = np.searchsorted(pair[:-1], links)
                    at = at[pair[at] == links]
                    n.append(int(best[at].sum()))
                    total.append(int(count[at].sum()))
                yield batch(**{c: b.column(c) for c in own}, n_best=pa.array(n, pa.int64()), count_sum=pa.array(total, pa.int64()))

        parts.append(texts.mapInArrow(run, kind))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out if number == 1 else out.groupBy(*own).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per row of docs (doc_id, text).

    first is a byte-level BPE file, before whose texts a space is put; second a sentencepiece model that puts one itself. Texts
    that are null, empty, or other than the bytes of either side's tokens have zeros and ''. No token is empty, so a group ends in
    one link. Rows that repeat, in id or text, each get a row and count each; other columns are not read; no documents, no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = aligned_texts(rows, first, second)
    counts = pair_counts(texts, pieces(content(second, True)).size)
    measures = stored(looked_up(texts, counts))
    # copies of a hot text are dealt to several tasks, by as many rows of its measures
    total = measures.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total")).first().total
    hot = measures.where(F.col("copies") * SHARE >= total).select("key", F.least(F.lit(SHARE), F.ceil(F.col("copies") * SHARE / F.lit(max(total, 1)))).cast("int").alias("salts"))
    dealt = measures.join(F.broadcast(hot), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts", "copies")
    own = rows.select("doc_id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("key")).join(F.broadcast(hot), "key", "left")
    # rows without a text have a key that fits nothing, of many values
    own = own.select("doc_id", F.coalesce("key", F.encode(F.rand(0).cast("string"), "utf-8")).alias("key"), F.floor(F.rand(0) * F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = own.join(dealt, ["key", "salt"], "left")
    out = out.select("doc_id", zero("n_a"), zero("n_b"), zero("n_groups"), F.coalesce("n_groups", F.lit(0)).alias("n_links"), zero("n_best"), zero("count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    discard(texts, counts)
    return out
