"""Quality by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blobs

TERMS = 2048  # hashed terms
TOPICS = 96  # latent dimensions
ROUNDS = 12  # of subspace iteration
SAMPLE = 6000  # labelled rows to learn from, at most: the bound of the fit
SHARPNESS = 24.0  # a neighbour at similarity s votes with weight exp(SHARPNESS * (s - 1))
# upper case letters A, lower case and non-ASCII letters a, digits 0, white space one kind, other signs as they are
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))


def terms(data: bytes) -> np.ndarray:
    """Log counts of hashed byte trigrams, four-grams of the letters' shapes, and how often words follow themselves."""
    out = np.zeros(TERMS, np.float32)
    if not data:
        return out
    for at in range(0, len(data), 1 << 20):  # a long text goes through in pieces; all of them count
        piece = data[max(0, at - 3) : at + (1 << 20)]
        x, s = (np.frombuffer(b"\n" + y + b"\n\n", np.uint8).astype(np.uint32) for y in (piece, piece.translate(SHAPE)))
        tri = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(7)
        shape = (s[:-3] * np.uint32(0x27D4EB2F) ^ s[1:-2] * np.uint32(0x165667B1) ^ s[2:-1] * np.uint32(0x9E3779B1) ^ s[3:] * np.uint32(0x85EBCA6B)) >> np.uint32(9)
        half = TERMS // 2
        out[:half] += np.bincount(tri % half, minlength=half)
        out[half : TERMS - 32] += np.bincount(shape % (half - 32), minlength=half - 32)
    out *= 1000.0 / max(1.0, float(out.sum()))  # texts of any length compare
    words = data.split()
    n = max(1, len(words))
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    kinds = 1 - len(set(words)) / n
    for i, v in enumerate((same, max(0.0, kinds - 0.5))):  # shares fill up to sixteen terms of their own each
        out[TERMS - 32 + 16 * i : TERMS - 32 + 16 * i + int(round(16 * v))] = 4.0
    return np.log1p(out)


class Space:
    """Inverse document frequencies, a projection onto latent topics, and the labelled vectors in it."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        """rows are scaled in place: they are the largest thing that the driver holds."""
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + len(rows)) / (1 + np.count_nonzero(rows, axis=0))).astype(np.float32) + 0.1
        rows *= self.idf
        rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]
        basis = np.linalg.qr(np.random.default_rng(3).standard_normal((rows.shape[1], TOPICS + 32)))[0].astype(np.float32)
        for _ in range(ROUNDS):  # the leading right singular vectors, by subspace iteration
            basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
        _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
        self.project = np.ascontiguousarray((basis @ turn.T)[:, :TOPICS], np.float32)
        self.vectors = self.unit(rows @ self.project)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for at in range(0, len(rows), 256):  # exact cosine products, block by block
            v = self.unit(self.unit(rows[at : at + 256] * self.idf) @ self.project)
            weight = np.exp(SHARPNESS * (v @ self.vectors.T - 1))
            out[at : at + 256] = weight @ self.labels / np.maximum(weight.sum(1), 1e-30)
        return np.clip(out, 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space | None:
    """The space of at most `sample` labelled rows, taken by a hash of their id; None without labelled rows.

    Only rows whose crc32(doc_id) mod 5 is not 0 are read. Of repeated labels of one id the lower quality counts, of
    different texts of one id the one whose terms are smallest.
    """
    marked = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # at most `sample` rows of two numbers: small whatever the input, so it may be broadcast
    picked = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("t")).join(F.broadcast(marked), F.col("doc_id") == F.col("_id")).select("_id", "t", "_q")

    def run(batches):
        for b in batches:
            v = [terms(x).astype(np.float16).tobytes() for x in blobs(b.column(1))]
            yield batch(id=b.column(0), v=pa.array(v, pa.binary()), q=b.column(2).cast(pa.int32()))

    got = picked.mapInArrow(run, "id long, v binary, q int").groupBy("id").agg(F.min(F.struct("v", "q")).alias("one")).select("id", "one.*").toArrow()
    if not len(got):
        return None
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    rows = np.empty((len(got), TERMS), np.float32)
    for i, k in enumerate(order.tolist()):
        rows[i] = np.frombuffer(got["v"][k].as_buffer(), np.float16)
    return Space(rows, got["q"].to_numpy()[order])


def score_batches(space: Space | None, column: int):
    """A function of Arrow batches: (batch, scores of its binary texts). Without a space every score is 0.5."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                cut = b.slice(at, 512)
                if space is None:
                    yield cut, np.full(cut.num_rows, 0.5)
                else:
                    yield cut, space.score(np.stack([terms(x) for x in blobs(cut.column(column))]))

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null and empty texts have the zero vector: every labelled row is equally far, and the score is the share of label 1.
    Only the text makes a score. Null ids are kept, held_out false. Repeated rows each get a row; no documents, no rows.
    """
    spark = docs.sparkSession
    space = learn(docs, labels, sample)
    shared = spark.sparkContext.broadcast(space)  # `sample` x TOPICS numbers at most

    def run(batches):
        for b, s in score_batches(shared.value, 2)(batches):
            yield batch(doc_id=b.column(0), held_out=b.column(1), score=pa.array(s), predicted=pa.array((s >= threshold).astype(np.int32)))

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("h"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """The documents that score `threshold` or more; columns stay as they are.

    Null and empty texts score the share of label 1 among the labelled rows. Rows are judged one by one: equal ones stay or go
    together, a null id changes nothing. Without labelled rows every score is 0.5, and all stay; no documents, no rows.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample)), docs.columns

    def run(batches):
        for b, s in score_batches(shared.value, len(names))(batches):
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=names).filter(pa.array(s >= threshold))

    return docs.select("*", F.col("text").cast("binary").alias("_bytes_of_text")).mapInArrow(run, docs.schema)
