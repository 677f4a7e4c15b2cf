"""Hard negatives: for each anchor and positive, the best rows of other labels within a window of scores, by a threshold algorithm.

Rows are taken in blocks. A block has one sorted list for each dimension; an anchor reads a list from its high end where its own
component is positive, else from its low end. The components at some depth of all lists give a threshold: no row that is not
reached yet scores more. Rows that are reached are scored at once, and a block is done for an anchor as soon as the threshold
falls strictly below the k-th score that each of its windows holds, or below the window. Scores are integers; a task takes what it
holds for an anchor from block to block, so that later blocks stop early, and its few best rows meet those of other tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch

BLOCK = 8192  # rows of a block
ANCHORS = 1 << 14  # anchors sent to the tasks at once, some 8 MB; more go through part by part
TILE = 1 << 21  # scores computed at once
FIRST = 8  # depth of the first look into the lists of a block
DENSE = 0.25  # an anchor that must reach more of a block than this scores it in one product
NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, q array<double>): rows with an id, a label and a vector of finite components, each made floor(256 * x)."""
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd)
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("q"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, and of longer ones than `width` the rest, which meets only zeros, goes."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = max(1, int(sizes.max(initial=0))) if width is None else width  # empty vectors as well have a list
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products of rows of integers whose norms' product is `most` or less; beyond 52 bits by Python's integers, held within 64 bits."""
    if most < 1 << 23:  # no partial sum is more, so four-byte floats hold it
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 52:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, NONE + 1, -(NONE + 1)).astype(np.int64)


class Best:
    """For each (anchor, window): the `k` first rows, by score, then id, of those that a window lets in."""

    def __init__(self, q: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.q, self.labels, self.low, self.high, self.k, self.same = q, labels, low, high, k, same
        self.up, self.down = np.maximum(q, 0), np.minimum(q, 0)
        self.norm = float(np.sqrt((q * q).sum(1).max(initial=0)))
        self.score = np.full((*low.shape, k), NONE)
        self.id = np.zeros((*low.shape, k), np.int64)
        self.own = np.zeros((*low.shape, k), bool)
        self.bound = np.zeros(len(q), np.int64)
        self._bounds(np.arange(len(q)))

    def _bounds(self, which: np.ndarray) -> None:
        """The least score that may still enter one of an anchor's windows."""
        least = np.maximum(self.low[which], self.score[which, :, -1])
        self.bound[which] = np.where(self.high[which] >= self.low[which], least, -NONE - 1).min(1, initial=-NONE - 1)

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Rows that were scored, each with its anchor."""
        w, k = self.low.shape[1], self.k
        for j in range(w):
            fit = (score >= np.maximum(self.low[anchor, j], self.score[anchor, j, -1])) & (score <= self.high[anchor, j])
            a, s, i, o = anchor[fit], score[fit], ids[fit], own[fit]
            if not len(a):
                continue
            there = np.unique(a)
            old = np.repeat(there, k)
            a, s = np.concatenate([old, a]), np.concatenate([self.score[there, j].ravel(), s])
            i, o = np.concatenate([self.id[there, j].ravel(), i]), np.concatenate([self.own[there, j].ravel(), o])
            order = np.lexsort((i, -s, s == NONE, a))
            a, s, i, o = a[order], s[order], i[order], o[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            first = place < k
            self.score[a[first], j, place[first]], self.id[a[first], j, place[first]], self.own[a[first], j, place[first]] = s[first], i[first], o[first]
        self._bounds(np.unique(anchor))


class Block:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q
        self.order = np.argsort(q, 0, kind="stable")  # one list for each dimension, lowest first
        depths = [0]
        while depths[-1] < len(q) - 1:
            depths.append(min(len(q) - 1, FIRST - 1 if depths[-1] == 0 else depths[-1] * 2 + 1))
        self.depths = np.array(depths)
        lists = np.take_along_axis(q, self.order, 0)
        self.high, self.low = lists[len(q) - 1 - self.depths], lists[self.depths]  # components at some depths, from either end

    def search(self, best: Best, ids: np.ndarray) -> None:
        """All that the block's rows change in what the anchors hold. ids: those of the anchors."""
        n, wide = self.q.shape
        self.most = best.norm * np.sqrt((self.q * self.q).sum(1).max())
        threshold = best.up @ self.high.T + best.down @ self.low.T
        # of floats: widened by more than their rounding; scores are integers, so that half of one does no harm
        threshold += 1e-9 * (best.up @ np.abs(self.high).T - best.down @ np.abs(self.low).T) + 0.5
        going = np.flatnonzero(threshold[:, 0] >= best.bound)
        new = best.bound[going] == NONE
        looked, going = going[new], going[~new]
        level, since = 1, 0
        while len(looked):  # some windows hold no k-th score yet: deeper and deeper looks give them one
            if level >= len(self.depths) or (self.depths[level] + 1) * wide > DENSE * n:
                self._rest(best, looked, threshold, ids, since)
                break
            for some in _tiles(looked, n):
                self._reached(best, some, int(self.depths[level]) + 1, ids, since)
            looked, since, level = looked[threshold[looked, level] >= best.bound[looked]], int(self.depths[level]) + 1, level + 2
        self._rest(best, going, threshold, ids, 0)

    def _rest(self, best: Best, going: np.ndarray, threshold: np.ndarray, ids: np.ndarray, since: int) -> None:
        """Go on from depth `since` to where the threshold falls below what each anchor's windows hold now; they can only gain by it."""
        n, wide = self.q.shape
        stops = threshold[going] < best.bound[going, None]
        need = np.where(stops.any(1), stops.argmax(1), len(self.depths) - 1)
        dense = (self.depths[need] + 1) * wide > DENSE * n
        for some in _tiles(going[dense], n):
            self._all(best, some, ids, since)
        for d in np.unique(need[~dense]).tolist():
            for some in _tiles(going[~dense & (need == d)], n):
                self._reached(best, some, int(self.depths[d]) + 1, ids, since)

    def _ends(self, best: Best, which: np.ndarray, depth: int) -> np.ndarray:
        """For each anchor, the rows within `depth` of the ends of the lists that suit its signs; a row may come several times."""
        high, low = self.order[::-1][:depth].T, self.order[:depth].T
        return np.where((best.q[which] >= 0)[:, :, None], high, low).reshape(len(which), -1)

    def _all(self, best: Best, which: np.ndarray, ids: np.ndarray, since: int) -> None:
        score = products(best.q[which], self.q, self.most)
        fit = score >= best.bound[which, None]
        if since:
            np.put_along_axis(fit, self._ends(best, which, since), False, 1)
        a, r = np.nonzero(fit)
        self._add(best, which[a], r, score[a, r], ids)

    def _reached(self, best: Best, which: np.ndarray, depth: int, ids: np.ndarray, since: int) -> None:
        new = np.zeros((len(which), len(self.q)), bool)
        np.put_along_axis(new, self._ends(best, which, depth), True, 1)
        if since:
            np.put_along_axis(new, self._ends(best, which, since), False, 1)
        a, r = np.nonzero(new)
        edges = np.searchsorted(a, np.arange(len(which) + 1)).tolist()
        score = np.concatenate([products(best.q[[i]], self.q[r[s:e]], self.most)[0] for i, s, e in zip(which.tolist(), edges, edges[1:])]) if len(which) else np.zeros(0, np.int64)
        keep = score >= best.bound[which[a]]
        self._add(best, which[a[keep]], r[keep], score[keep], ids)

    def _add(self, best: Best, anchor: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fit = (self.labels[row] == best.labels[anchor]) == best.same
        anchor, row, score = anchor[fit], row[fit], score[fit]
        own = (self.ids[row] == ids[anchor]) & best.same
        own[own] = (self.q[row[own]] == best.q[anchor[own]]).all(1)
        best.add(anchor, score, self.ids[row], own)


def _tiles(which: np.ndarray, each: int):
    step = max(1, TILE // max(1, each))
    for at in range(0, len(which), step):
        yield which[at : at + step]


def searched(rows: DataFrame, anchors: tuple, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """(a, w, score, id, own, place) of the `k` first rows of each anchor's windows, over all rows. anchors: (ids, labels, q) arrays.

    own: the row equals the anchor. A task hands on at most `k` rows of an anchor's window.
    """
    shared = rows.sparkSession.sparkContext.broadcast((*anchors, low, high))

    def run(batches):
        ids, labels, q, low, high = shared.value
        best = Best(q, labels, low, high, k, same)
        held, size = [], 0

        def search():
            t = pa.Table.from_batches(held).combine_chunks()
            Block(t.column(0).to_numpy(), t.column(1).to_numpy(), matrix(t.column(2).chunk(0), q.shape[1])).search(best, ids)

        for b in batches:
            at = 0
            while at < b.num_rows:
                held.append(b.slice(at, BLOCK - size))
                size += held[-1].num_rows
                at += held[-1].num_rows
                if size == BLOCK:
                    search()
                    held, size = [], 0
        if held:
            search()
        a, w, p = np.nonzero(best.score != NONE)
        for at in range(0, len(a), 1 << 16):
            i = (a[at : at + (1 << 16)], w[at : at + (1 << 16)], p[at : at + (1 << 16)])
            yield batch(a=pa.array(i[0].astype(np.int32)), w=pa.array(i[1].astype(np.int32)), score=pa.array(best.score[i]), id=pa.array(best.id[i]), own=pa.array(best.own[i]))

    found = rows.select("vec_id", "label", "q").mapInArrow(run, "a int, w int, score long, id long, own boolean")
    place = F.row_number().over(W.partitionBy("a", "w").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, embedding).

    Anchors are the rows that `anchor`, a condition on vec_id, picks. Scores are inner products of components floor(256 * x);
    higher ones come first, ties by smaller vec_id. An anchor's positives are its first rows of the same label, itself left out;
    its negatives for one are the first rows of other labels with `share` to 100 per cent of the positive's score.

    Rows without an id, label or vector, or with a component that is null or not finite, take no part. Rows that repeat, in id or as
    a whole, are rows of their own: a copy of an anchor may be its positive, and repeats its result. Shorter vectors end in zeros.
    No anchor, or none with a positive, gives no rows; other columns are not read. Components and scores are held within 64 bits.
    """
    spark, good = rows.sparkSession, usable(rows)
    own = good.where(anchor).groupBy("vec_id", "label", "q").agg(F.count("*").alias("times"))
    number = max(1, -(-own.count() // ANCHORS))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for part in range(number):
        t = own.where(F.pmod(F.xxhash64("vec_id", "q"), F.lit(number)) == part).toArrow().combine_chunks()  # ANCHORS rows, give or take chance
        n = t.num_rows
        if not n:
            continue
        anchors = t["vec_id"].to_numpy(), t["label"].to_numpy(), matrix(t["q"].chunk(0))
        every = np.full((n, 1), NONE), np.full((n, 1), -(NONE + 1))
        found = searched(good, anchors, *every, positives + 1, True).orderBy("a", "place").toArrow()
        a, score, ids, mine = (found[c].to_numpy() for c in ("a", "score", "id", "own"))
        nth = np.cumsum(mine)  # of the rows equal to an anchor, the first is taken for itself
        start = np.searchsorted(a, a)
        itself = mine & (nth - np.where(start > 0, nth[start - 1], 0) == 1)
        a, score, ids = a[~itself], score[~itself], ids[~itself]
        w = np.arange(len(a)) - np.searchsorted(a, a)
        a, score, ids, w = a[w < positives], score[w < positives], ids[w < positives], w[w < positives]
        low, high = np.full((n, positives), -(NONE + 1)), np.full((n, positives), NONE)
        low[a, w], high[a, w] = [-(-share * x // 100) for x in score.tolist()], score
        names = pa.table({
            "a": a.astype(np.int32), "w": w.astype(np.int32), "anchor_id": anchors[0][a], "positive_id": ids, "positive_score": score, "times": t["times"].to_numpy()[a],
        })
        got = searched(good, anchors, low, high, negatives, False).join(F.broadcast(spark.createDataFrame(names)), ["a", "w"])  # as many rows as windows
        got = got.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        out = out.unionByName(got.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out
