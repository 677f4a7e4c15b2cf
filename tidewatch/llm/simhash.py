"""SimHash near-duplicates, searched by the generalised pigeonhole principle.

64 bits are dealt to m partitions so that bits which move together share one. Two fingerprints within tau bits have, for
any thresholds t_1..t_m that sum to tau - m + 1, a partition i in which they differ in t_i bits or fewer. The thresholds
(-1: never probe that partition) and m are chosen by dynamic programming over the candidates and probes that the bit
statistics of all fingerprints lead to expect. The search is exact: it finds every link within tau. What it finds may be
verified by the texts themselves; then only texts of similar size meet, as others cannot be similar.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batch, blobs, discard, settle, stored
from .components import components

PROBE_COST = 400.0  # of one shuffled and sorted probe row, in comparisons of two fingerprints (some 6 ns each)
HOT = 4096  # members of one bucket in one task; larger buckets are split
HELD = 1 << 22  # shingles of a bucket's members in one task; larger buckets are split as well
ASKS = 64  # times HOT: what asks one bucket in one task; more is split
FEW = 1 << 20  # verified links that are joined into components in one task
SMALL = 200_000  # rows of three numbers that are broadcast at most, after they have been counted
BOTH, MEMBER, ASK = 0, 1, 2  # what a row of a bucket is; members come before what only asks
ROW = {"bucket": np.int64, "salt": np.int32, "probe": np.int8, "node": np.int64, "fp": np.int64, "size": np.int64}
KIND = "bucket long, salt int, probe byte, node long, fp long, size long"


def fingerprint(data: bytes, words: int, sets: bool = False) -> tuple[int, int, int, int, bytes]:
    """(signed 64-bit fingerprint, shingles, digest, size and sorted hashes of the set of shingles) of one UTF-8 text.

    The last three are 0, 0 and empty if not asked for, as is everything of a text without words.
    """
    tokens = data.translate(LOWER).split()
    if not tokens:
        return 0, 0, 0, 0, b""
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    digest, counts, seen = xxhash.xxh64_digest, np.zeros(64, np.int64), []
    for at in range(0, n, 65536):
        cut = slice(at, min(n, at + 65536))
        h = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[cut].tolist(), last[cut].tolist())])
        counts += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        if sets:
            seen.append(np.frombuffer(h, np.int64))
    fp = int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)
    if not sets:
        return fp, n, 0, 0, b""
    kinds = np.unique(np.concatenate(seen))
    own = kinds.tobytes()
    return fp, n, int.from_bytes(xxhash.xxh64_digest(own), "big", signed=True), len(kinds), own


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """(doc_id, h, fp, n_shingles, node, size): null texts count as empty, and get fingerprint 0. h is a hash of the text.

    node is what is linked: the digest of the set of shingles, of that size, or the fingerprint if sets are not asked for.
    """

    def run(batches):
        for b in batches:
            got = [fingerprint(x, words, sets)[:4] for x in blobs(b.column(2))]
            fp, n, node, size = (pa.array(x, pa.int64()) for x in (zip(*got) if got else ((), (), (), ())))
            yield batch(doc_id=b.column(0), h=b.column(1), fp=fp, n_shingles=n, node=node if sets else fp, size=size)

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, h long, fp long, n_shingles long, node long, size long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, t): an id and a hash of the text tell rows apart that share an id."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).cast("binary").alias("t"))


def bits_of(fp: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1; bit 0 is the lowest."""
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def classes(size: np.ndarray, width: float) -> np.ndarray:
    """Classes of sizes: those within a factor of exp(width) lie in one class or in two neighbours. No width: one class."""
    return np.floor(np.log(np.maximum(size, 1)) / width).astype(np.int64) + 1 if width else np.ones(len(size), np.int64)


def statistics(nodes: DataFrame, width: float) -> tuple[int, np.ndarray, float]:
    """How many nodes there are, in how many each two bits are both set, and the share of pairs whose classes can meet."""

    def run(batches):
        total, n, sizes = np.zeros((64, 64)), 0, np.zeros(1024)
        for b in batches:
            x = bits_of(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            for at in range(0, len(x), 4096):
                total += x[at : at + 4096].T @ x[at : at + 4096]
            sizes += np.bincount(classes(b.column(1).to_numpy(zero_copy_only=False), width), minlength=1024)
            n += len(x)
        if n:
            yield batch(k=pa.array(range(4096 + 1024), pa.int32()), v=pa.array([*total.ravel().tolist(), *sizes.tolist()], pa.float64()))

    rows = nodes.select("fp", "size").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # 5120 rows at most
    flat = np.zeros(4096 + 1024)
    for r in rows:
        flat[r.k] = r.v
    sizes = flat[4096:]
    n = int(sizes.sum())
    return n, flat[:4096].reshape(64, 64), float((sizes * (sizes / 2 + np.append(0, sizes[:-1]))).sum() / max(1.0, n * n / 2))


def plan(n: int, both: np.ndarray, tau: int, share: float = 1.0, asks: int = 1) -> list[tuple[list[int], int]]:
    """[(bits, threshold)]: the cheapest partitioning and thresholds for n fingerprints with these bit counts.

    share: of all pairs, those that can meet; asks: in how many classes each node asks.
    """
    n = max(n, 1)
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tied = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0)
    differ = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    best: tuple[float, list] = (math.inf, [])
    for m in range(2, max(2, min(8, tau + 1)) + 1):
        parts, free = [], set(range(64))
        for i in range(m):  # each partition grows around the most correlated bit left
            size = len(free) // (m - i)
            seed = max(free, key=lambda b: tied[b, list(free)].sum())
            own = [seed]
            free.discard(seed)
            while len(own) < size:
                nxt = max(free, key=lambda b: tied[b, own].sum())
                own.append(nxt)
                free.discard(nxt)
            parts.append(own)
        cost = []
        for own in parts:
            exactly = np.zeros(tau + 2)
            exactly[0] = 1
            for b in own:  # how likely two fingerprints differ in k of these bits
                exactly[1:] = exactly[1:] * (1 - differ[b]) + exactly[:-1] * differ[b]
                exactly[0] *= 1 - differ[b]
            within = np.cumsum(exactly)
            probes = np.cumsum([math.comb(len(own), k) for k in range(tau + 1)])
            cost.append([0.0] + [share * n * n / 2 * within[t] + PROBE_COST * n * (1 + asks * probes[t]) for t in range(tau + 1)])
        want = max(0, tau - m + 1)
        reach = {0: (0.0, [])}  # sum of (threshold + 1) so far -> cheapest
        for own, c in zip(parts, cost):
            nxt: dict[int, tuple[float, list]] = {}
            for s, (spent, chosen) in reach.items():
                for t in range(-1, tau + 1):
                    k, v = s + t + 1, spent + c[t + 1]
                    if k <= want + m and (k not in nxt or v < nxt[k][0]):
                        nxt[k] = (v, [*chosen, (own, t)])
            reach = nxt
        found = reach.get(want + m)
        if found and found[0] < best[0]:
            best = found
    return [(own, t) for own, t in best[1] if t >= 0]


def _width(least: float) -> float:
    """Of classes in which sets of this similarity lie together or side by side. Classes wider than need be lose nothing, and sizes up to 2**60 have under 1024 of them."""
    if least and not 0 < least <= 1:
        raise ValueError("a similarity lies above 0 and up to 1")
    return max(0.05, 1e-9 - math.log(least)) if least else 0.0


def dealt(nodes: DataFrame, tau: int, least: float) -> tuple[DataFrame, list[tuple[int, int]]] | None:
    """Distinct (node, fp, size) -> rows (bucket, salt, probe, node, fp, size), those of a bucket in one task and in a row, and
    the (mask, threshold) of each partition. No pairs: None.

    A bucket is a partition, its bits, and a class of sizes. Nodes are members of their own class and ask that and the next
    smaller one (least 0: all sizes are one class).
    """
    width = _width(least)
    n, both, share = statistics(nodes, width)
    if n < 2:
        return None
    chosen = plan(n, both, tau, share, 2 if width else 1)
    flips = []
    for own, t in chosen:
        v = [0]
        for k in range(1, t + 1):
            v += [sum(1 << i for i in c) for c in combinations(range(len(own)), k)]
        flips.append(np.array(v, np.int64))

    def rows_of(fp: np.ndarray, size: np.ndarray):
        """(buckets, what the rows are, of which node)."""
        x, kind, every = bits_of(fp).astype(np.int64), classes(size, width) << 48, np.arange(len(fp))
        for i, (own, _) in enumerate(chosen):
            key = (x[:, own] @ (np.int64(1) << np.arange(len(own), dtype=np.int64))) | np.int64(i << 58)
            k = len(flips[i])
            near, r = (key[:, None] ^ flips[i][None, :]).ravel(), np.repeat(every, k)
            yield key | kind, BOTH if k == 1 else MEMBER, every
            if k > 1:
                yield near | kind[r], ASK, r
            if width:
                yield near | (kind[r] - (1 << 48)), ASK, r

    def pieces(batches):
        for b in batches:
            cols = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            for at in range(0, b.num_rows, 4096):
                yield [x[at : at + 4096] for x in cols]

    def deal(batches):
        for node, fp, size in pieces(batches):
            for bucket, probe, r in rows_of(fp, size):
                yield batch(bucket=pa.array(bucket), probe=pa.array(np.full(len(r), probe, np.int8)), node=pa.array(node[r]), fp=pa.array(fp[r]), size=pa.array(size[r]))

    def count(batches):
        for _, fp, size in pieces(batches):
            for bucket, probe, r in rows_of(fp, size):
                b, at, k = np.unique(bucket, return_inverse=True, return_counts=True)
                none = np.zeros(len(b), np.int64)
                weight = np.bincount(at, size[r], len(b)).astype(np.int64)
                yield batch(bucket=pa.array(b), members=pa.array(none if probe == ASK else k), asks=pa.array(none if probe == MEMBER else k), shingles=pa.array(none if probe == ASK else weight))

    nodes = nodes.select("node", "fp", "size")
    rows = nodes.mapInArrow(deal, "bucket long, probe byte, node long, fp long, size long")
    sizes = nodes.mapInArrow(count, "bucket long, members long, asks long, shingles long").groupBy("bucket").agg(F.sum("members").alias("m"), F.sum("asks").alias("a"), F.sum("shingles").alias("s"))
    across = F.greatest(F.ceil(F.col("m") / HOT), F.least("m", F.ceil(F.col("s") / HELD))).cast("int")
    sizes = settle(sizes.where((F.col("m") > HOT) | (F.col("s") > HELD) | (F.col("m") > 0) & (F.col("a") > ASKS * HOT)).select("bucket", across.alias("across"), F.ceil(F.col("a") / (ASKS * HOT)).cast("int").alias("down")))
    if sizes.isEmpty():
        rows = rows.withColumn("salt", F.lit(0))
    else:  # a large bucket becomes a grid: members take a column of it, what asks takes a row
        rows = rows.join(sizes, "bucket", "left")
        hot = rows.where("across is not null")
        column, line = (F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), c)).cast("int") for c in ("across", "down"))
        upto = lambda c: F.sequence(F.lit(0), F.greatest(F.lit(1), c) - 1)
        cell = lambda x, y: x * F.greatest(F.lit(1), F.col("down")) + y
        names = ["bucket", "probe", "node", "fp", "size", "salt"]
        members = hot.where(F.col("probe") != ASK).withColumn("probe", F.lit(MEMBER).cast("byte")).select("*", F.explode(F.transform(upto(F.col("down")), lambda y: cell(column, y))).alias("salt"))
        asking = hot.where(F.col("probe") != MEMBER).withColumn("probe", F.lit(ASK).cast("byte")).select("*", F.explode(F.transform(upto(F.col("across")), lambda x: cell(x, line))).alias("salt"))
        rows = rows.where("across is null").withColumn("salt", F.lit(0)).select(names).unionByName(members.select(names)).unionByName(asking.select(names))
    return gathered(rows), [(sum(1 << b for b in own), t) for own, t in chosen]


def gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "probe")


class Bucket:
    """The members of one bucket and the pairs of what asks it, as both come in batches: members first.

    A pair that meets in several partitions counts in the first of them only.
    """

    def __init__(self, chosen: list[tuple[int, int]], tau: int, least: float):
        self.chosen, self.tau, self.least = chosen, tau, least
        self.members: dict[str, np.ndarray] = {}

    def add(self, c: dict[str, np.ndarray]) -> None:
        own = c["probe"] != ASK
        before = len(self.members["node"]) if self.members else 0
        if own.any():
            self.members = {k: np.concatenate([self.members[k], v[own]]) if before else v[own] for k, v in c.items()}
        if not self.members:
            return
        for kind in (BOTH, ASK):
            at = np.flatnonzero(c["probe"] == kind)
            step = max(1, min(4096, (1 << 20) // len(self.members["node"])))
            for s in range(0, len(at), step):
                asks = {k: v[at[s : s + step]] for k, v in c.items()}
                self.meet(asks, *self.near(asks, before + s if kind == BOTH else None))

    def near(self, asks: dict, first: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (ask, member). first: the asks are members from that place on, and meet those before themselves."""
        m = self.members
        i, j = np.nonzero(np.bitwise_count(asks["fp"].view(np.uint64)[:, None] ^ m["fp"].view(np.uint64)[None, :]) <= self.tau)
        x, y = asks["size"][i], m["size"][j]
        fit = np.minimum(x, y) >= self.least * np.maximum(x, y)
        if first is not None:
            fit &= j < first + i
        else:  # of two nodes that ask each other one does
            mutual = (asks["bucket_class"][i] == m["bucket_class"][j]) if "bucket_class" in m else np.ones(len(i), bool)
            fit &= ~mutual | (asks["node"][i] < m["node"][j])
        i, j = i[fit], j[fit]
        if len(i):
            differ, before = asks["fp"].view(np.uint64)[i] ^ m["fp"].view(np.uint64)[j], np.zeros(len(i), bool)
            for mask, t in self.chosen[: int(m["bucket"][0]) >> 58]:
                before |= np.bitwise_count(differ & np.uint64(mask)) <= t
            i, j = i[~before], j[~before]
        return i, j


def by_bucket(batches, width: float):
    """(a new bucket begins, columns): slices of batches in bucket order."""
    last = None
    for b in batches:
        cols = {k: x.to_numpy(zero_copy_only=False) for k, x in zip(b.schema.names, b.columns)}
        n = b.num_rows
        if not n:
            continue
        if width:
            cols["bucket_class"] = classes(cols["size"], width)
        new = (np.diff(cols["bucket"]) != 0) | (np.diff(cols["salt"]) != 0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for s, e in zip(cuts[:-1], cuts[1:]):
            here = (cols["bucket"][s], cols["salt"][s])
            yield here != last, {k: x[s:e] for k, x in cols.items()}
            last = here


class Forest(Bucket):
    """Keeps only the pairs that join two trees."""

    def __init__(self, chosen: list, tau: int):
        super().__init__(chosen, tau, 0.0)
        self.root, self.edges = np.zeros(0, np.int64), []

    def meet(self, asks: dict, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        node = self.members["node"]
        self.root = np.concatenate([self.root, np.arange(len(self.root), len(node))])
        order = np.argsort(node, kind="stable")
        place = order[np.minimum(np.searchsorted(node, asks["node"], sorter=order), len(node) - 1)]
        # what asks may be a member itself; the trees of the members last
        trees = np.concatenate([self.root, np.where(node[place] == asks["node"], self.root[place], len(node) + np.arange(len(asks["node"])))])
        taken = _joining(trees, i + len(node), j)
        self.root = trees[: len(node)]
        self.edges.append((asks["node"][i[taken]], node[j[taken]]))

    def done(self):
        if self.edges:
            a, b = (np.concatenate(x) for x in zip(*self.edges))
            yield batch(a=pa.array(a), b=pa.array(b))


def _joining(trees: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Which of the pairs, taken in order, join two trees; trees, the number of each node's tree, is brought up to date."""
    taken, left = [], np.arange(len(i))
    while len(left):
        for k in left[:512].tolist():
            p, r = trees[i[k]], trees[j[k]]
            if p != r:
                trees[trees == max(p, r)] = min(p, r)
                taken.append(k)
        left = left[512:]
        left = left[trees[i[left]] != trees[j[left]]]
    return taken


def links(nodes: DataFrame, tau: int) -> DataFrame:
    """Distinct (node, fp, size) -> edges (a, b) of nodes within tau bits: of each bucket a spanning forest."""
    found = dealt(nodes, tau, 0.0)
    if found is None:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    rows, chosen = found
    return rows.mapInArrow(_each(lambda: Forest(chosen, tau), 0.0), "a long, b long").distinct()


class Partners(Bucket):
    """Keeps the rows of a bucket that have a partner in it, and no pairs."""

    def __init__(self, chosen: list, tau: int, least: float):
        super().__init__(chosen, tau, least)
        self.has, self.asking = np.zeros(0, bool), []

    def meet(self, asks: dict, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        node = self.members["node"]
        self.has = np.concatenate([self.has, np.zeros(len(node) - len(self.has), bool)])
        self.has[j] = True
        if asks["probe"][0] == ASK:
            some = np.unique(i)
            self.asking.append({k: v[some] for k, v in asks.items()})
        else:
            self.has |= np.isin(node, asks["node"][i])

    def done(self):
        for rows in [{k: v[: len(self.has)][self.has] for k, v in self.members.items()}, *self.asking] if self.has.any() else ():
            yield batch(**{k: pa.array(rows[k].astype(t)) for k, t in ROW.items()})


class Verified(Bucket):
    """Counts the similarity of pairs whose ends are in different trees; those that pass join the trees."""

    def __init__(self, chosen: list, tau: int, least: float):
        super().__init__(chosen, tau, least)
        self.root, self.edges = np.zeros(0, np.int64), []

    def meet(self, asks: dict, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        node, held = self.members["node"], self.members["shingles"]
        self.root = np.concatenate([self.root, np.arange(len(self.root), len(node))])
        order = np.argsort(node, kind="stable")
        place = order[np.minimum(np.searchsorted(node, asks["node"], sorter=order), len(node) - 1)]
        for k, first, last in zip(*(x.tolist() for x in _runs(i))):
            me = place[k] if node[place[k]] == asks["node"][k] else None
            tree = -1 if me is None else self.root[me]
            own = np.frombuffer(asks["shingles"][k], np.int64)
            left = j[first:last]
            left = left[self.root[left] != tree]
            while len(left):
                now, left = left[:32], left[32:]
                for p in now[_alike(own, [np.frombuffer(held[p], np.int64) for p in now.tolist()], self.least)].tolist():
                    other = self.root[p]
                    if other != tree:
                        self.edges.append((int(asks["node"][k]), int(node[p])))
                        if tree >= 0:
                            self.root[self.root == max(tree, other)] = min(tree, other)
                        tree = other if tree < 0 else min(tree, other)
                left = left[self.root[left] != tree]

    def done(self):
        if self.edges:
            a, b = zip(*self.edges)
            yield batch(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))


def _runs(i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first, end) of each run of equal values in a sorted array that is not empty."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1])
    return i[first], first, np.append(first[1:], len(i))


def _alike(own: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the sets, sorted arrays like own, have a Jaccard similarity of `least` or more with it."""
    size = np.array([len(x) for x in others])
    every = np.concatenate(others)
    both = np.add.reduceat(own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every, np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64)
    return both >= least * (len(own) + size - both)


def verified(nodes: DataFrame, tau: int, least: float, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Distinct (node, fp, size) -> edges (a, b) of nodes within tau bits whose sets have a Jaccard similarity of `least` or more.

    sets gives (node, shingles), sorted 64-bit hashes as bytes, for a table of nodes. First only rows that have a partner
    are kept; then their sets are sent to their buckets and pairs are counted there, before any is left out. Of what passes a
    bucket returns a spanning forest; pairs are never rows. Pairs whose sizes differ by more than `least` never meet.
    """
    found = dealt(nodes, tau, least)
    if found is None:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    rows, chosen = found
    rows = stored(rows.mapInArrow(_each(lambda: Partners(chosen, tau, least), least), KIND))
    held = sets(rows.select("node").distinct())
    both = gathered(rows.join(held, "node").select(*ROW, "shingles"))
    edges = stored(both.mapInArrow(_each(lambda: Verified(chosen, tau, least), least), "a long, b long").distinct())
    discard(rows)
    return edges


def _each(make: Callable, least: float):
    """A function of Arrow batches: every bucket goes through an object of its own, made by make()."""
    width = _width(least)

    def run(batches):
        state = None
        for new, cols in by_bucket(batches, width):
            if new:
                if state:
                    yield from state.done()
                state = make()
            state.add(cols)
        if state:
            yield from state.done()

    return run


def shingles(data: bytes, words: int) -> set[bytes]:
    tokens = data.translate(LOWER).split()
    return {b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))} if tokens else set()


def shingle_sets(asked: DataFrame, keyed: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the nodes in asked (node, doc_id, h), which names a row of keyed (doc_id, h, t) for each.

    Only texts that are asked for are moved: up to SMALL of them, once counted, are told to where the texts are.
    """

    def hashed(batches):
        for b in batches:
            yield batch(node=b.column(0), shingles=pa.array([fingerprint(x, words, True)[4] for x in blobs(b.column(1))], pa.binary()))

    asked = settle(asked)
    if asked.limit(SMALL + 1).count() <= SMALL:
        asked = F.broadcast(asked)
    texts = asked.alias("q").join(keyed.alias("k"), (F.col("q.h") == F.col("k.h")) & F.col("q.doc_id").eqNullSafe(F.col("k.doc_id"))).select("node", "t")
    return stored(texts.mapInArrow(hashed, "node long, shingles binary").dropDuplicates(["node"]))


def _grouped(docs: DataFrame, words: int, tau: int, least: float | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all rows, (node, winner)): the winner of a component is its row of smallest id, null ids last."""
    own = settle(fingerprints(docs, words, id_col, text_col, least is not None))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h")).alias("first")
    nodes = settle(own.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), first))
    if least is None:
        parts = components(links(nodes, tau), FEW)
    else:  # a text without words is like none but those of its own node
        keyed = _keyed(docs, id_col, text_col)
        sets = lambda asked: shingle_sets(asked.join(nodes.select("node", "first.doc_id", "first.h"), "node"), keyed, words)
        parts = components(verified(nodes.where("size > 0"), tau, least, sets), FEW)
    named = nodes.join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    smallest = named.groupBy("root").agg(F.min("first").alias("winner"))
    return own, named.join(smallest, "root").select("node", "winner")


def near_duplicates(docs: DataFrame, words: int = 5, tau: int = 15, least: float | None = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, n_shingles, component_id): documents linked, over any number of steps, by fingerprints within tau bits.

    component_id is the smallest doc_id of the component. least: a link also needs that exact Jaccard similarity of the
    shingle sets, which is counted before any link is left out (None: fingerprints alone decide). Texts of one set of
    shingles (64-bit digests tell sets apart) are always linked. Two fingerprints of similarity 0.8 differ in 10 of 64 bits
    on average; 15 bits find 97 in 100 of such pairs, and nearly all from 0.85 on. Null texts are empty; texts without words
    have fingerprint 0 and share a component. Rows with null doc_id stay, and count for links, but never name a component
    unless all its ids are null. An empty table gives no rows. Rows with equal doc_id are kept apart; extra columns are
    not read.
    """
    own, label = _grouped(docs, words, tau, least, id_col, text_col)
    return own.join(label, "node").select("doc_id", "fp", "n_shingles", F.col("winner.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, words: int = 5, tau: int = 15, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near_duplicates(): that of smallest id, ids that are null last; all columns stay.

    Decisions are on rows: of rows that share an id only those go whose own text has a near duplicate. Of rows with one id
    and one text any one stays. An empty table stays empty.
    """
    own, label = _grouped(docs, words, tau, least, id_col, text_col)
    rows = own.join(label, "node").groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.min("winner").alias("winner"))
    wins = F.col("doc_id").eqNullSafe(F.col("winner.doc_id")) & (F.col("h") == F.col("winner.h"))
    rows = settle(rows.select(F.col("doc_id").alias("_row_id"), F.col("h").alias("_row_hash"), "n", wins.alias("wins")).where("n > 1 or not wins"))
    mine = F.col(id_col).cast("long").eqNullSafe(F.col("_row_id")) & (F.xxhash64(F.col(text_col)) == F.col("_row_hash"))
    kept = docs.join(rows.select("_row_id", "_row_hash"), mine, "left_anti")
    again = rows.where("wins").select("_row_id", "_row_hash")
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(again, mine).dropDuplicates(["_row_id", "_row_hash"]).select(docs.columns))
