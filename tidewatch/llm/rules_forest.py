"""Quality rules: statistics of each text, a few fixed limits, and an isolation forest over the statistics."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, batch, blobs, discard, stored

TREES = 200
SHARE = 1 / 16  # nodes that hold no more than this share of the rows are not split: a cluster of odd rows is told apart as a whole
DEEP = 12  # levels of splits: single rows far out may each use one up
LOST = 0.003  # share of labelled good rows above the threshold, at most, among those that grew no tree
STEPS = 100_000  # the threshold is one of so many steps of oddness

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = b"#*$%&|<>"
_FOLLOW = bytes(range(0x80, 0xC0))  # bytes that continue a character


def statistics(data: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-word windows)."""
    words = data.split()
    chars = len(data.translate(None, SPACE + _FOLLOW))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(windows) < len(words) - 2:
        end = 0
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if windows[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def rule_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row.

    Null texts have no words. Rows that repeat, in id or text, each get a row; other columns are not read; no documents, no rows.
    """

    def run(batches):
        for b in batches:
            rows = np.array([statistics(x) for x in blobs(b.column(1))], np.int64).reshape(-1, 5)
            yield batch(doc_id=b.column(0), n_words=pa.array(rows[:, 0]), word_chars=pa.array(rows[:, 1]), n_symbols=pa.array(rows[:, 2]), n_dup_lines=pa.array(rows[:, 3]), n_repeat_words=pa.array(rows[:, 4]))

    kind = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).mapInArrow(run, kind)


def features(b: pa.RecordBatch, at: int) -> np.ndarray:
    """The four rule statistics a word, so that long texts are not odd for being long."""
    n, *rest = (b.column(at + i).to_numpy(zero_copy_only=False).astype(float) for i in range(5))
    return np.stack(rest, axis=1) / np.maximum(n, 1)[:, None]


def rates(stats: DataFrame) -> DataFrame:
    """The columns of features() for forests that grow on Spark."""
    return stats.select(*[(F.col(x).cast("double") / F.greatest("n_words", F.lit(1))).alias(x) for x in STATISTICS[1:]])


class Forest:
    """Isolation trees: random splits; the fewer a row needs to be alone, the odder it is.

    A split is a random direction and a random place between the least and the largest of all its node's rows along it, so that
    a statistic counts by how far it spreads: those that hardly vary do not use up splits. Trees grow by levels over every row:
    from each level go one count, minimum and maximum a node, whatever the number of rows; nodes of SHARE or fewer are left, so
    a level has less than TREES / SHARE that grow on. `rows` is an array of four columns, or a table of four (see rates()).
    """

    def __init__(self, rows: np.ndarray | DataFrame, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees: list[list[tuple]] = [[(None, 0.0)] for _ in range(TREES)]
        self.typical, self.n_rows = self.expected(1 / SHARE), 0
        ways = {(t, 0): rng.standard_normal(4) for t in range(TREES)}
        for depth in range(DEEP + 1):
            seen = self.measured(rows, ways) if isinstance(rows, DataFrame) else self.reached(rows, ways)
            if depth == 0:
                self.n_rows = seen.get((0, 0), (0,))[0]
            further = {}
            for t, at in sorted(seen):
                n, low, high = seen[t, at]
                nodes = self.trees[t]
                part = n / self.n_rows
                nodes[at] = (None, depth + self.expected(part / SHARE))
                if depth < DEEP and part > SHARE and low < high:
                    nodes[at] = (ways[t, at], rng.uniform(low, high), len(nodes), len(nodes) + 1)
                    for child in nodes[at][2:]:
                        nodes.append((None, 0.0))
                        further[t, child] = rng.standard_normal(4)
            if not further:
                break
            ways = further

    @staticmethod
    def expected(n: float) -> float:
        """Splits that tell n rows apart, on average; of shares, n are those expected among 1 / SHARE rows."""
        return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @staticmethod
    def along(x: np.ndarray, way: np.ndarray) -> np.ndarray:
        return x[:, 0] * way[0] + x[:, 1] * way[1] + x[:, 2] * way[2] + x[:, 3] * way[3]  # the same, however rows are batched

    def leaves(self, x: np.ndarray, t: int):
        """(node, the rows of x that end there)."""
        nodes, todo = self.trees[t], [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if nodes[at][0] is None:
                yield at, rows
            elif len(rows):
                low = self.along(x[rows], nodes[at][0]) < nodes[at][1]
                todo += [(nodes[at][2], rows[low]), (nodes[at][3], rows[~low])]

    def reached(self, x: np.ndarray, ways: dict) -> dict:
        """(tree, node) of `ways` to (rows that reach it, least and largest place along its way)."""
        out = {}
        for t in sorted({t for t, _ in ways}):
            for at, rows in self.leaves(x, t):
                if (t, at) in ways and len(rows):
                    place = self.along(x[rows], ways[t, at])
                    out[t, at] = (len(rows), float(place.min()), float(place.max()))
        return out

    def measured(self, rows: DataFrame, ways: dict) -> dict:
        """reached() over a table."""
        shared = rows.sparkSession.sparkContext.broadcast((self, ways))

        def run(batches):
            forest, ways = shared.value
            for b in batches:
                if b.num_rows:
                    got = forest.reached(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1), ways)
                    yield batch(t=pa.array([t for t, _ in got], pa.int32()), at=pa.array([i for _, i in got], pa.int32()), n=pa.array([v[0] for v in got.values()], pa.int64()), low=pa.array([v[1] for v in got.values()], pa.float64()), high=pa.array([v[2] for v in got.values()], pa.float64()))

        out = rows.mapInArrow(run, "t int, at int, n long, low double, high double").groupBy("t", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
        shared.destroy()
        return {(r.t, r.at): (r.n, r.low, r.high) for r in out}

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; odd rows come near 1."""
        total = np.zeros(len(x))
        for t in range(TREES):
            for at, rows in self.leaves(x, t):
                total[rows] += self.trees[t][at][1]
        return 2.0 ** (-total / TREES / self.typical)


def steps(odd: np.ndarray) -> np.ndarray:
    return np.ceil(odd * STEPS).astype(np.int64)


def threshold(forest: Forest, good: DataFrame) -> int:
    """The least step of oddness that all but LOST of the rows stay at or below; all are scored and counted by step."""
    shared = good.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            if b.num_rows:
                step, n = np.unique(steps(shared.value.score(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))), return_counts=True)
                yield batch(step=pa.array(step), n=pa.array(n.astype(np.int64)))

    counts = good.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    allowed = LOST * sum(r.n for r in counts)
    above = 0
    for r in sorted(counts, reverse=True):
        if above + r.n > allowed:
            return r.step
        above += r.n
    return STEPS


def fitted(stats: DataFrame, labels: DataFrame) -> tuple[Forest, int]:
    """(forest, threshold) of all rows of rule_statistics() that have a label and pass the base (all rows, if none has a label).

    Rows whose id's hash is even grow the forest, good ones of the others set the threshold; where one side has none, all are on
    both. Of repeated labels the lower quality counts, and of labelled texts of one id one.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"))
    known = stats.join(marked, stats.doc_id == marked["_id"]).drop("_id")
    known = known.groupBy("doc_id").agg(F.min(F.struct(*STATISTICS, "quality")).alias("one")).select("doc_id", "one.*")
    sound = "n_words >= 50 and 100 * n_repeat_words <= 50 * n_words"
    known = stored(known.select("*", F.expr(sound).alias("sound"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("grows")))
    n = known.agg(F.count("*"), F.count_if(F.expr("sound and grows")), F.count_if(F.expr("sound and not grows"))).first()
    some = known.where("sound")
    grown, rest = (rates(some.where("grows")), some.where("not grows")) if n[1] and n[2] else (rates(some), some)
    good = rates(rest.where("quality = 1"))
    if not n[0]:
        grown = good = rates(stats)
    forest = Forest(grown)
    most = threshold(forest, good)
    discard(known)
    return forest, most


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, oddness, kept) of every document.

    Forest and threshold are those of fitted(), from all labelled rows that pass the base. Null and empty texts have no words
    and fail the base. Without documents there are no rows. Ids that repeat each keep their row.
    """
    stats = stored(rule_statistics(docs))
    shared = docs.sparkSession.sparkContext.broadcast(fitted(stats, labels))

    def run(batches):
        f, most = shared.value
        for b in batches:
            odd = f.score(features(b, 1)) if b.num_rows else np.zeros(0)
            n, rep = b.column(1).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            failed = (n < 50) | (100 * rep > 50 * n)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(failed), pa.array(odd), pa.array(~failed & (steps(odd) <= most))], names=[*b.schema.names[:6], "base_failed", "oddness", "kept"])

    return stats.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, oddness double, kept boolean")
