"""Secret scans: fixed forms, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, stored

# fixed forms; kinds in the order in which equal starts are listed
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")  # the same runs as HEX, of 24 characters or more
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")  # shorter strings are too few characters for a ratio to tell
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{12,64}+(?![A-Za-z0-9+/_=-])"  # candidates that are letters only
WEIGHT = 20_000  # what the words of the documents weigh together, at most: more count for less each, so that made-up strings keep their share
FALSE = 0.0001  # share of held-out ordinary strings that may score the margin or more
STEP = 100  # margins are hundredths
ODDS = 10.0  # least margin: natural logarithm of how many ordinary strings there are for one random one
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

# words of several languages that the ordinary strings of the training sample are put together from
PARTS = [x.split() for x in (
    "get set user name file path data value index count total first last item list map key node tree load save read write open close start stop config option default update delete insert select table column date"
    " test case build class method return result error message handler request response server client session connection buffer stream address international administration information development responsibility"
    " people water house world school street family country mother father friend music summer spring river mountain forest animal flower bread butter sugar coffee dinner kitchen table chair letter paper pencil picture"
    " village castle bridge harbour engine travel ticket doctor lawyer farmer soldier worker teacher student nothing something everything between without through against because before behind whether",
    "Anfang Arbeit Ausland Bericht Bildung Donau Dampf Schiff Fahrt Gesellschaft Entwicklung Erfahrung Forschung Geschichte Gemeinde Gesundheit Haushalt Jahrhundert Krankheit Landwirtschaft Leistung Regierung"
    " Rechnung Schreiben Sicherheit Verfahren Verantwortung Verwaltung Versicherung Wirtschaft Wissenschaft Zusammenhang Zeitung zwischen",
    "administration beaucoup changement connaissance construction developpement enseignement entreprise environnement evenement gouvernement heureusement internationale longtemps maintenant mouvement naturellement"
    " particulier population quelquefois recherche renseignement responsable souvent toujours travailler utilisation vraiment",
    "actividad administracion aprendizaje ayuntamiento ciudadano comunicacion conocimiento crecimiento desarrollo educacion empresa entonces establecimiento experiencia funcionamiento gobierno habitantes importante"
    " investigacion naturaleza necesidad poblacion pensamiento presidente produccion relaciones siguiente trabajador universidad",
)]


def labelled_samples(n: int = 1500) -> list[tuple[str, int]]:
    """(string, 1 if random): both made by a rule, so that they are the same everywhere. Random strings have 12 to 43 characters.

    Random ones are digests written in four alphabets; ordinary ones are words of one language joined as identifiers, compounds,
    paths, dates and versions, and plain numbers.
    """
    out = []
    for i in range(n):
        h = hashlib.sha512(f"sample {i}".encode()).digest()
        size, number = 12 + i % 32, h[5]
        out += [(x[:size], 1) for x in (h.hex(), base64.b64encode(h).decode(), base64.b32encode(h).decode(), base64.urlsafe_b64encode(h).decode())]
        for words in PARTS:
            a = [words[b % len(words)] for b in h[:4]]
            out += [(x, 0) for x in (
                "_".join(a), a[0].lower() + "".join(x.title() for x in a[1:]), "".join(x.title() for x in a[:3]), "-".join(a[:3]) + f"-{number}", "/" + "/".join(a) + f"/{1990 + number % 40}", "_".join(a).upper(), "".join(a).lower(), "".join(a[:2]).capitalize(), "-".join(a),
                f"{a[0]}-{1990 + number % 40}-{1 + number % 12:02}-{1 + number % 28:02}", f"{a[0].title()}{a[1].title()}V{number}", str(int.from_bytes(h[:12], "big"))[: 12 + i % 9], "-".join(map(str, h[:5])),
            ) if len(x) >= 12]
    return out


def ordinary_words(docs: DataFrame) -> DataFrame:
    """(w, held): every word of 12 to 64 letters that two rows or more hold; held ones, one in three by a hash, are for the margin."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("w")).groupBy("w").count().where("count > 1")
    return words.select("w", (F.pmod(F.xxhash64("w"), F.lit(3)) == 2).alias("held"))


class Markov:
    """First-order character models of the two kinds; score() is the log-likelihood ratio of a string.

    They are trained from two in three samples, and from all words that are not held, if there is a table of them; margin is set
    by the rest: as few of the ordinary strings as FALSE score more, and it is ODDS at least. recall is the share of the
    held-out random strings that score more. Words are counted on Spark by pairs of characters, and by hundredths of score.
    """

    def __init__(self, samples: list[tuple[str, int]], words: DataFrame | None = None):
        n = len(ALPHABET)
        place = np.full(256, n, np.int64)
        for i, c in enumerate(ALPHABET):
            place[ord(c)] = i
        self.place = place
        counts = np.full((2, n + 1, n + 1), 0.5)
        for k, (text, kind) in enumerate(samples):
            if k % 3 == 2:
                continue
            x = place[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
            np.add.at(counts[kind], (x[:-1], x[1:]), 1.0)
        weight = 1.0
        if words is not None:
            weight = min(1.0, WEIGHT / max(words.count(), 1))
            for r in self.pairs(words.where("not held")).collect():
                counts[0].flat[r.pair] += weight * r.n
        p = counts / counts.sum(2, keepdims=True)
        self.ratio = np.log(p[1]) - np.log(p[0])
        held = [[self.score(text) for text, kind in samples[2::3] if kind == k] for k in (0, 1)]
        mass = [(self.step(x), 1.0) for x in held[0]]
        if words is not None:
            mass += [(r.step, weight * r.n) for r in self.steps(words.where("held")).collect()]
        self.margin = max(ODDS, least_step(mass, FALSE) / STEP) if mass else ODDS
        self.recall = float(np.mean(np.array(held[1]) > self.margin)) if held[1] else 0.0

    def pairs(self, words: DataFrame) -> DataFrame:
        """(pair, n): how often two characters follow each other in the words; a pair is its place in the flat table of counts."""
        place, n = self.place, len(ALPHABET) + 1

        def run(batches):
            for b in batches:
                x = place[np.frombuffer(" ".join(b.column(0).to_pylist()).encode(), np.uint8)]  # the space is in no word
                within = (x[:-1] < n - 1) & (x[1:] < n - 1)
                pair, times = np.unique((x[:-1] * n + x[1:])[within], return_counts=True)
                yield batch(pair=pa.array(pair, pa.int64()), n=pa.array(times, pa.int64()))

        return words.select("w").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))

    def steps(self, words: DataFrame) -> DataFrame:
        """(step, n): how many of the words score so many hundredths, rounded up."""

        def run(batches):
            for b in batches:
                step, times = np.unique([self.step(self.score(w)) for w in b.column(0).to_pylist()], return_counts=True)
                yield batch(step=pa.array(step, pa.int64()), n=pa.array(times, pa.int64()))

        return words.select("w").mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))

    @staticmethod
    def step(score: float) -> int:
        return int(np.ceil(score * STEP))

    def score(self, text: str) -> float:
        x = self.place[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        return float(self.ratio[x[:-1], x[1:]].sum())


def least_step(mass: list[tuple[int, float]], share: float) -> int:
    """The least of the steps that no more than this share of the mass lies above."""
    above, allowed = 0.0, share * sum(m for _, m in mass)
    for step, m in sorted(mass, reverse=True):
        above += m
        if above > allowed:
            break
    return step


def fitted(docs: DataFrame, samples: list[tuple[str, int]] | None = None) -> Markov:
    """The models of these samples (None: labelled_samples() and all of the documents' own ordinary words)."""
    if samples is not None:
        return Markov(samples)
    words = stored(ordinary_words(docs))
    model = Markov(labelled_samples(), words)
    discard(words)
    return model


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, each kind leftmost and without overlaps."""
    out = []
    low = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(out)


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def all_spans(text: str, model: Markov) -> tuple[list, list]:
    """(fixed spans, all spans): strings that look random are added where no fixed span lies."""
    base = base_spans(text)
    more, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(base) and base[at][0] < e:  # both go by start
            reach = max(reach, base[at][2])
            at += 1
        if reach > s:
            continue
        if model.score(m[0]) > model.margin:
            more.append((s, 3, e))
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document; places are code points, ends exclusive.

    Null and empty texts have no spans. Rows that repeat, in id or text, each get a row; other columns are not read; no
    documents, no rows. Kind random is what the models add, of 12 characters or more and where no fixed form lies.
    """
    model = fitted(docs, samples)

    def run(batches):
        for b in batches:
            got = [all_spans(x or "", model) for x in b.column(1).to_pylist()]
            n = [[sum(k == i for _, k, _ in base) for base, _ in got] for i in range(3)]
            yield batch(
                doc_id=b.column(0), n_assign=pa.array(n[0], pa.int64()), n_access=pa.array(n[1], pa.int64()), n_hex=pa.array(n[2], pa.int64()),
                base_sha256=pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got], pa.string()), spans=pa.array([written(every) for _, every in got], pa.string()),
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, model: Markov) -> str:
    out, at = [], 0
    for s, k, e in all_spans(text, model)[1]:
        if e > at:
            out += [text[at : max(s, at)], f"[{KINDS[k]}]" if s >= at else ""]
            at = e
    return "".join(out) + text[at:] if out else text


def mask_secrets(docs: DataFrame, samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """docs with every secret replaced by its kind in brackets, and n_chars counted again; no row goes.

    Null texts stay null; all other columns stay as they are; of spans that overlap the first is replaced, and the rest of the
    others goes with it.
    """
    model = fitted(docs, samples)
    names = docs.columns

    def run(batches):
        for b in batches:
            text = [None if x is None else masked(x, model) for x in b.column(names.index("text")).to_pylist()]
            cols = list(b.columns)
            cols[names.index("text")] = pa.array(text, pa.string())
            if "n_chars" in names:
                at = names.index("n_chars")
                cols[at] = pa.array([n if t is None else len(t) for t, n in zip(text, cols[at].to_pylist())], pa.int64()).cast(cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
