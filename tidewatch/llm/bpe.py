"""Byte-level BPE through a minimal acyclic transducer of frequent words; unseen words are merged exactly."""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
from collections import Counter
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

FREQUENT = 200_000  # a word is frequent if at least one of so many is that word: no more than so many can be
LONG = 96  # bytes of a word from which its pairs are kept in a heap
HELD = 400_000  # words that a task remembers before it starts anew
GROUP = 1 << 20  # characters of texts whose unseen words are merged together, or one text if that is longer
SIDE = 4096  # unseen words merged side by side


def byte_letters() -> dict[int, str]:
    """Byte -> the printable letter that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """What a tokenizer file of byte-level BPE holds: ids, merge ranks, the word pattern and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        back = {c: b for b, c in letter.items()}
        raw = lambda s: bytes(back[c] for c in s)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE file")
        self.prefix_space = pre["add_prefix_space"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.merges = [(self.ids[raw(a)], self.ids[raw(b)], self.ids[raw(a) + raw(b)]) for a, b in merges]
        self.ranks = {(a, b): i for i, (a, b, _) in enumerate(self.merges)}
        # the same as arrays: sorted keys of pairs with their ranks, what a pair of each rank becomes, ranks of two bytes
        left, right, self.becomes = np.array(self.merges, np.int64).reshape(-1, 3).T
        order = np.argsort(left << 32 | right)
        self.pair_keys, self.pair_ranks = np.append((left << 32 | right)[order], -1), np.append(order, len(order))
        self.byte_id_array = np.array(self.byte_ids, np.int64)
        self.byte_ranks = self.rank_all(np.repeat(self.byte_id_array, 256), np.tile(self.byte_id_array, 256)).reshape(256, 256)
        self.text_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        # contractions; letters, digits or other signs after an optional space; white space
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        # the same for ASCII texts
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank is merged, leftmost first, until none is left."""
        if len(word) > LONG:
            return self.merge_long(word)
        parts = [self.byte_ids[b] for b in word]
        rank, none = self.ranks.get, len(self.merges)
        ranks = list(map(rank, zip(parts, parts[1:]), repeat(none)))
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i, both = ranks.index(best), self.merges[best][2]
            parts[i] = both
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], both), none)
            if i < len(ranks):
                ranks[i] = rank((both, parts[i + 1]), none)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """As merge(), for words of any length: pairs wait in a heap, parts know what stands before and after them."""
        n, rank, none = len(word), self.ranks.get, len(self.merges)
        parts = [self.byte_ids[b] for b in word]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank(pair, none)) < none]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank((parts[i], parts[j]), none) != r:
                continue  # one of the two has been merged since
            parts[i], parts[j], k = self.merges[r][2], -1, after[j]
            after[i] = k
            if before[i] >= 0 and (x := rank((parts[before[i]], parts[i]), none)) < none:
                heappush(heap, (x, before[i]))
            if k < n:
                before[k] = i
                if (x := rank((parts[i], parts[k]), none)) < none:
                    heappush(heap, (x, i))
        return [p for p in parts if p >= 0]

    def words(self, text: str) -> list[str]:
        return (self.plain if text.isascii() else self.pattern).findall(text)

    def rank_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; the number of merges where there is none."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys[:-1], key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.merges))

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """merge() of many words side by side, as little-endian unsigned 32-bit integers; those of like length go together."""
        rank, none = self.rank_all, len(self.merges)
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = np.array(self.merge_long(w), "<u4").tobytes()
            else:
                short.append(i)
        short.sort(key=lambda i: len(words[i]))
        for at in range(0, len(short), SIDE):
            ids = np.array(short[at : at + SIDE])
            left = np.array([len(words[i]) for i in ids])  # parts of each word
            wide = int(left[-1])
            raw = np.frombuffer(b"".join([words[i].ljust(wide, b"\0") for i in ids]), np.uint8).reshape(-1, wide)
            parts, ranks = self.byte_id_array[raw], self.byte_ranks[raw[:, :-1], raw[:, 1:]]
            ranks[np.arange(1, wide) >= left[:, None]] = none
            while len(ids):
                best = ranks.min(1, initial=none)
                over = best == none
                if over.any():
                    rows, size = parts[over].astype("<u4").tobytes(), parts.shape[1] * 4
                    for k, (i, n) in enumerate(zip(ids[over].tolist(), left[over].tolist())):
                        out[i] = rows[k * size : k * size + n * 4]
                    go = ~over
                    ids, left, parts, ranks, best = ids[go], left[go], parts[go], ranks[go], best[go]
                    if not len(ids):
                        break
                row, i = np.arange(len(ids)), ranks.argmin(1)  # the leftmost of the lowest rank
                new = self.becomes[best]
                keep = np.ones(parts.shape, bool)
                keep[row, i + 1] = False
                parts[row, i] = new
                parts = parts[keep].reshape(len(ids), -1)
                keep = np.ones(ranks.shape, bool)
                keep[row, i] = False
                ranks = ranks[keep].reshape(len(ids), -1)
                left -= 1
                a = np.flatnonzero(i > 0)
                ranks[a, i[a] - 1] = rank(parts[a, i[a] - 1], new[a])
                b = np.flatnonzero(i + 1 < left)
                ranks[b, i[b]] = rank(new[b], parts[b, i[b] + 1])
        return out

    def pieces(self, text: str):
        """(is special, string): the text cut at special tokens."""
        if not self.cut or not any(s in text for s in self.special):
            yield False, text
            return
        for i, s in enumerate(self.cut.split(text)):
            if s:
                yield i % 2 == 1, s


class Transducer:
    """A minimal acyclic automaton over byte words; the number of a word along its path leads to its ids.

    States are written in one array: for each state its first arc; for each arc a byte, a target, and how many words pass
    before it. Words are numbered in sorted order, so that the counts along a path add up to the word's number.
    """

    def __init__(self, data: bytes):
        self.data = data
        view, at, parts = memoryview(data), 40, []
        for n, kind, wide in zip(view[:40].cast("q").tolist(), "iBiii", (4, 1, 4, 4, 4)):
            parts.append(view[at : at + n * wide].cast(kind))
            at += -(-n * wide // 8) * 8
        self.first, self.byte, self.target, self.before, self.out = parts  # of a view, one number is read faster than of an array
        self.out_at = view[at:].cast("i")
        self.labels = self.byte.tobytes()

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> "Transducer":
        """Sorted words are added one at a time; a suffix that is complete is replaced by an equal one made before."""
        known: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, state), ...))

        def close(node: list) -> int:
            shape = (node[0], tuple(node[1]))
            if shape not in known:
                known[shape] = len(states)
                states.append(shape)
            return known[shape]

        path, last = [[False, []]], b""
        for word in sorted(words):
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], close(node)))
            for _ in word[same:]:
                path.append([False, []])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        root = close(path[0])
        below = []
        for final, arcs in states:
            below.append(final + sum(below[t] for _, t in arcs))
        order = [root, *(i for i in range(len(states)) if i != root)]
        place = {s: i for i, s in enumerate(order)}
        first, byte, target, before = [0], bytearray(), [], []
        for s in order:
            final, arcs = states[s]
            passed = int(final)
            for b, t in arcs:
                byte.append(b)
                target.append(place[t] * 2 + states[t][0])
                before.append(passed)
                passed += below[t]
            first.append(len(byte))
        out, out_at = [], [0]
        for word in sorted(words):
            out += words[word]
            out_at.append(len(out))
        parts = [np.array(first, np.int32), np.frombuffer(bytes(byte), np.uint8), np.array(target, np.int32), np.array(before, np.int32), np.array(out, np.int32)]
        pad = lambda x: x + b"\0" * (-len(x) % 8)
        return cls(np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(pad(x.tobytes()) for x in parts) + np.array(out_at, np.int32).tobytes())

    def mapped(self) -> "Transducer":
        """The same, read from a mapped file that has no name and goes with the process."""
        with tempfile.TemporaryFile() as f:
            f.write(self.data)
            f.flush()
            return Transducer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def __reduce__(self):
        return Transducer, (bytes(self.data),)

    def get(self, word: bytes) -> list[int] | None:
        first, find, before, target = self.first, self.labels.find, self.before, self.target
        number, t = 0, 0  # a target is twice a state, and one more if a word ends there
        for b in word:
            state = t >> 1
            arc = find(b, first[state], first[state + 1])
            if arc < 0:
                return None
            number += before[arc]
            t = target[arc]
        if not t & 1:
            return None
        return self.out[self.out_at[number] : self.out_at[number + 1]].tolist()


def frequent_words(texts: DataFrame, vocabulary: Vocabulary, one_of: int) -> list[bytes]:
    """The words that make up a share of 1 / one_of or more of all words of all texts: `one_of` words at most."""

    def run(batches):
        seen: Counter = Counter()

        def partial():
            return batch(w=pa.array(seen.keys(), pa.string()), n=pa.array(seen.values(), pa.int64()))

        for b in batches:
            for x in b.column(0).to_pylist():
                for special, s in vocabulary.pieces(x or ""):
                    if not special:
                        seen.update(vocabulary.words(s))
            if len(seen) > HELD:
                yield partial()
                seen = Counter()
        if seen:
            yield partial()

    counts = texts.mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    often = counts.crossJoin(total).where(F.col("n") * one_of >= F.col("total")) if one_of else counts.limit(0)
    return [r.w.encode() for r in often.select("w").collect()]


def encoder(vocabulary: Vocabulary, lexicon: Transducer):
    """texts -> for each its ids as little-endian unsigned 32-bit integers. What the lexicon lacks is merged, all texts at once."""
    held: dict[str, bytes] = {}
    mapped = lexicon.mapped()

    def learn(words: set[str]) -> None:
        new = words - held.keys()
        if len(held) + len(new) > HELD:
            held.clear()
            new = words
        unseen = []
        for word in new:
            ids = mapped.get(word.encode())
            if ids is None:
                unseen.append(word)
            else:
                held[word] = b"".join([i.to_bytes(4, "little") for i in ids])
        held.update(zip(unseen, vocabulary.merge_all([w.encode() for w in unseen])))

    def encode(texts: list[str]) -> list[bytes]:
        rows: list[list] = []
        words: set[str] = set()
        for text in texts:
            row: list = []
            for special, s in vocabulary.pieces(text):
                if special:
                    row.append(vocabulary.special[s].to_bytes(4, "little"))
                    continue
                if s and vocabulary.prefix_space and not s[0].isspace():
                    s = " " + s
                found = vocabulary.words(s)
                words.update(found)
                row.append(found)
            rows.append(row)
        learn(words)
        get = held.__getitem__
        return [b"".join([x if isinstance(x, bytes) else b"".join(map(get, x)) for x in row]) for row in rows]

    return encode


def groups(texts):
    """The texts, null as empty, in lists of about GROUP characters."""
    group, size = [], 0
    for x in texts:
        group.append(x or "")
        size += len(group[-1])
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def prepare(docs: DataFrame, tokenizer: str, one_of: int = FREQUENT, text_col: str = "text"):
    """(vocabulary, lexicon) for these documents, as one broadcast of a few MB: it holds `one_of` words at most."""
    vocabulary = Vocabulary(tokenizer)
    words = frequent_words(docs.select(F.col(text_col).cast("string").alias("t")), vocabulary, one_of)
    lexicon = Transducer.compile({w: vocabulary.merge(w) for w in words})
    return docs.sparkSession.sparkContext.broadcast((vocabulary, lexicon))


def encode_documents(docs: DataFrame, tokenizer: str, one_of: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row; other columns are left out.

    Null counts as empty: no ids, empty text. Rows that repeat, in id or text, each get a row; no documents, no rows.
    """
    shared = prepare(docs, tokenizer, one_of, text_col)

    def run(batches):
        vocabulary, lexicon = shared.value
        encode, back = encoder(vocabulary, lexicon), vocabulary.text_of
        for b in batches:
            for at in range(0, b.num_rows, 256):
                cut = b.slice(at, 256)
                ids = [np.frombuffer(x, "<u4") for g in groups(cut.column(1).to_pylist()) for x in encode(g)]
                text = [b"".join([back[i] for i in x.tolist()]).decode("utf-8", "replace") for x in ids]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
                yield batch(doc_id=cut.column(0), ids=pa.ListArray.from_arrays(offsets, values), decoded=pa.array(text, pa.string()))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, one_of: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode_documents() with ids and text digested where they are made.

    Nulls, repeated rows and empty tables as there.
    """
    shared = prepare(docs, tokenizer, one_of)

    def run(batches):
        vocabulary, lexicon = shared.value
        encode, back = encoder(vocabulary, lexicon), vocabulary.text_of
        for b in batches:
            n, a, c = [], [], []
            for ids in (x for g in groups(b.column(1).to_pylist()) for x in encode(g)):
                text = b"".join([back[i] for i in np.frombuffer(ids, "<u4").tolist()])
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                c.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
            yield batch(doc_id=b.column(0), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(a, pa.string()), decoded_sha256=pa.array(c, pa.string()))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
