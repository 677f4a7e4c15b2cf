"""Plain versions of the operators' contracts, over lists of (id, text)."""

import hashlib
import re
from collections import Counter

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {i: i + 32 for i in range(65, 91)}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def simhash(text, k):
    w = SPACED.findall((text or "").translate(UP))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs, k=3, tau=3, fps=None):
    fp = fps or {i: simhash(t, k) for i, t in docs}
    ids, top = sorted(fp), {i: i for i in fp}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fp[a] ^ fp[b]).bit_count() <= tau:
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def repeats(docs, length=400):
    seen = Counter()
    raw = {i: (t or "").encode() for i, t in docs}
    for x in raw.values():
        for p in range(len(x) - length + 1):
            seen[x[p : p + length]] += 1
    out = {}
    for i, x in raw.items():
        flag = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                flag[p : p + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(flag)))
        out[i] = (len(x), sum(flag), spans, sha(bytes(c for c, f in zip(x, flag) if not f)))
    return out


def rules(text):
    text = text or ""
    w = SPACED.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i, t in enumerate(zip(w, w[1:], w[2:])):
        if seen[t] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def contamination(docs, items):
    grams = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(UP))
        for at in range(max(1, len(w) - 9)) if w else ():
            grams.setdefault(tuple(w[at : at + 10]), set()).add(str(i))
    sizes = {len(g) for g in grams}
    out = {}
    for i, t in docs:
        w, hit, found = WORD.findall((t or "").translate(UP)), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (g := tuple(w[at : at + n])) in grams:
                    hit |= set(range(at, at + n))
                    found |= grams[g]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def phrases(text):
    w = WORD.findall((text or "").translate(UP))
    known = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    at = [(i, l) for p, l in known.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({l for _, l in at}))


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, p, n in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[0]) >= n]
    kinds = [sum(k == i for _, k, _ in out) for i in range(3)]
    return *kinds, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out)))
