"""Hard negatives, alignment and packing against plain versions, on the smallest tables and on odd rows."""

import random
import zlib
from collections import Counter

import brute as B
import numpy as np
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_contracts import odd_docs
from tokenizers import Tokenizer

from tidewatch.llm import alignment, encoders, hard_negatives, packing, queries
from tidewatch.llm.queries import tokenizer

MODEL = "piece_bpe_32k.model"
SCHEMA = "vec_id long, embedding array<float>, label int, q string, a long"


def plain_negatives(rows, is_anchor, positives=5, negatives=5, share=80):
    good = [(i, l, [int(np.floor(256 * float(x))) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, l, v) in enumerate(good):
        if is_anchor(i):
            every = sorted((-sum(x * y for x, y in zip(v, w)), j, m == l) for k, (j, m, w) in enumerate(good) if k != n)
            for s, p, _ in [e for e in every if e[2]][:positives]:
                fit = [(t, j) for t, j, same in every if not same and share * -s <= 100 * -t <= 100 * -s][:negatives]
                out += [(i, p, k, j, -s, -t) for k, (t, j) in enumerate(fit, 1)]
    return sorted(out)


def vectors(rng, n, wide, spread, step):
    return [(i, [round(rng.gauss(0, 1) * spread[d] / step) * step for d in range(wide)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("block, anchors, dense", [(8192, 1 << 14, 0.25), (64, 9, 2.0)])
def test_hard_negatives(spark, monkeypatch, block, anchors, dense):
    """Ties, copies, odd rows; lists read to the end, in part and not at all; anchors in one part and in many."""
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("DENSE", dense)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(block)
    one = vectors(rng, 400, 6, [1, 0.2, 0.1, 0.1, 0.05, 0], 0.25)  # many ties
    two = vectors(rng, 300, 3, [1, 0.01, 0.01], 0.001)  # one dimension decides, so that thresholds fall early
    odd = [(None, [1.0] * 6, 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan")] * 6, 0), (4, [float("inf")], 2), (5, [1.0], None), (6, [], 1), (40, [], 2), (60, [0.5], 0), (0, [1e30, -1e30], 1), (20, [2.0] * 9, 0)]
    for rows in (two, one + odd + one[:50] + [one[0]] * 3, odd, [(20 * i, [], i % 2) for i in range(9)], []):
        df = spark.createDataFrame([(i, v, l, "x", 1) for i, v, l in rows], SCHEMA).repartition(3)
        got = sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0).collect()))
        want = plain_negatives(rows, lambda i: i % 20 == 0)
        if any(abs(x or 0) > 1e9 for _, v, _ in rows for x in v or ()):  # beyond 64 bits scores are held, so only the others compare
            small = lambda r: [x for x in r if max(map(abs, x[4:])) < 1 << 50]
            got, want = small(got), small(want)
        assert got == want


def test_blocks_stop_where_the_threshold_falls(monkeypatch):
    """Against all scores, block by block; where one dimension decides few rows are scored, and later blocks fewer."""
    rng = np.random.default_rng(2)
    scored = []
    real = hard_negatives.products
    monkeypatch.setattr(hard_negatives, "products", lambda a, b, most: scored.append(len(a) * len(b)) or real(a, b, most))
    q = np.rint(rng.normal(0, 1, (16000, 8)) * [4000, *[5] * 7])
    labels, ids = rng.integers(0, 4, 16000), rng.permutation(16000)
    who = np.arange(0, 16000, 400)
    every = np.full((len(who), 1), hard_negatives.NONE), np.full((len(who), 1), -(hard_negatives.NONE + 1))
    best = hard_negatives.Best(q[who], labels[who], *every, 6, True)
    share = []
    for at in range(0, 16000, 4000):
        scored.clear()
        hard_negatives.Block(ids[at : at + 4000], labels[at : at + 4000], q[at : at + 4000]).search(best, ids[who])
        share.append(sum(scored) / (4000 * len(who)))
    for n, w in enumerate(who):
        s = (q @ q[w]).astype(np.int64)
        want = sorted((-s[k], ids[k]) for k in range(16000) if labels[k] == labels[w])[:6]
        assert list(zip(-best.score[n, 0], best.id[n, 0])) == want
    assert max(share) < 0.4 and share[-1] < share[0]


def test_hard_negatives_in_sql(spark, data):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    rows = db.execute(queries.ORACLE_SQL["op11_hard_negatives"])
    out = queries.op11_hard_negatives(spark, data)
    assert [c[0] for c in rows.description] == out.columns and sorted(rows.fetchall()) == sorted(map(tuple, out.collect()))


def plain_alignment(docs):
    a, b = Tokenizer.from_file(tokenizer()), sentencepiece.SentencePieceProcessor(model_file=tokenizer(MODEL))
    a.encode_special_tokens = True
    letters = {chr(v): k for k, v in zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*range(33, 127), *range(161, 173), *range(174, 256)])}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if chr(x) not in letters)}
    bytes_b = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    rows, count = [], Counter()
    for i, t in docs:
        ids_a, ids_b, groups, links = [], [], [], []
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            x, y = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a], [bytes_b(b.id_to_piece(k)) for k in ids_b]
            if b"".join(x) == b"".join(y) == (" " + t).encode():
                end_a, end_b = np.cumsum([len(k) for k in x]).tolist(), np.cumsum([len(k) for k in y]).tolist()
                p = r = 0
                for cut in sorted(set(end_a) & set(end_b)):
                    m, n = end_a.index(cut, p) + 1, end_b.index(cut, r) + 1
                    groups.append(",".join(map(str, ids_a[p:m])) + "|" + ",".join(map(str, ids_b[r:n])))
                    links.append((ids_a[m - 1], ids_b[n - 1]))
                    p, r = m, n
            else:
                ids_a, ids_b = [], []
        count.update(links)
        rows.append((i, len(ids_a), len(ids_b), len(groups), links, B.sha(";".join(groups)) if groups else ""))
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return sorted((i is None, i or 0, n, m, g, len(l), sum(count[k] == most[k[1]] for k in l), sum(count[k] for k in l), s) for i, n, m, g, l, s in rows)


@pytest.mark.parametrize("limit", [1 << 21, 300])
def test_alignment(spark, data, monkeypatch, limit):
    """Pairs in one part and in many; copies, odd texts, null and repeated ids."""
    monkeypatch.setattr(alignment, "PAIRS", limit)
    docs = [(int(r.doc_id), r.text) for r in pd.read_parquet(f"{data}/documents.parquet").itertuples()]
    odd = odd_docs() + [(1, "▁a b"), (None, "a b"), (1, "a b"), (2, " two  spaces "), (3, "<0x41> <s> </s><unk>"), *[(k, "a b") for k in range(60)], (9, "x" * 300_000), (9, " " * 200_000)]
    for rows in (docs, odd) if limit > 1000 else (odd,):
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, copies long").repartition(3)
        out = alignment.align(df, tokenizer(), tokenizer(MODEL))
        assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in out.collect()) == plain_alignment(rows)
    assert alignment.align(df.limit(0), tokenizer(), tokenizer(MODEL)).count() == 0
    assert alignment.align(df.select(F.col("doc_id").cast("int"), F.lit(None).cast("string").alias("text")), tokenizer(), tokenizer(MODEL)).agg(F.sum("n_a")).first()[0] == 0


def test_fast_encoding_equals_the_library():
    rng = random.Random(4)
    letters = [*map(chr, range(128)), " ", "'s", "'LL", "<|endoftext|>", "é", "\x85", "　", "漢", "🙂", "́", "ſ", "‍", "१", "²"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 80))) for _ in range(5000)] + [" " * 10**6, "\n " * 10**5, "a" * 10**6, ""]
    for special in (True, False):
        t = Tokenizer.from_file(tokenizer())
        t.encode_special_tokens = not special
        ours = encoders.byte_level(encoders.content(tokenizer()), special)
        assert [ours.encode(x).tolist() for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, docs, window):
    """Every id in one piece, pieces gapless, sequences full or powers of two."""
    t = Tokenizer.from_file(tokenizer())
    want = Counter()
    for (i, x), e in zip(docs, t.encode_batch([x or "" for _, x in docs], add_special_tokens=False)):
        want[i, tuple([*e.ids, 1])] += 1
    per_doc, per_sequence = {}, {}
    for r in rows:
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        per_doc.setdefault(r.doc_id, []).append(r)
    for pieces in per_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    assert per_doc.keys() == {i for i, _ in want}
    for i, pieces in per_doc.items():
        texts = [x for (j, x), n in want.items() if j == i for _ in range(n)]
        if len(texts) == 1:
            pieces.sort(key=lambda r: r.start)
            assert [x for r in pieces for x in r.ids] == list(texts[0]) and {r.doc_tokens for r in pieces} == {len(texts[0])}
            assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
        else:  # rows that share an id
            assert sorted(x for r in pieces for x in r.ids) == sorted(x for t in texts for x in t)
    return len(per_sequence), sum(r.length for r in rows)


@pytest.mark.parametrize("window, chunk", [(2048, 1 << 22), (96, 3000)])
def test_packing(spark, data, monkeypatch, window, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    docs = [(int(r.doc_id), r.text) for r in pd.read_parquet(f"{data}/documents.parquet").itertuples()]
    odd = odd_docs() + [(None, "a b"), (1, "a b"), (1, "a b"), (9, "ab " * 100_000)]
    for rows in (docs, odd):
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, n long").repartition(2)
        sequences, tokens = check_packing(packing.pack(df, tokenizer(), window).collect(), rows, window)
        assert sequences >= tokens / window
        if chunk == 1 << 22:  # two tasks, each with a few short sequences at its end
            assert sequences <= tokens / window + 2 * 11
    assert packing.pack(df.limit(0), tokenizer(), window).count() == 0
    assert {r.length for r in packing.pack(df.where("doc_id = 0").select(F.col("doc_id").cast("int"), "text"), tokenizer(), window).collect()} == {1}


@pytest.mark.parametrize("seed", range(6))
def test_lengths_fill_windows(seed):
    """Lengths of several kinds, few and many documents: all of each in order, no sequence padded, and few documents cut."""
    rng = np.random.default_rng(seed)
    n = [rng.lognormal(6.3, 0.9, 5000), rng.integers(1, 40, 3000), rng.integers(1900, 2049, 2000), np.full(777, 1500), rng.integers(1, 9000, 3), np.repeat([2048, 4096, 1], 5)][seed]
    n = np.maximum(1, n.astype(np.int64))
    mix = packing.mixture(Counter((n % 2048).tolist()), 2048)
    doc, start, length, seq, offset = packing.pack_lengths(n, mix, 2048)
    assert (length > 0).all() and (np.bincount(doc, length, len(n)) == n).all()
    for key, at in ((doc, start), (seq, offset)):
        order = np.lexsort((at, key))
        k, a, l = key[order], at[order], length[order]
        new = np.append(True, k[1:] != k[:-1])
        assert (a[new] == 0).all() and (a[1:][~new[1:]] == (a + l)[:-1][~new[1:]]).all()
    size = np.bincount(seq, length).astype(int)
    assert all(s == 2048 or s & (s - 1) == 0 for s in size) and (size < 2048).sum() <= 11
    if seed == 0:
        cut = np.bincount(doc)[n < 2048] > 1
        assert cut.mean() < 0.5  # cut blindly at every window, more than half of them would be


def test_least_squares():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, x = rng.random((12, 30)), np.maximum(rng.normal(0, 1, 30), 0)
        b = a @ x
        got = packing.nnls(a, b)
        assert (got >= 0).all() and np.linalg.norm(a @ got - b) < 1e-6
        b = rng.normal(0, 1, 12)
        got = packing.nnls(a, b)
        gain = a.T @ (b - a @ got)
        assert (gain <= 1e-6).all() and np.abs(gain[got > 0]).max(initial=0) < 1e-6  # the conditions of the optimum
    assert sorted(packing.combinations(5, 3)) == [(1, 1, 3), (1, 2, 2), (1, 4), (2, 3), (5,)]
    assert packing.mixture({}, 2048) == [] == packing.mixture({0: 9}, 2048)
