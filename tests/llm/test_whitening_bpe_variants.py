"""Operators 11 to 13 against numpy, one call of the tokenizer, and all pairs of words."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codequarry.llm.bpe import edge_of, encode_documents, encoded, joined, tree_joined
from codequarry.llm.variants import spelling_variants
from codequarry.llm.whitening import components, contours, feast, inertia, tridiagonal, whiten

BPE = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, i int, n string, component string"


def spectrum(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [[9, 7, 5, 3, 2, 1], [4, 4, 4, 4, 1, 0], [1e6, 1e3, 1, 1e-3], [5], [0, 0, 0], [8, 8 - 1e-9, 8 - 2e-9, 1, 0.5], list(range(1, 41)), [2.0] * 12])
def test_feast_against_eigh(spark, values):
    v = spectrum(values)
    v = (v + v.T) / 2
    want = np.sort(np.linalg.eigvalsh(v))[::-1]
    want = want[want > len(v) * np.finfo(float).eps * np.abs(v).sum(axis=1).max()][:7]
    cuts, k = contours(v, 7)
    assert k == len(want) and sum(c[2] for c in cuts) >= k
    e, u = components(spark, v, 7)
    assert np.allclose(e, want, rtol=1e-9, atol=1e-12 * max(values)) and np.allclose(u.T @ u, np.eye(k), atol=1e-12)
    assert np.abs(v @ u - u * e).max(initial=0) <= 1e-11 * max(1, max(values))


def test_inertia_and_a_contour():
    v = spectrum([7, 5, 3, 2, -1, -4])
    at = np.array([-5, -2, 0, 2.5, 6, 8])
    assert inertia(*tridiagonal(v), at).tolist() == [6, 5, 4, 3, 1, 0]
    e, u = feast(v, 2.5, 6.0, 2)
    assert np.allclose(sorted(e), [3, 5]) and np.allclose(v @ u, u * e)
    with pytest.raises(ArithmeticError):
        feast(v, 2.5, 6.0, 3)


def test_whiten_against_numpy(spark):
    rng = np.random.default_rng(3)
    c = (rng.standard_normal((400, 12)) @ np.diag(np.linspace(3, 0.2, 12)) + 2).astype(np.float32)
    rows = [(i, [float(x) for x in v], 1, "n", "c") for i, v in enumerate(c)]
    odd = [(1000, None, 1, "n", "c"), (1001, [None] + [1.0] * 11, 1, "n", "c"), (1002, [float("nan")] * 12, 1, "n", "c"), (1003, [float("inf")] * 12, 1, "n", "c"), (1004, [], 1, "n", "c"), (1005, [1.0, 2.0], 1, "n", "c")]
    extra = [(None, rows[0][1], 1, "n", "c"), (5, rows[5][1], 2, "n", "c")]
    got = whiten(spark.createDataFrame(rows + odd + extra, VECTORS).repartition(3), wanted=5).toPandas()
    x = np.floor(64 * np.vstack([c, c[0], c[5]]).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    e, u = np.linalg.eigh((x - s / n).T @ (x - s / n) / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 402 * 5 and set(got.n) == {402} and got.vec_id.isna().sum() == 5
    for i in (0, 7, 399):
        mine = got[got.vec_id == i].drop_duplicates("component").sort_values("component")
        assert (mine.deviation == int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s)))).all()
        want = (x[i] - s / n) @ u[:, :5] / np.sqrt(e[:5])
        assert np.allclose(np.abs(mine.whitened), np.abs(want), rtol=1e-8, atol=1e-9) and np.allclose(mine.explained, e[:5] / e.sum(), rtol=1e-10)
    white = got.whitened.to_numpy().reshape(-1, 5)  # a vector's components follow each other
    assert np.abs(white.T @ white / n - np.eye(5)).max() <= got.identity_error.iloc[0] + 1e-9 and got.identity_error.max() < 1e-9
    assert len(got[got.vec_id == 5]) == 10


def test_whiten_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whiten(frame([])).count() == 0 and whiten(frame([(1, [0.5, 0.5], 1, "", "")])).count() == 0
    assert whiten(frame([(k, [1.0, 2.0], 1, "", "") for k in range(5)])).count() == 0
    flat = whiten(frame([(k, [float(k), 2.0, float(-k)], 1, "", "") for k in range(5)])).toPandas()
    assert set(flat.component) == {1} and np.isclose(flat.explained.max(), 1.0)
    big = whiten(frame([(k, [1e7 * k, 1.0], 1, "", "") for k in (0, 1)])).toPandas()
    assert set(big.deviation) == {(64 * 10**7) ** 2}
    with pytest.raises(Exception, match="does not fit"):
        whiten(frame([(k, [1e9 * k, 1.0], 1, "", "") for k in (0, 1)])).count()
    with pytest.raises(Exception, match="too large"):
        whiten(frame([(1, [1e30], 1, "", "")])).count()


PARTS = ["the ", "'s", "'ll", "'", "''", "don't", "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "é", "é", "́", "̣", "日本語", "각", "각", "İ", "ß", " ", "\n\t", " ", "12", "3", "!!", "…", "😀", "👩‍👩‍👧", "internationalization", "aaaa", "ab", "zq", "QUEUE", "a" * 40, "\u0001", "﻿", "न", "ि"]


def test_joins_against_one_call():
    tokenizer = Tokenizer.from_file(BPE)
    edge, encode = edge_of(tokenizer), lambda t: encoded(tokenizer, t)
    rng = random.Random(12)
    for turn in range(1500):
        some = rng.sample(PARTS, rng.randint(1, 8))
        text = "".join(rng.choice(some) for _ in range(rng.randint(1, 120)))
        piece, window = rng.choice([7, 20, 60, 150]), rng.choice([1, 4, 16])
        parts = [encode(text[k : k + piece]) for k in range(0, len(text), piece)]
        got, want = tree_joined(parts, encode, window, edge), encode(text)
        assert got.ids.tolist() == want.ids.tolist() and got.starts.tolist() == want.starts.tolist(), (turn, text)


def test_a_join_encodes_a_window_alone():
    tokenizer, seen = Tokenizer.from_file(BPE), []
    encode = lambda t: (seen.append(len(t)), encoded(tokenizer, t))[1]
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij") for _ in range(20_000))  # one word, nowhere to split
    left, right = encoded(tokenizer, text[:9_000]), encoded(tokenizer, text[9_000:])
    assert joined(left, right, encode).ids.tolist() == encoded(tokenizer, text).ids.tolist() and sum(seen) < 1_000


def test_bpe_documents(spark):
    tokenizer, rng = Tokenizer.from_file(BPE), random.Random(7)
    texts = {1: "Hello World's don't", 2: None, 3: "", 4: " \n ", 5: "".join(rng.choice(PARTS) for _ in range(600)), 6: "x" * 3_000, 7: "word " * 2_000, 8: " " * 1_000, 9: "".join(chr(rng.choice([rng.randint(33, 0x2FFF), 97, 98])) for _ in range(2_000)), 10: "<|endoftext|>" * 200}
    rows = [(k, t, "clash", 1) for k, t in texts.items()] + [(7, texts[7], "clash", 1), (None, "null id", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, piece int")
    got = encode_documents(docs, BPE, piece=100, window=4).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 7 for r in got) == 2
    for r in got:
        ids = tokenizer.encode((texts.get(r["doc_id"]) if r["doc_id"] else "null id") or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), r["doc_id"]
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_documents(docs.limit(0), BPE).count() == 0


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, slips, ratio=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % slips == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    around = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) if vs else None for w, vs in around.items()}
    form = {w: b if b and n[b] >= ratio * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("slips", [3, 199])
def test_variants_against_all_pairs(spark, slips):
    rng = random.Random(slips)
    bases = ["aaaaaa", "aabbcc", "abcabc", "straße", "ÉTÉàéîô", "bookkeeper", "mississippi"]
    rows = []
    for i in range(60):
        out = []
        for _ in range(120):
            w = rng.choice(bases[: rng.choice([2, 4, 7])])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k, c = rng.randrange(len(w) + 1), rng.choice("abcé")
                w = rng.choice([w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :]])
            out.append(rng.choice([w, w.upper() if w.isascii() else w]))
        rows.append((i, rng.choice([" ", "-", "1 "]).join(out)))
    rows += [(3, rows[3][1]), (70, None), (71, ""), (72, "… 12 日本")]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = {r["word"]: tuple(r)[1:] for r in spelling_variants(docs, slips).collect()}
    want = brute_variants(rows, slips)
    assert got == want and sum(v[0] is not None for v in want.values()) > 10 and (slips < 199 or any(want[v[0]][0] for v in want.values() if v[0]))
    assert spelling_variants(docs.limit(0)).count() == 0
    one = spelling_variants(docs.limit(0).unionByName(spark.createDataFrame([(None, "Lonely lonely LONELY lonely lonely", "", 1)], docs.schema)), 10**9).collect()
    assert [tuple(r) for r in one] == [("lonely", None, "lonely", 5, 0, None)]
