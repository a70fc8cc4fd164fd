"""Language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix

DIMS = 4096
ORDERS = (1, 2, 3, 4)


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts of the lower-cased text in UTF-8, at unit length."""
    total = np.zeros(DIMS)
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(data), 1 << 20):
        part = data[at : at + (1 << 20) + max(ORDERS) - 1].astype(np.uint64)
        for n in ORDERS:
            if len(part) >= n:
                h = np.full(len(part) - n + 1, n, np.uint64)
                for k in range(n):
                    h = h << np.uint64(8) | part[k : k + len(h)]
                total += np.bincount((mix(h) >> np.uint64(52)).astype(np.int64), minlength=DIMS)
    x = np.sqrt(total)
    return x / max(np.linalg.norm(x), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """An n x bits matrix of -1 and 1: all different splits for up to five classes, else random ones far apart."""
    if n <= 1:
        return np.ones((n, 1), int)
    if n <= 5:
        return np.array([[1 if (b >> k) & 1 or k == n - 1 else -1 for b in range(2 ** (n - 1) - 1)] for k in range(n)])
    rng, bits, best = np.random.default_rng(seed), 4 * int(np.ceil(np.log2(n))) + 7, None
    for _ in range(200):
        m = rng.choice([-1, 1], (n, bits))
        gap = min((m[a] != m[b]).sum() for a in range(n) for b in range(a))
        split = (np.abs(m.sum(axis=0)) < n).all()
        if split and (best is None or gap > best[0]):
            best = (gap, m)
    return best[1]


@dataclass
class LanguageModel:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray  # (DIMS + 1) x bits, the bias last


def fit_languages(labelled: DataFrame, per_lang: int = 500) -> LanguageModel:
    """Learn from ``labelled(doc_id, text, lang)``; a language with more rows gives a seeded sample of about ``per_lang``."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], codewords(0), np.zeros((DIMS + 1, 1), np.float32))
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(int(1e6 * min(1.0, per_lang / sizes[name])))) for name in langs])
    picked = rows.where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_000)) < share)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([features(t).astype(np.float16).tobytes() for t in b.column(0).to_pylist()], pa.binary())], ["lang", "x"])

    got = picked.select("text", "lang").mapInArrow(run, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    codes = codewords(len(langs))
    x = np.array([np.frombuffer(bytes(r["x"]), np.float16) for r in got], np.float32).reshape(len(got), DIMS)
    label = np.array([langs.index(r["lang"]) for r in got], int)
    y = (codes[label] > 0).astype(np.float32)
    importance = (1 / np.maximum(np.bincount(label, minlength=len(langs)), 1))[label].astype(np.float32)[:, None] / len(langs)
    w, b = np.zeros((DIMS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    mean, square, step = np.zeros_like(w), np.zeros_like(w), 0
    for step in range(1, 121):  # Adam over the whole sample
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = (p - y) * importance
        grad = x.T @ g + 1e-5 * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w -= 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
        b -= 2.0 * g.sum(axis=0)
    return LanguageModel(langs, codes, np.vstack([w, b]))


def decode(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Logistic loss of each codeword against the bit classifiers' margins, as probabilities of the classes."""
    loss = np.logaddexp(0, -bits[None, :] * codes).sum(axis=1)
    p = np.exp(loss.min() - loss)
    return p / p.sum()


def identify(docs: DataFrame, model: LanguageModel, ambiguous_below: float = 0.6) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for each row of ``docs``, from the whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learnt.  ``ambiguous`` marks a
    best class below ``ambiguous_below``.  Ties go to the first language by code point.  Rows that repeat a doc_id, and rows
    with a null doc_id, are judged as any other; other columns are ignored; an empty table gives an empty result.
    """
    def run(batches):
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1).to_pylist():
                if not text or not model.langs or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                p = decode(features(text) @ model.weights[:-1] + model.weights[-1], model.codes)
                names.append(model.langs[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.withColumn("ambiguous", (F.col("lang_pred") != "und") & (F.col("score") < ambiguous_below))
