"""Toxicity: a lexicon learnt from labels, found through a Levenshtein automaton over its trie, judged in context."""

from __future__ import annotations

import re
from bisect import bisect
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W_]+")
MARK = re.compile("[\"“”«»„\n]")
CLOSERS = {'"': '"', "“": "”", "«": "»", "„": "“”"}
REPORTING = frozenset("said says called calls quoted quote quotes word term wrote writes insult slur dit disait mot terme sagte nannte wort begriff dijo llamó palabra término".split())
WINDOW = 5
STEMS = (4, 5, 6)
CACHE = 400_000


class FuzzyTrie:
    """Words within one edit of a lexicon: the trie and the Levenshtein automaton, run together and made
    deterministic as inputs need it.  A state is a set of (trie node, edits so far)."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.last: list[bool] = [False]
        for word in words:
            at = 0
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.last.append(False)
                at = self.next[at][c]
            self.last[at] = True
        self.moves: dict[frozenset, dict[str, frozenset]] = {}
        self.ends: dict[frozenset, bool] = {}

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, edits in state:
            if c in self.next[node]:
                out.add((self.next[node][c], edits))
            if not edits:
                out.add((node, 1))
                for child in self.next[node].values():
                    out.add((child, 1))
                    if c in self.next[child]:
                        out.add((self.next[child][c], 1))
        return frozenset(out)

    def _accepts(self, state: frozenset) -> bool:
        return any(self.last[n] or (not e and any(self.last[x] for x in self.next[n].values())) for n, e in state)

    def near(self, word: str) -> bool:
        state = frozenset([(0, 0)])
        for c in word:
            row = self.moves.setdefault(state, {})
            if c not in row:
                if len(self.moves) > 50_000:
                    self.moves.clear()
                    row = {}
                row[c] = self._step(state, c)
            state = row[c]
            if not state:
                return False
        if state not in self.ends:
            self.ends[state] = self._accepts(state)
        return self.ends[state]


@dataclass
class ToxicityModel:
    """words and stems with their log-odds; weights of the document features, the bias last."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] | None = None


FEATURES = ("word_hits", "stem_hits", "near_hits", "quoted_hits", "density", "strongest")


def _lookup(model: ToxicityModel):
    trie = FuzzyTrie([w for w in model.words if len(w) >= 5])
    cache: dict[str, tuple[int, float]] = {}

    def find(word: str) -> tuple[int, float]:
        got = cache.get(word)
        if got is None:
            if word in model.words:
                got = (1, model.words[word])
            else:
                stem = max((model.stems[word[:n]] for n in STEMS if word[:n] in model.stems), default=0.0)
                got = (2, stem) if stem else (3, 1.0) if len(word) >= 5 and trie.near(word) else (0, 0.0)
            if len(cache) >= CACHE:
                cache.clear()
            cache[word] = got
        return got

    return find


def quotations(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of what stands in quotation marks, however long; a quotation does not go past its line.

    A straight mark opens only ahead of a word and not behind one, and closes only where no word follows it: one behind
    a number, as for inches, opens nothing.
    """
    opened, closed, start, closers = [], [], -1, ""
    for m in MARK.finditer(text):
        c, ahead, behind = m.group(), text[m.end() : m.end() + 1], text[m.start() - 1 : m.start()] if m.start() else ""
        if c == "\n":
            start = -1
        elif start < 0:
            if c in CLOSERS and (c != '"' or not (ahead.isspace() or behind.isalnum())):
                start, closers = m.start(), CLOSERS[c]
        elif c in closers and (c != '"' or not ahead.isalnum()):
            opened.append(start)
            closed.append(m.end())
            start = -1
    return opened, closed


def _features(text: str | None, find) -> tuple[float, ...]:
    t = (text or "").lower()
    tokens = TOKEN.findall(t)
    hits = {w: f for w in set(tokens) if (f := find(w))[0]}
    if not hits:
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    opened, closed = quotations(t)
    count, strongest, before = [0.0, 0.0, 0.0, 0.0], 0.0, []
    for m in TOKEN.finditer(t):
        w = m.group()
        kind, weight = hits.get(w, (0, 0.0))
        if kind:
            k = bisect(opened, m.start()) - 1
            if REPORTING.intersection(before) or k >= 0 and m.start() < closed[k]:
                count[3] += 1
            else:
                count[kind - 1] += 1
                strongest = max(strongest, weight)
        before = [*before[1 - WINDOW :], w]
    return *(float(np.log1p(c)) for c in count), sum(count[:3]) / len(tokens), strongest


def _feature_task(model: ToxicityModel):
    def run(batches):
        find = _lookup(model)
        for batch in batches:
            rows = [_features(t, find) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            i = batch.schema.get_field_index("text")
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(FEATURES))]
            rest = [batch.column(k) for k in range(batch.num_columns) if k != i]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, *columns], [*names, *FEATURES])

    return run


FEATURE_SCHEMA = ", ".join(f"{f} double" for f in FEATURES)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> list[float]:
    scale = np.maximum(x.std(axis=0), 1e-3)
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps // 20):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = np.diag([*[0.5] * x.shape[1], 1e-6])
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
    return [*(w[:-1] / scale), w[-1]]


def fit_toxicity(labelled: DataFrame, max_docs: int = 20_000) -> ToxicityModel:
    """Learn from ``labelled(doc_id, text, toxic)``; of more than ``max_docs`` rows a seeded sample of that size is used.

    Terms are words of four letters or more, whole or as stems (their first 4 to 6 letters); shorter ones are never terms.  A term enters the lexicon when it marks toxic
    documents fifty times as often as others and either stands in one toxic document of a hundred or, taken greedily,
    in three that no chosen term covers.  Document features are then weighted by logistic regression.
    """
    rows = labelled.where("toxic is not null and doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    total = rows.count()
    if total > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * max_docs / total))
    counts = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in counts}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    model = ToxicityModel()
    if n1:
        word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w")
        stems = [F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in STEMS]
        terms = rows.select("doc_id", "toxic", word).select("doc_id", "toxic", F.explode(F.array_compact(F.array(F.col("w"), *stems))).alias("term")).where("length(term) >= 4")
        per_doc = terms.groupBy("term", "doc_id").agg(F.max("toxic").alias("toxic"))
        stats = per_doc.groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"), F.collect_list(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("docs"))
        odd = stats.where(F.col("bad") >= 3).where((F.col("good") + 0.0) * n1 * 50 <= F.col("bad") * F.lit(float(max(n0, 1))))
        _choose(model, [(r["term"], r["bad"], r["good"], r["docs"]) for r in odd.collect()], n1, n0)
    got = rows.select("doc_id", "text", "toxic").mapInArrow(_feature_task(model), f"doc_id long, toxic int, {FEATURE_SCHEMA}").drop("doc_id").toPandas() if total else None
    if got is None or not len(got):
        model.weights = [0.0] * len(FEATURES) + [-3.0]
    else:
        model.weights = _logistic(got[list(FEATURES)].to_numpy(), got["toxic"].to_numpy())
    return model


def _choose(model: ToxicityModel, found: list[tuple], n1: int, n0: int) -> None:
    left: set[int] = set()
    for term, _, _, docs in found:
        left.update(docs)
    order = sorted(found, key=lambda r: (-r[1], r[0].endswith("*"), -len(r[0]), r[0]))
    for term, bad, good, docs in order:
        gain = len(left.intersection(docs))
        if bad >= max(5, 0.01 * n1) or gain >= 3:
            odds = float(np.log((bad + 0.5) / (n1 + 1)) - np.log((good + 0.5) / (n0 + 1)))
            (model.stems if term.endswith("*") else model.words)[term.rstrip("*")] = odds
            left.difference_update(docs)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` and the counts of hits, a row for each row of ``docs``; whole texts, null as empty.

    Only the text is read.  A hit is a lexicon word, a word with a lexicon stem, or a word within one edit of a
    lexicon word of five letters or more; hits in quotation marks, or within five words after a reporting word, count
    as quoted and apart.  Texts without a hit get the model's base rate.  The reporting words are a fixed list.

    Rows with a null doc_id and rows that repeat one are scored as any other; equal texts get equal scores; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = rows.mapInArrow(_feature_task(model), f"doc_id long, {FEATURE_SCHEMA}")
    logit = F.lit(float(model.weights[-1]))
    for name, w in zip(FEATURES, model.weights):
        logit = logit + F.col(name) * float(w)
    return scored.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"), *FEATURES)


def without_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.7) -> DataFrame:
    """``docs``, whole rows with all their columns, without those scored ``limit`` or more."""
    rows = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["_doc"].dataType.simpleString()
    logit = F.lit(float(model.weights[-1]))
    for name, w in zip(FEATURES, model.weights):
        logit = logit + F.col(name) * float(w)
    found = rows.mapInArrow(_feature_task(model), f"_doc {kind}, {FEATURE_SCHEMA}")
    return found.where(1 / (1 + F.exp(-logit)) < limit).select("_doc.*")
