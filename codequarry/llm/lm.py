"""Language-model scores: a log-bilinear model trained in numpy by noise-contrastive estimation.

The softmax has two levels: a word's class, then the word among those of its class.  Both are normalised by batched
matrix products, and both are trained by noise-contrastive estimation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mix, word_hashes
from .workspace import written

END = np.uint64(0x5851F42D4C957F2D)
FREQUENT = 1 << 18  # words whose counts every task holds; the rest are counted by a join
ITEMS, BUCKETS = 61_440, 4096  # words with an output of their own at most; rows that the other words share as contexts
SINGLE, LARGEST, EQUAL = 64, 640, 96  # words that are a class alone; words of a class at most; share of a class
DIM, CONTEXT, CLASS_NOISE, WORD_NOISE = 16, 4, 32, 3
BLOCK = 512  # tokens of one matrix product; its scores stay in the processor's cache
PREDICTED = 4096  # tokens whose contexts are added at a time; they stay in the processor's cache
START, COPY = (2048, 0.1, 0.1), (4096, 0.06, 1.0)  # tokens of a batch, step size, first sum of squares, of the start and of the copies
REST, STOP = 0, 1  # items: all words without an output of their own; the end of a text
FAN_IN = 32  # copies of a part of the model that one task averages
CHUNK = 4096  # rows of the model in a part
SCORED = 1_000_000  # characters that are scored at a time, in whole texts: enough words of each class for its product to pay


def _token_counts(batches):
    seen, counts, held = np.empty(0, np.uint64), np.empty(0, np.int64), 0
    for b in batches:
        docs = [np.append(word_hashes(t), END) for t in b.column(0).to_pylist()]
        if docs:
            h, n = np.unique(np.concatenate(docs), return_counts=True)
            h, inverse = np.unique(np.concatenate([seen, h]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, n]), len(h)).astype(np.int64)
            seen = h
    for at in range(0, len(seen), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(seen[at : at + 200_000].view(np.int64)), pa.array(counts[at : at + 200_000])], ["h", "n"])


class Lexicon:
    """Sorted hashes of the frequent words with their counts and items; items of a class are neighbours.

    Items are REST, STOP, then words by falling count.  The commonest are a class each; a further class ends with 1 / EQUAL
    of the words' mass that is left, or with LARGEST words.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.lexsort((hashes, -counts))
        own = order[hashes[order] != END][: ITEMS - 2]
        item = np.zeros(len(hashes), np.int64)
        item[own] = np.arange(2, len(own) + 2)
        item[hashes == END] = STOP
        by = np.argsort(hashes)
        self.hashes, self.counts, self.item = hashes[by], counts[by], item[by]
        self.starts = np.searchsorted(self.hashes >> np.uint64(44), np.arange(1 << 20, dtype=np.uint64))
        self.hashes = np.append(self.hashes, np.uint64((1 << 64) - 1))
        self.total, self.distinct = total, distinct
        share = lambda n: (n + 0.5) / (total + 0.5 * (distinct + 1))
        self.log_base = np.log10(share(self.counts))
        self.unigram = np.zeros(len(own) + 2)
        self.unigram[2:] = share(counts[own])
        self.unigram[STOP] = share(counts[hashes == END].sum()) if (hashes == END).any() else 1e-12
        self.unigram[REST] = max(1 - self.unigram[1:].sum(), 1e-12)
        left = self.unigram[2 + SINGLE :].sum() / EQUAL
        starts, mass = list(range(min(2 + SINGLE, len(self.unigram)))), 0.0
        for k in range(2 + SINGLE, len(self.unigram)):
            if k == 2 + SINGLE or mass >= left or k - starts[-1] >= LARGEST:
                starts.append(k)
                mass = 0.0
            mass += self.unigram[k]
        self.first = np.array(starts)
        self.size = np.diff(np.append(self.first, len(self.unigram)))
        self.klass = np.repeat(np.arange(len(self.first)), self.size)
        self.class_unigram = np.add.reduceat(self.unigram, self.first)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each hash and whether it is there."""
        at = self.starts[(h >> np.uint64(44)).astype(np.int64)]
        open_ = np.flatnonzero(self.hashes[at] < h)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.hashes[at[open_]] < h[open_]]
        there = (self.hashes[at] == h) & (at < len(self.item))
        return np.where(there, at, 0), there

    def items(self, h: np.ndarray, at: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of words, and their rows as contexts: words without an item share rows by hash."""
        item = np.where(there, self.item[at], REST) if len(self.item) else np.zeros(len(h), np.int64)
        shared = len(self.unigram) + (mix(h) >> np.uint64(52)).astype(np.int64)
        return item, np.where(item == REST, shared, item)


@dataclass
class LogBilinear:
    """context (items and buckets x dim), output (items x dim and bias), place (context x dim), classes (classes x dim and bias)."""

    context: np.ndarray
    output: np.ndarray
    place: np.ndarray
    classes: np.ndarray

    @staticmethod
    def fresh(words: Lexicon) -> LogBilinear:
        rng = np.random.default_rng(11)
        n, k = len(words.unigram), len(words.first)
        rows = lambda m: rng.normal(0, 0.1, (m, DIM + 1)).astype(np.float32)
        model = LogBilinear(rows(n + BUCKETS)[:, :DIM].copy(), rows(n), np.tile(1 / np.arange(1, CONTEXT + 1), (DIM, 1)).T.astype(np.float32), rows(k))
        model.output[:, DIM], model.classes[:, DIM] = np.log(words.unigram), np.log(words.class_unigram)
        return model

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        q = np.ones((len(contexts), DIM + 1), np.float32)
        for at in range(0, len(q), PREDICTED):
            part = contexts[at : at + PREDICTED]
            total = self.context[part[:, 0]] * self.place[0]
            for i in range(1, CONTEXT):
                total += self.context[part[:, i]] * self.place[i]
            q[at : at + PREDICTED, :DIM] = total
        return q

    def log_probabilities(self, words: Lexicon, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Normalised natural logs of items: of its class, and of the item in its class, class by class."""
        q, out, klass = self.predicted(contexts), np.empty(len(targets), np.float64), words.klass[targets]
        for at in range(0, len(targets), BLOCK):
            out[at : at + BLOCK] = _log_softmax(q[at : at + BLOCK], self.classes, klass[at : at + BLOCK])
        order = np.argsort(klass.astype(np.uint16), kind="stable")
        ends = np.searchsorted(klass[order], np.arange(len(words.first) + 1))
        for k in np.flatnonzero((np.diff(ends) > 0) & (words.size > 1)):
            mine, first = order[ends[k] : ends[k + 1]], words.first[k]
            for at in range(0, len(mine), BLOCK):
                part = mine[at : at + BLOCK]
                out[part] += _log_softmax(q[part], self.output[first : first + words.size[k]], targets[part] - first)
        return out


def _log_softmax(q: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    s = q @ rows.T
    mine = s[np.arange(len(own)), own].astype(np.float64)
    top = s.max()
    s -= top
    np.exp(s, out=s)
    return mine - top - np.log(np.maximum(s.sum(axis=1), 1e-30))


def _summed(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids below 2^16, the sums of their rows and how many there were."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    ids = ids[order]
    at = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[at], np.add.reduceat(values[order], at, axis=0), np.diff(np.append(at, len(ids)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive batches with a step size for each row (Adagrad): a batch shares its noise classes, drawn from
    their unigram; a word's noise are words of its class, all as likely."""

    def __init__(self, model: LogBilinear, words: Lexicon, seed: int, rate: float, square: float):
        self.model, self.words = LogBilinear(model.context.copy(), model.output.copy(), model.place.copy(), model.classes.copy()), words
        self.rng, self.rate = np.random.default_rng(seed), rate
        self.squares = {k: np.full(len(getattr(model, k)), square, np.float32) for k in ("context", "output", "place", "classes")}
        self.seen = {k: np.zeros(len(getattr(model, k)), np.float32) for k in self.squares}
        self.cumulative = np.cumsum(words.class_unigram)
        self.class_noise_log = np.log(words.class_unigram * CLASS_NOISE).astype(np.float32)
        self.word_noise_log = np.log(WORD_NOISE / words.size).astype(np.float32)

    def _move(self, name: str, ids, g: np.ndarray, n) -> None:
        rows, squares = getattr(self.model, name), self.squares[name]
        squares[ids] += (g * g).mean(axis=1)
        rows[ids] -= self.rate * g / np.sqrt(squares[ids])[:, None]
        self.seen[name][ids] += n

    def step(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        m, words = self.model, self.words
        klass, q = words.klass[targets], m.predicted(contexts)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(CLASS_NOISE) * self.cumulative[-1]), len(words.first) - 1)
        own = _sigmoid(np.einsum("nd,nd->n", q, m.classes[klass]) - self.class_noise_log[klass]) - 1
        other = _sigmoid(q @ m.classes[noise].T - self.class_noise_log[noise])
        dq = own[:, None] * m.classes[klass] + other @ m.classes[noise]
        moves = [("classes", *_summed(np.concatenate([klass, noise]), np.vstack([own[:, None] * q, other.T @ q])))]
        sub = np.flatnonzero(words.size[klass] > 1)
        if len(sub):
            k, qs = klass[sub], q[sub]
            items = words.first[k][:, None] + (self.rng.random((len(sub), WORD_NOISE)) * words.size[k][:, None]).astype(np.int64)
            items = np.concatenate([targets[sub][:, None], items], axis=1)
            rows = m.output[items]
            d = _sigmoid(np.einsum("nd,nkd->nk", qs, rows) - self.word_noise_log[k][:, None])
            d[:, 0] -= 1
            dq[sub] += np.einsum("nk,nkd->nd", d, rows)
            moves.append(("output", *_summed(items.ravel(), (d[:, :, None] * qs[:, None, :]).reshape(-1, DIM + 1))))
        dq = dq[:, :DIM]
        dp = np.stack([np.einsum("nd,nd->d", dq, m.context[contexts[:, i]]) for i in range(CONTEXT)])
        moves.append(("context", *_summed(contexts.T.ravel(), np.concatenate([dq * m.place[i] for i in range(CONTEXT)]))))
        for move in moves:
            self._move(*move)
        self._move("place", np.arange(CONTEXT), dp, len(targets))

    def parts(self):
        """``(part, rows, seen, values)``: rows that were trained, how often, and their values, as bytes."""
        for name, seen in self.seen.items():
            for at in range(0, len(seen), CHUNK):
                rows = at + np.flatnonzero(seen[at : at + CHUNK])
                if len(rows):
                    yield f"{name}:{at}", rows.astype(np.int32).tobytes(), seen[rows].tobytes(), getattr(self.model, name)[rows].astype(np.float16).tobytes()


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of a part as one: each row's mean, weighted by how often the row was trained."""
    width = DIM if pdf["part"].iloc[0].split(":")[0] in ("context", "place") else DIM + 1
    rows, seen = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("rows", np.int32), ("seen", np.float32)))
    values = np.concatenate([np.frombuffer(x, np.float16).astype(np.float32).reshape(-1, width) for x in pdf["values"]])
    order = np.argsort(rows, kind="stable")
    rows, seen, values = rows[order], seen[order], values[order]
    at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    n = np.add.reduceat(seen, at)
    mean = np.add.reduceat(values * seen[:, None], at, axis=0) / n[:, None]
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "copy": [int(pdf["copy"].min())], "rows": [rows[at].tobytes()], "seen": [n.tobytes()], "values": [mean.astype(np.float16).tobytes()]})


COPIES = "part string, copy int, rows binary, seen binary, values binary"


def _averaged(start: LogBilinear, copies: DataFrame) -> LogBilinear:
    """``start`` with the mean of what each copy learnt, by parts of the model and in rounds of FAN_IN copies."""
    copies = written(copies, "copies")
    n = copies.agg(F.max("copy")).first()[0]
    if n is None:
        return start
    n += 1
    while n > 1:
        n = -(-n // FAN_IN)
        merged = copies.withColumn("copy", F.pmod("copy", F.lit(n))).groupBy("part", "copy").applyInPandas(_merged, COPIES)
        copies = written(merged, "copies")
    model = LogBilinear(start.context.copy(), start.output.copy(), start.place.copy(), start.classes.copy())
    for r in copies.collect():  # the rows of one model
        rows = getattr(model, r["part"].split(":")[0])
        rows[np.frombuffer(r["rows"], np.int32)] = np.frombuffer(r["values"], np.float16).reshape(-1, rows.shape[1])
    return model


def _laid(rows: list[np.ndarray]) -> np.ndarray:
    """Contexts of the texts' tokens, nearest first; before a text stand ends."""
    pad = np.full(CONTEXT, STOP, np.int64)
    flat = np.concatenate([x for r in rows for x in (pad, r)])
    lengths = np.array([len(r) for r in rows])
    places = np.repeat(np.arange(1, len(rows) + 1) * CONTEXT, lengths) + np.arange(lengths.sum())
    return np.stack([flat[places - i] for i in range(1, CONTEXT + 1)], axis=1)


def _tokens(texts: list[str | None], words: Lexicon):
    """Of all texts' tokens: lengths by text, hashes, index and presence in the lexicon, items, contexts."""
    hashes = [np.append(word_hashes(t), END) for t in texts]
    lengths, flat = np.array([len(h) for h in hashes]), np.concatenate(hashes)
    at, there = words.look_up(flat)
    item, row = words.items(flat, at, there)
    return lengths, flat, at, there, item, _laid(np.split(row, np.cumsum(lengths)[:-1]))


def _train_task(lexicon, start, batch: int, rate: float, square: float):
    def run(batches):
        model, task = Trainer(start.value, lexicon.value, 3, rate, square), TaskContext.get()
        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), 64):
                *_, targets, contexts = _tokens(texts[at : at + 64], lexicon.value)
                cuts = range(0, len(targets), batch)
                for cut in model.rng.permutation(len(cuts)):
                    model.step(contexts[cuts[cut] : cuts[cut] + batch], targets[cuts[cut] : cuts[cut] + batch])
        for part in model.parts():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part[0], task.partitionId() if task else 0, *part[1:]), (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "copy", "rows", "seen", "values"])

    return run


def fit(training: DataFrame, lexicon: Lexicon, sample_docs: int = 2000) -> LogBilinear:
    """Train on ``training(doc_id, text)``.

    A seeded sample of about ``sample_docs`` texts starts the model off in one task; from there every partition of the
    whole corpus trains a copy on all its batches, and each row of the copies is averaged by how often it was trained.
    """
    spark = training.sparkSession
    words, model = spark.sparkContext.broadcast(lexicon), LogBilinear.fresh(lexicon)
    total = training.count()
    if not total:
        return model
    sample = training.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1e6 * min(1.0, sample_docs / total))).select("text").coalesce(1)
    model = _averaged(model, sample.mapInArrow(_train_task(words, spark.sparkContext.broadcast(model), *START), COPIES))
    return _averaged(model, training.select("text").mapInArrow(_train_task(words, spark.sparkContext.broadcast(model), *COPY), COPIES))


def _groups(texts: list[str | None]):
    """Ranges of texts that begin within the same SCORED characters."""
    sizes = np.array([len(t or "") + 1 for t in texts])
    of = (np.cumsum(sizes) - sizes) // SCORED
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(texts)]
    return zip(cuts, cuts[1:]) if texts else ()


def _score_task(lexicon, model):
    def run(batches):
        words, lbl = lexicon.value, model.value
        scale, rest = np.log(10), np.log10(words.unigram[REST])
        for b in batches:
            uids, ids, texts = (b.column(k).to_pylist() for k in range(3))
            for first, last in _groups(texts):
                lengths, flat, at, there, item, contexts = _tokens(texts[first:last], words)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                base = np.where(there, words.log_base[at], 0.0) if len(words.log_base) else np.zeros(len(flat))
                score = lbl.log_probabilities(words, contexts, item) / scale
                score += np.where(item == REST, base - rest, 0.0)
                sums = [np.bincount(owner, x, len(lengths)) for x in (base, score, there)]
                uid = np.array(uids[first:last], np.int64)
                none = pa.nulls(len(uid), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(ids[first:last], pa.int64()), none, pa.array(lengths.astype(np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])], NAMES)
                if not there.all():
                    pairs, n = _pairs(owner[~there], flat[~there])
                    zeros = pa.array(np.zeros(len(n)))
                    yield pa.RecordBatch.from_arrays([pa.array(uid[pairs[0]]), pa.nulls(len(n), pa.int64()), pa.array(pairs[1].view(np.int64)), pa.array(n), pa.array(np.zeros(len(n), np.int64)), zeros, zeros], NAMES)

    return run


def _pairs(owner: np.ndarray, h: np.ndarray):
    """Distinct (owner, hash) pairs and how often each stands there."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))
    at = np.flatnonzero(new)
    return (owner[at], h[at]), np.diff(np.append(at, len(h))).astype(np.int64)


NAMES = ["uid", "doc_id", "h", "n", "known", "base", "score"]


def score_documents(docs: DataFrame, learn: Column) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Learns from the rows where ``learn`` holds.  Tokens are the words, A-Z lower-cased, then one end.  base_score adds
    log10((c + 0.5) / (N + 0.5 (V + 1))); c counts every training token.  score is the model's: a two-level softmax over
    the ITEMS most frequent tokens and one item for the rest, inside which words are as likely as in the base, so that
    probabilities of all known words and of the unknown one add up to 1.  Words without an item still have rows of
    their own kind as contexts, shared by hash.  Words are told apart by 64-bit hashes; ties of counts go by hash.

    A null or empty text is one end.  Without training rows every token is unknown (N = V = 0).  Rows that repeat a
    doc_id, and rows with a null doc_id, are scored as any other; other columns are ignored, an empty table gives an
    empty result.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    training = docs.where("learn").select("doc_id", "text")
    counts = training.select("text").mapInArrow(_token_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))
    counts = written(counts, "counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = sums["n"], sums["v"]
    top = counts.orderBy(F.col("c").desc(), "h").limit(FREQUENT).toArrow()
    lexicon = Lexicon(top["h"].to_numpy().view(np.uint64), top["c"].to_numpy(), total, distinct)
    model = fit(training, lexicon)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.mapInArrow(_score_task(sc.broadcast(lexicon), sc.broadcast(model)), "uid long, doc_id long, h long, n long, known long, base double, score double")
    parts = written(parts, "scores")
    log_base = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    rare = parts.where("h is not null").select("uid", "h", "n").join(counts, "h", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("more"), F.sum(F.col("n") * log_base).alias("add"))
    own = parts.where("h is null").select("uid", "doc_id", F.col("n").alias("n_tokens"), "known", "base", "score")
    more, add = F.coalesce("more", F.lit(0)), F.coalesce("add", F.lit(0.0))
    return own.join(rare, "uid", "left").select("doc_id", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("score") + add).alias("score"))
