"""BPE encoding and decoding of texts of any length: pieces encoded in parallel, joined in a tree by growing windows."""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import written

PIECE = 32_768  # code points of a piece; texts of no more are encoded whole
WINDOW = 64  # tokens on each side of a join that are encoded again at first
EDGE = 16  # code points at a cut end that more text could change (a contraction, an end of word); more if a special token is longer
BATCH = 64
KEPT = 300_000  # words of which a task keeps the ids


class Span:
    """A stretch of text and its tokens, as if the text stood alone: ids, and the code points that each token covers."""

    __slots__ = ("text", "ids", "starts", "ends")

    def __init__(self, text: str, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.text, self.ids, self.starts, self.ends = text, ids, starts, ends


def encoded(tokenizer, text: str) -> Span:
    e = tokenizer.encode(text, add_special_tokens=False)
    offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
    return Span(text, np.array(e.ids, np.int32), offsets[:, 0].copy(), offsets[:, 1].copy())


def _units(span: Span, first: int, last: int, shift: int) -> dict[tuple, int]:
    """Groups of tokens ``first..last - 1`` that share code points, as (place, end, ids) -> index after the group."""
    out, k = {}, first
    while k < last:
        begin, end, at = int(span.starts[k]), int(span.ends[k]), k
        k += 1
        while k < last and span.starts[k] < end:
            end = max(end, int(span.ends[k]))
            k += 1
        if (k == len(span.ids) or span.starts[k] >= end) and not (at and span.ends[at - 1] > begin) and begin < len(span.text) and not unicodedata.combining(span.text[begin]):
            out[begin + shift, end + shift, tuple(span.ids[at:k].tolist())] = k
    return out


def joined(left: Span, right: Span, encode: Callable[[str], Span], window: int = WINDOW, edge: int = EDGE) -> Span:
    """The tokens of both texts together.

    The last tokens of the left and the first of the right are encoded again as one text.  Where the result has a token
    in common with the left, and a later one with the right, at the same place and clear of any cut end, all three agree:
    every two neighbours in left + window + right are neighbours in an encoding of text that stands whole around them,
    which makes the sequence the encoding of the whole.  Otherwise the window grows, at last to both texts.
    """
    text, cut = left.text + right.text, len(left.text)
    while window < max(len(left.ids), len(right.ids)):
        a, b = max(0, len(left.ids) - window), min(len(right.ids), window)
        begin = int(left.starts[a]) if a else 0
        end = cut + int(right.ends[b - 1]) if b < len(right.ids) else len(text)
        w = encode(text[begin:end])
        inner = _units(w, 0, len(w.ids), begin)
        ours = {u: k for u, k in _units(left, a, len(left.ids), 0).items() if u[1] <= cut - edge}
        theirs = {u: k for u, k in _units(right, 0, b, cut).items() if u[1] <= end - edge or end == len(text)}
        lefts = sorted((k, ours[u]) for u, k in inner.items() if u in ours)
        rights = sorted((k, theirs[u]) for u, k in inner.items() if u in theirs)
        x = lefts[-1] if lefts else (0, 0) if not a else None
        y = rights[0] if rights else (len(w.ids), len(right.ids)) if b == len(right.ids) else None
        if x and y and x[0] <= y[0]:
            take = lambda p, q, r: np.concatenate([p[: x[1]], q[x[0] : y[0]], r[y[1] :]]).astype(np.int32)  # noqa: B023, E731
            return Span(text, take(left.ids, w.ids, right.ids), take(left.starts, w.starts + begin, right.starts + cut), take(left.ends, w.ends + begin, right.ends + cut))
        window *= 2
    return encode(text)


def tree_joined(pieces: list[Span], encode: Callable[[str], Span], window: int = WINDOW, edge: int = EDGE) -> Span:
    """Neighbours joined in pairs, and the results again, until one is left."""
    while len(pieces) > 1:
        pieces = [joined(*pieces[k : k + 2], encode, window, edge) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0]


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    """One for each Python worker: to read it takes longer than to encode a text."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    t = Tokenizer.from_str(definition)
    t.no_truncation()
    t.no_padding()
    return t


class Words:
    """Encodes texts word by word, and keeps what a word gave, for a tokenizer that drops white space.

    Blanks and line ends are in no token and no merge, special token or normal form reaches over them, so the ids of a
    text are those of what stands between them.
    """

    def __init__(self, tokenizer, kept: int = KEPT):
        self.tokenizer, self.kept, self.ids = tokenizer, kept, {"": b""}
        probe = "Ab c'd\n\n é<|x ' s\n"
        if b"".join(self._new([w for line in probe.split("\n") for w in line.split(" ")])) != self._new([probe])[0]:
            raise ValueError("this tokenizer does not drop white space")

    def _new(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.ids) > self.kept:
            self.ids = {"": b""}
        new = list({w for ws in split for w in ws} - self.ids.keys())
        for k in range(0, len(new), 1024):
            self.ids.update(zip(new[k : k + 1024], self._new(new[k : k + 1024])))
        return [b"".join(map(self.ids.__getitem__, ws)) for ws in split]


def edge_of(tokenizer) -> int:
    return max(EDGE, 1 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0))


def _digests(tokenizer, ids: bytes) -> tuple[int, str, str]:
    text = tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


FIRST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, row string, piece int, pieces int, text string"
SECOND = "doc_id long, row string, piece int, text string, ids binary, starts binary, ends binary"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def encode_documents(docs: DataFrame, tokenizer_path: str, piece: int = PIECE, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``, by the tokenizer file of the library ``tokenizers``.

    Texts of up to ``piece`` code points are encoded where they are read, each word once in a task; the tokenizer must be
    one that drops white space (others raise ValueError).  Longer ones are cut, blank or not, into pieces
    that are dealt to all tasks and encoded there, with the places of their tokens; a text's pieces then meet in one task,
    which joins neighbours, pairs of neighbours and so on, each by a window that grows until both sides agree exactly.
    What one task must hold is one text and its tokens.  The ids of a text equal those of a single call, whatever the
    tokenizer's special tokens, which occur in texts as themselves.

    Null texts are empty: no tokens, and the digests of no bytes.  Rows with a null doc_id and repeated rows have a row
    each; further columns are ignored; an empty table gives an empty result.  The driver reads the file and
    broadcasts it (some megabytes), so that executors need no copy.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(definition.value)
        words = Words(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), BATCH):
                some, rows = list(zip(ids[at : at + BATCH], texts.slice(at, BATCH).to_pylist())), []
                short = [r for r in some if len(r[1]) <= piece]
                for (doc_id, _), e in zip(short, words.encode([t for _, t in short])):
                    rows.append((doc_id, *_digests(tokenizer, e), None, None, None, None))
                yield _arrow(rows, FIRST)
                for doc_id, text in some:
                    if len(text) > piece:
                        row, n = os.urandom(16).hex(), -(-len(text) // piece)
                        for k in range(n):
                            yield _arrow([(doc_id, None, None, None, row, k, n, text[k * piece : (k + 1) * piece])], FIRST)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(definition.value)
        for batch in batches:
            for doc_id, row, k, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                s = encoded(tokenizer, text)
                yield _arrow([(doc_id, row, k, text, s.ids.tobytes(), s.starts.tobytes(), s.ends.tobytes())], SECOND)

    def join(table: pa.Table) -> pa.Table:
        tokenizer = _tokenizer(definition.value)
        parts = sorted(table.to_pylist(), key=lambda r: r["piece"])
        spans = [Span(r["text"], *(np.frombuffer(r[c], np.int32) for c in ("ids", "starts", "ends"))) for r in parts]
        whole = tree_joined(spans, lambda t: encoded(tokenizer, t), window, edge_of(tokenizer))
        return pa.Table.from_batches([_arrow([(parts[0]["doc_id"], *_digests(tokenizer, whole.ids.astype("<u4").tobytes()))], RESULT)])

    first = written(given.mapInArrow(cut, FIRST), "encoded")
    long = first.where("row is not null").select("doc_id", "row", "piece", "text")
    joins = long.repartition("row", "piece").mapInArrow(encode, SECOND).groupBy("row").applyInArrow(join, RESULT)
    return first.where("row is null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(joins)
