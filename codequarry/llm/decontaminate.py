"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel edit distance."""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = re.compile(r"[\x20\x09-\x0D]+")
BLOCK_CHARS = 4_000_000  # items are taken in blocks of at most so many characters, each sent to every task


def normal(text: str | None) -> str:
    return SPACE.sub(" ", text or "").strip().lower()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``item`` in budget + 1 parts of nearly equal length: with at most budget edits one part is unharmed."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def distances(pattern: str, text: str, start: int = 0, anchored: bool = False):
    """For each end in ``text``: the edit distance of ``pattern`` to the nearest substring that ends there (Myers 1999).

    ``anchored``: to the text from ``start`` up to there.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top, score = (1 << m) - 1, 1 << m - 1, m
    up, down = full, 0
    for j in range(start, len(text)):
        eq = masks.get(text[j], 0)
        x = eq | down
        d = ((((eq & up) + up) & full) ^ up) | x
        plus, minus = down | (full & ~(d | up)), up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1 | anchored) & full, minus << 1 & full
        up, down = minus | (full & ~(x | plus)), plus & x
        yield score


def passages(item: str, text: str, budget: int):
    """``(distance, start, end)`` of the occurrences of ``item`` within ``budget`` edits, left to right, apart from each other.

    From the first end within the budget on, the least distance of the next ``budget`` ends decides; the passage is the
    shortest one of that distance.
    """
    at = 0
    while at < len(text):
        best = None
        for j, score in enumerate(distances(item, text, at), at + 1):
            if best and (not best[0] or j > best[2]):
                break
            if score <= budget and (best is None or score < best[0]):
                best = score, j, best[2] if best else j + budget
        if not best:
            return
        distance, end, _ = best
        back = text[max(at, end - len(item) - budget) : end][::-1]
        length = next(j for j, score in enumerate(distances(item[::-1], back, 0, True), 1) if score == distance)
        yield distance, end - length, end
        at = end


def budget_of(length: int, rate: float) -> int:
    return int(length * rate)


def _matcher(items: list[tuple[int, str]], rate: float):
    """A function from a text to its matches ``(item_id, distance, start, end)`` in normalised text."""
    where: dict[str, list[tuple[int, int]]] = {}
    for k, (_, item) in enumerate(items):
        for at, part in pieces(item, budget_of(len(item), rate)):
            where.setdefault(part, []).append((k, at))
    auto = ahocorasick.Automaton()
    for part, hits in where.items():
        auto.add_word(part, (len(part), hits))
    auto.make_automaton()

    def matches(text: str):
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, hits) in auto.iter(text):
            for k, at in hits:
                budget, start = budget_of(len(items[k][1]), rate), end + 1 - size - at
                windows.setdefault(k, []).append((max(0, start - budget), start + len(items[k][1]) + budget))
        for k, spans in windows.items():
            item_id, item = items[k]
            budget = budget_of(len(item), rate)
            for lo, hi in _joined(spans):
                for distance, start, end in passages(item, text[lo:hi], budget):
                    if budget or _whole(text, lo + start, lo + end):
                        yield item_id, distance, lo + start, lo + end

    return matches


def _joined(spans: list[tuple[int, int]]):
    """Spans in order, those that overlap as one."""
    spans.sort()
    lo, hi = spans[0]
    for a, b in spans[1:]:
        if a > hi:
            yield lo, hi
            lo, hi = a, b
        else:
            hi = max(hi, b)
    yield lo, hi


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05) -> DataFrame:
    """Passages of ``docs`` within an edit distance of rate * length of a benchmark item.

    Returns ``doc_id, item_id, distance, start_char, end_char``, one row for each passage; places are code points of
    the normalised text (white space to one space, trimmed, lower-cased).  Each item is cut into budget + 1 pieces; an
    exact hit of a piece fixes a window, in which bit-parallel edit distance finds all passages, apart from each other.
    Items so short that the budget is 0 would match by chance and must occur as whole words.

    The benchmark is the query set: it is taken in blocks of BLOCK_CHARS characters, so what each task holds is bounded;
    every block is held against all documents.  Null and empty texts or items match nothing; a repeated item counts
    once; rows with a null doc_id and rows that repeat one are matched as any other; further columns are ignored.
    """
    schema = "doc_id long, item_id long, distance int, start_char int, end_char int"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = [rows.mapInArrow(_match_task(block, rate), schema) for block in _blocks(benchmark)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05) -> DataFrame:
    """``docs``, whole rows with all their columns, without those that hold a passage (see :func:`benchmark_matches`).

    One pass over the documents, without a shuffle; rows with null texts stay, repeated rows fare alike.
    """
    rows = docs.select(F.struct("*").alias("_doc"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["_doc"].dataType.simpleString()
    for block in _blocks(benchmark):
        rows = rows.mapInArrow(_keep_task(block, rate), f"_doc {kind}, text string")
    return rows.select("_doc.*")


def _blocks(benchmark: DataFrame):
    """Broadcasts of lists of ``(item_id, normalised text)``; the driver reads item by item and holds one block."""
    block, size = set(), 0
    for row in benchmark.where("text is not null").select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        text = normal(row["text"])
        if text and (row["item_id"], text) not in block:
            block.add((row["item_id"], text))
            size += len(text)
        if size >= BLOCK_CHARS:
            yield benchmark.sparkSession.sparkContext.broadcast(sorted(block, key=str))
            block, size = set(), 0
    if block:
        yield benchmark.sparkSession.sparkContext.broadcast(sorted(block, key=str))


def _match_task(block, rate: float):
    def run(batches):
        find = _matcher(block.value, rate)
        for batch in batches:
            out = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for m in find(normal(text))]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "distance", "start_char", "end_char"])

    return run


def _keep_task(block, rate: float):
    def run(batches):
        find = _matcher(block.value, rate)
        for batch in batches:
            yield batch.filter(pa.array([not text or next(find(normal(text)), None) is None for text in batch.column(1).to_pylist()], pa.bool_()))

    return run


def _whole(text: str, start: int, end: int) -> bool:
    return not (text[start - 1 : start].isalnum() and start) and not text[end : end + 1].isalnum()


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05) -> DataFrame:
    """One row for each matched document: ``doc_id, n_items, n_passages, items`` (item ids, comma-joined, ascending)."""
    found = benchmark_matches(docs, benchmark, rate)
    items = F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",")
    return found.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.count(F.lit(1)).alias("n_passages"), items.alias("items"))
