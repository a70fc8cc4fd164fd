"""Spelling variants: words that differ by one code point, found among sorted permuterm rotations."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SLIPS = 199  # one run of a document in so many loses a code point
HELD = 200_000  # distinct words that a task holds before it hands their counts on
END = "$"


def slipped(doc_id: str, run: str, slips: int = SLIPS) -> str:
    """The run of letters, with a code point deleted where the crc32 of ``doc_id:run`` is a multiple of ``slips``."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % slips:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counts(slips: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine: Counter = Counter()
                for word, n in Counter(map(itemgetter(0), RUN.finditer(text or ""))).items():  # a long text makes no long list
                    mine[word.lower() if word.isascii() else word.translate(LOWER)] += n
                for word, n in mine.items():
                    word = slipped(doc_id, word, slips)
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    return run


def words(docs: DataFrame, slips: int = SLIPS, length: int = 6, occurrences: int = 5) -> DataFrame:
    """``word, n``: words of all texts of at least ``length`` code points that occur ``occurrences`` times; counted per task before the shuffle."""
    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_counts(slips, length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def rotations(found: DataFrame) -> DataFrame:
    """``key, word, n, kind``: the permuterm rotations of each word, twice over.

    A rotation of ``word$`` that starts after code point i ends in i.  Without that last code point it is the prefix
    under which all words lie that differ from this one by a replacement there (kind 1, or 2 where the code point before
    is the same, so that its deletion is another one's too).  A whole rotation (kind 0) is the same prefix for the words
    that have one code point more there.
    """
    size = F.length("word")
    marked = F.concat("word", F.lit(END))
    turned = found.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("k"), marked.alias("m"), size.alias("size"))
    turned = turned.select("word", "n", "k", "size", F.concat(F.expr("substring(m, k + 1)"), F.expr("substring(m, 1, k)")).alias("key"))
    letter, before = F.expr("substring(word, k, 1)"), F.expr("CASE WHEN k > 1 THEN substring(word, k - 1, 1) ELSE '' END")
    edited = turned.where("k > 0").select(F.expr("substring(key, 1, size)").alias("key"), "word", "n", F.when(letter == before, 2).otherwise(1).alias("kind"))
    return turned.select("key", "word", "n", F.lit(0).alias("kind")).unionByName(edited)


def neighbours(found: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near``: how many words differ by one code point, and the commonest of them (ties: the least).

    Rotations are sorted by ranges, so that those under one prefix lie together, and each prefix is scanned once.  Under
    a prefix there is at most one word for each letter and the whole rotation, a hundred at the very most; a word takes
    the best of the others, or the second best where it is the best itself, so no pairs are made.  Two words that differ
    by a replacement meet under one prefix; by an insertion in a run of equal letters under several, of which only the
    run's first letter counts (kind 1).
    """
    at = rotations(found).repartitionByRange("key")
    under = Window.partitionBy("key")
    best: Column = F.struct((-F.col("n")).alias("n"), "word")
    replaced = under.orderBy(F.col("kind") == 0, F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = at.select(
        "*", best.alias("me"),
        F.sum((F.col("kind") > 0).cast("long")).over(under).alias("n_edited"), F.sum((F.col("kind") == 1).cast("long")).over(under).alias("n_first"),
        F.max(F.when(F.col("kind") == 0, best)).over(under).alias("whole"), F.min(F.when(F.col("kind") == 1, best)).over(under).alias("longer"),
        F.nth_value(F.when(F.col("kind") > 0, best), 1).over(replaced).alias("one"), F.nth_value(F.when(F.col("kind") > 0, best), 2).over(replaced).alias("two"),
    )
    other = F.when(F.col("one") == F.col("me"), F.col("two")).otherwise(F.col("one"))
    shorter = F.when(F.col("kind") == 1, F.col("whole"))
    near = F.when(F.col("kind") == 0, F.col("longer")).otherwise(F.least(other, shorter))
    n = F.when(F.col("kind") == 0, F.col("n_first")).otherwise(F.col("n_edited") - 1 + F.when((F.col("kind") == 1) & F.col("whole").isNotNull(), 1).otherwise(0))
    each = at.select("word", n.alias("n"), near.alias("near")).where("near is not null")
    return each.groupBy("word").agg(F.sum("n").alias("n_near"), F.min("near").alias("near")).select("word", "n_near", (-F.col("near.n")).alias("near_n"), F.col("near.word").alias("near"))


def spelling_variants(docs: DataFrame, slips: int = SLIPS, length: int = 6, occurrences: int = 5, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of all texts.

    Words are runs of letters with A-Z lower-cased, of which one in ``slips`` loses a code point.  A word's form is the
    commonest word that differs from it by one code point, if that occurs ``ratio`` times as often; root follows forms to
    the last.  Counts rise by ``ratio`` with each step, so a chain has at most log(max n) steps and is followed by doubling.

    Null and empty texts have no words; a null doc_id counts as an empty one; rows that repeat a doc_id, and repeated
    rows, are counted each; words that tie as forms give the least in code-point order.  An empty table gives an empty
    result, further columns are ignored.
    """
    found = written(words(docs, slips, length, occurrences), "words")
    near = written(found.join(neighbours(found), "word", "left"), "near")
    form = F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near"))
    mine = written(near.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), F.col("near_n")).alias("form_n")), "forms")
    steps = mine.where("form is not null").select("word", F.col("form").alias("root"))
    most = found.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(2.0, math.log(most, ratio) + 1)))):
        further = steps.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        steps = written(steps.join(further, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_to", "root").alias("root")), "roots")
    return mine.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
