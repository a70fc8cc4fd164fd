"""Near-duplicate documents: tensored MinHash banding, then confirmation on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import shingle_set
from .workspace import written

HALF = 3  # min-hashes in each half of a table key
SKETCH = 64  # one byte of each of so many min-hashes estimates a pair's similarity
FIRST_REPS = 4  # likeliest representatives that a node is confirmed against before the turn across components
FILTER_BITS = 1 << 24
COUNTERS = 1 << 20  # counters by which shingles are told rare or frequent
SMALL = 200_000  # rows that may be broadcast
PART = 8192  # nodes of a key that one task compares with the others of the key


def tables_per_side(threshold: float, recall: float = 0.995) -> int:
    """Smallest m for which a pair at the threshold shares a key of the m x m tables with probability ``recall``."""
    p = threshold**HALF
    return max(2, math.ceil(math.log(1 - math.sqrt(recall)) / math.log(1 - p))) if p < 1 else 2


def _minhashes(shingles: np.ndarray, n: int) -> np.ndarray:
    rng = np.random.default_rng(20240229)
    mul = rng.integers(1 << 62, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(1 << 62, size=n, dtype=np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * mul[None, :] + add[None, :]
        part ^= part >> np.uint64(29)
        least = np.minimum(least, (part * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
    return least


def _sketch(m: int, words: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, copy in zip(*(batch.column(k).to_pylist() for k in range(3))):
                s = shingle_set(text, words)
                if not len(s):
                    out.append((doc_id, copy, 0, None, None, None, None))
                    continue
                least = _minhashes(s, max(2 * m * HALF, SKETCH))
                halves = [int.from_bytes(hashlib.blake2b(bytes([k]) + row.tobytes(), digest_size=8).digest(), "little", signed=True) for k, row in enumerate(least[: 2 * m * HALF].reshape(2 * m, HALF))]
                packed = (least[:SKETCH] & np.uint64(255)).astype(np.uint8).view(np.int64).tolist()
                out.append((doc_id, copy, len(s), _digest(s), halves[:m], halves[m:], packed))
            longs = pa.list_(pa.int64())
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), longs, longs, longs))], ["doc_id", "copy", "n_shingles", "digest", "left", "right", "sketch"])

    return run


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _agreeing(a: Column, b: Column) -> Column:
    """How many of the sketches' 8 * SKETCH bits are equal: all eight of a byte for equal min-hashes, else half."""
    return F.lit(8 * SKETCH) - reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(SKETCH // 8)])


def least_agreeing(threshold: float) -> int:
    """Equal bits of a pair at the threshold, less 3.5 standard deviations."""
    spread = SKETCH * (16 * threshold * (1 - threshold) + 2 * (1 - threshold))
    return math.floor(SKETCH * 4 * (1 + threshold) - 3.5 * math.sqrt(spread))


def _filter_words(rows: DataFrame) -> np.ndarray:
    """A Bloom filter of the rows' hashes ``row``, of fixed size: the driver gets at most FILTER_BITS / 64 longs."""
    h = F.pmod("row", F.lit(FILTER_BITS))
    words = rows.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).collect()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words:
        out[r["w"]] = r["b"]
    return out


def _row(doc_id: str, copy: str | Column) -> Column:
    return F.xxhash64(doc_id, copy)


def _sets(docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """``(digest, shingles)`` of the documents that may be in ``rows(row)``; the texts themselves are not shuffled."""
    wanted = docs.sparkSession.sparkContext.broadcast(_filter_words(rows))

    def run(batches):
        bits, seen = wanted.value, set()
        for batch in batches:
            h = batch.column(1).to_numpy()
            keep = np.flatnonzero((bits[h >> 6] >> (h & 63)) & 1)
            sets = {_digest(s): s.view(np.int64) for s in (shingle_set(t, words) for t in batch.column(0).take(pa.array(keep)).to_pylist())}
            sets = {d: s for d, s in sets.items() if d not in seen}  # repeated rows give one set a task
            seen.update(sets)
            sizes = np.concatenate(([0], np.cumsum([len(s) for s in sets.values()]))).astype(np.int32)
            flat = np.concatenate(list(sets.values())) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["digest", "shingles"])

    return docs.select("text", F.pmod(_row("doc_id", "copy"), F.lit(FILTER_BITS)).alias("h")).mapInArrow(run, "digest binary, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs ``(a, b)`` of nodes whose full sets have den * |intersection| >= num * |union|."""
    one = pairs.withColumn("digest", F.col("a.digest")).join(sets.withColumnRenamed("shingles", "x"), "digest").drop("digest")
    two = one.withColumn("digest", F.col("b.digest")).join(sets.withColumnRenamed("shingles", "y"), "digest")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return two.where(common * den >= (F.size("x") + F.size("y") - common) * num).select("a", "b")


def _levels(sets: DataFrame) -> np.ndarray:
    """How frequent the shingles of each of COUNTERS hash classes are, as powers of two of the mean; a quarter at most is not 0."""
    counts = sets.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(COUNTERS)).alias("c")).count()
    mean = sets.agg(F.sum(F.size("shingles").cast("long"))).first()[0] or 0
    most = counts.where(F.col("count") > 4 * max(1.0, mean / COUNTERS)).select(F.col("c").cast("int").alias("c"), F.log2("count").cast("byte").alias("l")).toArrow()
    out = np.zeros(COUNTERS, np.uint8)
    out[most["c"].to_numpy()] = most["l"].to_numpy()
    return out


def _prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``digest, prefix``: a set's rarest shingles, in an order that is the same for all sets, as 32-bit hashes.

    Two sets with an intersection of at least k share a shingle among the first n - k + 1 of each; the prefix serves
    the smallest k that any partner at the threshold allows.
    """
    levels = sets.sparkSession.sparkContext.broadcast(_levels(sets))

    def run(batches):
        for batch in batches:
            out = []
            for s in batch.column(1):
                s = s.values.to_numpy()
                order = np.lexsort((s, levels.value[s & (COUNTERS - 1)]))
                out.append((s[order[: len(s) + 1 - -(-num * len(s) // den)]] >> 32).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["digest", "prefix"])

    return sets.select("digest", "shingles").mapInArrow(run, "digest binary, prefix array<int>")


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast where it has at most SMALL rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _across(placed: DataFrame, nodes: DataFrame, prefixes: DataFrame, m: int, agree: int, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of different components ``c`` that share a table key of ``placed(key, slot, id, c, n)``.

    A pair meets once, under the first left and the first right triple that it shares, and leaves the join only if
    its sizes, its sketches and its rarest shingles allow the threshold.  A key of n nodes is compared in n / PART parts.
    """
    rows = placed.join(nodes, "id").withColumn("digest", F.col("id.digest")).join(prefixes, "digest")
    before = F.concat(F.slice("left", F.lit(1), F.floor(F.col("slot") / m).cast("int")), F.slice("right", F.lit(1), F.col("slot") % m))
    rows = written(rows.select("key", "id", "digest", F.col("c.digest").alias("c"), F.col("n_shingles").cast("int").alias("size"), "sketch", before.alias("before"), "prefix", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "rows")
    x = rows.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).alias("x")
    y = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    less, more = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    common = F.ceil((less + more) * num / (num + den)).cast("int")  # shingles that a pair at the threshold shares
    rarest = lambda side: F.slice(F.col(f"{side}.prefix"), F.lit(1), F.col(f"{side}.size") - common + 1)
    tests = [F.col("x.key") == F.col("y.key"), F.col("x.part") == F.col("y.part"), F.col("x.digest") < F.col("y.digest"), F.col("x.c") != F.col("y.c"), less * den >= more * num]
    tests += [_agreeing(F.col("x.sketch"), F.col("y.sketch")) >= agree, F.arrays_overlap(rarest("x"), rarest("y")), ~F.arrays_overlap("x.before", "y.before")]
    return x.join(y, reduce(and_, tests)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, words: int = 5) -> DataFrame:
    """Link documents whose shingle sets have Jaccard similarity of at least num/den; a row for each row of ``docs``.

    Returns ``doc_id, n_shingles, component_id, kept, text_md5``.  Two small hash collections of m min-hash triples each
    give m * m table keys (every left triple with every right one), so 2 * 3 * m min-hashes do the work of 3 * 2 * m * m.
    Documents with equal sets are one node.  Triples and keys that only one node has are dropped by counting; in each
    shared key nodes are compared with a representative, and what these links leave apart is compared across
    components in a second turn, so no bucket is expanded into all its pairs and none is capped.  A one-byte sketch
    skips pairs that are far below the threshold (3.5 standard deviations); every link is confirmed on full sets.

    Texts without words, and null texts, link with nothing (n_shingles 0).  Rows that repeat a doc_id are judged by
    their own texts.  Rows with a null doc_id are returned with a null component_id and kept.  Other columns of
    ``docs`` are ignored, an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("copy"))
    m, agree = tables_per_side(num / den), least_agreeing(num / den)
    sketched = written(docs.mapInArrow(_sketch(m, words), "doc_id long, copy binary, n_shingles long, digest binary, left array<long>, right array<long>, sketch array<long>"), "sketches")
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    same = [F.first(c).alias(c) for c in ("n_shingles", "left", "right", "sketch")]  # functions of the set
    nodes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "copy")).alias("at"), *same)
    node = F.struct(F.col("at.doc_id").alias("low"), "digest")
    nodes = written(nodes.select(node.alias("id"), _row("at.doc_id", F.col("at.copy")).alias("row"), "n_shingles", "left", "right", "sketch"), "nodes")

    halves = nodes.select("id", F.posexplode(F.concat("left", "right")).alias("slot", "h"))
    met = halves.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    side = lambda test: F.collect_list(F.when(test, F.struct("slot", "h")))
    mine = halves.join(met, "h", "left_semi").groupBy("id").agg(side(F.col("slot") < m).alias("lefts"), side(F.col("slot") >= m).alias("rights"))
    mine = mine.where("size(lefts) > 0 and size(rights) > 0").join(nodes.select("id", "row", "sketch"), "id")
    keys = mine.select("id", "row", "sketch", F.explode("lefts").alias("x"), "rights").select("id", "row", "sketch", "x", F.explode("rights").alias("y"))
    keys = written(keys.select("id", "row", "sketch", F.xxhash64("x.h", "y.h").alias("key"), (F.col("x.slot") * m + F.col("y.slot") - m).alias("slot")), "keys")
    rank = F.struct(F.xxhash64("id", "key").alias("r"), F.col("id").alias("rep"), F.col("sketch").alias("rep_sketch"))
    shared = keys.groupBy("key").agg(F.min(rank).alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "m.rep", "m.rep_sketch")
    like = F.when(F.col("id") != F.col("rep"), _agreeing(F.col("sketch"), F.col("rep_sketch")))
    members = written(keys.join(shared, "key").select("key", "slot", "id", "row", "rep", like.alias("like")), "members")

    sets = written(_sets(docs, members.select("row"), words), "sets")
    best = F.slice(F.sort_array(F.collect_set(F.struct("like", "rep")), asc=False), 1, FIRST_REPS)
    pairs = members.where(F.col("like") >= agree).groupBy("id").agg(best.alias("r")).select(F.col("id").alias("a"), F.explode("r.rep").alias("b"))
    links = written(_confirmed(pairs, sets, num, den), "links")
    groups = connected_components(links)

    at = members.select("key", "slot", "id").join(_small(groups), "id", "left").select("key", "slot", "id", F.coalesce("component_id", "id").alias("c"))
    split = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
    pairs = _across(at.join(split, "key"), nodes.drop("row"), _prefixes(sets, num, den), m, agree, num, den)
    groups = connected_components(written(links.union(_confirmed(pairs, sets, num, den)), "all_links"))

    of = nodes.select("id", F.col("id.digest").alias("digest")).join(_small(groups), "id", "left").select("digest", F.coalesce("component_id", "id")["low"].alias("component_id"))
    out = full.select("doc_id", "n_shingles", "copy", "digest").join(of, "digest")
    alone = sketched.where("not (n_shingles > 0 and doc_id is not null)").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"), F.lower(F.hex("copy")).alias("text_md5")]
    return out.select(*columns).unionByName(alone.select(*columns))


def _identity(doc_id: Column, text_md5: Column) -> Column:
    """128 bits of a row's doc_id and text, nulls told apart from texts."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text_md5, F.lit("null"))))


def without_duplicates(docs: DataFrame, num: int = 80, den: int = 100, words: int = 5) -> DataFrame:
    """``docs``, whole rows with all their columns: of each group of near duplicates only the least doc_id's.

    Rows that repeat both doc_id and text stay once (the first by their JSON); rows that repeat a doc_id with another
    text are judged by it; rows without words, and those with a null doc_id, are no duplicates of other rows.
    """
    found = near_duplicates(docs, num, den, words).select("kept", _identity(F.col("doc_id"), F.col("text_md5")).alias("gone"))
    odd = _small(written(found.groupBy("gone").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1"), "odd"))
    rows = docs.select(F.struct("*").alias("_doc"), _identity(F.col("doc_id"), F.md5(F.col("text").cast("string"))).alias("_key"))
    once = rows.join(odd.where("kept"), F.col("_key") == F.col("gone"), "left_semi").groupBy("_key").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))
    alone = rows.join(odd, F.col("_key") == F.col("gone"), "left_anti")
    return alone.select("_doc").unionByName(once.select("_doc")).select("_doc.*")
