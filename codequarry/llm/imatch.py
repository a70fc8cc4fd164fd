"""Document fingerprints: I-Match over randomised lexicon subsets, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

WIDTH = 1024  # doc_ids of a bucket, in which the next document is looked up
SUBSETS, LEVELS = 16, 3
SMALL = 500_000
#: Lexicon band as shares of documents.  A document has a bounded mean number of distinct terms, so at most that
#: number / LOW terms reach LOW: the lexicon is bounded whatever the corpus, and may be broadcast.
LOW, HIGH = 0.002, 0.1


def term_hashes(text: Column) -> Column:
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``term``: hashes of the terms whose share of all documents lies in [low, high]."""
    n = docs.count()
    df = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return written(df.where(F.col("df").between(low * n, high * n)).select("term"), "lexicon")


def following_bucket(buckets: DataFrame) -> DataFrame:
    """``bucket, next_bucket``: the next lower one there is, after the lowest the highest.

    Buckets are dealt by ranges; only the ranges' first ones, as many as there are partitions, are put in one order.
    """
    ranged = written(buckets.repartitionByRange(F.col("bucket").desc()).withColumn("part", F.spark_partition_id()), "ranged")
    w = Window.orderBy("part")
    tops = ranged.groupBy("part").agg(F.max("bucket").alias("first"))
    tops = tops.select("part", F.coalesce(F.lead("first").over(w), F.first("first").over(w)).alias("beyond"))
    inside = F.lead("bucket").over(Window.partitionBy("part").orderBy(F.col("bucket").desc()))
    return ranged.withColumn("inside", inside).join(tops, "part").select("bucket", F.coalesce("inside", "beyond").alias("next_bucket"))


def with_next(rows: DataFrame, payload: list[str]) -> DataFrame:
    """``rows(doc_id, h, ...)`` with ``next_<c>`` of the document that follows by descending (doc_id, h), in a ring.

    Rows are dealt by ranges of doc_ids and move once; only the first row of each range is looked up apart.
    """
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("doc_id") / WIDTH), F.shiftright("h", 48) - (1 << 54)))  # null ids last, by hash
    firsts = rows.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", "h")).alias("m"))
    firsts = written(firsts.select("bucket", F.col("m.doc_id").alias("first_id"), F.col("m.h").alias("first_h")), "firsts")
    follow = following_bucket(firsts.select("bucket"))
    asked = follow.join(firsts.withColumnRenamed("bucket", "next_bucket"), "next_bucket").select(F.col("bucket").alias("asked_by"), "first_id", "first_h")
    asked = written(asked, "asked")
    asked = F.broadcast(asked) if asked.count() <= SMALL else asked
    beyond = rows.join(asked, rows["doc_id"].eqNullSafe(F.col("first_id")) & (rows["h"] == F.col("first_h"))).dropDuplicates(["asked_by"])
    beyond = beyond.select(F.col("asked_by").alias("bucket"), *[F.col(c).alias(f"_beyond_{c}") for c in payload])
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    led = rows.select("*", F.lead(F.lit(True)).over(w).alias("_more"), *[F.lead(c).over(w).alias(f"_in_{c}") for c in payload])
    nexts = [F.when(F.col("_more"), F.col(f"_in_{c}")).otherwise(F.col(f"_beyond_{c}")).alias(f"next_{c}") for c in payload]
    return led.join(beyond, "bucket").select(*rows.columns, *nexts)


def level_of(terms: Column) -> Column:
    """Sampling level at which one to two of a text's terms are expected in a subset."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size(terms), F.lit(1)).cast("double"))).cast("int"))


def signatures(terms: Column, level: Column) -> Column:
    """Hashes of the sorted terms in SUBSETS random subsets of the lexicon at each of LEVELS sampling rates.

    A subset at level j keeps the terms whose hash with the subset's number ends in j zero bits; 0 marks no term.
    """
    kept = lambda s, k, j: F.filter(s, lambda h: F.xxhash64(h, k).bitwiseAND(F.expr("1L") * F.pow(F.lit(2.0), j).cast("long") - 1) == 0)
    one = lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(F.xxhash64(s).cast("string").substr(-9, 9).cast("int"))
    firsts = F.transform(F.sequence(F.lit(1), F.lit(SUBSETS)), lambda k: F.struct(k.alias("k"), kept(terms, k, level).alias("s")))
    return F.flatten(F.transform(firsts, lambda f: F.array(*[one(f["s"] if not j else kept(f["s"], f["k"], level + j)) for j in range(LEVELS)])))


def likeness(a_level: Column, a: Column, b_level: Column, b: Column) -> Column:
    """Share of equal signatures among the subsets that either text has terms in, over the levels both have."""
    shift = a_level - b_level
    pairs = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS * LEVELS - 1)), lambda i: F.struct(F.get(a, i).alias("x"), F.when((i % LEVELS + shift).between(0, LEVELS - 1), F.get(b, i + shift)).alias("y")))
    both = F.filter(pairs, lambda p: p["y"].isNotNull() & ((p["x"] != 0) | (p["y"] != 0)))
    equal = F.size(F.filter(both, lambda p: p["x"] == p["y"]))
    return F.when(F.size(both) > 0, equal / F.size(both)).otherwise(0.0)


def fingerprint_text(level: Column, signature: Column, plain: Column) -> Column:
    """The level and the signatures in hex; of a text without lexicon terms its own hash, by its length."""
    digits = F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return F.when(F.exists(signature, lambda x: x != 0), F.concat(level.cast("string"), F.lit(":"), digits)).otherwise(F.concat(F.lit("t:"), F.lower(F.hex(plain))))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of each text and of its edited form: the last third replaced by the start of the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.  Terms (runs of
    letters and digits, lower-cased) whose document share lies in [low, high] form the lexicon; a fingerprint is the
    hashes of a text's sorted distinct terms in several random subsets of it, sampled so that each has a few.

    Null texts are empty.  Texts without a lexicon term are like only equal ones.  The next document is the next by
    descending doc_id, null last, rows that repeat a doc_id by the hash of their text; alone in its table, a document
    is followed by itself.  Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = lexicon(docs, low, high)
    few = words.count() <= SMALL
    words = words.union(docs.sparkSession.range(1).select(F.lit(-1).cast("long"))).toDF("term")
    words = F.broadcast(words) if few else words
    rows = with_next(docs.withColumn("h", F.xxhash64("text")), ["text"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("bucket", "doc_id", "h", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.select("bucket", "doc_id", "h", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("edited").alias("edited_h"), F.monotonically_increasing_id().alias("row"), term_hashes(F.col("text")).alias("own"), term_hashes(F.col("edited")).alias("other"))
    mark = lambda c: F.transform(F.concat(F.array(F.lit(-1).cast("long")), c), lambda t: t)
    flat = rows.select("bucket", "row", "doc_id", "h", "n_chars", "edited_sha256", "edited_h", F.explode(F.array(F.struct(F.lit(0).alias("which"), mark(F.col("own")).alias("t")), F.struct(F.lit(1).alias("which"), mark(F.col("other")).alias("t")))).alias("e"))
    flat = flat.select("bucket", "row", "doc_id", "h", "n_chars", "edited_sha256", "edited_h", "e.which", F.explode("e.t").alias("term")).join(words, "term")
    of = lambda k: F.array_sort(F.array_remove(F.collect_set(F.when(F.col("which") == k, F.col("term"))), -1))
    sets = flat.groupBy("bucket", "row").agg(*[F.first(c).alias(c) for c in ("doc_id", "h", "n_chars", "edited_sha256", "edited_h")], of(0).alias("own"), of(1).alias("other"))
    sets = sets.withColumns({"level": level_of(F.col("own")), "edited_level": level_of(F.col("other"))})
    sets = sets.select("doc_id", "h", "n_chars", "edited_sha256", "edited_h", "level", "edited_level", signatures(F.col("own"), F.col("level")).alias("sig"), signatures(F.col("other"), F.col("edited_level")).alias("edited_sig"))
    done = with_next(written(sets, "signatures"), ["h", "level", "sig"])
    alike = lambda lv, sig, h: F.when(F.col("h") == F.col(h), 1.0).otherwise(likeness(F.col("level"), F.col("sig"), F.col(lv), F.col(sig)))
    return done.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_text(F.col("level"), F.col("sig"), F.col("h")).alias("fingerprint"),
        fingerprint_text(F.col("edited_level"), F.col("edited_sig"), F.col("edited_h")).alias("edited_fingerprint"),
        alike("edited_level", "edited_sig", "edited_h").alias("near_edited"),
        alike("next_level", "next_sig", "next_h").alias("near_next"),
    )
