"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; a target stops at
    cap times its source's size and the excess is shared anew by weight.  With sources ordered by cap * size / weight
    the capped ones are a prefix: its end is where the common level no longer reaches the next one's cap.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    s = sources.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[turn]).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.encode("source", "UTF-8"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("share", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("free", F.col("share") * F.col("weight") <= F.col("cap"))
    rate = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("share")))).over(everything)["share"]
    return s.select("source", "source_size", F.round(F.least("cap", F.coalesce(rate * F.col("weight"), F.col("cap"))), 6).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Seats of each party by highest quotients votes / (2 s + 1), within each group; ties go by key.

    Only quotients near the cut are listed: rounding votes * seats / total differs from the quota by less than the
    number of parties in the group, so all below that are granted at once and the rest are ranked.
    """
    g = Window.partitionBy(*group)
    p = parties.withColumn("_all", F.sum(votes).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    sure = F.greatest(F.lit(0).cast("long"), F.floor(F.col(votes) * F.col(seats) / F.col("_all")) - F.col("_n"))
    p = p.withColumn("_sure", F.when(F.col("_all") > 0, sure).otherwise(0)).withColumn("_left", F.col(seats) - F.sum("_sure").over(g))
    listed = p.where("_left > 0").select(*group, *key, "_left", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.least("_left", F.col("_n") * 2 + 1)), lambda s: F.col(votes) / ((F.col("_sure") + s) * 2 + 1))).alias("_q"))
    rank = F.row_number().over(g.orderBy(F.col("_q").desc(), *key))
    won = listed.withColumn("_rank", rank).where("_rank <= _left").groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_won"))
    won = won.select("_won", *[F.col(c).alias(f"_of_{c}") for c in (*group, *key)])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, *key)]
    return p.join(won, same, "left").select(*parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(out))


def mix_sources(docs: DataFrame, weights: list[float] = (5, 2, 1), cap: int = 3, block_tokens: int = 100, shard_tokens: int = 250_000, max_shards: int = 4096, seed: str = "mix-1") -> DataFrame:
    """How many words the mix takes of each document: ``doc_id, size, source_size, target, taken``.

    The total is cut into blocks of ``block_tokens`` words.  Sainte-Laguë apportionment gives each source its number
    of blocks by its target, and each shard of a source (a hash of the doc_id, so that no source is one task) its
    number by its words.  A shard's documents stand in a seeded order; its quota is laid along that order, round and
    round, never beyond cap times, so whole passes repeat every document and the last pass ends inside one.

    Null texts have size 0; a null source is a source of its own, ordered last; rows that repeat a doc_id each count.
    Null doc_ids are one shard.  An empty table gives an empty result; further columns are ignored.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("draw"))
    rows = written(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = written(targets(sources, list(weights), cap), "targets")
    total = aims.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    blocks = -(-total // block_tokens)
    quotas = sainte_lague(aims.withColumn("one", F.lit(1)).withColumn("seats", F.lit(blocks).cast("long")), ["one"], ["source"], "target", "seats", "source_blocks")
    plan = quotas.select("source", "source_size", "target", "source_blocks", F.least(F.lit(max_shards), F.ceil(F.col("source_size") / shard_tokens)).alias("shards"))
    plan = written(plan.withColumn("shards", F.greatest(F.lit(1), F.col("shards"))), "quotas")
    number = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    plan = plan.withColumnRenamed("source", "of")
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "draw", "source_size", "target", "source_blocks", F.pmod(number, F.col("shards")).alias("shard"))
    placed = written(placed, "placed")
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("source_blocks").alias("source_blocks"))
    shards = written(sainte_lague(shards, ["source"], ["shard"], "shard_size", "source_blocks", "shard_blocks"), "shards").select(F.col("source").alias("s"), F.col("shard").alias("h"), "shard_size", "shard_blocks")
    w = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))
    laid = laid.join(shards, laid["source"].eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    words = F.least(F.col("shard_blocks") * block_tokens, F.col("shard_size") * cap)
    passes = F.when(F.col("shard_size") > 0, F.floor(words / F.greatest(F.col("shard_size"), F.lit(1)))).otherwise(0)
    rest = words - passes * F.col("shard_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return laid.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
