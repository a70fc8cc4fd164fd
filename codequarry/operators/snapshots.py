"""Digests of a manifest's contents, kept from run to run in a versioned table."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FULL_EVERY = 16  # of so many versions one holds all names, the others what changed
SCHEMA = "name string, digest string"


def _sha(content: Column) -> Column:
    return F.sha2(content, 256)


def _folders(spark: SparkSession, path: str) -> list[tuple[int, int, bool]]:
    """``(version, version of the whole that it adds to, ended)`` of all folders below ``path``; Spark marks a folder when all its files are there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    found = [str(s.getPath().getName()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
    named = [(n, re.fullmatch(r"v(\d+)-(\d+)", n)) for n in found]
    return sorted((int(m[1]), int(m[2]), fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))) for n, m in named if m)


def _name(version: int, base: int) -> str:
    return f"v{version:08d}-{base:08d}"


def versions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """``(version, base)`` of the versions that readers see: from the last whole one on."""
    ended = [(v, base) for v, base, done in _folders(spark, path) if done]
    return [e for e in ended if e[1] == ended[-1][1]]


def kept_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``name, digest`` as the last version that ended has them; empty where there is none."""
    parts = [spark.read.schema(SCHEMA).parquet(f"{path}/{_name(*v)}").withColumn("_v", F.lit(v[0])) for v in versions(spark, path)]
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    newest = F.max(F.struct("_v", "digest"))
    return reduce(DataFrame.unionByName, parts).groupBy("name").agg(newest.alias("n")).select("name", "n.digest")


def modified_and_kept(current: DataFrame, path: str, digest: Callable[[Column], Column] = _sha) -> DataFrame:
    """``name, digest`` of the names whose content's digest is missing from the kept snapshot or unequal; these are then kept.

    A run writes a new version: what changed, or every so often all names.  Readers take the last version that ended, so
    a run that fails leaves the old one.  One run at a time may write.  Names that are no longer there stay kept; a null name is left out, a null content has a null digest, a name that is repeated counts
    with its greatest digest.
    """
    spark = current.sparkSession
    now = current.where("name is not null").groupBy("name").agg(F.max(digest(F.col("content"))).alias("digest"))
    old = kept_snapshot(spark, path)
    before = old.select(F.col("name").alias("_n"), F.col("digest").alias("_d"))
    both = now.join(before, F.col("name") == F.col("_n"), "full_outer")
    changed = F.col("name").isNotNull() & (F.col("_n").isNull() | ~F.col("digest").eqNullSafe(F.col("_d")))
    version = max((v for v, _, _ in _folders(spark, path)), default=0) + 1
    seen = versions(spark, path)
    whole = not seen or len(seen) >= FULL_EVERY
    folder = f"{path}/{_name(version, version if whole else seen[0][1])}"
    rows = both.select(F.coalesce("name", "_n").alias("name"), F.when(F.col("name").isNotNull(), F.col("digest")).otherwise(F.col("_d")).alias("digest"), changed.alias("changed"))
    (rows if whole else rows.where("changed")).write.parquet(folder)
    return spark.read.schema(f"{SCHEMA}, changed boolean").parquet(folder).where("changed").select("name", "digest")
