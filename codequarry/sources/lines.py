"""Files as tables of numbered lines, read in many splits; no file is ever one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut, running_sum

SMALL = 200_000  # splits, one row each, that may be broadcast


def scan_lines(spark: SparkSession, path: str, glob: str = "*", line_sep: str | None = None) -> DataFrame:
    """``path, line_no, line`` of the files below ``path``, line_no from 1.

    A file is read in as many splits as its size asks for.  Lines are numbered within their split and moved on by what
    the file's earlier splits hold, one row for each split.  Lines end at LF, CRLF or CR, or at ``line_sep`` alone; an
    end of line at the end of a file begins no further line, and an empty file has none.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    rows = (reader if line_sep is None else reader.option("lineSep", line_sep)).text(path)
    rows = cut(rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = cut(rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")))
    splits = splits.select("path", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1 - F.col("first")).alias("move"))
    splits = F.broadcast(splits) if splits.count() <= SMALL else splits
    return rows.join(splits, ["path", "block"]).select("path", (F.col("at") + F.col("move")).alias("line_no"), "line")


def head_lines(lines: DataFrame, lines_kept: int = 10, skip: int = 0) -> DataFrame:
    """The first lines of each file after ``skip``; 0 or less for all."""
    kept = lines.where(F.col("line_no") > skip)
    return kept.where(F.col("line_no") <= skip + lines_kept) if lines_kept > 0 else kept


def tail_lines(lines: DataFrame, lines_kept: int = 10, skip: int = 0) -> DataFrame:
    """The last lines of each file before the ``skip`` last ones; below 0 for all."""
    ends = lines.groupBy("path").agg((F.max("line_no") - skip).alias("_end"))
    kept = lines.join(ends, "path").where(F.col("line_no") <= F.col("_end"))
    return (kept.where(F.col("line_no") > F.col("_end") - lines_kept) if lines_kept >= 0 else kept).drop("_end")


def line_tokens(lines: DataFrame, tokenised: Column) -> DataFrame:
    """``path, position, token``: the tokens of each file's lines, numbered from 0 over the whole file."""
    found = lines.select("path", "line_no", tokenised.alias("_tokens")).where(F.size("_tokens") > 0).withColumn("_n", F.size("_tokens"))
    placed = running_sum(found, ["path"], ["line_no"], "_n", "_before")
    return placed.select("path", "_before", F.posexplode("_tokens").alias("_at", "token")).select("path", (F.col("_before") + F.col("_at")).alias("position"), "token")
