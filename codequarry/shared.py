"""The shared folder that a cluster names for checkpoints, and what runs across range partitions: sums, last values, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the checkpoint folder that is set; with neither, one of our own where Spark runs on one machine.

    On a cluster without either this is an error: executors do not see each other's temporary folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-codequarry-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, so that its lineage ends and a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows of the same keys before, in order.

    Rows are dealt by ranges of keys and order, so that a hot key is many tasks; what comes before a range is a sum of
    sums, at most one row for each key and range.
    """
    ranged = cut(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    sums = sums.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in keys], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return within.join(sums, same).select(*rows.columns, (F.col("_inside") + F.col("_before")).alias(out))


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], upto_here: bool = True, backward: bool = False) -> DataFrame:
    """``rows`` with a column for each of ``values``: its last non-null value among the rows of the same keys up to here.

    ``upto_here=False`` leaves the row itself out (so that a value without nulls is that of the row before), ``backward``
    goes from the last row to the first.  Rows are dealt by ranges of keys and order, so that a hot key is many tasks.
    What comes from earlier ranges is one row for each range that begins within a key, at most as many as there are
    ranges, and is broadcast.
    """
    if not values:
        return rows
    turned = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    ranged = cut(rows.repartitionByRange(*keys, *turned).withColumn("_part", F.spark_partition_id())).withColumns({f"_v_{k}": v for k, v in values.items()})
    inside = Window.partitionBy("_part", *keys).orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0 if upto_here else -1)
    at = F.struct(*order)
    last = (lambda c: F.min_by(c, F.when(c.isNotNull(), at))) if backward else (lambda c: F.max_by(c, F.when(c.isNotNull(), at)))
    ends = ranged.groupBy(*keys, "_part").agg(*[last(F.col(f"_v_{k}")).alias(f"_e_{k}") for k in values])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in keys], F.count(F.lit(1)).over(before).alias("_earlier"), *[F.last(f"_e_{k}", ignorenulls=True).over(before).alias(f"_b_{k}") for k in values]).where("_earlier > 0")
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    within = ranged.withColumns({f"_i_{k}": F.last(f"_v_{k}", ignorenulls=True).over(inside) for k in values})
    return within.join(F.broadcast(carried), same, "left").select(*rows.columns, *[F.coalesce(f"_i_{k}", f"_b_{k}").alias(k) for k in values])


def global_rank(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``rows`` with ``out``: 1, 2, 3 ... in an order over all rows, by ranges and the numbers of rows in them."""
    return running_sum(rows.withColumn("_one", F.lit(1)), [], order, "_one", out).withColumn(out, (F.col(out) + 1).cast("long")).drop("_one")
