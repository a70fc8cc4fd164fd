"""Connected components of an edge table, by repeated contraction towards random local minima."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import written

LOCAL = 500_000  # edges that one task may hold; more are contracted first


def _hashable(column: pa.Array) -> list:
    return list(zip(*(part.to_pylist() for part in column.flatten()))) if pa.types.is_struct(column.type) else column.to_pylist()


def _union_find(batches):
    above: dict = {}

    def root(x):
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    kind = None
    for b in batches:
        kind = b.column(0).type
        for x, y in zip(_hashable(b.column(0)), _hashable(b.column(1))):
            x, y = root(x), root(y)
            above[max(x, y)] = min(x, y)
    if kind is None:
        return
    ends = [list(above), [root(x) for x in above]]
    if pa.types.is_struct(kind):
        names, types = [f.name for f in kind], [f.type for f in kind]
        columns = [pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*e), types)], names) for e in ends]
    else:
        columns = [pa.array(e, kind) for e in ends]
    yield pa.RecordBatch.from_arrays(columns, ["id", "component_id"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` of longs or of flat structs to ``(id, component_id)``: the smallest id that each end reaches.

    While there are more than LOCAL edges, every node moves to the neighbour (or itself) with the least random rank, and
    edges are renamed and made distinct, so that the number of nodes shrinks geometrically whatever the shape of the
    graph; one task joins up what is left, at most LOCAL edges.  Hubs are aggregated before the shuffle.  Ids without
    an edge are not in the result; loops, repeated edges and an empty table are allowed, rows with a null end are
    ignored.  ``edges`` is read twice: give a written table.
    """
    kind = edges.schema["a"].dataType.simpleString()
    live, labels, turn = edges.where("a <> b"), None, 0
    while live.count() > LOCAL:
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("r"), F.col(c).alias("to"))
        both = live.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        moves = written(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("old"), F.least(F.col("m"), rank("a"))["to"].alias("new")), "moves")
        for end in ("a", "b"):
            live = live.join(moves, live[end] == moves["old"]).drop(end, "old").withColumnRenamed("new", end)
        live = written(live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        labels = moves.toDF("id", "at") if labels is None else written(labels.join(moves, F.col("at") == F.col("old"), "left").select("id", F.coalesce("new", "at").alias("at")), "labels")
    roots = live.coalesce(1).mapInArrow(_union_find, f"id {kind}, component_id {kind}")
    if labels is None:
        return written(roots, "groups")
    roots = written(roots.toDF("old", "new"), "roots")
    labels = written(labels.join(roots, F.col("at") == F.col("old"), "left").select("id", F.coalesce("new", "at").alias("at")), "labels")
    least = labels.groupBy("at").agg(F.min("id").alias("component_id"))
    return written(labels.join(least, "at").select("id", "component_id"), "groups")
