"""Closures over edge tables ``(src, dst)``, in a number of rounds that goes with the logarithm of the depth."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import new_path

ROUNDS = 1000  # the greatest depth of a closure
SHALLOW = 4  # levels that are taken one by one before ways of 2, 4, 8 ... edges are laid
CORE = 1 << 18  # edges that are left to doubling when chains are contracted
WIDE = 16  # ways of a length are laid while they are at most so many times the edges


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends, and Spark plans by the size that it has.

    A checkpoint keeps the size that Spark expected, for a join the product of both sides'.  In rounds that join what the
    round before joined, that number's digits double each time, until it fills the driver's memory by itself.
    """
    path = new_path(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _squares(edges: DataFrame, longest: int, bound: int | None = None) -> Iterator[tuple[int, DataFrame | None]]:
    """``(length, ways)``: pairs ``(src, dst)`` joined by a way of exactly 1, 2, 4 ... edges, up to ``longest`` edges.

    Ends where there is no way of that length, or, with None for ways, where its pairs are more than ``bound``.
    """
    ways, length = edges, 1
    while length <= longest:
        n = ways.count()
        if not n:
            return
        if bound is not None and length > 1 and n > bound:
            yield length, None
            return
        yield length, ways
        after = ways.select(F.col("src").alias("_at"), F.col("dst").alias("_to"))
        ways, length = cut(ways.join(after, F.col("dst") == F.col("_at")).select("src", F.col("_to").alias("dst")).distinct()), 2 * length


def _further(seen: DataFrame, ways: DataFrame, length: int) -> DataFrame:
    """``seen(node, depth)`` and what lies a way of ``length`` edges further, each at its least depth."""
    found = seen.join(ways, seen["node"] == ways["src"]).select(F.col("dst").alias("node"), (F.col("depth") + length).alias("depth"))
    return cut(seen.unionByName(found).groupBy("node").agg(F.min("depth").alias("depth")))


def closure(edges: DataFrame, roots: DataFrame, transitive: bool = True) -> DataFrame:
    """``node, depth`` reached from ``roots(node)`` by at most ROUNDS edges, each at its least depth.

    Not transitive: roots and their direct references.  The first levels are taken one by one, which ends most graphs.
    Deeper ones are closed by doubling: ways of 1, 2, 4 ... edges are each followed once, which reaches every depth, as
    a depth is a sum of such lengths and the start of a least way is a least way.  Where the ways of a length are more
    than WIDE times the edges, the longest ones that are not are followed until nothing is new.  Cycles are allowed.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = cut(roots.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, (SHALLOW if transitive else 1) + 1):
        found = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    if not transitive:
        return seen
    seen, last = cut(seen), edges
    for length, ways in _squares(edges, ROUNDS, WIDE * edges.count()):
        if ways is not None:
            seen, last = _further(seen, ways, length), ways
            continue
        reached, before = length, None  # all depths below are there; half that length is the stride
        while reached <= ROUNDS and before != (before := seen.agg(F.count(F.lit(1)), F.sum("depth")).first()):
            seen, reached = _further(seen, last, length // 2), reached + length // 2
    return seen.where(F.col("depth") <= ROUNDS)


def affected(edges: DataFrame, changed: DataFrame, transitive: bool = True) -> DataFrame:
    """``node`` of everything that depends on ``changed(node)``; not transitive: an inner class brings in its top-level class."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = closure(back, changed, transitive).select("node")
    if transitive:
        return found.distinct()
    return found.select(F.explode(F.array_distinct(F.array("node", F.substring_index("node", "$", 1)))).alias("node")).distinct()


def _counted(edges: DataFrame) -> DataFrame:
    """Each pair ``src, dst`` once, with its greatest ``len``, and ``n``: the edges from src; one shuffle for both."""
    pairs = edges.repartition("src").groupBy("src", "dst").agg(F.max("len").alias("len"))
    return cut(pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("src"))))


def _contracted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(rest, gone)``: edges as ``_counted`` after nodes were taken out, and each round's edges of the nodes taken out.

    A node with one edge is taken out where its coin falls heads and tails for what that edge leads to; edges into it
    then lead there, longer by its own.  A chain loses a quarter of its nodes a round, so all rounds together do the
    work of four.  Ends at CORE edges, or where a round takes out less than one in twenty.
    """
    gone, before = [], None
    while (left := edges.count()) > CORE and (before is None or left <= 0.95 * before):
        coin = lambda c, k=len(gone): F.xxhash64(c, F.lit(k)) % 2 == 0
        out = (F.col("n") == 1) & coin("src") & ~coin("dst")
        gone.append(edges.where(out).select("src", "dst", "len"))
        on = gone[-1].select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.col("len").alias("_more"))
        rest = edges.where(~out).join(on, F.col("dst") == F.col("_at"), "left")
        edges, before = _counted(rest.select("src", F.coalesce("_to", "dst").alias("dst"), (F.col("len") + F.coalesce("_more", F.lit(0))).alias("len"))), left
    return edges, gone


def _longest(edges: DataFrame) -> DataFrame:
    """``node, dit``: longest way from each node of ``edges(src, dst, len)``, by doubling; null where ways do not end."""
    ways, length = edges.select("src", "dst", "len"), 1
    found = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.lit(0).cast("long").alias("dit"), F.lit(0).cast("long").alias("edges")))
    nodes = found.count()
    while length <= nodes and not ways.isEmpty():
        beyond = ways.join(found, ways["dst"] == found["node"]).select(F.col("src").alias("node"), (F.col("dit") + F.col("len")).alias("dit"), (F.col("edges") + length).alias("edges"))
        found = cut(found.unionByName(beyond).groupBy("node").agg(F.max("dit").alias("dit"), F.max("edges").alias("edges")))
        after = ways.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.col("len").alias("_more"))
        pairs = ways.join(after, F.col("dst") == F.col("_at")).select("src", F.col("_to").alias("dst"), (F.col("len") + F.col("_more")).alias("len"))
        ways, length = cut(pairs.groupBy("src", "dst").agg(F.max("len").alias("len"))), 2 * length
    return found.select("node", F.when(F.col("edges") < max(nodes, 1), F.col("dit")).alias("dit"))  # a way of as many edges as there are nodes meets one twice


def inheritance(edges: DataFrame) -> DataFrame:
    """``node, dit, noc``: longest way to a root along ``src extends dst``, and number of direct children.

    Nodes with one parent are taken out first, by rounds whose work adds up to a few times the edges, however deep the
    chains.  In what is left longest ways double: one of less than 2^(k+1) edges is one of less than 2^k, or a way of 2^k
    edges and one of less than 2^k from there; there is no cap.  What was taken out then follows its parent, last round
    first.  From a cycle, and from what leads into one, ways do not end: these nodes are left out (their ways are laid all
    the same: up to the square of a cycle's nodes).
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    core, gone = _contracted(_counted(edges.withColumn("len", F.lit(1).cast("long"))))
    found = _longest(core)
    for taken in reversed(gone):  # a parent that is not found yet has no parent itself
        above = found.select(F.col("node").alias("_of"), F.col("dit").alias("_dit"))
        told = taken.join(above, F.col("dst") == F.col("_of"), "left")
        found = found.unionByName(cut(told.select(F.col("src").alias("node"), F.when(F.col("_of").isNull(), F.col("len")).otherwise(F.col("_dit") + F.col("len")).alias("dit"))))
    children = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("noc"))
    nodes = edges.select(F.col("src").alias("node")).unionByName(children.select("node")).distinct()
    found = nodes.join(found.withColumn("_seen", F.lit(True)), "node", "left").where("_seen is null or dit is not null")
    return found.join(children, "node", "left").select("node", F.coalesce("dit", F.lit(0)).cast("int").alias("dit"), F.coalesce("noc", F.lit(0)).alias("noc"))


def containers(wanted: DataFrame, holdings: DataFrame) -> DataFrame:
    """``name, container``: of ``holdings(name, container, path_ordinal)`` the first on the path that holds the name."""
    return wanted.select("name").distinct().join(holdings, "name").groupBy("name").agg(F.min_by("container", "path_ordinal").alias("container"))
