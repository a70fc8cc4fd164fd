"""Reports over metric rows: summaries, validation, comparison, roll-up, coupling, inheritance, change history, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import carry_forward, running_sum


def summary(metrics: DataFrame) -> DataFrame:
    """One row: classes, average npm and loc (two places, null when empty), total loc."""
    return metrics.agg(F.count(F.lit(1)).alias("classes"), F.round(F.avg("npm"), 2).alias("avg_npm"), F.round(F.avg("loc"), 2).alias("avg_loc"), F.sum("loc").alias("total_loc"))


def validate(metrics: DataFrame, base: DataFrame, tolerance: float = 0.05, columns: tuple[str, ...] = ("npm", "loc")) -> DataFrame:
    """``name`` with a status: missing, extra, outside or ok, by relative deviation from the baseline."""
    m = metrics.select("name", *[F.col(c).alias(f"m_{c}") for c in columns], F.lit(True).alias("m_in"))
    b = base.select("name", *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("b_in"))
    near = F.lit(True)
    for c in columns:
        near = near & (F.abs(F.col(f"m_{c}") - F.col(f"b_{c}")) <= F.col(f"b_{c}") * tolerance)
    status = F.when(F.col("m_in").isNull(), "missing").when(F.col("b_in").isNull(), "extra").when(near, "ok").otherwise("outside")
    return m.join(b, "name", "full_outer").select("name", status.alias("status"))


def compare_releases(metrics: DataFrame, a: int, b: int, key: str = "name") -> DataFrame:
    """``key, loc_a, loc_b, change`` of what either release has."""
    one = metrics.where(F.col("release") == a).groupBy(key).agg(F.sum("loc").alias("loc_a"))
    two = metrics.where(F.col("release") == b).groupBy(key).agg(F.sum("loc").alias("loc_b"))
    change = F.coalesce("loc_b", F.lit(0)) - F.coalesce("loc_a", F.lit(0))
    return one.join(two, key, "full_outer").select(key, "loc_a", "loc_b", change.alias("change"))


def rollup_metrics(metrics: DataFrame, levels: list[str]) -> DataFrame:
    """Sums at every level of the hierarchy, with ``level`` (0: the finest) from the grouping id."""
    return metrics.rollup(*levels).agg(F.sum("npm").alias("npm"), F.sum("loc").alias("loc"), F.count(F.lit(1)).alias("classes"), F.bit_count(F.grouping_id()).alias("level"))


def class_complexity(types: DataFrame) -> DataFrame:
    """wmc, max_cc and avg_cc over direct methods; a type without methods has 0."""
    return types.select("path", "name", F.col("own_wmc").alias("wmc"), F.col("own_max").alias("max_cc"), F.round(F.when(F.col("own_n") > 0, F.col("own_wmc") / F.col("own_n")).otherwise(0.0), 4).alias("avg_cc"))


def coupling(edges: DataFrame) -> DataFrame:
    """``node, ca, ce``: distinct users of it, distinct things it uses."""
    ca = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("ca"))
    ce = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("ce"))
    return ca.join(ce, "node", "full_outer").select("node", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))


def change_sets(log: DataFrame) -> DataFrame:
    """Entries of equal date, author and comment as one, with their files in order."""
    return log.groupBy("date", "author", "comment").agg(F.sort_array(F.collect_list(F.struct("file", "revision", "prev_revision"))).alias("files"))


def dated_between(log: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    out = log.where("date is not null")
    out = out if start is None else out.where(F.col("date") >= start)
    return out if end is None else out.where(F.col("date") <= end)


def display_authors(log: DataFrame, names: DataFrame, author: str, key: str, name: str) -> DataFrame:
    """Author ids replaced by display names; unknown ids stay."""
    looked = names.select(F.col(key).alias("_k"), F.col(name).alias("_n"))
    return log.join(looked, F.col(author) == F.col("_k"), "left").withColumn(author, F.coalesce("_n", F.col(author).cast("string"))).drop("_k", "_n")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, version: Column) -> DataFrame:
    """``key, change``: added, removed or modified between two snapshots."""
    o, n = old.select(key, version.alias("o"), F.lit(True).alias("o_in")), new.select(key, version.alias("n"), F.lit(True).alias("n_in"))
    change = F.when(F.col("o_in").isNull(), "added").when(F.col("n_in").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "modified")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def parse_changelog(texts: DataFrame) -> DataFrame:
    """``doc_id, file, revision, date, author, comment`` from log text, a row for each revision block.

    A date in either ``yyyy/MM/dd HH:mm:ss`` or ``yyyy-MM-dd HH:mm:ss``; one in neither format is null.
    """
    block = texts.select("doc_id", F.posexplode(F.split("text", r"\n(?:-{20,}|={70,})\n?")).alias("b", "block"))
    file = F.nullif(F.regexp_extract("block", r"(?m)^Working file: (.*)$", 1), F.lit(""))
    w = Window.partitionBy("doc_id").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    block = block.withColumn("file", F.last(file, ignorenulls=True).over(w)).where(F.col("block").rlike(r"(?m)^revision "))
    stamp = F.regexp_extract("block", r"(?m)^date: ([^;]*);", 1)
    date = F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")))
    return block.select("doc_id", "file", F.regexp_extract("block", r"(?m)^revision (\S+)", 1).alias("revision"), date.alias("date"), F.regexp_extract("block", r"(?m)author: ([^;]*);", 1).alias("author"), F.regexp_extract("block", r"(?m)^date:.*\n([\s\S]*?)\s*\z", 1).alias("comment"))


def parse_changelog_lines(lines: DataFrame) -> DataFrame:
    """``path, file, revision, date, author, comment`` from ``lines(path, line_no, line)`` of logs of any size.

    As ``parse_changelog``, but a log is never one value or one task: each line takes the last separator and the last file
    from the lines before it, by ranges, and only the lines of one revision, from separator to separator, meet.
    """
    line = F.col("line")
    ends = line.rlike(r"^(?:-{20,}|={70,})$")
    file = F.when(line.startswith("Working file: "), F.substr(line, F.lit(15)))
    at = carry_forward(lines.select("path", "line_no", "line"), ["path"], ["line_no"], {"block": F.when(ends, F.col("line_no")), "file": file})
    first = lambda pattern: F.min_by(F.regexp_extract("line", pattern, 1), F.when(line.rlike(pattern), F.col("line_no")))
    dated = F.min(F.when(line.startswith("date: "), F.col("line_no")))
    blocks = at.where(~ends).groupBy("path", "block").agg(
        F.max_by("file", "line_no").alias("file"), first(r"^revision (\S+)").alias("revision"), first(r"^date: ([^;]*);").alias("stamp"), first(r"author: ([^;]*);").alias("author"),
        dated.alias("dated"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"),
    )
    said = F.array_join(F.transform(F.filter("rows", lambda r: r["line_no"] > F.col("dated")), lambda r: r["line"]), "\n")
    date = F.coalesce(F.try_to_timestamp("stamp", F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd HH:mm:ss")))
    comment = F.when(F.col("dated").isNull(), "").otherwise(F.regexp_replace(said, r"\s+\z", ""))
    return blocks.where("revision is not null").select("path", "file", "revision", date.alias("date"), F.coalesce("author", F.lit("")).alias("author"), comment.alias("comment"))


def infer_levels(outline: DataFrame) -> DataFrame:
    """``log, line_no, name, level, parent``: package, file, class or method of each element of an indented outline.

    ``outline(log, line_no, indent, name)``.  A name that ends in ``.java`` or ``.class`` is a file, one with parentheses a
    method.  Others are told by what encloses them: below a file, or below classes in a file, a class; else a package.
    parent is the line of the element that encloses it, the last one before it with a smaller indent.  Each element takes
    the last line of every smaller indent along, by ranges, so that one long log is many tasks; there is a column for
    each distinct indent, of which an outline has as many as it has levels.
    """
    kind = F.when(F.col("name").rlike(r"\.(?:java|class)$"), "file").when(F.col("name").contains("("), "method")
    indents = sorted(r[0] for r in outline.select("indent").distinct().collect())
    here = F.struct("line_no", kind.alias("kind"))
    last = {f"_{k}": F.when(F.col("indent") == i, here) for k, i in enumerate(indents)}
    rows = carry_forward(outline.select("log", "line_no", "indent", "name"), ["log"], ["line_no"], last, upto_here=False)
    above, open_, parent = F.lit(None).cast("string"), F.lit(-1).cast("long"), F.lit(None).cast("long")
    for k, i in enumerate(indents):  # outer to inner: what is still open is later than all that is further out
        c = F.col(f"_{k}")
        mine = c.isNotNull() & (F.col("indent") > i) & (c["line_no"] > open_)
        above, parent = F.when(mine & c["kind"].isNotNull(), c["kind"]).otherwise(above), F.when(mine, c["line_no"]).otherwise(parent)
        open_ = F.greatest(open_, F.when(F.col("indent") > i, c["line_no"]))
    level = F.coalesce(kind, F.when(above == "file", "class").otherwise("package"))
    return rows.select("log", "line_no", "name", level.alias("level"), parent.alias("parent"))


def rollup_methods(methods: DataFrame) -> DataFrame:
    """Sums over ``methods(package, path, class, method, cc)`` at four levels: methods, classes, files, packages, and the whole (level 4)."""
    return methods.rollup("package", "path", "class", "method").agg(F.sum("cc").alias("cc"), F.max("cc").alias("max_cc"), F.count(F.lit(1)).alias("n"), F.bit_count(F.grouping_id()).alias("level"))


def suite_summary(suites: DataFrame) -> DataFrame:
    return suites.groupBy("package").agg(F.sum("tests").alias("runs"), F.sum("failures").alias("failures"), F.sum("errors").alias("errors"), F.sum("seconds").alias("seconds"))


def violations(texts: DataFrame) -> DataFrame:
    """``file, line, message`` of ``file:line : message`` lines; other lines are dropped."""
    line = texts.select(F.explode(F.split("text", "\n")).alias("l"))
    pattern = r"^(.+?):(\d+) : (.*)$"
    return line.where(F.col("l").rlike(pattern)).select(F.regexp_extract("l", pattern, 1).alias("file"), F.regexp_extract("l", pattern, 2).cast("int").alias("line"), F.regexp_extract("l", pattern, 3).alias("message"))


def violation_counts(found: DataFrame) -> DataFrame:
    """Violations by file, and in total as the row with a null file."""
    return found.rollup("file").agg(F.count(F.lit(1)).alias("n"))


def concat_docs(rows: DataFrame, key: str, order: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """Texts of a key in order, one below the other, as ordered pieces: ``key, order, start, text``.

    start: where the text begins in the concatenation, in code points.  A key's concatenation is never one value or one
    task, however many rows it has; null texts are skipped, rows that tie in ``order`` follow by text.
    """
    kept = rows.where(F.col(text).isNotNull()).select(key, order, F.col(text).alias("text"))
    sized = kept.withColumn("_size", F.length("text").cast("long") + len(separator))
    return running_sum(sized, [key], [order, "text"], "_size", "start").select(key, order, "start", "text")


def write_concat(pieces: DataFrame, key: str, path: str, separator: str = "\n") -> None:
    """The concatenations that ``concat_docs`` places, as text: a folder for each key, its parts in order by name.

    Pieces are dealt by ranges of key and place, so that a key of any size is many parts; each text is followed by the
    separator.
    """
    placed = pieces.select(key, "start", F.col("text").alias("value"))
    placed.repartitionByRange(key, "start").sortWithinPartitions(key, "start").select(key, "value").write.partitionBy(key).text(path, lineSep=separator)
