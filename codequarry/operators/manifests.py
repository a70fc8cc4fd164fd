"""Snapshot joins and set algebra over manifests ``(name, exist, last_modified, is_dir, size, content, ordinal)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import COMPARISONS
from ..shared import global_rank


def _there(df: DataFrame) -> Column:
    return F.coalesce(df["exist"], F.lit(True))


def present(source: DataFrame, target: DataFrame, mapped: Column | None = None, present_in: str = "both") -> DataFrame:
    """Rows whose mapped name exists in the target (``both``) or does not (``srconly``); unmapped names are dropped."""
    names = target.where(_there(target)).select(F.col("name").alias("_target"))
    rows = source.withColumn("_mapped", F.col("name") if mapped is None else mapped).where("_mapped is not null")
    return rows.join(names, F.col("_mapped") == F.col("_target"), "left_semi" if present_in == "both" else "left_anti").drop("_mapped")


def _paired(source: DataFrame, target: DataFrame, mapped: Column | None = None) -> DataFrame:
    rows = source.withColumn("_mapped", F.col("name") if mapped is None else mapped).where("_mapped is not null")
    other = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns])
    return rows.join(other, F.col("_mapped") == F.col("t_name"), "left")


def different(source: DataFrame, target: DataFrame, ignore_times: bool = True, ignore_contents: bool = False, granularity_ms: int = 1000) -> DataFrame:
    """Rows that differ from their target in existence, size, time (beyond the granularity) or content."""
    p = _paired(source, target)
    here, there = F.coalesce("exist", F.lit(True)), F.col("t_name").isNotNull() & F.coalesce("t_exist", F.lit(True))
    apart = ~F.col("size").eqNullSafe(F.col("t_size"))
    if not ignore_times:
        apart = apart | (F.abs(F.unix_millis("last_modified") - F.unix_millis("t_last_modified")) > granularity_ms)
    if not ignore_contents:
        apart = apart | ~F.sha2("content", 256).eqNullSafe(F.sha2("t_content", 256))
    return p.where((here != there) | (here & there & apart)).select(*source.columns)


def out_of_date(source: DataFrame, target: DataFrame, mapped: Column | None = None, granularity_ms: int = 1000) -> DataFrame:
    """Existing source rows whose target is missing or older by more than the granularity."""
    p = _paired(source, target, mapped)
    there = F.col("t_name").isNotNull() & F.coalesce("t_exist", F.lit(True))
    older = F.unix_millis("last_modified") - granularity_ms > F.unix_millis("t_last_modified")
    return p.where(F.coalesce("exist", F.lit(True)) & (~there | older)).select(*source.columns)


def out_of_date_any(source: DataFrame, target: DataFrame, targets: Column, now: Column, granularity_ms: int = 1000) -> DataFrame:
    """Source rows with any of several mapped targets missing or older, and ``in_future`` for times after ``now``.

    A directory target is never older; rows that map to nothing are dropped.
    """
    rows = source.withColumn("_targets", targets).where(F.coalesce(F.size("_targets"), F.lit(0)) > 0).withColumn("_t", F.explode("_targets"))
    other = target.select(F.col("name").alias("t_name"), F.col("exist").alias("t_exist"), F.col("last_modified").alias("t_time"), F.col("is_dir").alias("t_dir"))
    joined = rows.join(other, F.col("_t") == F.col("t_name"), "left")
    missing = F.col("t_name").isNull() | ~F.coalesce("t_exist", F.lit(True))
    older = ~F.coalesce("t_dir", F.lit(False)) & (F.unix_millis("last_modified") - granularity_ms > F.unix_millis("t_time"))
    stale = joined.groupBy("name").agg(F.bool_or(missing | F.coalesce(older, F.lit(False))).alias("stale"), F.first("last_modified").alias("last_modified"))
    return stale.where("stale").select("name", (F.unix_millis("last_modified") - granularity_ms > F.unix_millis(now)).alias("in_future"))


def up_to_date(source: DataFrame, target: DataFrame) -> DataFrame:
    return out_of_date(source, target).agg((F.count(F.lit(1)) == 0).alias("up_to_date"))


def dependencies_fresh(sources: DataFrame, source_time: str, targets: DataFrame, target_time: str) -> DataFrame:
    """One row ``fresh``: no time is missing and the oldest target is not older than the newest source."""
    s = sources.agg(F.max(source_time).alias("s"), F.coalesce(F.bool_or(F.col(source_time).isNull()), F.lit(False)).alias("sm"))
    t = targets.agg(F.min(target_time).alias("t"), F.coalesce(F.bool_or(F.col(target_time).isNull()), F.lit(False)).alias("tm"))
    return s.join(F.broadcast(t)).select(F.when(F.col("sm") | F.col("tm"), False).otherwise(F.coalesce(F.col("t") >= F.col("s"), F.lit(True))).alias("fresh"))


def sync_plan(source: DataFrame, target: DataFrame, preserve: Column | None = None, granularity_ms: int = 1000) -> DataFrame:
    """``name, action``: copy (missing or stale in the target), remove (orphans not preserved), keep."""
    s = source.where(F.coalesce("exist", F.lit(True)) & ~F.coalesce("is_dir", F.lit(False))).select("name", F.unix_millis("last_modified").alias("s_time"))
    t = target.where(F.coalesce("exist", F.lit(True)) & ~F.coalesce("is_dir", F.lit(False))).select("name", F.unix_millis("last_modified").alias("t_time"), F.lit(True).alias("in_target"))
    both = s.withColumn("in_source", F.lit(True)).join(t, "name", "full_outer")
    kept = F.lit(False) if preserve is None else preserve
    action = F.when(F.col("in_source").isNull(), F.when(kept, "keep").otherwise("remove")).when(F.col("in_target").isNull() | (F.col("s_time") - granularity_ms > F.col("t_time")), "copy").otherwise("keep")
    return both.select("name", action.alias("action"))


def emptied_directories(plan: DataFrame) -> DataFrame:
    """Directories all of whose files the plan removes."""
    d = F.regexp_extract("name", r"^(.*)/[^/]*$", 1)
    return plan.groupBy(d.alias("dir")).agg(F.bool_and(F.col("action") == "remove").alias("gone")).where("gone").select("dir")


def modified_since(current: DataFrame, cached: DataFrame, digest=lambda c: F.sha2(c, 256)) -> DataFrame:
    """Names whose content's digest is missing from or unequal to the cached one."""
    c = cached.select(F.col("name").alias("_n"), digest(F.col("content")).alias("_d"))
    return current.select("name", digest(F.col("content")).alias("digest")).join(c, F.col("name") == F.col("_n"), "left").where(~F.col("digest").eqNullSafe(F.col("_d")) | F.col("_n").isNull()).select("name")


def contents_match(rows: DataFrame, group: list[str], content: str = "content") -> DataFrame:
    return rows.groupBy(*group).agg((F.count_distinct(F.sha2(content, 256)) <= 1).alias("all_match"))


def verify_digests(rows: DataFrame, recorded: DataFrame, algorithm=F.md5) -> DataFrame:
    """``name, ok`` of every recorded checksum; a name without content is not ok."""
    now = rows.select("name", algorithm(F.col("content")).alias("now"))
    return recorded.join(now, "name", "left").select("name", F.coalesce(F.col("now") == F.col("checksum"), F.lit(False)).alias("ok"))


def union_distinct(frames: list[DataFrame], key: list[str], ordinal: str) -> DataFrame:
    """Distinct rows of all frames by ``key``; first-seen order as ``first_seen`` (branch, ordinal)."""
    tagged = [f.withColumn("_branch", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, tagged).groupBy(*key).agg(F.min(F.struct("_branch", ordinal)).alias("first_seen"))


def intersect_all(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of the first frame, repeats kept, whose key is in every other frame."""
    if len(frames) < 2:
        raise ValueError("intersect needs at least two inputs")
    out = frames[0]
    for f in frames[1:]:
        other = f.select(*[F.col(k).alias(f"_{k}") for k in key])
        out = out.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]), "left_semi")
    return out


def difference(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Keys that occur exactly once over all frames."""
    if len(frames) < 2:
        raise ValueError("difference needs at least two inputs")
    return reduce(DataFrame.unionByName, [f.select(*key) for f in frames]).groupBy(*key).count().where("count = 1").select(*key)


def first_rows(rows: DataFrame, n: int = 1, ordinal: str = "ordinal") -> DataFrame:
    if n < 0:
        raise ValueError("the count must not be negative")
    return rows.orderBy(ordinal).limit(n)


COMPARATORS = {
    "name": lambda: F.col("name"), "size": lambda: F.coalesce("size", F.lit(0)), "date": lambda: F.coalesce(F.unix_millis("last_modified"), F.lit(0)),
    "type": lambda: F.coalesce("is_dir", F.lit(False)), "exists": lambda: F.coalesce("exist", F.lit(True)), "content": lambda: F.col("content"),
}


def sort_keys(*comparators: str, ordinal: str = "ordinal") -> list[Column]:
    """Sort keys by comparator name, ``-`` in front reverses one; then the ordinal, so that the order is total."""
    keys = [COMPARATORS[c.lstrip("-")]() for c in comparators or ("name",)]
    return [*(k.desc() if c.startswith("-") else k.asc() for k, c in zip(keys, comparators or ("name",))), F.col(ordinal).asc()]


def sort_ranks(rows: DataFrame, *comparators: str, ordinal: str = "ordinal", out: str = "rank") -> DataFrame:
    """``rows`` with their places 1, 2, 3 ... in the order of ``sort_keys`` over all rows, by ranges."""
    return global_rank(rows, sort_keys(*comparators, ordinal=ordinal), out)


def representatives(rows: DataFrame, *comparators: str, ordinal: str = "ordinal") -> DataFrame:
    """Bag sort: rows that tie under the comparators all appear as the first of them."""
    w = Window.partitionBy(*[COMPARATORS[c.lstrip("-")]() for c in comparators]).orderBy(ordinal)
    return rows.withColumn("name", F.first("name").over(w))


def tokens(rows: DataFrame, key: str, tokenised: Column) -> DataFrame:
    return rows.select(key, F.posexplode(tokenised).alias("position", "token"))


def concatenated(frames: list[DataFrame]) -> DataFrame:
    """All rows in order, repeats kept; ``branch`` numbers the frames."""
    return reduce(DataFrame.unionByName, [f.withColumn("branch", F.lit(i)) for i, f in enumerate(frames)])


def property_subset(rows: DataFrame, key: str, exact: list[str] = (), prefix: str | None = None, regex: str | None = None, negate: bool = False, mapped: Column | None = None) -> DataFrame:
    k = F.col(key)
    tests = ([k.isin(list(exact))] if exact else []) + ([k.startswith(prefix)] if prefix is not None else []) + ([k.rlike(regex)] if regex else [])
    hit = reduce(lambda a, b: a | b, tests) if tests else F.lit(True)
    out = rows.where(~hit if negate else hit)
    return out if mapped is None else out.withColumn(key, F.coalesce(mapped, k))


def length_each(rows: DataFrame) -> DataFrame:
    return rows.select("name", F.when(F.coalesce("exist", F.lit(True)) & ~F.coalesce("is_dir", F.lit(False)), F.col("size")).alias("length"))


def length_text(text: Column, trim: bool = False) -> Column:
    """Length in characters; ``trim`` strips every character up to U+0020 at both ends first."""
    return F.length(F.regexp_replace(text, r"^[\x00-\x20]++|[\x00-\x20]+$", "") if trim else text).cast("long")


def length_is(length: Column, threshold: int, when: str = "equal") -> Column:
    """The condition form: a length against a threshold."""
    return COMPARISONS[when](length, F.lit(threshold))


def length_all(rows: DataFrame) -> DataFrame:
    return length_each(rows).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
