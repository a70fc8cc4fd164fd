"""Row predicates over manifest and text columns; every function returns a boolean Column.

A null argument gives null, so that a filter drops the row, unless a function says otherwise.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import running_sum

UNITS = {"": 1, "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12, "KI": 2**10, "MI": 2**20, "GI": 2**30, "TI": 2**40}
COMPARISONS = {
    "equal": lambda a, b: a == b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "greater": lambda a, b: a > b, "gt": lambda a, b: a > b,
    "more": lambda a, b: a > b, "less": lambda a, b: a < b, "lt": lambda a, b: a < b, "ge": lambda a, b: a >= b, "le": lambda a, b: a <= b,
}


def glob_regex(pattern: str) -> str:
    """``**`` any directories, ``*`` and ``?`` inside one name; a trailing ``/`` stands for all below."""
    if pattern.endswith("/"):
        pattern += "**"
    out, parts = "", pattern.split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += "(?:[^/]+(?:/[^/]+)*)?" if last else "(?:[^/]+/)*"
        else:
            out += "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part) + ("" if last else "/")
    return f"^{out.removesuffix('/(?:[^/]+(?:/[^/]+)*)?')}{'(?:/.*)?' if out.endswith('/(?:[^/]+(?:/[^/]+)*)?') else ''}$"


def glob(name: Column, pattern: str, case_sensitive: bool = True, negate: bool = False) -> Column:
    hit = name.rlike(("" if case_sensitive else "(?i)") + glob_regex(pattern))
    return ~hit if negate else hit


def pattern_set(name: Column, includes: list[str] = (), excludes: list[str] = (), case_sensitive: bool = True) -> Column:
    """Any include (none given: everything) and no exclude."""
    inside = reduce(or_, [glob(name, p, case_sensitive) for p in includes]) if includes else F.lit(True)
    return inside & ~reduce(or_, [glob(name, p, case_sensitive) for p in excludes]) if excludes else inside


def line_contains(text: Column, literal: str, case_sensitive: bool = True, ignore_whitespace: bool = False, is_dir: Column | None = None) -> Column:
    """Some line contains the literal; directories always pass."""
    def f(c: Column) -> Column:
        c = c if case_sensitive else F.lower(c)
        return F.regexp_replace(c, r"\s+", "") if ignore_whitespace else c

    hit = F.exists(F.split(text, "\n"), lambda line: F.contains(f(line), f(F.lit(literal))))
    return hit if is_dir is None else is_dir | hit


def line_matches(text: Column, pattern: str, is_dir: Column | None = None) -> Column:
    hit = F.exists(F.split(text, "\n"), lambda line: line.rlike(pattern))
    return hit if is_dir is None else is_dir | hit


def size_is(size: Column, value: int, units: str = "", when: str = "equal", is_dir: Column | None = None) -> Column:
    if value < 0:
        raise ValueError("a size must not be negative")
    hit = COMPARISONS[when](size, F.lit(value * UNITS[units.upper()]))
    return hit if is_dir is None else is_dir | hit


def time_is(stamp: Column, moment: Column, when: str, granularity_ms: int = 0) -> Column:
    """before: t - g < moment; after: t + g > moment; equal: within g of it."""
    t, m = F.unix_millis(stamp), F.unix_millis(moment)
    return {"before": t - granularity_ms < m, "after": t + granularity_ms > m, "equal": F.abs(t - m) <= granularity_ms}[when]


def moment_of(text: str, pattern: str = "MM/dd/yyyy hh:mm a") -> Column:
    """A time from its text; one that does not fit the pattern, or lies before 1970, is an error."""
    fits = F.try_to_timestamp(F.lit(text), F.lit(pattern))
    wrong = F.raise_error(F.lit(f"date of {text} cannot be parsed as {pattern}"))
    early = F.raise_error(F.lit(f"date of {text} lies before January 1, 1970, 00:00:00 GMT"))
    return F.when(fits.isNull(), wrong).when(F.unix_millis(fits) < 0, early).otherwise(fits).cast("timestamp")


def depth_below(path: Column, base: Column) -> Column:
    """Depth of a path below a base directory; a path that is not below it is an error."""
    inside = F.startswith(path, F.concat(F.rtrim(base, F.lit("/")), F.lit("/")))
    return F.when(inside, depth(path) - depth(base) - 1).otherwise(F.raise_error(F.concat(path, F.lit(" is not below "), base)).cast("int"))


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != "")) - 1


def depth_between(path: Column, least: int | None = None, most: int | None = None) -> Column:
    if least is None and most is None:
        raise ValueError("give a least or a most depth")
    tests = [depth(path) >= least] * (least is not None) + [depth(path) <= most] * (most is not None)
    return reduce(and_, tests)


def is_file(is_dir: Column) -> Column:
    return ~F.coalesce(is_dir, F.lit(False))


def exists(exist: Column) -> Column:
    return F.coalesce(exist, F.lit(True))


def all_of(*tests: Column) -> Column:
    return reduce(and_, tests, F.lit(True))


def any_of(*tests: Column) -> Column:
    return reduce(or_, tests, F.lit(False))


def none_of(*tests: Column) -> Column:
    return ~any_of(*tests)


def xor(*tests: Column) -> Column:
    return reduce(lambda a, b: a != b, tests)


def majority(*tests: Column, allow_tie: bool = True, empty: bool = False) -> Column:
    """More tests hold than fail; as many of both: ``allow_tie``; no test: ``empty``."""
    if not tests:
        return F.lit(empty)
    held = sum((t.cast("int") for t in tests), F.lit(0)) * 2
    return held >= len(tests) if allow_tie else held > len(tests)


def text_contains(text: Column, part: Column, case_sensitive: bool = True) -> Column:
    return F.contains(text, part) if case_sensitive else F.contains(F.lower(text), F.lower(part))


def text_equals(a: Column, b: Column, trim: bool = False, case_sensitive: bool = True) -> Column:
    f = lambda c: c if case_sensitive else F.lower(c)
    return f(F.trim(a)) == f(F.trim(b)) if trim else f(a) == f(b)


def text_matches(text: Column, pattern: str, case_sensitive: bool = True, multiline: bool = False, singleline: bool = False) -> Column:
    flags = "i" * (not case_sensitive) + "m" * multiline + "s" * singleline
    return text.rlike(f"(?{flags}){pattern}" if flags else pattern)


def restrict(rows: DataFrame, *tests: Column) -> DataFrame:
    """Rows that pass all tests."""
    return rows.filter(all_of(*tests))


def compare_with(rows: DataFrame, value: str, control: DataFrame, other: str, when: str = "less", quantifier: str = "all") -> DataFrame:
    """Rows whose value compares with all, any, one, most or none of the control's values.

    The distinct values of both sides are ordered by ranges, and the control's values below, at and above each of them
    are counted; rows find their counts by an equi-join.  An empty control: all and none hold.  Null values compare
    with nothing, so they are left out unless the control is empty and the quantifier is all or none.
    """
    both = rows.select(F.col(value).alias("_v"), F.lit(0).cast("long").alias("_n")).unionByName(control.select(F.col(other).alias("_v"), F.lit(1).cast("long").alias("_n")))
    values = running_sum(both.where("_v is not null").groupBy("_v").agg(F.sum("_n").alias("_at")), [], ["_v"], "_at", "_below")
    total = control.where(F.col(other).isNotNull()).agg(F.count(F.lit(1)).alias("_all"))  # one row
    joined = rows.crossJoin(F.broadcast(total)).join(values, F.col(value) == F.col("_v"), "left")
    below, at, every = F.col("_below"), F.col("_at"), F.col("_all")
    less, more = every - below - at, below  # of the control's values that the row's is less or more than
    n = {"less": less, "lt": less, "le": less + at, "greater": more, "gt": more, "more": more, "ge": more + at, "equal": at, "eq": at, "ne": every - at}[when]
    n = F.coalesce(n, F.when(every == 0, F.lit(0)))
    tests = {"all": n == every, "any": n > 0, "one": n == 1, "most": n * 2 > every, "none": n == 0}
    same = {"each": "all", "every": "all", "some": "any", "majority": "most"}
    return joined.where(tests[same.get(quantifier, quantifier)]).select(*rows.columns)
