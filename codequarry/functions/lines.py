"""Line counts of source text, as folds over arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def trim(c: Column) -> Column:
    """Strip every character up to U+0020 at both ends."""
    return F.regexp_replace(c, BLANKS, "")


def _rest(t: Column) -> Column:
    """What follows the first ``*/``, trimmed."""
    return trim(F.substring(t, F.locate("*/", t) + 2, F.length(t)))


def _fold(lines: Column, after_close, opened_here, otherwise) -> Column:
    """Fold of (in_block, n); null lines give null."""
    state = lambda block, n: F.struct(block.alias("block"), n.alias("n"))
    no, yes = F.lit(False), F.lit(True)

    def step(a: Column, line: Column) -> Column:
        t = line
        closed = F.contains(t, F.lit("*/"))
        add = lambda cond: a["n"] + cond.cast("int")
        return (
            F.when(t == "", a)
            .when(a["block"] & ~closed, a)
            .when(a["block"], state(no, add(after_close(_rest(t)))))
            .when(F.startswith(t, F.lit("/*")) & ~closed, state(yes, a["n"]))
            .when(F.startswith(t, F.lit("/*")), state(no, add(opened_here(_rest(t)))))
            .otherwise(state(no, add(otherwise(t))))
        )

    return F.aggregate(F.transform(lines, trim), state(no, F.lit(0)), step, lambda a: a["n"])


def _is_code(r: Column) -> Column:
    return (r != "") & ~F.startswith(r, F.lit("//")) & ~F.startswith(r, F.lit("/*"))


def code_lines(lines: Column) -> Column:
    """Lines of code in an array of lines: blank, comment and star-led lines do not count; code after ``*/`` does."""
    return _fold(lines, _is_code, _is_code, lambda t: ~F.startswith(t, F.lit("//")) & ~F.startswith(t, F.lit("*")))


def simple_code_lines(text: Column) -> Column:
    """The simpler count over a text: nothing after a comment that opens a line counts, star-led lines do."""
    lines = F.split(text, "\r\n|\r|\n")
    return _fold(lines, lambda r: (r != "") & ~F.startswith(r, F.lit("//")), lambda r: F.lit(False), lambda t: ~F.startswith(t, F.lit("//")))


def physical_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)
