"""Text filters: functions from a text Column to a text Column, to be chained in one projection."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _whole_lines(text: Column) -> Column:
    """Lines up to each LF, with it."""
    return F.regexp_extract_all(text, F.lit("[^\n]*+\n|[^\n]+"), F.lit(0))


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _kept(lines: Column) -> Column:
    """Lines that have kept their ends, as one text."""
    return F.array_join(lines, "")


def head(text: Column, lines: int = 10, skip: int = 0) -> Column:
    """The first ``lines`` (0 or less: all) after ``skip``; LF, CR and CRLF end a line and stay with it."""
    body = line_tokens(text, keep_ends=True)
    skip = max(skip, 0)
    return _kept(F.slice(body, skip + 1, F.lit(lines) if lines > 0 else F.greatest(F.size(body), F.lit(1))))


def tail(text: Column, lines: int = 10, skip: int = 0) -> Column:
    """The last ``lines`` (-1: all) after the last ``skip`` lines are dropped; skipping more than there are gives nothing."""
    body = line_tokens(text, keep_ends=True)
    left = F.greatest(F.size(body) - max(skip, 0), F.lit(0))
    n = left if lines < 0 else F.least(left, F.lit(lines))
    return _kept(F.slice(body, left - n + 1, n))


def lines_containing(text: Column, *literals: str, negate: bool = False) -> Column:
    def keep(line: Column) -> Column:
        hit = reduce(lambda a, b: a & b, [F.contains(line, F.lit(x)) for x in literals])
        return ~hit if negate else hit

    return _kept(F.filter(_whole_lines(text), keep))


def lines_matching(text: Column, *patterns: str, negate: bool = False) -> Column:
    def keep(line: Column) -> Column:
        hit = reduce(lambda a, b: a & b, [line.rlike(p) for p in patterns])
        return ~hit if negate else hit

    return _kept(F.filter(_whole_lines(text), keep))


def strip_line_comments(text: Column, *prefixes: str) -> Column:
    return _kept(F.filter(_whole_lines(text), lambda line: ~reduce(lambda a, b: a | b, [F.startswith(line, F.lit(p)) for p in prefixes])))


def strip_java_comments(text: Column) -> Column:
    return F.regexp_replace(text, r'("(?:[^"\\]++|\\.)*+"|\'(?:[^\'\\]++|\\.)*+\')|/\*[\s\S]*?(?:\*/|\z)|//[^\n\r]*', "$1")


def strip_line_breaks(text: Column, chars: str = "\r\n") -> Column:
    return F.translate(text, chars, "")


def tabs_to_spaces(text: Column, n: int = 8) -> Column:
    return F.replace(text, F.lit("\t"), F.lit(" " * n))


def prefix_lines(text: Column, prefix: str) -> Column:
    return _kept(F.transform(_whole_lines(text), lambda line: F.concat(F.lit(prefix), line)))


def replace_tokens(text: Column, values: dict[str, Column], begin: str = "@", end: str = "@") -> Column:
    """``@key@`` by its value in one pass; unknown keys stay, values are not looked at again."""
    key = rf"{re.escape(begin)}(?:{'|'.join(map(re.escape, sorted(values, key=len, reverse=True)))}){re.escape(end)}"
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(begin + k + end), v.cast("string"))])
    pieces = F.zip_with(F.split(text, key, -1), F.regexp_extract_all(text, F.lit(key), F.lit(0)), lambda a, b: F.concat(a, F.coalesce(table[b], F.lit(""))))
    return F.array_join(pieces, "")


def resolve(values: dict[str, str], begin: str = "@", end: str = "@") -> dict[str, str]:
    """Expand keys inside values until nothing changes; a loop is an error."""
    def expand(key: str, seen: tuple[str, ...]) -> str:
        if key in seen:
            raise ValueError(f"infinite loop in tokens: {' -> '.join([*seen, key])}")
        return re.sub(rf"{re.escape(begin)}(\w+){re.escape(end)}", lambda m: expand(m[1], (*seen, key)) if m[1] in values else m[0], values[key])

    return {k: expand(k, ()) for k in values}


def filter_set(text: Column, values: dict[str, str], begin: str = "@", end: str = "@", recurse: bool = True) -> Column:
    values = resolve(values, begin, end) if recurse else values
    return replace_tokens(text, {k: F.lit(v) for k, v in values.items()}, begin, end)


def expand_properties(text: Column, values: dict[str, Column]) -> Column:
    return replace_tokens(text, values, "${", "}")


def escape_unicode(text: Column) -> Column:
    """Characters from U+0080 on as ``\\uXXXX`` in UTF-16 units."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        wide = F.concat(unit(F.shiftright(n - 0x10000, 10) + 0xD800), unit((n - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return F.when(n < 128, c).when(n < 0x10000, unit(n)).otherwise(wide)

    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def concat_text(text: Column, before: str = "", after: str = "") -> Column:
    return F.concat(F.lit(before), text, F.lit(after))


def replace_regex(text: Column, pattern: str, replacement: str, flags: str = "", by_line: bool = False) -> Column:
    """Flags g (else the first only), i, m, s; over the whole text or line by line."""
    inline = "".join(f for f in "ims" if f in flags)
    head = f"(?{inline})" if inline else ""

    def one(c: Column) -> Column:
        if "g" in flags:
            return F.regexp_replace(c, head + pattern, replacement)
        shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", replacement)
        return F.regexp_replace(c, rf"{head}\A([\s\S]*?)(?:{pattern})", f"$1{shifted}")

    return _joined(F.transform(_lines(text), one)) if by_line else one(text)


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def normalise_ends(text: Column, cr: str = "remove", eof: str = "asis", tab: str = "asis", width: int = 8) -> Column:
    """Line ends: cr ``remove`` drops every CR, ``add`` puts one before each LF and drops all others; 0x1A ``remove``, ``add`` or ``asis``.

    A 0x1A goes at the end of the text, and before a LF at its end with that LF, but not where the text has nothing else.
    tab ``remove`` expands tabs to stops of ``width`` columns, a power of two; ``add`` writes runs of two blanks or more
    with as many tabs as they reach stops.  Both drop blanks before line ends.
    """
    bare = F.replace(text, F.lit("\r"), F.lit("")) if cr in ("remove", "add") else text
    if cr == "add":
        bare = F.replace(bare, F.lit("\n"), F.lit("\r\n"))
    if tab in ("remove", "add"):
        if width < 2 or width & (width - 1):
            raise ValueError("width must be a power of two")
        bare = expand_tabs(F.regexp_replace(bare, r"(?<![ \t])[ \t]++(?=[\r\n]|\z)", ""), width)
        bare = _joined(F.transform(_lines(bare), lambda line: _tabbed(line, width))) if tab == "add" else bare
    if eof == "remove":
        return F.regexp_replace(bare, "(?s)(?<=.)\x1a\\n?\\z", "")
    return F.when(F.endswith(bare, F.lit("\x1a")), bare).otherwise(F.concat(bare, F.lit("\x1a"))) if eof == "add" else bare


def _tabbed(line: Column, width: int) -> Column:
    """The line with a tab for the blanks before each stop, where a run has two or more; no blanks may end it."""
    blank = F.lit(" ")

    def cells(c: Column) -> Column:
        many = lambda x, i: F.endswith(x, F.lit("  ")) | (F.endswith(x, blank) & F.startswith(F.get(c, i + 1), blank))
        return F.array_join(F.transform(c, lambda x, i: F.when((F.length(x) == width) & many(x, i), F.concat(F.rtrim(x), F.lit("\t"))).otherwise(x)), "")

    return F.transform(F.array(F.regexp_extract_all(line, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))), cells)[0]


def expand_tabs(text: Column, width: int = 8) -> Column:
    """Tabs to the next multiple of ``width`` columns, by line."""
    def line(c: Column) -> Column:
        cells = F.split(c, "\t", -1)
        last = F.size(cells) - 1
        return F.array_join(F.transform(cells, lambda x, i: F.when(i < last, F.rpad(x, ((F.length(x) / width).cast("int") + 1) * width, F.lit(" "))).otherwise(x)), "")

    return F.when(F.contains(text, F.lit("\t")), _joined(F.transform(_lines(text), line))).otherwise(text)


def line_tokens(text: Column, keep_ends: bool = False) -> Column:
    found = F.regexp_extract_all(text, F.lit("[^\r\n]*+(?:\r\n|\r|\n)|[^\r\n]+"), F.lit(0))
    return found if keep_ends else F.transform(found, lambda x: F.regexp_replace(x, "[\r\n]+\\z", ""))


def string_tokens(text: Column, delimiters: str | None = None, delimiters_are_tokens: bool = False) -> Column:
    chars = r"\s" if delimiters is None else re.escape(delimiters).replace("]", r"\]")
    pattern = f"[^{chars}]+|[{chars}]" if delimiters_are_tokens else f"[^{chars}]+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chain(text: Column, *steps) -> Column:
    """Apply functions of one text Column in order; one projection, no shuffle."""
    return reduce(lambda t, f: f(t), steps, text)


def census(text: Column) -> list[Column]:
    """n_chars, n_cr, n_lf, n_tab, and whether 0x1A ends the text."""
    count = lambda c: (F.length(text) - F.length(F.translate(text, c, ""))).cast("long")
    return [F.length(text).cast("long").alias("n_chars"), count("\r").alias("n_cr"), count("\n").alias("n_lf"), count("\t").alias("n_tab"), F.endswith(text, F.lit("\x1a")).alias("has_eof")]


def occurrences(text: Column, literal: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("long")
