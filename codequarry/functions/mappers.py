"""Name mappers (Column to Column, null where a name does not match), digests, versions and times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_map(name: Column, source: str, target: str, case_sensitive: bool = True) -> Column:
    """One ``*`` in each pattern stands for the same text."""
    if "*" not in source:
        test = name == source if case_sensitive else F.lower(name) == source.lower()
        return F.when(test, F.lit(target))
    pre, post = source.split("*", 1)
    x = name if case_sensitive else F.lower(name)
    p, q = (pre, post) if case_sensitive else (pre.lower(), post.lower())
    ok = F.startswith(x, F.lit(p)) & F.endswith(x, F.lit(q)) & (F.length(name) >= len(pre) + len(post))
    middle = F.substring(name, F.lit(len(pre) + 1), F.length(name) - len(pre) - len(post))
    before, _, after = target.partition("*")
    return F.when(ok, F.concat(F.lit(before), middle, F.lit(after)) if "*" in target else F.lit(target))


def regex_map(name: Column, pattern: str, target: str) -> Column:
    """``\\0`` to ``\\9`` in the target stand for the match and its groups."""
    parts = [F.regexp_extract(name, pattern, int(t[1])) if re.fullmatch(r"\\\d", t) else F.lit(t) for t in re.split(r"(\\\d)", target) if t]
    return F.when(name.rlike(pattern), F.concat(*parts))


def flatten(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def merge(name: Column, constant: str) -> Column:
    return F.when(name.isNotNull(), F.lit(constant))


def package_map(name: Column, source: str, target: str) -> Column:
    return F.replace(glob_map(name, source, target), F.lit("/"), F.lit("."))


def unpackage_map(name: Column, source: str, target: str) -> Column:
    return F.replace(glob_map(name, source, target), F.lit("."), F.lit("/"))


def composite(name: Column, *mappers) -> Column:
    """Distinct results of all mappers, in order."""
    return F.array_distinct(F.flatten(F.array(*[_names(m, name) for m in mappers])))


def chained(name: Column, *mappers) -> Column:
    """Results of each mapper go through the next; a mapper gives one name, none, or, marked by :func:`many`, an array."""
    out = F.array(name)
    for m in mappers:
        out = F.array_distinct(F.flatten(F.transform(out, _of(m))))
    return out


def _of(mapper):
    return lambda name: _names(mapper, name)


def _names(mapper, name: Column) -> Column:
    found = mapper(name)
    return F.array_compact(found if getattr(mapper, "many", False) else F.array(found))


def many(mapper):
    """Marks a mapper that gives an array of names, as a composite does."""
    def run(name: Column) -> Column:
        return mapper(name)

    run.many = True
    return run


def adler32(text: Column) -> Column:
    """Two sums over the bytes of the UTF-8 text, modulo 65521; the second one weighs a byte by how many follow it, and itself."""
    data = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.octet_length(text).cast("long")
    a, b = total(data) + 1, total(F.transform(data, lambda x, i: x * (n - i) % 65521)) + n
    return (b % 65521) * 65536 + a % 65521


def string_hash(text: Column) -> Column:
    """31-polynomial over the UTF-16 units of a text, as a signed 32-bit number; past the basic plane a character is two units."""
    n = lambda c: F.ascii(c).cast("long")
    high, low = (lambda c: F.shiftright(n(c) - 0x10000, 10) + 0xD800), (lambda c: (n(c) - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00)
    step = lambda a, c: F.when(n(c) < 0x10000, a * 31 + n(c)).otherwise((a * 31 + high(c)) * 31 + low(c)) % 4294967296
    wrapped = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step)
    return F.when(wrapped >= 2147483648, wrapped - 4294967296).otherwise(wrapped)


def digests(text: Column) -> list[Column]:
    return [F.md5(text).alias("md5"), F.sha1(text).alias("sha1"), F.crc32(text).alias("crc32")]


def version_key(version: Column) -> Column:
    """Dotted version as an array that compares in order; missing components are 0, others than numbers an error."""
    parts = F.transform(F.split(version, r"\."), lambda p: p.cast("int"))
    kept = F.aggregate(F.reverse(parts), F.array().cast("array<int>"), lambda a, p: F.when((F.size(a) == 0) & (p == 0), a).otherwise(F.concat(F.array(p), a)))
    return kept


def elapsed(millis: Column) -> Column:
    """``2 minutes 5 seconds`` and the like."""
    s = F.floor(millis / 1000)
    m, r = F.floor(s / 60), s % 60
    unit = lambda n, w: F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n == 1, "").otherwise("s"))
    return F.when(m > 0, F.concat_ws(" ", unit(m, "minute"), unit(r, "second"))).otherwise(unit(r, "second"))


def iso_time(text: Column) -> Column:
    """ISO-8601 date-time or date; null where neither fits."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def stamp_formats(stamp: Column) -> list[Column]:
    """``dstamp, tstamp, today`` as a build's time stamps."""
    return [F.date_format(stamp, p).alias(n) for n, p in (("dstamp", "yyyyMMdd"), ("tstamp", "HHmm"), ("today", "MMMM d yyyy"))]


def gmt_format(millis: Column, pattern: str) -> Column:
    """Milliseconds since the epoch by a pattern, in GMT whatever the session's zone."""
    local = F.to_utc_timestamp(F.timestamp_millis(millis), F.current_timezone())
    return F.date_format(local, pattern)


def mapped_path(name: Column, prefixes: list[tuple[str, str]] = (), separator: str = "/", ignore_case: bool = False) -> Column:
    """A path with the first prefix that fits replaced, then written with the target's directory separator."""
    x = F.lower(name) if ignore_case else name
    out = F.coalesce(*[F.when(F.startswith(x, F.lit(a.lower() if ignore_case else a)), F.concat(F.lit(b), F.substring(name, F.lit(len(a) + 1), F.length(name)))) for a, b in prefixes], name)
    return F.replace(out, F.lit("/"), F.lit(separator))


def base64_text(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))
