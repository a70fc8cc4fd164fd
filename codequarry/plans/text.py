"""Queries over document texts: filters, tokens, digests, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import filters as T
from ..functions import mappers as N
from ..functions.user import text_filter
from ..operators import manifests as M
from ..operators import reports as R

Q: dict = {}
O: dict[str, str] = {}
LINES = "string_split(text, chr(10))"
JOIN = "array_to_string({}, chr(10))"
TABBED = "concat(CASE WHEN doc_id % 3 = 0 THEN replace(CASE WHEN doc_id % 5 = 0 THEN replace(text, ' ', chr(9)) ELSE text END, chr(10), chr(13) || chr(10)) ELSE CASE WHEN doc_id % 5 = 0 THEN replace(text, ' ', chr(9)) ELSE text END END, CASE WHEN doc_id % 10 = 0 THEN chr(26) ELSE '' END)"
TAB = f"(SELECT doc_id, {TABBED} AS text FROM documents)"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def docs(spark, d):
    return X.table(spark, d, "documents")


def tabbed(spark, d):
    return docs(spark, d).select("doc_id", F.expr(TABBED).alias("text"))


def mapped(name: str, f, sql: str, rows=docs, source: str = "documents"):
    """Register a text-to-text filter under ``name``; results are compared by length and digest."""
    def run(spark, d):
        out = rows(spark, d).select("doc_id", f(F.col("text")).alias("t"))
        return out.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))

    run.__name__ = name
    query(f"SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM (SELECT doc_id, {sql} AS t FROM {source})")(run)


#: The tabbed texts with a final LF, CRLF, CR or none.
RAGGED = f"concat({TABBED}, CASE doc_id % 4 WHEN 1 THEN chr(10) WHEN 2 THEN chr(13) || chr(10) WHEN 3 THEN chr(13) ELSE '' END)"
RAG = f"(SELECT doc_id, {RAGGED} AS text FROM documents)"
ENDED, LF_ENDED = "regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+')", "regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')"
KEPT = "array_to_string({}, '')"


def ragged(spark, d):
    return docs(spark, d).select("doc_id", F.expr(RAGGED).alias("text"))


mapped("t01_head", lambda t: T.head(t, 3, 1), KEPT.format(f"{ENDED}[2:4]"), ragged, RAG)
mapped("t02_tail", lambda t: T.tail(t, 2, 1), KEPT.format(f"list_reverse(list_reverse({ENDED})[2:3])"), ragged, RAG)
mapped("t03_lines_containing", lambda t: T.lines_containing(t, "the", "of"), KEPT.format(f"list_filter({LF_ENDED}, lambda l: contains(l, 'the') AND contains(l, 'of'))"), ragged, RAG)
mapped("t04_lines_matching", lambda t: T.lines_matching(t, r"ing\b", negate=True), KEPT.format(f"list_filter({LF_ENDED}, lambda l: NOT regexp_matches(l, 'ing\\b'))"), ragged, RAG)
mapped("t05_strip_line_comments", lambda t: T.strip_line_comments(t, "The", "En"), KEPT.format(f"list_filter({LF_ENDED}, lambda l: NOT (starts_with(l, 'The') OR starts_with(l, 'En')))"), ragged, RAG)
mapped("t07_strip_line_breaks", T.strip_line_breaks, "replace(replace(text, chr(13), ''), chr(10), '')", tabbed, TAB)
mapped("t08_tabs_to_spaces", lambda t: T.tabs_to_spaces(t, 4), "replace(text, chr(9), '    ')", tabbed, TAB)
mapped("t09_prefix_lines", lambda t: T.prefix_lines(t, "> "), KEPT.format(f"list_transform({LF_ENDED}, lambda l: '> ' || l)"), ragged, RAG)
mapped("t13_escape_unicode", lambda t: T.escape_unicode(t), "array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c <> '' AND ord(c) >= 128 THEN concat('\\u', lpad(lower(to_hex(ord(c))), 4, '0')) ELSE c END), '')")
mapped("t14_concat", lambda t: T.concat_text(t, "<", ">"), "concat('<', text, '>')")
mapped("t15_replace_regex", lambda t: T.replace_regex(t, "th(e)", "<$1>", "g"), "regexp_replace(text, 'th(e)', '<\\1>', 'g')")
mapped("t15_replace_first", lambda t: T.replace_regex(t, "th(e)", "<$1>", "i", by_line=True), JOIN.format(f"list_transform({LINES}, lambda l: regexp_replace(l, 'th(e)', '<\\1>', 'i'))"))
mapped("t16_replace_all", lambda t: T.replace_all(t, [("the", "THE"), ("THEr", "x")]), "replace(replace(text, 'the', 'THE'), 'THEr', 'x')")
mapped("t17_normalise_ends", lambda t: T.normalise_ends(t, "remove", "remove"), "regexp_replace(replace(text, chr(13), ''), '\\x1a$', '')", tabbed, TAB)

LONE = "(SELECT doc_id, concat(replace(text, ' b', chr(13) || 'b'), CASE doc_id % 4 WHEN 1 THEN chr(26) WHEN 2 THEN chr(26) || chr(10) WHEN 3 THEN chr(10) ELSE '' END) AS text FROM documents WHERE text <> '')"


def lone(spark, d):
    end = F.element_at(F.array(F.lit(""), F.lit("\x1a"), F.lit("\x1a\n"), F.lit("\n")), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, d).where("text <> ''").select("doc_id", F.concat(F.replace("text", F.lit(" b"), F.lit("\rb")), end).alias("text"))


mapped("t17_lone_ends", lambda t: T.normalise_ends(t, "remove", "remove"), "CASE WHEN doc_id % 4 = 2 THEN left(replace(text, chr(13), ''), length(replace(text, chr(13), '')) - 2) WHEN doc_id % 4 = 1 THEN left(replace(text, chr(13), ''), length(replace(text, chr(13), '')) - 1) ELSE replace(text, chr(13), '') END", lone, LONE)
mapped("t17_add_ends", lambda t: T.normalise_ends(t, "add", "add"), "concat(replace(replace(text, chr(13), ''), chr(10), chr(13) || chr(10)), CASE WHEN doc_id % 4 = 1 THEN '' ELSE chr(26) END)", lone, LONE)

#: Lines of the tabbed texts without blanks at their ends, tabs expanded to stops of 4; then blanks before stops as tabs.
EXPANDED = "list_transform(string_split(regexp_replace(text, '[ \\t]+(\\r|\\n|$)', '\\1', 'g'), chr(10)), lambda l: list_reduce(string_split(l, chr(9)), lambda a, x: concat(rpad(a, CAST((length(a) // 4 + 1) * 4 AS INT), ' '), x)))"
CELLS = "list_transform(generate_series(0, (length(l) - 1) // 4), lambda i: CASE WHEN l[i * 4 + 4] = ' ' AND (l[i * 4 + 3] = ' ' OR l[i * 4 + 5] = ' ') THEN rtrim(l[i * 4 + 1 : i * 4 + 4]) || chr(9) ELSE l[i * 4 + 1 : i * 4 + 4] END)"
SPACED = f"(SELECT doc_id, regexp_replace({RAGGED}, ' ([a-m])', '   \\1', 'g') AS text FROM documents)"


def spaced(spark, d):
    return ragged(spark, d).select("doc_id", F.regexp_replace("text", " ([a-m])", "   $1").alias("text"))


mapped("t17_remove_tabs", lambda t: T.normalise_ends(t, "asis", "asis", "remove", 4), JOIN.format(EXPANDED), spaced, SPACED)
mapped("t17_add_tabs", lambda t: T.normalise_ends(t, "asis", "asis", "add", 4), JOIN.format(f"list_transform({EXPANDED}, lambda l: array_to_string({CELLS}, ''))"), spaced, SPACED)
mapped("t19_chain", lambda t: T.chain(t, lambda x: T.head(x, 5), lambda x: T.prefix_lines(x, "- "), lambda x: T.strip_line_breaks(x)), f"array_to_string(list_transform({LINES}[1:5], lambda l: '- ' || l), '')")


@query("""SELECT path, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM (SELECT path, regexp_replace(regexp_replace(replace(text, '/* tax */', ''), '/\\*\\*\\n \\* order \\d+\\n \\*/', ''), '// status .', '') AS t FROM (""" + X.source_files("duckdb") + "))")
def t06_strip_java_comments(spark, d):
    out = X.derived(spark, d, X.source_files("spark")).select("path", T.strip_java_comments(F.col("text")).alias("t"))
    return out.select("path", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def templated():
    return F.concat(F.lit("@id@ ${lang} @unknown@ "), "text")


@query("SELECT doc_id, md5(concat(doc_id, ' ${lang} @unknown@ ', text)) AS digest FROM documents")
def t10_replace_tokens(spark, d):
    t = T.replace_tokens(templated(), {"id": F.col("doc_id")})
    return docs(spark, d).select("doc_id", F.md5(t).alias("digest"))


@query("SELECT doc_id, md5(concat('a-b-c ${lang} @unknown@ ', text)) AS digest FROM documents")
def t11_filter_set(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.filter_set(templated(), {"id": "a-@b@", "b": "b-@c@", "c": "c"})).alias("digest"))


@query("SELECT doc_id, md5(concat('@id@ ', lang, ' @unknown@ ', text)) AS digest FROM documents")
def t12_expand_properties(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.expand_properties(templated(), {"lang": F.col("lang")})).alias("digest"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+'))::INT AS n_lines, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0b]+'))::INT AS n_words, len(regexp_extract_all(text, '[^,.]+|[,.]'))::INT AS n_parts FROM documents")
def t18_tokenisers(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", F.size(T.line_tokens(t)).alias("n_lines"), F.size(T.string_tokens(t)).alias("n_words"), F.size(T.string_tokens(t, ",.", True)).alias("n_parts"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def t24_digests(spark, d):
    return docs(spark, d).select("doc_id", *N.digests(F.col("text"))).drop("crc32")


BYTES = "list_transform(range(1, len(x) // 2 + 1), lambda i: CAST('0x' || substr(x, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))"


@query(f"SELECT c_custkey, (list_sum(list_transform(b, lambda v, i: v * (len(b) - i + 1))) + len(b)) % 65521 * 65536 + (list_sum(b) + 1) % 65521 AS adler32, CAST((list_reduce(list_prepend(0, b), lambda a, v: (a * 31 + v) % 4294967296) + 2147483648) % 4294967296 - 2147483648 AS BIGINT) AS string_hash, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(b, lambda v: list_transform(range(8), lambda i: (v >> CAST(i AS INT)) & 1)))), lambda a, x: xor(a >> 1, 3988292384 * (xor(a, x) & 1))), CAST(4294967295 AS BIGINT)) AS crc32 FROM (SELECT c_custkey, {BYTES} AS b FROM (SELECT c_custkey, hex(encode(c_name)) AS x FROM customer))")
def t24_checksums(spark, d):
    n = F.col("c_name")
    return X.table(spark, d, "customer").select("c_custkey", N.adler32(n).cast("long").alias("adler32"), N.string_hash(n).cast("long").alias("string_hash"), F.crc32(n).alias("crc32"))


@query("SELECT doc_id, CAST(length(t) AS BIGINT) AS plain, CAST(length(regexp_replace(regexp_replace(t, '^[\\x00-\\x20]+', ''), '[\\x00-\\x20]+$', '')) AS BIGINT) AS trimmed, length(t) > 500 AS more FROM (SELECT doc_id, concat('  ', text, chr(10), ' ') AS t FROM documents)")
def g02_length_text(spark, d):
    t = F.concat(F.lit("  "), "text", F.lit("\n "))
    return docs(spark, d).select("doc_id", M.length_text(t).alias("plain"), M.length_text(t, trim=True).alias("trimmed"), M.length_is(F.length(t), 500, "greater").alias("more"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS dstamp, strftime(o_orderdate, '%H%M') AS tstamp, strftime(o_orderdate, '%B %-d %Y') AS today, strftime(make_timestamp(CAST(o_orderkey * 1000000 AS BIGINT)), '%H:%M:%S') AS gmt FROM orders")
def t27_stamps(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", *N.stamp_formats(F.col("o_orderdate")), N.gmt_format(F.col("o_orderkey") * 1000, "HH:mm:ss").alias("gmt"))


@query("SELECT DISTINCT p_size, p_size % 10 AS minor, CASE WHEN (p_size // 10, p_size % 10) < (2, 5) THEN 'older' WHEN (p_size // 10, p_size % 10) = (2, 5) THEN 'same' ELSE 'newer' END AS than FROM part")
def t25_versions(spark, d):
    v = F.concat((F.col("p_size") / 10).cast("int").cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"), F.lit(".0"))
    a, b = N.version_key(v), N.version_key(F.lit("2.5"))
    return X.table(spark, d, "part").select("p_size", (F.col("p_size") % 10).alias("minor"), F.when(a < b, "older").when(a == b, "same").otherwise("newer").alias("than")).distinct()


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS dstamp, strftime(o_orderdate, '%H%M') AS tstamp, CASE WHEN o_orderkey % 7200 >= 60 THEN concat(o_orderkey % 7200 // 60, CASE WHEN o_orderkey % 7200 // 60 = 1 THEN ' minute ' ELSE ' minutes ' END) ELSE '' END || concat(o_orderkey % 60, CASE WHEN o_orderkey % 60 = 1 THEN ' second' ELSE ' seconds' END) AS took FROM orders")
def t27_times(spark, d):
    ms = (F.col("o_orderkey") % 7200) * 1000
    return X.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("dstamp"), F.date_format("o_orderdate", "HHmm").alias("tstamp"), N.elapsed(ms).alias("took"))


@query("SELECT c_custkey, base64(encode(c_name)) AS coded FROM customer")
def t28_base64(spark, d):
    return X.table(spark, d, "customer").select("c_custkey", N.base64_text(F.col("c_name")).alias("coded"))


@query(f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(length(text) - length(replace(text, chr(13), '')) AS BIGINT) AS n_cr, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS n_lf, CAST(length(text) - length(replace(text, chr(9), '')) AS BIGINT) AS n_tab, doc_id % 10 = 0 AS has_eof FROM {TAB}")
def g07_census(spark, d):
    return tabbed(spark, d).select("doc_id", *T.census(F.col("text")))


@query("SELECT CAST(sum((length(text) - length(replace(text, 'the', ''))) // 3) AS BIGINT) AS replaced, CAST(sum(CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM documents")
def g08_replacements(spark, d):
    n = T.occurrences(F.col("text"), "the")
    return docs(spark, d).agg(F.sum(n).alias("replaced"), F.sum((n > 0).cast("long")).alias("changed"))


@query("SELECT source, doc_id, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def s10_concat_docs(spark, d):
    return R.concat_docs(docs(spark, d), "source", "doc_id").select("source", "doc_id", "start", F.md5("text").alias("digest"))


@query("SELECT doc_id, md5(upper(c)) AS digest FROM (SELECT item_id AS doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS c FROM benchmark)")
def u02_user_filter(spark, d):
    ascii_only = F.regexp_replace("text", "[^ -~]", "")
    return X.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.md5(text_filter(str.upper)(ascii_only)).alias("digest"))
