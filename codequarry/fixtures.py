"""Input tables derived from the base tables, by SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _lines(dialect: str) -> str:
    return f"listagg(m, {NL}) WITHIN GROUP (ORDER BY m)" if dialect == "spark" else f"string_agg(m, {NL} ORDER BY m)"


def source_files(dialect: str) -> str:
    return f"""
SELECT CAST(year(o_orderdate) AS INT) AS release, concat('/src/p', o_custkey % 10, '/O', o_orderkey, '.java') AS path, o_orderkey,
  concat('package p', o_custkey % 10, ';', {NL}, {NL}, 'import p', (o_custkey + 1) % 10, '.Base;', {NL}, '/**', {NL}, ' * order ', o_orderkey, {NL}, ' */', {NL},
    'public class O', o_orderkey, ' extends Base {{', {NL}, '  // status ', o_orderstatus, {NL}, methods, {NL},
    CASE WHEN o_orderpriority LIKE '1-%' THEN concat('  static class Inner {{', {NL}, '    public int k() {{ return 0; }}', {NL}, '  }}', {NL}) ELSE '' END, '}}', {NL}) AS text
FROM orders JOIN (SELECT l_orderkey, {_lines(dialect)} AS methods FROM (
  SELECT l_orderkey, concat(CASE WHEN l_returnflag = 'R' THEN '  public int m' ELSE '  int m' END, l_linenumber, '_', l_partkey, '(int q) {{', {NL},
    CASE WHEN l_quantity >= 25 THEN concat('    if (q > 3) {{ return 1; }}', {NL}) ELSE '' END,
    CASE WHEN l_linestatus = 'O' THEN concat('    for (int i = 0; i < q; i++) {{ q--; }}', {NL}) ELSE '' END,
    '    /* tax */', {NL}, CASE WHEN l_discount > 0.05 THEN '    return q > 0 && q < 9 ? 1 : 0;' ELSE '    return 0;' END, {NL}, '  }}') AS m
  FROM lineitem) GROUP BY l_orderkey) ON l_orderkey = o_orderkey""".replace("{{", "{").replace("}}", "}")


#: Closed forms of the same files, from the relational columns alone.
METRICS = """
SELECT CAST(year(o_orderdate) AS INT) AS release, concat('/src/p', o_custkey % 10, '/O', o_orderkey, '.java') AS path, concat('p', o_custkey % 10, '.O', o_orderkey) AS name,
  concat('p', o_custkey % 10) AS package, o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' THEN 1 ELSE 0 END AS inner_n, n, r, q, o, d, maxcc
FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END) AS q,
  sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS d,
  max(1 + CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END) AS maxcc
  FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""

CLASS_METRICS = f"""
SELECT release, path, name, package, CAST(r + inner_n AS BIGINT) AS npm, CAST(n + inner_n AS BIGINT) AS methods, CAST(2 + 3 * n + q + o + 3 * inner_n AS BIGINT) AS loc, CAST(n + q + o + 2 * d AS BIGINT) AS wmc, CAST(maxcc AS BIGINT) AS max_cc, CAST(n AS BIGINT) AS direct, o_orderkey FROM ({METRICS})
UNION ALL SELECT release, path, concat(name, '$Inner'), package, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(3 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), o_orderkey FROM ({METRICS}) WHERE inner_n = 1"""

#: Files whose bodies hold types; Spark alone reads the text, the closed forms below are for both.
SCOPED_FILES = f"""
SELECT concat('/src/q', o_custkey % 10, '/S', o_orderkey, '.java') AS path,
  concat('package q', o_custkey % 10, ';', {NL}, '@interface Mark', o_orderkey, ' {{ String value() default ""; int level(); }}', {NL}, '@Mark', o_orderkey, '(value = "x", level = 1)', {NL}, 'public class S', o_orderkey, ' {{', {NL}, members, {NL},
    CASE WHEN o_orderpriority LIKE '1-%' THEN concat('  enum Kind {{ A(1) {{ public int v() {{ return 1; }} }}, B; public int v() {{ return 0; }} class Shut {{ public void s() {{}} }} }}', {NL}) ELSE '' END, '}}', {NL}) AS text
FROM orders JOIN (SELECT l_orderkey, {_lines("spark")} AS members FROM (
  SELECT l_orderkey, concat('  public void m', id, '(int q) {{ ', CASE WHEN l_quantity >= 25 THEN 'class Local {{ public int no() {{ return 0; }} }} ' ELSE '' END, 'Runnable r = new Runnable() {{ public void run() {{ }} }}; }}',
    CASE WHEN l_linestatus = 'O' THEN concat({NL}, '  Runnable f', id, ' = new Runnable() {{ public void run() {{ }} void help() {{ }} }};') ELSE '' END,
    CASE WHEN l_returnflag = 'R' THEN concat({NL}, '  static class N', id, ' {{ N', id, '(int i) {{ }} public int k() {{ return 0; }} }}') ELSE '' END,
    CASE WHEN l_discount > 0.05 THEN concat({NL}, '  static {{ class InBlock {{ public void yes() {{ }} }} }}') ELSE '' END) AS m
  FROM (SELECT *, concat(l_linenumber, '_', l_partkey) AS id FROM lineitem)) GROUP BY l_orderkey) ON l_orderkey = o_orderkey""".replace("{{", "{").replace("}}", "}")

SCOPED_METRICS = f"""
SELECT replace(replace(path, '/p', '/q'), '/O', '/S') AS path, replace(replace(name, 'p', 'q'), 'O', 'S') AS name, NULL AS outer_type, CAST(n + o + r + d + 3 * inner_n AS BIGINT) AS npm, CAST(n + 2 * o + 2 * r + d + 3 * inner_n AS BIGINT) AS methods FROM ({METRICS})
UNION ALL SELECT replace(replace(path, '/p', '/q'), '/O', '/S'), concat(replace(package, 'p', 'q'), '.Mark', o_orderkey), NULL, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ({METRICS})
UNION ALL SELECT concat('/src/q', o_custkey % 10, '/S', o_orderkey, '.java'), concat('q', o_custkey % 10, '.S', o_orderkey, '$N', l_linenumber, '_', l_partkey), concat('S', o_orderkey), CAST(1 AS BIGINT), CAST(2 AS BIGINT) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"""

METRICS_BASE = f"SELECT release, name, npm, CAST(round(loc * CASE WHEN o_orderkey % 2 = 0 THEN 1.04 ELSE 1.2 END) AS BIGINT) AS loc FROM ({CLASS_METRICS}) WHERE o_orderkey % 50 <> 0"


def manifest(dialect: str) -> str:
    stamp = "timestamp_micros(1704067200000000 + doc_id * 60000000)" if dialect == "spark" else "make_timestamp(1704067200000000 + doc_id * 60000000)"
    return f"""SELECT concat(lang, '/', source, '/', doc_id, '.txt') AS name, doc_id % 31 <> 0 AS exist, {stamp} AS last_modified, doc_id % 37 = 0 AS is_dir, n_chars AS size, text AS content, doc_id AS ordinal FROM documents"""


def manifest_target(dialect: str) -> str:
    micros = "1704067200000000 + doc_id * 60000000 + CASE WHEN doc_id % 13 = 0 THEN 5000000 ELSE 0 END - CASE WHEN doc_id % 17 = 0 THEN 86400000000 ELSE 0 END"
    stamp = f"timestamp_micros({micros})" if dialect == "spark" else f"make_timestamp({micros})"
    cols = f"doc_id % 31 <> 0 AS exist, {stamp} AS last_modified, doc_id % 37 = 0 AS is_dir, n_chars + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size, text AS content, doc_id AS ordinal"
    return f"""SELECT concat(lang, '/', source, '/', doc_id, '.txt') AS name, {cols} FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT concat('orphan/', doc_id, '.txt') AS name, {cols} FROM documents WHERE doc_id % 19 = 0"""


CHANGELOG = """SELECT concat('f', event_id, '.java') AS file, concat('1.', event_id % 9 + 1) AS revision, CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('1.', event_id % 9) END AS prev_revision,
  CASE WHEN event_id % 101 = 0 THEN NULL ELSE date_trunc('day', ts) END AS date, user_id AS author, event_type AS comment, event_id FROM events"""

PART_TREE = "SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM part WHERE p_partkey >= 2"
EDGES = """SELECT DISTINCT concat('P', l_partkey) AS src, concat('S', l_suppkey) AS dst FROM lineitem
UNION ALL SELECT concat('S', s_suppkey), concat('N', s_nationkey) FROM supplier UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey) FROM nation"""

BUILD_EVENTS = """SELECT event_id, ts, user_id AS target, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 2 = 1 THEN 'started' ELSE 'finished' END AS kind,
  CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS priority, concat(event_type, ' ', event_id) AS message FROM events"""

#: Messages of builds, and the actions of two recorders for each build; signups act before their own message.
RECORDED = "SELECT event_id, ts, user_id % 50 AS build, user_id AS target, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS priority, concat(event_type, ' ', event_id) AS message FROM events"
RECORDER_ACTIONS = "SELECT event_id, ts, user_id % 50 AS build, concat('log', event_id % 2) AS recorder, CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'stop' END AS action FROM events WHERE event_type = 'signup'"

SUITES = """SELECT concat('<testsuite name="', replace(p_brand, ' ', ''), '.', replace(p_type, ' ', ''), '" tests="', tests, '" failures="', failures, '" errors="', errors, '" time="', seconds, '"/>') AS xml
FROM (SELECT p_brand, p_type, count(*) AS tests, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS failures, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS errors, CAST(sum(l_linenumber) AS BIGINT) AS seconds
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand, p_type)
UNION ALL SELECT '' FROM region WHERE r_regionkey = 0 UNION ALL SELECT '<other/>' FROM region WHERE r_regionkey = 0 UNION ALL SELECT '<testsuite name="a.b"' FROM region WHERE r_regionkey = 0"""


#: Suites with a case for each line item, in both kinds of quotes, with entities; Spark alone reads the text.
CASE_SUITES = """SELECT concat('<?xml version="1.0"?><testsuite name=', chr(39), 'p', p, '.S', l_orderkey, chr(39), ' tests="', count(*), '" time="1.5">', listagg(concat('<testcase name="t', l_linenumber, '_', l_partkey, ' &lt;&amp;&#62;" time=', chr(39), l_linenumber, chr(39), '>',
  CASE l_returnflag WHEN 'R' THEN '<failure message="is &quot;R&quot;" type="F"/>' WHEN 'A' THEN '<error>A &amp; more</error>' ELSE '' END, '</testcase>'), ''), '</testsuite>') AS xml
FROM (SELECT *, l_orderkey % 7 AS p FROM lineitem) GROUP BY l_orderkey, p
UNION ALL SELECT concat('<testsuite name="cut', r_regionkey, '"><testcase') FROM region UNION ALL SELECT concat('<suites><testsuite name="r', r_regionkey, '"/></suites>') FROM region UNION ALL SELECT ' ' FROM region"""

#: An outline of packages (odd ones within another), files, classes and methods: each element a line deeper than what holds it.
OUTLINE = """
SELECT 'all' AS log, k * 1000000000000 AS line_no, 0 AS indent, concat('p', k) AS name, 'package' AS level, NULL AS parent FROM (SELECT DISTINCT o_custkey % 10 AS k FROM orders)
UNION ALL SELECT 'all', k * 1000000000000 + 1, 1, concat('p', k, '.sub'), 'package', concat('p', k) FROM (SELECT DISTINCT o_custkey % 10 AS k FROM orders) WHERE k % 2 = 1
UNION ALL SELECT 'all', (o_custkey % 10) * 1000000000000 + 1000 * (o_orderkey + 1), 1 + o_custkey % 2, concat('O', o_orderkey, '.java'), 'file', concat('p', o_custkey % 10, CASE WHEN o_custkey % 2 = 1 THEN '.sub' ELSE '' END) FROM orders
UNION ALL SELECT 'all', (o_custkey % 10) * 1000000000000 + 1000 * (o_orderkey + 1) + 1, 2 + o_custkey % 2, concat('O', o_orderkey), 'class', concat('O', o_orderkey, '.java') FROM orders
UNION ALL SELECT 'all', (o_custkey % 10) * 1000000000000 + 1000 * (o_orderkey + 1) + 2 + l_linenumber, 3 + o_custkey % 2, concat('m', l_linenumber, '(int)'), 'method', concat('O', o_orderkey) FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey
UNION ALL SELECT 'all', (o_custkey % 10) * 1000000000000 + 1000 * (o_orderkey + 1) + 900, 3 + o_custkey % 2, 'Inner', 'class', concat('O', o_orderkey) FROM orders WHERE o_orderpriority LIKE '1-%'"""


def violations_log(dialect: str) -> str:
    return f"""SELECT l_orderkey AS doc_id, concat({_lines(dialect)}, {NL}, 'summary ', l_orderkey) AS text
FROM (SELECT l_orderkey, concat('src/O', l_orderkey, '.java:', l_linenumber, ' : flag ', l_returnflag) AS m FROM lineitem) GROUP BY l_orderkey"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NAMED = re.compile(rf"(?<=FROM )(?:{'|'.join(TABLES)})\b|(?<=JOIN )(?:{'|'.join(TABLES)})\b")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a fixture's SQL over the base tables that it names."""
    used = {name: table(spark, sf_dir, name) for name in set(NAMED.findall(sql))}
    return spark.sql(NAMED.sub(lambda m: f"{{{m[0]}}}", sql.replace("{", "{{").replace("}", "}}")), **used)
