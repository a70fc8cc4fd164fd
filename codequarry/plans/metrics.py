"""Queries over source files: declarations, counts, reports, graphs, histories, build events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions.lines import simple_code_lines
from ..operators import declarations as D
from ..operators import graph as G
from ..operators import reports as R
from ..shared import new_path, running_sum
from ..sources import code as S
from ..sources import lines as L
from ..streaming import recorder

Q: dict = {}
O: dict[str, str] = {}
M, C, B = f"({X.METRICS})", f"({X.CLASS_METRICS})", f"({X.METRICS_BASE})"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def files(spark, d):
    return X.derived(spark, d, X.source_files("spark"))


def scoped(spark, d):
    return X.derived(spark, d, X.SCOPED_FILES)


def corrupt(spark, d):
    """Every 97th file loses its last brace, every 89th ends in an open comment."""
    f = files(spark, d)
    t = F.when(F.col("o_orderkey") % 97 == 0, F.regexp_replace("text", r"\}\n\z", "")).otherwise(F.col("text"))
    return f.withColumn("text", F.when(F.col("o_orderkey") % 89 == 0, F.concat(t, F.lit("/* open"))).otherwise(t))


def closed(spark, d, sql):
    return X.derived(spark, d, sql)


@query(f"SELECT name, npm, loc FROM {C}")
def s04_compact_metrics(spark, d):
    f = files(spark, d)
    return D.loc_by_type(f, complexity=False).select("name", "npm", "loc")


ALL_COLUMNS = ", ".join(c if c == "name" else f"CAST({c if c in ('npm', 'loc') else 0} AS {'INT' if c in S.INTS else 'DOUBLE'}) AS {c}" for c in S.COLUMNS)


@query(f"SELECT {ALL_COLUMNS} FROM {C}")
def s05_full_format(spark, d):
    return S.to_full_format(closed(spark, d, X.CLASS_METRICS))


@query(f"SELECT name, npm FROM {C}")
def m03_npm_by_type(spark, d):
    return D.types(files(spark, d), complexity=False).select("name", "npm")


@query("SELECT DISTINCT name, CASE WHEN name LIKE '%$%' THEN split_part(split_part(name, '.', 2), '$', 1) ELSE NULL END AS outer_type, package FROM " + C)
def m01_types(spark, d):
    return D.types(files(spark, d), complexity=False).select("name", F.col("outer").alias("outer_type"), F.col("pkg").alias("package"))


@query(f"SELECT name FROM {C} WHERE name LIKE '%$%'")
def m02_nested_types(spark, d):
    return D.types(files(spark, d), complexity=False).where("outer is not null").select("name")


@query(f"SELECT path, CAST(r + inner_n AS BIGINT) AS npm FROM {M}")
def m04_npm_by_file(spark, d):
    return D.counts_by_file(D.types(files(spark, d), complexity=False)).select("path", "npm")


@query(f"SELECT name, methods FROM {C}")
def m05_methods_by_type(spark, d):
    return D.types(files(spark, d), complexity=False).select("name", "methods")


@query(f"SELECT name, outer_type, npm, methods FROM ({X.SCOPED_METRICS})")
def m01_scoped_types(spark, d):
    """Types, nested types and their counts where bodies hold types: local and anonymous classes, enums, annotations."""
    return D.types(scoped(spark, d), complexity=False).select("name", F.col("outer").alias("outer_type"), "npm", "methods")


@query(f"SELECT path, CAST(sum(npm) AS BIGINT) AS npm, CAST(sum(methods) AS BIGINT) AS methods FROM ({X.SCOPED_METRICS}) WHERE outer_type IS NULL GROUP BY path")
def m04_scoped_files(spark, d):
    return D.counts_by_file(D.types(scoped(spark, d), complexity=False))


@query(f"SELECT name, loc FROM {C}")
def m06_loc_by_type(spark, d):
    return D.loc_by_type(files(spark, d), complexity=False).select("name", "loc")


LOC = f"SELECT path, CAST(4 + 3 * n + q + o + 3 * inner_n AS BIGINT) AS loc FROM {M}"


@query(LOC)
def m07_loc_by_file(spark, d):
    return D.loc_by_file(files(spark, d))


@query(LOC)
def m08_simple_loc(spark, d):
    return files(spark, d).select("path", simple_code_lines(F.col("text")).cast("long").alias("loc"))


@query("""SELECT concat('/src/p', o_custkey % 10, '/O', o_orderkey, '.java') AS path, concat('m', l_linenumber, '_', l_partkey) AS method,
CAST(1 + CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END AS BIGINT) AS cc
FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL """ + f"SELECT path, 'k', CAST(1 AS BIGINT) FROM {M} WHERE inner_n = 1")
def m09_cyclomatic(spark, d):
    return D.declarations(files(spark, d)).where("kind = 'method'").select("path", F.col("name").alias("method"), "cc")


@query(f"SELECT path, name, wmc, max_cc, round(CAST(wmc AS DOUBLE) / direct, 4) AS avg_cc FROM {C}")
def m10_class_complexity(spark, d):
    return R.class_complexity(D.types(files(spark, d)))


@query(f"SELECT path, CASE WHEN o_orderkey % 89 = 0 THEN 'unterminated comment' ELSE 'unbalanced braces' END AS problem FROM {M} WHERE o_orderkey % 89 = 0 OR o_orderkey % 97 = 0")
def m11_diagnostics(spark, d):
    return D.diagnostics(corrupt(spark, d))


@query(f"SELECT path, CASE WHEN o_orderkey % 89 = 0 THEN 'unterminated comment' WHEN o_orderkey % 97 = 0 THEN 'unbalanced braces' END AS parse_error FROM {M}")
def s03_error_column(spark, d):
    return D.problems(corrupt(spark, d)).withColumnRenamed("problem", "parse_error")


@query(f"SELECT count(*) AS classes, round(avg(npm), 2) AS avg_npm, round(avg(loc), 2) AS avg_loc, CAST(sum(loc) AS BIGINT) AS total_loc FROM {C}")
def m12_summary(spark, d):
    return R.summary(closed(spark, d, X.CLASS_METRICS))


@query(f"SELECT coalesce(m.name, b.name) AS name, CASE WHEN m.name IS NULL THEN 'missing' WHEN b.name IS NULL THEN 'extra' WHEN abs(m.npm - b.npm) <= b.npm * 0.05 AND abs(m.loc - b.loc) <= b.loc * CAST(0.05 AS DOUBLE) THEN 'ok' ELSE 'outside' END AS status FROM {C} m FULL JOIN {B} b ON m.name = b.name")
def m13_validate(spark, d):
    return R.validate(closed(spark, d, X.CLASS_METRICS), closed(spark, d, X.METRICS_BASE))


@query(f"SELECT coalesce(a.package, b.package) AS package, loc_a, loc_b, coalesce(loc_b, 0) - coalesce(loc_a, 0) AS change FROM (SELECT package, CAST(sum(loc) AS BIGINT) AS loc_a FROM {C} WHERE release = 1995 GROUP BY package) a FULL JOIN (SELECT package, CAST(sum(loc) AS BIGINT) AS loc_b FROM {C} WHERE release = 1996 GROUP BY package) b ON a.package = b.package")
def m14_compare_releases(spark, d):
    return R.compare_releases(closed(spark, d, X.CLASS_METRICS), 1995, 1996, "package")


@query(f"SELECT package, path, name, CAST(sum(npm) AS BIGINT) AS npm, CAST(sum(loc) AS BIGINT) AS loc, count(*) AS classes, grouping(package) + grouping(path) + grouping(name) AS level FROM {C} GROUP BY ROLLUP (package, path, name)")
def m15_rollup(spark, d):
    return R.rollup_metrics(closed(spark, d, X.CLASS_METRICS), ["package", "path", "name"])


@query(f"WITH RECURSIVE e AS ({X.PART_TREE}), t AS (SELECT DISTINCT dst AS node, 0 AS dit FROM e WHERE dst NOT IN (SELECT src FROM e) UNION ALL SELECT e.src, t.dit + 1 FROM t JOIN e ON e.dst = t.node) SELECT node, dit, (SELECT count(*) FROM e WHERE e.dst = t.node) AS noc FROM t")
def m16_inheritance(spark, d):
    return G.inheritance(closed(spark, d, X.PART_TREE))


@query(f"WITH e AS ({X.EDGES}), a AS (SELECT dst AS node, count(DISTINCT src) AS ca FROM e GROUP BY dst), c AS (SELECT src AS node, count(DISTINCT dst) AS ce FROM e GROUP BY src) SELECT coalesce(a.node, c.node) AS node, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM a FULL JOIN c ON a.node = c.node")
def m17_coupling(spark, d):
    return R.coupling(closed(spark, d, X.EDGES))


@query(f"SELECT release, count(*) AS files FROM {M} GROUP BY release")
def s07_releases(spark, d):
    return files(spark, d).groupBy("release").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH s AS ({X.SUITES}) SELECT regexp_extract(xml, 'name=\"([^\".]*)', 1) AS package, regexp_extract(xml, 'name=\"[^\".]*\\.([^\"]*)', 1) AS classname, CAST(regexp_extract(xml, 'tests=\"(\\d+)', 1) AS BIGINT) AS tests, CAST(regexp_extract(xml, 'failures=\"(\\d+)', 1) AS BIGINT) AS failures FROM s WHERE xml LIKE '<testsuite %/>'")
def s08_suites(spark, d):
    return S.read_suites(closed(spark, d, X.SUITES)).select("package", "classname", "tests", "failures")


@query("SELECT replace(p_brand, ' ', '') AS package, CAST(count(*) AS BIGINT) AS runs, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS failures, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(l_linenumber) AS DOUBLE) AS seconds FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand")
def g06_suite_summary(spark, d):
    return R.suite_summary(S.read_suites(closed(spark, d, X.SUITES)))


LEVELS = f"({X.OUTLINE})"


@query(f"SELECT line_no, name, level, parent FROM {LEVELS}")
def m15_levels(spark, d):
    """Levels told from indents alone, with the name of what encloses each element."""
    outline = closed(spark, d, X.OUTLINE)
    found = R.infer_levels(outline.select("log", "line_no", "indent", "name"))
    names = outline.select(F.col("line_no").alias("parent"), F.col("name").alias("_name"))
    return found.join(names, "parent", "left").select("line_no", "name", "level", F.col("_name").alias("parent"))


@query(f"""WITH m AS (SELECT concat('p', o_custkey % 10) AS package, concat('/src/p', o_custkey % 10, '/O', o_orderkey, '.java') AS path, concat('O', o_orderkey) AS class, concat('m', l_linenumber, '_', l_partkey) AS method,
  1 + CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END AS cc FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION ALL SELECT package, path, 'Inner', 'k', 1 FROM {M} WHERE inner_n = 1)
SELECT package, path, class, method, CAST(sum(cc) AS BIGINT) AS cc, CAST(max(cc) AS BIGINT) AS max_cc, count(*) AS n, grouping(package) + grouping(path) + grouping(class) + grouping(method) AS level FROM m GROUP BY ROLLUP (package, path, class, method)""")
def m15_rollup_methods(spark, d):
    """All four levels, from the methods of the sources."""
    m = D.declarations(files(spark, d)).where("kind = 'method'")
    return R.rollup_methods(m.select(F.regexp_extract("path", "^/src/([^/]*)/", 1).alias("package"), "path", F.col("outer").alias("class"), F.col("name").alias("method"), "cc"))


@query("SELECT concat('p', l_orderkey % 7) AS package, concat('S', l_orderkey) AS classname, concat('t', l_linenumber, '_', l_partkey, ' <&>') AS name, CAST(l_linenumber AS DOUBLE) AS seconds, CASE l_returnflag WHEN 'R' THEN 'failure' WHEN 'A' THEN 'error' ELSE 'passed' END AS status, CASE l_returnflag WHEN 'R' THEN 'is \"R\"' WHEN 'A' THEN 'A & more' END AS message FROM lineitem")
def s08_suite_cases(spark, d):
    return S.suite_cases(closed(spark, d, X.CASE_SUITES))


@query("SELECT concat('<testsuite name=\"cut', r_regionkey, '\"><testcase') AS xml, 'malformed' AS problem FROM region UNION ALL SELECT concat('<suites><testsuite name=\"r', r_regionkey, '\"/></suites>'), 'wrong root' FROM region UNION ALL SELECT ' ', 'empty' FROM region")
def s08_suite_problems(spark, d):
    return S.suite_problems(closed(spark, d, X.CASE_SUITES))


FILE_ROWS = 10_000  # sources in one file of a tree


def tree(spark, d, key, bad=False):
    """The source files below a folder for each value of ``key``, in files of at most FILE_ROWS sources; ``bad``: some end in a byte that no text has.

    A scan has a file as one value: so it is the number of files that grows with the sources, not their size.
    """
    path = new_path(spark, "tree")
    f = files(spark, d).withColumn("o", F.col("o_orderkey")).withColumn("k", key)
    text = F.when(F.col("k") % 3 == 0, F.concat("text", F.unhex(F.lit("FF")).cast("string"))).otherwise(F.col("text")) if bad else F.col("text")
    f.select("k", "o", text.alias("text")).sortWithinPartitions("k", "o").select("k", "text").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("k").text(path)
    return path


def sizes(key: str, name: str = "k") -> str:
    return f"SELECT CAST(k AS VARCHAR) AS {name}, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM (SELECT *, {key} AS k FROM ({X.source_files('duckdb')})) GROUP BY k"


def folder():
    return F.regexp_extract("path", "/k=([^/]*)/", 1).alias("k")


@query(sizes("o_orderkey % 10"))
def s01_scan_sources(spark, d):
    found = S.scan_sources(spark, tree(spark, d, F.col("o_orderkey") % 10), require_nonempty=True, glob="*.txt")
    return found.groupBy(folder()).agg(F.sum(F.length("text")).alias("chars"))


@query(f"SELECT n, 'ValueError' AS error FROM (SELECT count(*) AS n FROM {M})")
def s02_nothing_found(spark, d):
    """A tree without a file of the kind that is asked for is an error."""
    try:
        S.scan_sources(spark, tree(spark, d, F.lit(0)), require_nonempty=True, glob="*.java")
        error = None
    except ValueError:
        error = "ValueError"
    return files(spark, d).agg(F.count(F.lit(1)).alias("n")).withColumn("error", F.lit(error))


@query(f"SELECT k, CASE WHEN CAST(k AS INT) % 3 = 0 THEN 'undecodable' END AS problem, CASE WHEN CAST(k AS INT) % 3 <> 0 THEN chars END AS chars FROM ({sizes('o_orderkey % 10')})")
def s03_checked_scan(spark, d):
    """Files that cannot be read are told; the others are there."""
    good, failures = S.scan_checked(spark, tree(spark, d, F.col("o_orderkey") % 10, bad=True), glob="*.txt")
    good, failures = good.groupBy(folder()).agg(F.sum(F.length("text")).alias("chars")), failures.select(folder(), "problem").distinct()
    return good.join(failures, "k", "full_outer").select("k", "problem", "chars")


@query(sizes("release", "release"))
def s07_scan_releases(spark, d):
    """Each release from a tree of its own, in one job."""
    path = tree(spark, d, F.col("release"))
    named = sorted(r[0] for r in files(spark, d).select("release").distinct().collect())
    found = S.scan_releases(spark, {str(r): f"{path}/k={r}" for r in named}, glob="*.txt")
    return found.groupBy("release").agg(F.sum(F.length("text")).alias("chars"))


@query("SELECT 0 AS statement, true AS ok, count(DISTINCT c_nationkey) AS rows, NULL AS error FROM customer UNION ALL SELECT 1, false, NULL, 'UNRESOLVED_COLUMN.WITH_SUGGESTION' UNION ALL SELECT 2, true, count(*), NULL FROM customer WHERE c_acctbal > 100")
def s09_sql_statements(spark, d):
    """One statement in the middle fails; the run goes on."""
    X.table(spark, d, "customer").createOrReplaceTempView("s09_customer")
    statements = ["SELECT c_nationkey, count(*) AS n FROM s09_customer GROUP BY c_nationkey", "SELECT nothing FROM s09_customer", "SELECT c_name FROM s09_customer WHERE c_acctbal > :least"]
    return S.sql_run(spark, statements, {"least": 100}, new_path(spark, "statements"), on_error="continue")


def line_files(spark, d):
    """The events as one text file for each of eight users' groups, read as lines."""
    path = new_path(spark, "lines")
    e = X.table(spark, d, "events").select((F.col("user_id") % 8).alias("k"), "event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string")).alias("line"))
    e.repartition("k").sortWithinPartitions("k", "event_id").select("k", "line").write.partitionBy("k").text(path)
    return L.scan_lines(spark, path)


NUMBERED = "SELECT CAST(user_id % 8 AS VARCHAR) AS k, row_number() OVER w AS line_no, count(*) OVER (PARTITION BY user_id % 8) AS total, concat(event_id, ' ', event_type, ' ', user_id) AS line FROM events WINDOW w AS (PARTITION BY user_id % 8 ORDER BY event_id)"


@query(f"SELECT k, line_no, line FROM ({NUMBERED})")
def s01_scan_lines(spark, d):
    return line_files(spark, d).select(folder(), "line_no", "line")


@query(f"SELECT k, line_no, line FROM ({NUMBERED}) WHERE line_no > 3 AND line_no <= 23")
def t01_head_of_files(spark, d):
    return L.head_lines(line_files(spark, d), 20, 3).select(folder(), "line_no", "line")


@query(f"SELECT k, line_no, line FROM ({NUMBERED}) WHERE line_no <= total - 3 AND line_no > total - 23")
def t02_tail_of_files(spark, d):
    return L.tail_lines(line_files(spark, d), 20, 3).select(folder(), "line_no", "line")


@query(f"SELECT k, (line_no - 1) * 3 + i - 1 AS position, string_split(line, ' ')[i] AS token FROM ({NUMBERED}), unnest([1, 2, 3]) AS t(i)")
def e07_tokens_of_files(spark, d):
    return L.line_tokens(line_files(spark, d), F.split("line", " ")).select(folder(), "position", "token")


@query("SELECT source, CAST(i - 1 AS BIGINT) AS position, l[i] AS line FROM (SELECT source, string_split(string_agg(text, chr(10) ORDER BY doc_id, text), chr(10)) AS l FROM documents WHERE text IS NOT NULL GROUP BY source), unnest(generate_series(1, len(l))) AS t(i)")
def s10_concat_written(spark, d):
    """The texts of each source as one text in ordered parts, read again line by line."""
    path = new_path(spark, "concatenated")
    docs = X.table(spark, d, "documents")
    R.write_concat(R.concat_docs(docs, "source", "doc_id"), "source", path)
    lines = L.scan_lines(spark, path, line_sep="\n").withColumn("source", F.regexp_extract("path", "/source=([^/]*)/", 1))
    placed = running_sum(lines.withColumn("one", F.lit(1)), ["source"], ["path", "line_no"], "one", "position")
    return placed.select("source", "position", "line")


@query("SELECT trim(c_name) AS c_name, CAST(count(*) AS VARCHAR) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY trim(c_name)")
def s09_sql_export(spark, d):
    X.table(spark, d, "customer").createOrReplaceTempView("s09_customer")
    X.table(spark, d, "orders").createOrReplaceTempView("s09_orders")
    path = new_path(spark, "exported")
    S.sql_export(spark, "SELECT c_name, count(*) AS n FROM s09_customer JOIN s09_orders ON o_custkey = c_custkey WHERE o_totalprice > :least GROUP BY c_name", {"least": 100000}, path)
    return spark.read.schema("c_name string, n string").csv(path, header=True)


@query(f"SELECT 'quarry' AS project, '1' AS release, name, CAST(npm AS INT) AS npm, CAST(loc AS INT) AS loc, CAST(0 AS INT) AS bug FROM {C}")
def s06_baseline(spark, d):
    """Written in the full format and read again as a baseline."""
    path = new_path(spark, "baseline")
    S.write_metrics_csv(closed(spark, d, X.CLASS_METRICS), f"{path}/quarry/1.csv", include_all_columns=True)
    return S.read_baseline(spark, path).select("project", "release", "name", "npm", "loc", "bug")


@query(f"SELECT path, 'import' AS relation, concat('p', (CAST(substr(package, 2) AS INT) + 1) % 10, '.Base') AS dst FROM {M} UNION ALL SELECT path, 'extends', 'Base' FROM {M}")
def h05_edges(spark, d):
    return D.dependency_edges(files(spark, d)).select("path", "relation", "dst")


@query(f"WITH RECURSIVE e AS ({X.EDGES}), r AS (SELECT 'P1' AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def h01_closure(spark, d):
    e = closed(spark, d, X.EDGES)
    return G.closure(e, e.where("src = 'P1'").select(F.col("src").alias("node")).limit(1)).select("node")


@query(f"WITH RECURSIVE e AS ({X.PART_TREE}), r AS (SELECT src AS node, src AS root, 0 AS depth FROM e WHERE src NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, root, depth + 1 FROM r JOIN e ON e.src = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def h02_ancestors(spark, d):
    """From every leaf."""
    e = closed(spark, d, X.PART_TREE)
    return G.closure(e, e.select(F.col("src").alias("node")).join(e.select(F.col("dst").alias("node")), "node", "left_anti"))


@query(f"WITH RECURSIVE e AS ({X.PART_TREE}), r AS (SELECT src AS node, 0 AS depth FROM e UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def h02_ancestors_all(spark, d):
    """From every source node."""
    e = closed(spark, d, X.PART_TREE)
    return G.closure(e, e.select(F.col("src").alias("node")))


@query("SELECT p_partkey AS node, max(p_partkey) OVER (PARTITION BY p_partkey // 900) - p_partkey AS depth FROM part")
def h02_ancestors_deep(spark, d):
    """Chains of 900 parts, each above the one before, from their lowest."""
    p = X.table(spark, d, "part")
    e = p.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - 1).alias("dst")).where("src % 900 <> 0")
    return G.closure(e, p.groupBy(F.expr("p_partkey div 900")).agg(F.max("p_partkey").alias("node")))


@query("SELECT o_orderkey AS node, o_orderkey AS dit, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 0 ELSE 1 END AS noc FROM orders")
def m16_inheritance_deep(spark, d):
    """One chain of all orders, far deeper than any number of rounds."""
    return G.inheritance(X.table(spark, d, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") - 1).alias("dst")))


@query(f"WITH RECURSIVE e AS ({X.EDGES}), r AS (SELECT 'N3' AS node UNION SELECT e.src FROM r JOIN e ON e.dst = r.node) SELECT node FROM r")
def h03_affected(spark, d):
    e = closed(spark, d, X.EDGES)
    return G.affected(e, e.where("src = 'N3'").select(F.col("src").alias("node")))


@query("SELECT l_partkey AS name, CAST(min(l_suppkey) AS BIGINT) AS container FROM lineitem GROUP BY l_partkey")
def h04_containers(spark, d):
    li = X.table(spark, d, "lineitem")
    holdings = li.select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("container"), F.col("l_suppkey").alias("path_ordinal"))
    return G.containers(holdings, holdings)


LOG = f"({X.CHANGELOG})"


@query(f"SELECT date, author, comment, string_agg(file || '@' || revision, ',' ORDER BY file) AS files FROM {LOG} GROUP BY date, author, comment")
def g03_change_sets(spark, d):
    sets = R.change_sets(closed(spark, d, X.CHANGELOG))
    return sets.withColumn("files", F.array_join(F.transform("files", lambda f: F.concat(f["file"], F.lit("@"), f["revision"])), ","))


@query(f"SELECT event_id AS doc_id, file, revision, date, CAST(author AS VARCHAR) AS author, comment FROM {LOG}")
def g04_parse_changelog(spark, d):
    log = closed(spark, d, X.CHANGELOG)
    stamp = F.coalesce(F.when(F.col("event_id") % 2 == 0, F.date_format("date", "yyyy/MM/dd HH:mm:ss")).otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss")), F.lit("unknown"))
    text = F.concat(F.lit("\nWorking file: "), "file", F.lit("\nhead: 1.1\n"), F.lit("-" * 28), F.lit("\nrevision "), "revision", F.lit("\ndate: "), stamp, F.lit(";  author: "), F.col("author").cast("string"), F.lit(";  state: Exp;\n"), "comment", F.lit("\n" + "=" * 77))
    return R.parse_changelog(log.select(F.col("event_id").alias("doc_id"), text.alias("text")))


@query(f"SELECT file, revision, date, CAST(author AS VARCHAR) AS author, comment FROM {LOG}")
def g04_parse_one_log(spark, d):
    """All entries as one log of numbered lines."""
    log = closed(spark, d, X.CHANGELOG)
    stamp = F.coalesce(F.date_format("date", "yyyy/MM/dd HH:mm:ss"), F.lit("unknown"))
    lines = F.array(F.concat(F.lit("Working file: "), "file"), F.lit("head: 1.1"), F.lit("-" * 28), F.concat(F.lit("revision "), "revision"), F.concat(F.lit("date: "), stamp, F.lit(";  author: "), F.col("author").cast("string"), F.lit(";  state: Exp;")), F.col("comment"), F.lit("=" * 77))
    return R.parse_changelog_lines(log.select(F.lit("log").alias("path"), "event_id", F.posexplode(lines).alias("at", "line")).select("path", (F.col("event_id") * 8 + F.col("at")).alias("line_no"), "line")).drop("path")


@query(f"SELECT event_id FROM {LOG} WHERE date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def g05_date_range(spark, d):
    day = lambda s: F.to_timestamp(F.lit(s))
    return R.dated_between(closed(spark, d, X.CHANGELOG), day("2024-01-05"), day("2024-01-20")).select("event_id")


@query(f"SELECT event_id, coalesce(c_name, CAST(author AS VARCHAR)) AS author FROM {LOG} LEFT JOIN customer ON author = c_custkey")
def j09_display_authors(spark, d):
    return R.display_authors(closed(spark, d, X.CHANGELOG), X.table(spark, d, "customer"), "author", "c_custkey", "c_name").select("event_id", "author")


@query("SELECT concat('src/O', l_orderkey, '.java') AS file, count(*) AS n FROM lineitem GROUP BY l_orderkey UNION ALL SELECT NULL, count(*) FROM lineitem")
def g09_violations(spark, d):
    return R.violation_counts(R.violations(X.derived(spark, d, X.violations_log("spark"))))


@query(f"WITH p AS (SELECT package AS key, CAST(sum(loc) AS BIGINT) AS v, release FROM {C} GROUP BY package, release), a AS (SELECT * FROM p WHERE release = 1995), b AS (SELECT * FROM p WHERE release = 1996) SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.key = b.key WHERE a.v IS DISTINCT FROM b.v")
def j08_snapshot_diff(spark, d):
    p = closed(spark, d, X.CLASS_METRICS).groupBy(F.col("package").alias("key"), "release").agg(F.sum("loc").alias("v"))
    return R.snapshot_diff(p.where("release = 1995"), p.where("release = 1996"), "key", F.col("v"))


EVENTS = f"({X.BUILD_EVENTS})"


@query(f"SELECT event_id, concat(CASE WHEN length(concat('[', target, '] ')) < 12 THEN lpad(concat('[', target, '] '), 12, ' ') ELSE concat('[', target, '] ') END, message) AS line FROM {EVENTS} WHERE priority <= 2")
def r01_record(spark, d):
    return recorder.record(closed(spark, d, X.BUILD_EVENTS))


@query("SELECT event_id, event_type AS line FROM events WHERE event_type IN ('error', 'signup', 'purchase')")
def r01_record_stream(spark, d):
    """The recorder over a stream of the events, run on what is available."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    level = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 3).otherwise(4)
    events = stream.select("event_id", F.col("user_id").alias("target"), level.alias("priority"), F.col("event_type").alias("message"))
    return recorder.run_to_table(recorder.record(events, emacs=True), new_path(spark, "recorded"))


WHILE_ON = f"""WITH a AS ({X.RECORDER_ACTIONS}), m AS ({X.RECORDED}), u AS (
  SELECT m.build, r.recorder, m.ts, m.event_id, 1 AS seq, NULL AS act, concat(CASE WHEN length(concat('[', target, '] ')) < 12 THEN lpad(concat('[', target, '] '), 12, ' ') ELSE concat('[', target, '] ') END, message) AS line
  FROM m JOIN (SELECT DISTINCT build, recorder FROM a) r ON r.build = m.build WHERE priority <= 3
  UNION ALL SELECT build, recorder, ts, event_id, 0, coalesce(action, ''), NULL FROM a)
SELECT build, recorder, event_id, line FROM (SELECT *, last_value(nullif(act, '') IGNORE NULLS) OVER w AS state, last_value(act IGNORE NULLS) OVER w AS known FROM u WINDOW w AS (PARTITION BY build, recorder ORDER BY ts, event_id, seq)) WHERE seq = 1 AND coalesce(state = 'start', known IS NOT NULL)"""


@query(WHILE_ON)
def r01_record_while_on(spark, d):
    """Two recorders for each build, on and off by actions."""
    return recorder.record_while_on(closed(spark, d, X.RECORDED), closed(spark, d, X.RECORDER_ACTIONS), level=3)


def arriving(spark, d, sql, **last_row):
    """The rows of a fixture over ``events`` as a stream that is not in order, with a last row that ends the watermark's wait."""
    path = new_path(spark, "arriving")
    rows = closed(spark, d, sql)
    rows.repartition(6, F.xxhash64("event_id")).write.parquet(path)
    last = rows.agg(F.max("event_id").alias("event_id"), (F.max("ts") + F.expr("interval 400 days")).alias("ts"))
    last.select("event_id", "ts", *[F.lit(last_row.get(c)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("event_id", "ts")]).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query(WHILE_ON)
def r01_record_while_on_stream(spark, d):
    """The same over streams, run to their end: equal to the batch."""
    said, done = arriving(spark, d, X.RECORDED, priority=0, message="end"), arriving(spark, d, X.RECORDER_ACTIONS, recorder="end", action="stop")
    stream = recorder.stream_record_while_on(said, done, level=3, delay="365 days")
    return recorder.run_to_table(stream, new_path(spark, "recorded"))


PAIRS = f"WITH p AS (SELECT *, lead(kind) OVER w AS k, lead(ts) OVER w AS t, lead(event_id) OVER w AS e FROM {EVENTS} WINDOW w AS (PARTITION BY target ORDER BY ts, event_id)), q AS (SELECT *, k = 'finished' AND epoch_us(t) - epoch_us(ts) <= 86400000000 AS done FROM p WHERE kind = 'started') SELECT target, event_id AS started_id, CASE WHEN done THEN e END AS finished_id, CASE WHEN done THEN round((epoch_us(t) - epoch_us(ts)) / 1e6, 3) END AS seconds FROM q"


@query(PAIRS)
def r02_durations(spark, d):
    """Every started event, with its end or unfinished after a day."""
    return recorder.durations(closed(spark, d, X.BUILD_EVENTS), within=86_400.0)


@query(PAIRS)
def r02_durations_stream(spark, d):
    """The same over a stream, run to its end: equal to the batch."""
    stream = recorder.stream_durations(arriving(spark, d, X.BUILD_EVENTS), 86_400.0, delay="365 days")
    return recorder.run_to_table(stream, new_path(spark, "durations"))
