"""Queries over manifests: predicates, joins, set algebra, lengths, mappers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import mappers as N
from ..functions import predicates as P
from ..functions.user import name_mapper, predicate
from ..operators import manifests as J
from ..operators import reports as R
from ..operators.snapshots import modified_and_kept
from ..shared import new_path

Q: dict = {}
O: dict[str, str] = {}
MD, TD = f"({X.manifest('duckdb')})", f"({X.manifest_target('duckdb')})"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def man(spark, d):
    return X.derived(spark, d, X.manifest("spark"))


def target(spark, d):
    return X.derived(spark, d, X.manifest_target("spark"))


def kept(name: str, test, where: str):
    """Register a filter of the manifest under ``name``."""
    def run(spark, d):
        return P.restrict(man(spark, d), test()).select("name")

    run.__name__ = name
    query(f"SELECT name FROM {MD} WHERE {where}")(run)


n, size, when_ = (lambda: F.col("name")), (lambda: F.col("size")), (lambda: F.col("last_modified"))
kept("p01_glob", lambda: P.glob(n(), "**/src1?/*5.txt"), r"regexp_matches(name, '^(.*/)?src1[^/]/[^/]*5\.txt$')")
kept("p04_size", lambda: P.size_is(size(), 2, "K", "greater", F.col("is_dir")), "is_dir OR size > 2000")
kept("p05_date_before", lambda: P.time_is(when_(), F.to_timestamp(F.lit("2024-01-01 02:00:00")), "before", 1000), "epoch_ms(last_modified) - 1000 < epoch_ms(TIMESTAMP '2024-01-01 02:00:00')")
kept("p05_date_equal", lambda: P.time_is(when_(), F.to_timestamp(F.lit("2024-01-01 02:00:00")), "equal", 60000), "abs(epoch_ms(last_modified) - epoch_ms(TIMESTAMP '2024-01-01 02:00:00')) <= 60000")
kept("p05_date_pattern", lambda: P.time_is(when_(), P.moment_of("01/01/2024 03:00 AM"), "after"), "epoch_ms(last_modified) > epoch_ms(TIMESTAMP '2024-01-01 03:00:00')")
kept("p06_depth_below", lambda: P.depth_below(F.concat(F.lit("base/"), n()), F.lit("base")) >= 2, "len(string_split(name, '/')) - 1 >= 2")
kept("p06_depth", lambda: P.depth_between(n(), 2, 2), "len(string_split(name, '/')) - 1 BETWEEN 2 AND 2")
kept("p07_type_exists", lambda: P.all_of(P.is_file(F.col("is_dir")), P.exists(F.col("exist"))), "NOT is_dir AND exist")
kept("p08_combinators", lambda: P.any_of(P.xor(F.col("is_dir"), F.col("exist")) & (size() > 500), P.none_of(F.col("exist"), size() > 900)), "((is_dir <> exist) AND size > 500) OR NOT (exist OR size > 900)")
kept("p09_majority", lambda: P.majority(F.col("exist"), size() > 1000, n().startswith("en"), F.col("is_dir")), "(exist::INT + (size > 1000)::INT + starts_with(name, 'en')::INT + is_dir::INT) * 2 >= 4")
kept("p11_restrict", lambda: P.all_of(size() > 100, ~F.col("is_dir"), P.glob(n(), "en/**")), "size > 100 AND NOT is_dir AND name LIKE 'en/%'")
kept("p13_pattern_set", lambda: P.pattern_set(n(), ["en/**", "de/**"], ["**/src1/**"]), "(name LIKE 'en/%' OR name LIKE 'de/%') AND NOT name LIKE '%/src1/%'")


@query("SELECT doc_id FROM documents WHERE list_bool_or(list_transform(string_split(text, chr(10)), lambda l: contains(regexp_replace(lower(l), '\\s+', '', 'g'), 'ofthe')))")
def p02_line_contains(spark, d):
    return X.table(spark, d, "documents").where(P.line_contains(F.col("text"), "Of The", case_sensitive=False, ignore_whitespace=True)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE list_bool_or(list_transform(string_split(text, chr(10)), lambda l: regexp_matches(l, '^[A-Z][a-z]+ing\\b')))")
def p03_line_matches(spark, d):
    return X.table(spark, d, "documents").where(P.line_matches(F.col("text"), r"^[A-Z][a-z]+ing\b")).select("doc_id")


@query("SELECT o_orderkey, o_totalprice > 150000 AS more, o_totalprice <= 50000 AS le, o_totalprice <> 100000 AS ne FROM orders")
def p10_comparison(spark, d):
    p = F.col("o_totalprice")
    return X.table(spark, d, "orders").select("o_orderkey", P.COMPARISONS["more"](p, F.lit(150000)).alias("more"), P.COMPARISONS["le"](p, F.lit(50000)).alias("le"), P.COMPARISONS["ne"](p, F.lit(100000)).alias("ne"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT max(s_acctbal) FROM supplier) ")
def p12_greater_than_all(spark, d):
    return P.compare_with(X.table(spark, d, "customer"), "c_acctbal", X.table(spark, d, "supplier"), "s_acctbal", "greater", "all").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM supplier WHERE c_acctbal < s_acctbal) * 2 > (SELECT count(*) FROM supplier)")
def p12_less_than_most(spark, d):
    return P.compare_with(X.table(spark, d, "customer"), "c_acctbal", X.table(spark, d, "supplier"), "s_acctbal", "less", "most").select("c_custkey")


@query("SELECT p_partkey, contains(lower(p_name), 'an') AS has, lower(trim(p_type)) = 'promo' AS same, regexp_matches(p_type, '(?i)^standard') AS fits FROM part")
def p14_string_conditions(spark, d):
    return X.table(spark, d, "part").select("p_partkey", P.text_contains(F.col("p_name"), F.lit("AN"), False).alias("has"), P.text_equals(F.col("p_type"), F.lit("PROMO"), True, False).alias("same"), P.text_matches(F.col("p_type"), "^standard", False).alias("fits"))


@query(f"SELECT name FROM {MD} m WHERE EXISTS (SELECT 1 FROM {TD} t WHERE t.name = m.name AND t.exist)")
def j01_present_both(spark, d):
    return J.present(man(spark, d), target(spark, d)).select("name")


@query(f"SELECT name FROM {MD} m WHERE NOT EXISTS (SELECT 1 FROM {TD} t WHERE t.name = m.name AND t.exist)")
def j01_present_source_only(spark, d):
    return J.present(man(spark, d), target(spark, d), present_in="srconly").select("name")


@query(f"SELECT m.name FROM {MD} m LEFT JOIN {TD} t ON t.name = m.name WHERE (m.exist <> (t.name IS NOT NULL AND t.exist)) OR (m.exist AND t.name IS NOT NULL AND t.exist AND (m.size <> t.size OR abs(epoch_ms(m.last_modified) - epoch_ms(t.last_modified)) > 1000 OR sha256(m.content) <> sha256(t.content)))")
def j02_different(spark, d):
    return J.different(man(spark, d), target(spark, d), ignore_times=False).select("name")


STALE = f"SELECT m.name FROM {MD} m LEFT JOIN {TD} t ON t.name = m.name WHERE m.exist AND (t.name IS NULL OR NOT t.exist OR epoch_ms(m.last_modified) - 1000 > epoch_ms(t.last_modified))"


@query(STALE)
def j03_out_of_date(spark, d):
    return J.out_of_date(man(spark, d), target(spark, d)).select("name")


@query(f"WITH x AS (SELECT m.name, m.last_modified AS lm, unnest([m.name, concat('orphan/', m.ordinal, '.txt')]) AS tn FROM {MD} m WHERE m.exist) SELECT x.name, bool_or(lm > TIMESTAMP '2024-01-02') AS in_future FROM x LEFT JOIN {TD} t ON t.name = tn GROUP BY x.name HAVING bool_or(t.name IS NULL OR NOT t.exist OR (NOT t.is_dir AND epoch_ms(lm) - 1000 > epoch_ms(t.last_modified)))")
def j04_out_of_date_any(spark, d):
    """Of the rows that exist."""
    m = man(spark, d).where("exist")
    targets = F.array("name", F.concat(F.lit("orphan/"), F.col("ordinal").cast("string"), F.lit(".txt")))
    return J.out_of_date_any(m, target(spark, d), targets, F.to_timestamp(F.lit("2024-01-01 23:59:59")))


@query(f"WITH x AS (SELECT m.name, m.last_modified AS lm, unnest([m.name, concat('orphan/', m.ordinal, '.txt')]) AS tn FROM {MD} m) SELECT x.name, bool_or(lm > TIMESTAMP '2024-01-02') AS in_future FROM x LEFT JOIN {TD} t ON t.name = tn GROUP BY x.name HAVING bool_or(t.name IS NULL OR NOT t.exist OR (NOT t.is_dir AND epoch_ms(lm) - 1000 > epoch_ms(t.last_modified)))")
def j04_out_of_date_any_all(spark, d):
    """Over the whole manifest."""
    m = man(spark, d)
    targets = F.array("name", F.concat(F.lit("orphan/"), F.col("ordinal").cast("string"), F.lit(".txt")))
    return J.out_of_date_any(m, target(spark, d), targets, F.to_timestamp(F.lit("2024-01-01 23:59:59")))


@query(f"SELECT count(*) = 0 AS up_to_date FROM ({STALE})")
def j05_up_to_date(spark, d):
    return J.up_to_date(man(spark, d), target(spark, d))


@query("SELECT (SELECT min(l_shipdate) FROM lineitem) >= (SELECT max(o_orderdate) FROM orders) AS fresh")
def j06_dependencies_fresh(spark, d):
    return J.dependencies_fresh(X.table(spark, d, "orders"), "o_orderdate", X.table(spark, d, "lineitem"), "l_shipdate")


SYNC = f"SELECT coalesce(s.name, t.name) AS name, CASE WHEN s.name IS NULL THEN CASE WHEN t.name LIKE 'orphan/1%' THEN 'keep' ELSE 'remove' END WHEN t.name IS NULL OR epoch_ms(s.last_modified) - 1000 > epoch_ms(t.last_modified) THEN 'copy' ELSE 'keep' END AS action FROM (SELECT * FROM {MD} WHERE exist AND NOT is_dir) s FULL JOIN (SELECT * FROM {TD} WHERE exist AND NOT is_dir) t ON s.name = t.name"


@query(SYNC)
def j07_sync_plan(spark, d):
    return J.sync_plan(man(spark, d), target(spark, d), P.glob(F.col("name"), "orphan/1*"))


@query(f"SELECT regexp_extract(name, '^(.*)/[^/]*$', 1) AS dir FROM (SELECT coalesce(s.name, t.name) AS name, s.name IS NULL AS gone FROM (SELECT * FROM {MD} WHERE exist AND NOT is_dir) s FULL JOIN (SELECT * FROM {TD} WHERE exist AND NOT is_dir) t ON s.name = t.name) GROUP BY 1 HAVING bool_and(gone)")
def j07_emptied_directories(spark, d):
    return J.emptied_directories(J.sync_plan(man(spark, d), target(spark, d)))


@query(f"SELECT m.name FROM {MD} m LEFT JOIN {TD} t ON t.name = m.name WHERE t.name IS NULL OR sha256(m.content) IS DISTINCT FROM sha256(t.content)")
def j10_modified_since(spark, d):
    return J.modified_since(man(spark, d), target(spark, d)).select("name")


@query(f"SELECT 1 AS run, name FROM {TD} GROUP BY name UNION ALL SELECT 2, m.name FROM {MD} m LEFT JOIN {TD} t ON t.name = m.name WHERE t.name IS NULL OR sha256(m.content) IS DISTINCT FROM sha256(t.content)")
def j10_kept_snapshot(spark, d):
    """Three runs over a snapshot that is kept: the target, then the source, then the source again, which finds nothing."""
    path = new_path(spark, "snapshot")
    runs = [modified_and_kept(rows(spark, d), path).select(F.lit(k).alias("run"), "name") for k, rows in ((1, target), (2, man), (3, man))]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("SELECT n_chars, count(DISTINCT sha256(text)) <= 1 AS all_match FROM documents GROUP BY n_chars")
def j11_contents_match(spark, d):
    return J.contents_match(X.table(spark, d, "documents"), ["n_chars"], "text")


@query(f"SELECT m.name, CASE WHEN ordinal % 3 = 0 THEN false ELSE true END AS ok FROM {MD} m")
def j12_verify_digests(spark, d):
    m = man(spark, d)
    recorded = m.select("name", F.md5(F.when(F.col("ordinal") % 3 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))).alias("checksum"))
    return J.verify_digests(m, recorded)


def slices(spark, d):
    m = man(spark, d)
    return [m.where("ordinal % 2 = 0"), m.where("ordinal % 3 = 0"), m.where("ordinal % 5 = 0")]


@query(f"SELECT name FROM {MD} WHERE ordinal % 2 = 0 OR ordinal % 3 = 0 OR ordinal % 5 = 0")
def e01_union(spark, d):
    return J.union_distinct(slices(spark, d), ["name"], "ordinal").select("name")


@query(f"SELECT name FROM {MD} WHERE ordinal % 30 = 0")
def e02_intersect(spark, d):
    return J.intersect_all(slices(spark, d), ["name"]).select("name")


@query(f"SELECT name FROM {MD} WHERE (ordinal % 2 = 0)::INT + (ordinal % 3 = 0)::INT + (ordinal % 5 = 0)::INT = 1")
def e03_difference(spark, d):
    return J.difference(slices(spark, d), ["name"])


@query(f"SELECT name FROM {MD} ORDER BY ordinal LIMIT 7")
def e04_first(spark, d):
    """The feature is the limit itself."""
    return J.first_rows(man(spark, d), 7).select("name")


@query(f"SELECT name, row_number() OVER (PARTITION BY split_part(name, '/', 1) ORDER BY is_dir, size DESC, ordinal) AS rank FROM {MD}")
def e05_sort_rank(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy(F.split_part("name", F.lit("/"), F.lit(1))).orderBy(*J.sort_keys("type", "-size"))
    return man(spark, d).select("name", F.row_number().over(w).alias("rank"))


@query(f"SELECT name, row_number() OVER (ORDER BY is_dir, size DESC, ordinal) AS rank FROM {MD}")
def e05_sort_global(spark, d):
    """Places in the order of the whole manifest."""
    return J.sort_ranks(man(spark, d), "type", "-size").select("name", "rank")


@query(f"SELECT first_value(name) OVER (PARTITION BY size, is_dir ORDER BY ordinal) AS name, ordinal FROM {MD}")
def e06_representatives(spark, d):
    return J.representatives(man(spark, d), "size", "type").select("name", "ordinal")


@query("SELECT doc_id, CAST(i - 1 AS INT) AS position, l[i] AS token FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) AS t(i)")
def e07_tokens(spark, d):
    return J.tokens(X.table(spark, d, "documents"), "doc_id", F.split("text", "\n", -1))


@query(f"SELECT 0 AS branch, count(*) AS n FROM {MD} WHERE ordinal % 2 = 0 UNION ALL SELECT 1, count(*) FROM {MD} WHERE ordinal % 3 = 0 UNION ALL SELECT 2, count(*) FROM {MD} WHERE ordinal % 5 = 0")
def e08_concatenation(spark, d):
    return J.concatenated(slices(spark, d)).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('part.', p_name) AS key, p_brand FROM part WHERE NOT (p_name LIKE 'a%' OR regexp_matches(p_name, 'ee'))")
def e09_property_subset(spark, d):
    return J.property_subset(X.table(spark, d, "part").select(F.col("p_name").alias("key"), "p_brand"), "key", prefix="a", regex="ee", negate=True, mapped=N.glob_map(F.col("key"), "*", "part.*"))


@query(f"SELECT count(*) AS n, count(*) > 100 AS more FROM {MD}")
def g01_count(spark, d):
    c = man(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("more", P.COMPARISONS["more"](F.col("n"), F.lit(100)))


@query(f"SELECT name, CASE WHEN exist AND NOT is_dir THEN size END AS length FROM {MD}")
def g02_length_each(spark, d):
    return J.length_each(man(spark, d))


@query(f"SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS length FROM {MD} WHERE exist AND NOT is_dir")
def g02_length_all(spark, d):
    return J.length_all(man(spark, d))


@query(f"SELECT name, CASE WHEN name LIKE 'en/%' AND name LIKE '%.txt' THEN concat('out/', substr(name, 4, length(name) - 7), '.bak') END AS mapped FROM {MD}")
def t20_glob_mapper(spark, d):
    return man(spark, d).select("name", N.glob_map(F.col("name"), "en/*.txt", "out/*.bak").alias("mapped"))


@query(f"SELECT name, CASE WHEN regexp_matches(name, '^(..)/src1(.)/(.*)$') THEN regexp_replace(name, '^(..)/src1(.)/(.*)$', '\\3-\\1-\\2') END AS mapped FROM {MD}")
def t21_regex_mapper(spark, d):
    return man(spark, d).select("name", N.regex_map(F.col("name"), r"^(..)/src1(.)/(.*)$", r"\3-\1-\2").alias("mapped"))


@query(f"SELECT name, split_part(name, '/', 3) AS flat, 'one' AS merged, replace(substr(name, 1, length(name) - 4), '/', '.') AS package FROM {MD}")
def t22_mappers(spark, d):
    x = F.col("name")
    return man(spark, d).select("name", N.flatten(x).alias("flat"), N.merge(x, "one").alias("merged"), N.package_map(x, "*.txt", "*").alias("package"))


@query(f"SELECT name, CASE WHEN name LIKE 'en/%' THEN concat(name, ',', split_part(name, '/', 3), ',', 'x/' || substr(name, 4)) ELSE concat(name, ',', split_part(name, '/', 3)) END AS names, concat('flat/', split_part(name, '/', 3)) AS piped, concat('x/', name, ',x/', split_part(name, '/', 3)) AS both FROM {MD}")
def t23_combinators(spark, d):
    x = F.col("name")
    both = N.composite(x, lambda c: c, N.flatten, lambda c: N.glob_map(c, "en/*", "x/*"), lambda c: c)
    return man(spark, d).select("name", F.array_join(both, ",").alias("names"), F.array_join(N.chained(x, N.flatten, lambda c: N.glob_map(c, "*", "flat/*")), ",").alias("piped"), F.array_join(N.chained(x, N.many(lambda c: N.composite(c, lambda y: y, N.flatten)), lambda c: N.glob_map(c, "*", "x/*")), ",").alias("both"))


ENTRY = "replace(CASE WHEN name LIKE 'en/%' THEN 'E:' || substr(name, 4) WHEN name LIKE 'de/%' THEN 'D:' || substr(name, 4) ELSE name END, '/', '\\')"


@query(f"SELECT source, ordinal, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY ordinal, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, text FROM (SELECT split_part(name, '/', 2) AS source, ordinal, {ENTRY} AS text FROM {MD})")
def t26_path_list(spark, d):
    """Entries in order, each with its place in the joined list."""
    entry = N.mapped_path(F.col("name"), [("en/", "E:"), ("de/", "D:")], "\\")
    rows = man(spark, d).select(F.split_part("name", F.lit("/"), F.lit(2)).alias("source"), "ordinal", entry.alias("text"))
    return R.concat_docs(rows, "source", "ordinal", separator=";")


@query(f"SELECT name FROM {MD} WHERE length(name) % 2 = 0")
def u01_user_predicate(spark, d):
    return P.restrict(man(spark, d), predicate(lambda s: len(s) % 2 == 0)(F.col("name"))).select("name")


@query(f"SELECT name, unnest(string_split(name, '/')) AS mapped FROM {MD}")
def u03_user_mapper(spark, d):
    return man(spark, d).select("name", F.explode(name_mapper(lambda s: s.split("/"))(F.col("name"))).alias("mapped"))
