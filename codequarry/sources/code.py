"""Scans and sinks for source trees and metric tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTS = "wmc dit noc cbo rfc lcom ca ce npm loc moa ic cbm max_cc bug".split()
COLUMNS = "name wmc dit noc cbo rfc lcom ca ce npm lcom3 loc dam moa mfa cam ic cbm amc max_cc avg_cc bug".split()
DEFECTS = T.StructType([T.StructField(c, T.StringType() if c == "name" else T.IntegerType() if c in INTS else T.DoubleType()) for c in COLUMNS])


def scan_sources(spark: SparkSession, path: str, require_nonempty: bool = False, glob: str = "*.java") -> DataFrame:
    """``path, text`` of every ``.java`` file below ``path``, whole; a missing path is an analysis error."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if require_nonempty and files.isEmpty():
        raise ValueError(f"no {glob} file below {path}")
    return files


def scan_checked(spark: SparkSession, path: str, glob: str = "*.java") -> tuple[DataFrame, DataFrame]:
    """``(files, failures)``: ``path, text`` of what can be read, and ``path, problem`` of what cannot; neither ends the job.

    Files are listed apart from reading them: one that breaks while it is read is ``unreadable``, one of which less comes than its length ``cut off``, one whose bytes are no UTF-8 ``undecodable``.  Empty files, and files that go away
    meanwhile, are in neither.
    """
    reader = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreMissingFiles", True)
    listed, whole = reader().load(path).select("path"), reader().option("ignoreCorruptFiles", True).load(path)
    text = F.col("content").cast("string")
    good = F.is_valid_utf8(text) & (F.octet_length("content") == F.col("length"))
    files = whole.where(good).select("path", text.alias("text"))
    told = whole.select(F.col("path").alias("_path"), F.when(F.octet_length("content") < F.col("length"), "cut off").when(~F.is_valid_utf8(text), "undecodable").alias("problem"))
    read = listed.join(told, F.col("path") == F.col("_path"), "left")
    return files, read.select("path", F.when(F.col("_path").isNull(), "unreadable").otherwise(F.col("problem")).alias("problem")).where("problem is not null")


def scan_releases(spark: SparkSession, releases: dict[str, str], glob: str = "*.java") -> DataFrame:
    """``release, path, text`` of several trees in one job."""
    scans = [scan_sources(spark, p, glob=glob).select(F.lit(r).alias("release"), "path", "text") for r, p in releases.items()]
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out


def to_full_format(metrics: DataFrame) -> DataFrame:
    """The 22 columns of a defect table; what is not computed is 0."""
    return metrics.select(*[F.col(f.name).cast(f.dataType) if f.name in ("name", "npm", "loc") else F.lit(0).cast(f.dataType).alias(f.name) for f in DEFECTS])


def write_metrics_csv(metrics: DataFrame, path: str, include_all_columns: bool = False) -> None:
    """CSV sorted by name with a header and CRLF line ends; ``name,npm,loc`` or all 22 columns."""
    rows = to_full_format(metrics) if include_all_columns else metrics.select("name", "npm", "loc")
    rows.orderBy("name").write.mode("overwrite").csv(path, header=True, lineSep="\r\n", escape='"')


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Defect tables below ``path`` with ``project`` and ``release`` from ``.../project/release.csv``."""
    rows = spark.read.option("recursiveFileLookup", True).schema(DEFECTS).csv(path, header=True, escape='"', lineSep="\r\n")
    file = F.regexp_replace(F.col("_metadata.file_path"), "/part-[^/]*$", "")  # a table that Spark wrote is a folder
    return rows.select("*", F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("project"), F.regexp_extract(file, r"([^/]+?)(?:\.csv)?$", 1).alias("release"))


def sql_export(spark: SparkSession, sql: str, args: dict, path: str, append: bool = False) -> None:
    """Run a parameterised statement and write its rows as text: header, comma-joined trimmed values."""
    rows = spark.sql(sql, args=args)
    rows.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in rows.columns]).write.mode("append" if append else "overwrite").csv(path, header=True)


def sql_run(spark: SparkSession, statements: list[str], args: dict, path: str, on_error: str = "abort") -> DataFrame:
    """Run statements in turn, each exported to ``path/k`` (from 0), and tell ``statement, ok, rows, error`` of each that was begun.

    A statement that fails is told with its error.  ``continue`` goes on with the next, ``stop`` ends the run there without
    failing, ``abort`` raises its error.
    """
    if on_error not in ("continue", "stop", "abort"):
        raise ValueError("on_error is continue, stop or abort")
    told = []
    for k, sql in enumerate(statements):
        counted = Observation()
        try:
            rows = spark.sql(sql, args={n: v for n, v in args.items() if f":{n}" in sql})
            rows.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in rows.columns]).observe(counted, F.count(F.lit(1)).alias("n")).write.csv(f"{path}/{k}", header=True)
            told.append((k, True, counted.get["n"], None))
        except PySparkException as e:
            if on_error == "abort":
                raise
            told.append((k, False, None, e.getCondition() or type(e).__name__))
            if on_error == "stop":
                break
    return spark.createDataFrame(told, "statement int, ok boolean, rows long, error string")


_TOLD = "struct<_present:string,_message:string,_type:string,_VALUE:string>"
_CASES = f"array<struct<_name:string,_classname:string,_time:string,failure:{_TOLD},error:{_TOLD}>>"
_SUITE = f"_name string, _tests string, _failures string, _errors string, _time string, testcase {_CASES}, _bad string"
_ROOT = r"^(?:\s++|<\?[\s\S]*?\?>|<!--[\s\S]*?-->|<!DOCTYPE[^>]*+>)*+<([\w:.-]++)"


def _suites(xml: DataFrame) -> DataFrame:
    """Documents with ``s``, the parsed suite, and ``problem``.  An outcome without text or attributes is marked, so that it is seen."""
    marked = F.regexp_replace("xml", r"<(failure|error)(?=[\s/>])", '<$1 present="1"')
    s = F.from_xml(marked, _SUITE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "rowTag": "testsuite"})
    rows = xml.select("*", F.explode_outer(F.array(s)).alias("s"))  # once: filters on it are not pushed ahead of the parser, where they would parse again
    blank = F.coalesce(F.trim("xml"), F.lit("")) == ""
    problem = F.when(blank, "empty").when(F.col("s._bad").isNotNull(), "malformed").when(F.regexp_extract("xml", _ROOT, 1) != "testsuite", "wrong root")
    package, dotted = F.regexp_extract("s._name", r"^(.*)\.[^.]*$", 1), F.col("s._name").contains(".")
    rows = rows.withColumns({"problem": problem, "package": F.when(dotted, package).otherwise("")})
    return rows.withColumn("classname", F.when(dotted, F.regexp_extract("s._name", r"([^.]*)$", 1)).otherwise(F.coalesce("s._name", F.lit(""))))


def read_suites(xml: DataFrame) -> DataFrame:
    """``id, package, classname, tests, failures, errors, seconds`` of test-result documents in column ``xml``.

    Documents are parsed as XML: either kind of quote, entities, comments and prologues.  Empty texts, other roots and
    documents that are cut off are skipped, ``suite_problems`` names them; numbers that are none are null.
    """
    rows = _suites(xml).where("problem is null").withColumn("id", F.xxhash64("package", "classname"))
    return rows.select("package", "classname", *[F.col(f"s._{a}").try_cast("long").alias(a) for a in ("tests", "failures", "errors")], F.col("s._time").try_cast("double").alias("seconds"), "id")


def suite_problems(xml: DataFrame) -> DataFrame:
    """``xml, problem`` of the documents that are skipped: empty, malformed or wrong root."""
    return _suites(xml).where("problem is not null").select("xml", "problem")


def suite_cases(xml: DataFrame) -> DataFrame:
    """``package, classname, name, seconds, status, message`` of each test case: passed, failure or error."""
    # no filter and no inner explode ahead of the cases: Spark would parse each document once more for every such test
    cases = _suites(xml).select("package", "classname", F.explode_outer(F.when(F.col("problem").isNull(), F.col("s.testcase"))).alias("c")).where("c is not null")
    status = F.when(F.col("c.error").isNotNull(), "error").when(F.col("c.failure").isNotNull(), "failure").otherwise("passed")
    told = F.coalesce("c.error", "c.failure")
    return cases.select("package", "classname", F.col("c._name").alias("name"), F.col("c._time").try_cast("double").alias("seconds"), status.alias("status"), F.coalesce(told["_message"], told["_VALUE"]).alias("message"))
