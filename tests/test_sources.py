"""Sources that are read in many splits, checked, kept from run to run, or parsed as XML; logs and outlines across ranges."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from codequarry import shared
from codequarry.operators import reports as R
from codequarry.operators import snapshots as V
from codequarry.plans import metrics as P
from codequarry.sources import code as S
from codequarry.sources import lines as L


@pytest.fixture()
def many_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "200")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_lines_of_files_in_many_splits(spark, tmp_path, many_splits):
    rng = random.Random(1)
    texts = {f"f{k}.txt": "".join("word%d " % i * rng.randint(0, 6) + rng.choice(["\n", "\r\n", "\n\n"]) for i in range(n)) + tail for k, (n, tail) in enumerate([(300, "last"), (200, ""), (0, ""), (1, "x"), (0, "alone")])}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    lines = L.scan_lines(spark, str(tmp_path), "*.txt")
    want = {n: t.replace("\r\n", "\n").split("\n")[: None if t and not t.endswith("\n") else -1] for n, t in texts.items()}
    by_file = lambda df, c: {n: [r[c] for r in sorted(df.collect(), key=lambda r: r[1]) if r["path"].endswith(n)] for n in texts}
    got = by_file(lines, "line")
    assert got == want and by_file(lines, "line_no") == {n: list(range(1, len(w) + 1)) for n, w in want.items()}
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    for n, skip in ((10, 0), (3, 5), (0, 2), (5, 1000)):
        assert by_file(L.head_lines(lines, n, skip), "line") == {f: w[skip : skip + n if n > 0 else None] for f, w in want.items()}
        end = lambda w: w[: len(w) - skip] if skip <= len(w) else []  # noqa: B023, E731
        assert by_file(L.tail_lines(lines, n or -1, skip), "line") == {f: end(w)[-n:] if n else end(w) for f, w in want.items()}
    assert by_file(L.line_tokens(lines, F.regexp_extract_all("line", F.lit("\\S+"), F.lit(0))), "token") == {f: " ".join(w).split() for f, w in want.items()}


def test_snapshot_is_kept_and_a_failed_run_leaves_it(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kept")
    frame = lambda rows: spark.createDataFrame(rows, "name string, content string")
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(V.modified_and_kept(frame([("a", "1"), ("b", None), (None, "x"), ("c", "1"), ("c", "2")]), path)) == ["a", "b", "c"]
    assert names(V.modified_and_kept(frame([("a", "1"), ("b", None)]), path)) == []
    boom = F.udf(lambda s: 1 / 0, "string")
    with pytest.raises(PySparkException):
        V.modified_and_kept(frame([("a", "9")]), path, boom)
    assert names(V.modified_and_kept(frame([("a", "1"), ("d", "1"), ("b", "now")]), path)) == ["b", "d"]
    monkeypatch.setattr(V, "FULL_EVERY", 2)
    for k in range(5):
        assert names(V.modified_and_kept(frame([("a", str(k)), ("d", "1")]), path)) == ["a"]
    assert names(V.modified_and_kept(frame([("a", "4"), ("b", "now"), ("d", "1")]), path)) == [] and len(V.versions(spark, path)) <= 2
    assert {r["name"] for r in V.kept_snapshot(spark, path).collect()} == {"a", "b", "c", "d"} and V.kept_snapshot(spark, str(tmp_path / "none")).count() == 0


def test_checked_scan(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/Good.java").write_text("class Good {}\n")
    (tmp_path / "p/Cut.java").write_text("class Cut { void f() {")
    (tmp_path / "p/Bad.java").write_bytes(b"class Bad { \xff }")
    (tmp_path / "p/Gone.java").write_text("class Gone {}")
    (tmp_path / "p/Empty.java").write_text("")
    (tmp_path / "p/Broken.java").write_text("class Broken {}")
    (tmp_path / "p/.Broken.java.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + bytes(4))  # a checksum that does not hold
    files, failures = S.scan_checked(spark, str(tmp_path))
    (tmp_path / "p/Gone.java").unlink()
    last = lambda p: p.rsplit("/", 1)[1]
    assert {last(r["path"]): r["text"] for r in files.collect()} == {"Good.java": "class Good {}\n", "Cut.java": "class Cut { void f() {"}
    assert {last(r["path"]): r["problem"] for r in failures.collect()} == {"Bad.java": "undecodable", "Broken.java": "unreadable"}


def test_statements_and_error_policies(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("three")
    statements = ["SELECT id FROM three WHERE id >= :n", "SELECT raise_error('no') FROM three", "SELECT 1 AS x"]
    told = lambda policy: [(r["statement"], r["ok"], r["rows"]) for r in S.sql_run(spark, statements, {"n": 1}, str(tmp_path / policy), policy).orderBy("statement").collect()]
    assert told("continue") == [(0, True, 2), (1, False, None), (2, True, 1)] and told("stop") == [(0, True, 2), (1, False, None)]
    with pytest.raises(PySparkException):
        told("abort")
    assert spark.read.csv(str(tmp_path / "continue/0"), header=True).count() == 2
    with pytest.raises(ValueError):
        told("ignore")


def test_suites_as_xml(spark):
    rows = [
        "<testsuite name='a.b.C' tests='2' failures=\"1\" errors='0' time='1.5'><testcase name='t&amp;1' time='0.5'/><testcase name='t2'><failure message='x &lt; &#65;'>stack</failure></testcase><testcase name='t3'><error/></testcase></testsuite>",
        "<?xml version='1.0'?>\n<!-- c --><testsuite name='one' tests='x'><system-out><![CDATA[ a < b ]]></system-out><testcase name='t'><failure>said</failure></testcase></testsuite>",
        "", None, "<other/>", "<suites><testsuite name='in'/></suites>", "<testsuite name='a.b'", "<testsuite name='a'><testcase name='t'/>", "none",
    ]
    xml = spark.createDataFrame([(r,) for r in rows], "xml string")
    got = {(r["package"], r["classname"], r["tests"], r["failures"], r["errors"], r["seconds"]) for r in S.read_suites(xml).collect()}
    assert got == {("a.b", "C", 2, 1, 0, 1.5), ("", "one", None, None, None, None)}
    assert sorted(r["problem"] for r in S.suite_problems(xml).collect()) == ["empty"] * 2 + ["malformed"] * 3 + ["wrong root"] * 2
    cases = {(r["classname"], r["name"], r["status"], r["message"]) for r in S.suite_cases(xml).collect()}
    assert cases == {("C", "t&1", "passed", None), ("C", "t2", "failure", "x < A"), ("C", "t3", "error", None), ("one", "t", "failure", "said")}


def test_a_suite_is_parsed_once(spark):
    """No filter and no test of whether a document has cases stands ahead of the parser: it would parse the document again."""
    xml = spark.range(3).select(F.concat(F.lit("<testsuite name='s"), F.col("id").cast("string"), F.lit("'/>")).alias("xml"))
    for read in (S.suite_cases, S.read_suites, S.suite_problems):
        assert read(xml)._jdf.queryExecution().optimizedPlan().toString().lower().count("from_xml") == 1


def test_one_log_in_ranges_equals_the_whole_text(spark):
    rng, text = random.Random(3), "header\n"
    for f in range(12):
        text += f"Working file: src/f{f}.java\nhead: 1.{f}\n"
        for r in range(rng.randint(0, 4)):
            text += "-" * 28 + f"\nrevision 1.{r}\ndate: 2002/01/0{r + 1} 10:00:00;  author: u{r};  state: Exp;\n" + "".join(rng.choice(["a line\n", "\n", "date: of old\n", " x \n"]) for _ in range(rng.randint(0, 3)))
        text += "=" * 77 + "\n"
    whole = R.parse_changelog(spark.createDataFrame([("l", text)], "doc_id string, text string"))
    lines = spark.createDataFrame([("l", k, t) for k, t in enumerate(text.split("\n")[:-1])], "path string, line_no long, line string").repartition(5)
    got, want = (sorted(tuple(r)[1:] for r in df.collect()) for df in (R.parse_changelog_lines(lines), whole))
    assert [g[:4] for g in got] == [w[:4] for w in want] and [g[4].split() for g in got] == [w[4].split() for w in want] and len(got) > 12


def test_levels_against_a_stack(spark):
    rng, rows = random.Random(9), []
    for k in range(400):
        rows.append(("log", k, rng.randint(0, 5), rng.choice(["a", "b", "F.java", "G.class", "m()", "c"])))
    want, stack = {}, []
    for _, k, indent, name in rows:
        while stack and stack[-1][1] >= indent:
            stack.pop()
        kind = "file" if name[-5:] in (".java", "class") else "method" if "(" in name else "class" if stack and stack[-1][2] in ("file", "class") else "package"
        want[k] = (kind, stack[-1][0] if stack else None)
        stack.append((k, indent, kind))
    df = spark.createDataFrame(rows, "log string, line_no long, indent int, name string").repartition(3)
    assert {r["line_no"]: (r["level"], r["parent"]) for r in R.infer_levels(df).collect()} == want
    assert R.infer_levels(df.limit(0)).count() == 0


def test_levels_write_no_more_than_the_outline(spark, monkeypatch):
    """What each element carries is worked out behind the ranges, so that it is neither dealt nor written."""
    written = []
    monkeypatch.setattr(shared, "cut", lambda df, _cut=shared.cut: written.append(df.columns) or _cut(df))
    df = spark.createDataFrame([("log", 0, 0, "a"), ("log", 1, 1, "F.java")], "log string, line_no long, indent int, name string")
    assert R.infer_levels(df).count() == 2 and written == [["log", "line_no", "indent", "name", "_part"]]


def test_trees_are_of_files_of_bounded_size(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    sources = P.files(spark, d).select("release", (F.col("o_orderkey") % 10).alias("k"), F.length("text").alias("n")).collect()
    monkeypatch.setattr(P, "FILE_ROWS", 20)
    path = P.tree(spark, d, F.col("o_orderkey") % 10)
    found = [r["text"] for r in S.scan_sources(spark, path, glob="*.txt").collect()]
    assert max(t.count("package ") for t in found) <= 20 and sum(t.count("package ") for t in found) == len(sources)
    by = lambda c: {str(v): sum(r["n"] + 1 for r in sources if r[c] == v) for v in {r[c] for r in sources}}
    assert {r["k"]: r["chars"] for r in P.s01_scan_sources(spark, d).collect()} == by("k")
    assert {r["release"]: r["chars"] for r in P.s07_scan_releases(spark, d).collect()} == by("release")
    checked = {r["k"]: (r["problem"], r["chars"]) for r in P.s03_checked_scan(spark, d).collect()}
    assert checked == {k: ("undecodable", None) if int(k) % 3 == 0 else (None, n) for k, n in by("k").items()}
    assert [tuple(r) for r in P.s02_nothing_found(spark, d).collect()] == [(len(sources), "ValueError")]
