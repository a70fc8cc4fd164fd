import pytest
from pyspark.sql import functions as F

from codequarry.functions.lines import code_lines, physical_lines, simple_code_lines
from codequarry.operators import declarations as D
from codequarry.operators import reports as R
from codequarry.sources import code as S

SAMPLE = """package a.b;

import x.Y; // note { brace
/** doc */
public class Outer extends Base implements Runnable, Comparable {
  private String s = "class Fake { public void no() {} }";
  /* public void gone() {} */
  public Outer() { }
  protected int f(int a, int b) throws Exception {
    if (a > b && a > 0) { return 1; }
    for (int i = 0; i < 3; i++) { while (a > 1) a--; }
    Runnable r = new Runnable() { public void run() { } };
    return a > b ? 1 : 0;
  }
  public static class Inner {
    public void g() {
      switch (1) { case 1: break; default: }
      try { h(); } catch (Exception e) { }
    }
    interface Leaf { void deep(); public void open(); }
    enum Color { RED, GREEN }
  }
}
"""


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")


def test_types_methods_and_complexity(spark):
    f = files(spark, SAMPLE)
    got = {r["name"]: r for r in D.types(f).collect()}
    assert set(got) == {"a.b.Outer", "a.b.Outer$Inner", "a.b.Inner$Leaf"}
    assert {n: r["npm"] for n, r in got.items()} == {"a.b.Outer": 3, "a.b.Outer$Inner": 2, "a.b.Inner$Leaf": 1}
    assert got["a.b.Outer"]["methods"] == 5
    cc = {r["name"]: r["cc"] for r in D.declarations(f).where("kind = 'method'").collect()}
    assert cc == {"Outer": 1, "f": 6, "g": 3, "deep": 1, "open": 1}


def test_edges_and_diagnostics(spark):
    f = files(spark, SAMPLE, "class A {", "class B {} /* open", "class C { String s = \"/*\"; }")
    edges = {(r["relation"], r["dst"]) for r in D.dependency_edges(f).where("path = 'f0'").collect()}
    assert edges == {("import", "x.Y"), ("extends", "Base"), ("implements", "Runnable"), ("implements", "Comparable")}
    assert {r["path"]: r["problem"] for r in D.diagnostics(f).collect()} == {"f1": "unbalanced braces", "f2": "unterminated comment"}


@pytest.mark.parametrize(
    "text, loc, simple",
    [
        ("a\n\n // x\n/* c */ code\n", 2, 1),
        ("/* open\n mid\n*/ x\n*/ y\n* star\n", 1, 3),
        ("/*\n*/ /* again\ncode\n", 1, 2),
        ("/*/\ncode", 1, 1),
        ("int a; /* not tracked\nstill code\n", 2, 2),
        ("", 0, 0),
    ],
)
def test_line_counts(spark, text, loc, simple):
    r = spark.createDataFrame([(text,)], "t string").select(code_lines(physical_lines(F.col("t"))), simple_code_lines(F.col("t"))).first()
    assert (r[0], r[1]) == (loc, simple)


def test_loc_by_file_needs_a_type(spark):
    got = {r["path"]: r["loc"] for r in D.loc_by_file(files(spark, "int x;\n", "class A {\n}\n")).collect()}
    assert got == {"f0": 0, "f1": 2}


def test_summary_of_nothing(spark):
    r = R.summary(spark.createDataFrame([], "name string, npm int, loc int")).first()
    assert tuple(r) == (0, None, None, None)


def test_validation_statuses(spark):
    m = spark.createDataFrame([("a", 1, 104), ("b", 1, 120), ("c", 1, 1)], "name string, npm int, loc int")
    b = spark.createDataFrame([("a", 1, 100), ("b", 1, 100), ("d", 1, 1)], "name string, npm int, loc int")
    assert {r["name"]: r["status"] for r in R.validate(m, b).collect()} == {"a": "ok", "b": "outside", "c": "extra", "d": "missing"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "src/p").mkdir(parents=True)
    (tmp_path / "src/p/A.java").write_text("class A {}")
    (tmp_path / "src/p/notes.txt").write_text("no")
    f = S.scan_sources(spark, str(tmp_path / "src"), require_nonempty=True)
    assert [r["text"] for r in f.collect()] == ["class A {}"]
    assert S.scan_releases(spark, {"1": str(tmp_path / "src"), "2": str(tmp_path / "src")}).count() == 2
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        S.scan_sources(spark, str(tmp_path / "empty"), require_nonempty=True)
    with pytest.raises(Exception):
        S.scan_sources(spark, str(tmp_path / "missing")).count()
    m = spark.createDataFrame([("b,\"q\"", 1, 2), ("a", 3, 4)], "name string, npm int, loc int")
    S.write_metrics_csv(m, str(tmp_path / "out.csv"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out.csv").glob("part-*")))
    assert raw.replace(b"name,npm,loc\r\n", b"") == b'a,3,4\r\n"b,""q""",1,2\r\n'
    S.write_metrics_csv(m, str(tmp_path / "base/project/1.3.csv"), include_all_columns=True)
    back = S.read_baseline(spark, str(tmp_path / "base"))
    assert len(back.columns) == 24 and {(r["name"], r["npm"], r["bug"]) for r in back.collect()} == {('b,"q"', 1, 0), ("a", 3, 0)}
    m.createOrReplaceTempView("m_rows")
    S.sql_export(spark, "SELECT name FROM m_rows WHERE npm >= :n", {"n": 3}, str(tmp_path / "rows"))
    assert [r["name"] for r in spark.read.csv(str(tmp_path / "rows"), header=True).collect()] == ["a"]


def test_annotations_constants_wildcards_and_long_literals(spark):
    text = 'class A { @Api("x(y)") @Deprecated public void m() { Map<? super A, ?> p = null; } String s = "' + "a\\\\b" * 300_000 + '"; }\n'
    text += "enum E { RED(1), GREEN(2); E(int i) { } public int v() { return 1; } }\n@interface N { int w(); }"
    rows = {r["name"]: r for r in D.types(files(spark, text)).collect()}
    assert (rows["A"]["npm"], rows["A"]["methods"], rows["A"]["own_wmc"]) == (1, 1, 1)
    assert (rows["E"]["npm"], rows["E"]["methods"]) == (1, 2) and "N" in rows
    assert D.diagnostics(files(spark, text)).count() == 0 and D.loc_by_file(files(spark, text)).first()["loc"] == 3


SCOPES = """package s;
@interface Mark { String[] value() default {}; int n() default 1; class Held { public void a() {} } }
@Mark({"x", "y"}) public class Top {
  @SuppressWarnings({"a", "b"}) public void first(@Mark({"p"}) int a, int b) { class Local { public void no() {} } int[] x = {1, 2}; }
  Runnable field = new Runnable() { public void run() { new Object() { public void deep() {} }; } };
  Object made = wrap(new Object() { public int size() { return 1; } }, new Thing(a(1)) { public void two() {} });
  static { class InBlock { public void yes() {} } }
  { for (int i = 0; i < 3; i++) { call(i); } }
  int[][] table = {{1, 2}, {3}};
  Top() throws Error { this.x = 1; }
  synchronized void sync() { synchronized (this) { go(); } label: for (;;) { } }
  public abstract java.util.List<String> none(int a, Map<String, int[]> b);
  native int raw();
  enum Shade { DARK(1) { public int v() { return 1; } }, LIGHT { int w() { return 2; } }; Shade(int i) { } Shade() { } public int v() { return 0; } class InEnum { public void e() {} } }
  interface Deep { void quiet(); class Leaf { public Leaf() {} } }
}
enum Plain { A, B; public void p() {} class Hidden { public void h() {} } }
class Last { public void z() { if (a) { b(); } else if (c(new X() { public void q() {} })) { } } }
"""


def test_scopes_of_declarations(spark):
    f = files(spark, SCOPES)
    got = {r["name"]: (r["npm"], r["methods"], r["first_line"], r["last_line"]) for r in D.types(f).collect()}
    assert got == {
        "s.Mark": (1, 1, 2, 2), "s.Top": (10, 17, 3, 16), "s.Top$Deep": (1, 2, 15, 15), "s.Deep$Leaf": (1, 1, 15, 15),
        "s.Plain": (2, 2, 17, 17), "s.Last": (1, 1, 18, 18),
    }
    methods = sorted(r["name"] for r in D.declarations(f).where("kind = 'method'").collect())
    assert methods == sorted("a first run size two yes Top sync none raw v w Shade Shade v e quiet Leaf p h z".split())
    assert {r["name"]: r["cc"] for r in D.declarations(f).where("name in ('z', 'sync', 'first')").collect()} == {"z": 3, "sync": 2, "first": 1}


def test_many_annotations_long_words_and_many_parentheses(spark):
    word = "w" * 1_000_000
    texts = ["class A { " + "@Mark(1) " * 6_000 + "public void m() { } }", f"class B {{ int {word}; void g() {{ {word} = 1; {word}(); }} public void h() {{}} }}", "class C { int x = " + "(" * 5_000 + "1" + ")" * 5_000 + "; public void k() {} }", f"class {word} {{ public void l() {{}} }}", "class D { public void n() {} " + "( " * 3_000]
    got = {r["path"]: (r["npm"], r["methods"]) for r in D.types(files(spark, *texts)).collect()}
    assert got == {"f0": (1, 1), "f1": (1, 2), "f2": (1, 1), "f3": (1, 1), "f4": (0, 0)}


def test_running_sums_and_concatenation(spark):
    rows = spark.range(500).selectExpr("id % 3 as k", "id", "repeat('x', cast(id % 7 as int)) as text")
    got = {}
    for r in R.concat_docs(rows, "k", "id").collect():
        got.setdefault(r["k"], []).append(r)
    for k, found in got.items():
        at = 0
        for r in sorted(found, key=lambda r: r["id"]):
            assert r["start"] == at
            at += len(r["text"]) + 1
        assert len(found) == sum(i % 3 == k for i in range(500))


def test_declarations_shuffle_nothing_and_batches_may_end_anywhere(spark):
    texts = [SCOPES, SAMPLE, "class A {", "}} class B { void f() {} }", "int x;", "", "enum E { A { void v() {} } }", SCOPES]
    f = files(spark, *texts).coalesce(1)
    for found in (D.declarations(f), D.loc_by_type(f), D.problems(f), D.loc_by_file(f)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(str, df.collect()))
    whole, loc = rows(D.declarations(f)), rows(D.loc_by_type(f))
    assert loc == rows(D.loc_by_type(f, D.types(f))) and len(loc) > 15
    assert len(whole) == sum(D.declarations(files(spark, t)).count() for t in texts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert rows(D.declarations(f)) == whole and rows(D.loc_by_type(f)) == loc
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_masks_and_open_comments_against_python(spark):
    import random
    import re

    literal = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
    hidden = re.compile(literal + r"|/\*[\s\S]*?\*/|/\*[\s\S]*|//[^\n]*")
    rng = random.Random(5)
    texts = ["".join(rng.choice(["/*", "*/", "//", "\n", "\n", '"', "'", "\\", "a", "*", "/", " "]) for _ in range(rng.randint(0, 24))) for _ in range(3000)]
    f = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in f.select("i", D.masked(F.col("text")).alias("m"), F.col("text").rlike(D.OPEN_COMMENT).alias("o")).collect():
        found = [m[0] for m in hidden.finditer(texts[r["i"]])]
        want = hidden.sub(lambda m: re.sub(r"[^\n]", "", m[0]) if m[0][0] == "/" else m[0][0] * 2, texts[r["i"]])
        assert r["m"] == want, repr(texts[r["i"]])
        assert r["o"] == any(h.startswith("/*") and not (len(h) > 3 and h.endswith("*/")) for h in found), repr(texts[r["i"]])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_text_is_masked_and_cut_once(spark):
    """No test of whether a text has pieces stands ahead of the explode: it would mask and cut the text again."""
    f = spark.range(3).select(F.concat(F.lit("/"), F.col("id").cast("string")).alias("path"), F.concat(F.lit("class A"), F.col("id").cast("string"), F.lit(" { int a() { if (b) c(); } }")).alias("text"))
    plan = _plan(D.pieces(f))
    assert plan.count("regexp_extract_all(code") == 1 and plan.count(D.HIDDEN) == 1
    assert D.BRANCHES in plan and D.BRANCHES not in _plan(D.pieces(f, complexity=False))


def test_pieces_are_few_and_hold_all_counts(spark):
    """Plain statements and the brace that closes behind them are one row, its lines and branches are theirs; types without complexity are the same."""
    text = "class A {\n int a;\n int b = c ? 1 : 2;\n void m() { x = y;\n z = w && v;\n}\n}\n"
    f = spark.createDataFrame([("p", text), ("q", ""), (None, text)], "path string, text string")
    assert D.pieces(f.where("path = 'p'")).count() == 5  # class, fields, method, its statements with its end, end of class
    found = {(r["path"], r["kind"], r["name"]): (r["first_line"], r["last_line"], r["cc"]) for r in D.declarations(f).collect()}
    assert found == {(p, k, n): v for p in ("p", None) for (k, n), v in {("type", "A"): (1, 7, None), ("method", "m"): (4, 6, 2)}.items()}
    kept = [c for c in D.types(f).columns if c not in D.COMPLEXITY]
    assert D.types(f, complexity=False).columns == kept
    assert sorted(map(str, D.types(f, complexity=False).collect())) == sorted(map(str, D.types(f).select(kept).collect()))


def test_diagnostics_mask_once(spark):
    f = spark.range(3).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("class A {"), F.col("id").cast("string")).alias("text"))
    plan = _plan(D.diagnostics(f))
    assert plan.count(D.HIDDEN) == 1 and plan.count(D.OPEN_COMMENT) == 1
    assert {r["problem"] for r in D.diagnostics(f).collect()} == {"unbalanced braces"}
