import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codequarry.functions.lines import code_lines, physical_lines
from codequarry.operators import cutting
from codequarry.operators import declarations as D

PARTS = """class A {|enum E {|@interface N {|interface I {|public class B extends C<D> {|}|}|}|{|;|;|(|)|( |, |=|void f() {|public int g(int a, int b) throws X {|public static void h(@Mark({"p"}) int a);|A() {|B(1) {
|int x = y;|int[] z = {1, 2};|foo(a, {b}, c(d));|if (a && b || c) {|for (int i = 0; i < n; i++) {|label: while (x) {|default: {|case 1: {|else {|else if (q ? r : s) {|try {|switch (x) {|static {|synchronized (this) {
|new Object() {|Runnable r = new Runnable() {|return new X(1) {|RED(1) {|, GREEN(2) {|, BLUE {|@Api(x(y)) |@Override\n|@A(b(c(d)))|@a.B |?|? extends|? super X|??|&&&|&&&&|\\|\\|\\||ifx|case|catch(e)|public|publicly|.call()|a.b (|x ()|classy|\n|\n\n|\t|\x0b| |\f|\r|é|éclass Q {|üif (x) {|package p.q;|"a{b"|'c'|// d {\n|/* e\n */|((((((((((x))))))))))|(((((((((y)))))))))|{ a, b }|( { a } )|w|this(|super(x);|assert f(x);""".split("|")
PARTS = [p for p in (q.replace("\\", "|") for q in PARTS) if p]


def test_bytes_are_cut_as_the_regular_expressions_say(spark):
    def by_pieces(batches):  # what the rows of ``pieces`` declare, all of a partition's at once
        t = pa.Table.from_batches(batches)
        if len(t):
            yield D.declared(*D.unpacked(t))[0]

    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    f = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)] + [("null", None), (None, texts[5])], "path string, text string").repartition(4).cache()
    want = sorted(map(str, D.pieces(f).mapInArrow(by_pieces, D.FOUND).collect()))
    assert sorted(map(str, D.declarations(f).collect())) == want and len(want) > 4000
    f.unpersist()


def test_code_lines_of_ranges_against_the_fold(spark):
    rng = random.Random(3)
    parts = ["/*", "*/", "//", "/", "*", "\n", "\n", "\n", "x", " ", "\t", "\x01", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2500)]
    rows = []
    for t in texts:
        first = rng.randint(1, t.count("\n") + 1)
        rows.append((len(rows), t, first, rng.randint(first - 1, t.count("\n") + 2)))
    f = spark.createDataFrame(rows, "i int, text string, a int, b int")
    fold = code_lines(F.slice(physical_lines(F.col("text")), F.col("a"), F.greatest(F.lit(0), F.col("b") - F.col("a") + 1)))
    want = [r[0] for r in f.orderBy("i").select(fold).collect()]
    got = cutting.code_lines(pa.array(texts), np.arange(len(texts)), *(np.array([r[k] for r in rows]) for k in (2, 3)))
    assert got.tolist() == want and max(want) > 3


def test_types_with_lines_carry_no_text_back(spark):
    f = spark.createDataFrame([("a", "class A {\n /* x\n */ int a;\n class B {\n }\n}\n"), ("b", None)], "path string, text string")
    plan = D.loc_by_type(f)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "Generate" not in plan
    assert {r["name"]: r["loc"] for r in D.loc_by_type(f).collect()} == {"A": 5, "A$B": 2}


def test_declarations_send_no_row_for_each_piece(spark):
    """A text is one row on its way to Python, whatever it holds, and is masked once."""
    f = spark.range(3).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("class A { int a() { if (b) c(); } }"), F.col("id").cast("string")).alias("text"))
    for df in (D.declarations(f), D.loc_by_type(f)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" not in plan and plan.count(D.HIDDEN) == 1


def test_batches_are_cut_in_whole_files(monkeypatch):
    texts = ["class A { void f() { } }", None, "", "class B { }", "x" * 500 + " class C { void g(int i); }"]
    batch = pa.RecordBatch.from_pydict({"code": pa.array(texts, pa.string())})
    whole = cutting.cut(batch["code"], True)
    assert whole[1].tolist() == [0, 3, 4] and whole[2].to_pylist() == ["A", "f", None, None, "B", None, "C", "g", None]
    for n in (1, 30, 600):
        monkeypatch.setattr(cutting, "BYTES", n)
        parts = list(cutting.chunks(batch))
        assert [t for p in parts for t in p["code"].to_pylist()] == texts
        assert [x for p in parts for x in cutting.cut(p["code"], True)[2].to_pylist()] == whole[2].to_pylist()
