import re

import pytest
from pyspark.sql import functions as F

from codequarry.functions import filters as T
from codequarry.functions import mappers as N
from codequarry.functions import predicates as P
from codequarry.operators import graph as G
from codequarry.operators import manifests as J
from codequarry.shared import carry_forward, global_rank
from codequarry.streaming import recorder


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_filters(spark):
    ten = "\n".join(map(str, range(10)))
    assert one(spark, ten, lambda t: T.head(t, 2, 3)) == "3\n4\n"
    assert one(spark, ten, lambda t: T.head(t, 0, 8)) == "8\n9"
    assert one(spark, ten, lambda t: T.tail(t, 2, 3)) == "5\n6\n"
    assert one(spark, ten, lambda t: T.tail(t, -1, 8)) == "0\n1\n"
    assert one(spark, ten, lambda t: T.tail(t, 2, 30)) == ""
    for text, first in (("a\nb\n", "a\n"), ("a\r\nb", "a\r\n"), ("a\rb\r", "a\r"), ("\n\n", "\n"), ("a", "a"), ("", "")):
        assert one(spark, text, lambda t: T.head(t, 1)) == first
    assert one(spark, "a\nb\n", lambda t: T.tail(t, 1)) == "b\n" and one(spark, "a\nb\n", lambda t: T.prefix_lines(t, "> ")) == "> a\n> b\n"
    assert one(spark, "x1\r\ny\nx2", lambda t: T.lines_containing(t, "x")) == "x1\r\nx2" and one(spark, "#a\nb\n#c\n", lambda t: T.strip_line_comments(t, "#")) == "b\n"
    assert one(spark, "#b\na\n", lambda t: T.lines_matching(t, "^a")) == "a\n"
    literal = '"' + "a\\\"/*" * 200_000 + '"'
    assert one(spark, literal + "/* x */", lambda t: T.strip_java_comments(t)) == literal
    source = "a /* x */ b // c\n\"/* keep */\" '//' d"
    stripped = one(spark, source, T.strip_java_comments)
    assert stripped == "a  b \n\"/* keep */\" '//' d" and one(spark, stripped, T.strip_java_comments) == stripped
    assert one(spark, "x @a@ y @zz @b@ @q@", lambda t: T.replace_tokens(t, {"a": F.lit("1"), "b": F.lit("2")})) == "x 1 y @zz 2 @q@"
    with pytest.raises(ValueError):
        T.resolve({"a": "@b@", "b": "@a@"})
    assert one(spark, "é😀a", T.escape_unicode) == "\\u00e9\\ud83d\\ude00a"
    assert one(spark, "a\tbc\td\n\tx", lambda t: T.expand_tabs(t, 4)) == "a   bc  d\n    x"
    assert one(spark, "a\r\nb\rc\x1a", lambda t: T.normalise_ends(t, "add", "remove")) == "a\r\nbc"
    for text, added, removed in (("a   b", "a\tb", "a   b"), ("abc d", "abc d", "abc d"), ("abc  d", "abc\t d", "abc  d"), ("\tx \t\n  y ", "\tx\n  y", "    x\n  y"), ("a\t\tb \r\n", "a\t\tb\r\n", "a       b\r\n"), ("", "", ""), ("  \t", "", "")):
        assert one(spark, text, lambda t: T.normalise_ends(t, "asis", "asis", "add", 4)) == added
        assert one(spark, text, lambda t: T.normalise_ends(t, "asis", "asis", "remove", 4)) == removed
    with pytest.raises(ValueError):
        T.normalise_ends(F.lit(""), tab="add", width=6)
    assert one(spark, "aXbX", lambda t: T.replace_regex(t, "(X)", "<$1>")) == "a<X>bX"
    assert one(spark, "a\r\nb\n", lambda t: T.line_tokens(t, keep_ends=True)) == ["a\r\n", "b\n"]


def test_digests_versions_times(spark):
    assert one(spark, "Wikipedia", N.adler32) == 300286872
    assert one(spark, "", N.adler32) == 1
    import zlib

    assert one(spark, "né\U0001f600" * 50_000, N.adler32) == zlib.adler32(("né\U0001f600" * 50_000).encode())
    assert one(spark, "hello", N.string_hash) == 99162322
    assert one(spark, "1.2.0", N.version_key) == [1, 2]
    assert one(spark, "x", lambda t: N.version_key(F.lit("1.10")) > N.version_key(F.lit("1.9.0")))
    assert one(spark, "2024-01-02T03:04:05", N.iso_time) is not None and one(spark, "zzz", N.iso_time) is None
    assert one(spark, "x", lambda t: N.elapsed(F.lit(61000))) == "1 minute 1 second"


def test_globs():
    import re

    hit = lambda p, n: bool(re.search(P.glob_regex(p), n))
    assert hit("**/a.txt", "a.txt") and hit("**/a.txt", "x/y/a.txt") and not hit("**/a.txt", "x/ba.txt")
    assert hit("x/**", "x/y/z") and hit("x/**", "x") and not hit("x/**", "xy/z")
    assert hit("x/", "x/y") and hit("a?c", "abc") and not hit("a?c", "a/c") and not hit("*", "a/b")
    assert hit("x/**/y", "x/y") and hit("x/**/y", "x/a/b/y")


def test_votes_and_quantifiers(spark):
    row = spark.range(1)
    yes, no = F.lit(True), F.lit(False)
    assert row.select(P.majority(yes, no), P.majority(yes, no, allow_tie=False), P.majority(), P.xor(yes, yes, yes), P.none_of(no)).first()[:] == (True, False, False, True, True)
    left = spark.createDataFrame([(1,), (5,), (9,)], "v int")
    right, empty = spark.createDataFrame([(4,), (6,)], "w int"), spark.createDataFrame([], "w int")
    got = lambda q, when, c=right: sorted(r["v"] for r in P.compare_with(left, "v", c, "w", when, q).collect())
    assert got("all", "less") == [1] and got("any", "less") == [1, 5] and got("one", "less") == [5] and got("none", "less") == [9] and got("most", "less") == [1]
    assert got("all", "less", empty) == [1, 5, 9] == got("none", "less", empty) and got("any", "less", empty) == [] == got("one", "less", empty)


def manifest(spark, *rows):
    return spark.createDataFrame([(n, True, t, False, s, c, i) for i, (n, t, s, c) in enumerate(rows)], "name string, exist boolean, last_modified long, is_dir boolean, size long, content string, ordinal long").withColumn("last_modified", F.timestamp_seconds("last_modified"))


def test_set_algebra(spark):
    a = manifest(spark, ("x", 1, 1, "c"), ("x", 1, 1, "c"), ("y", 1, 1, "c"))
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(J.difference([a, a], ["name"])) == [] and names(J.difference([a.where("name = 'y'"), a.where("name = 'x'")], ["name"])) == ["y"]
    assert names(J.intersect_all([a, a.where("name = 'x'")], ["name"])) == ["x", "x"]
    assert names(J.union_distinct([a, a], ["name"], "ordinal")) == ["x", "y"]
    for f in (J.difference, J.intersect_all):
        with pytest.raises(ValueError):
            f([a], ["name"])
    with pytest.raises(ValueError):
        J.first_rows(a, -1)
    assert J.first_rows(a, 0).count() == 0


def test_snapshot_joins(spark):
    s = manifest(spark, ("same", 10, 1, "c"), ("newer", 20, 1, "c"), ("missing", 10, 1, "c"), ("bigger", 10, 2, "c"))
    t = manifest(spark, ("same", 10, 1, "c"), ("newer", 10, 1, "c"), ("bigger", 10, 1, "c"), ("orphan", 1, 1, "c"))
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(J.present(s, t)) + names(J.present(s, t, present_in="srconly")) == ["bigger", "newer", "same", "missing"]
    assert names(J.different(s, t)) == ["bigger", "missing"]
    assert names(J.different(s, t, ignore_times=False)) == ["bigger", "missing", "newer"]
    assert names(J.out_of_date(s, t)) == ["missing", "newer"]
    assert {r["name"]: r["action"] for r in J.sync_plan(s, t).collect()} == {"same": "keep", "newer": "copy", "missing": "copy", "bigger": "keep", "orphan": "remove"}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x$1", "a")], "src string, dst string")
    root = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in G.closure(e, root).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r) for r in G.closure(e, root, transitive=False).collect()} == {("a", 0), ("b", 1)}
    assert {r["node"] for r in G.affected(e, root).collect()} == {"a", "b", "c", "x$1"}
    assert {r["node"] for r in G.affected(e, root, transitive=False).collect()} == {"a", "c", "x", "x$1"}
    tree = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a")], "src string, dst string")
    assert {tuple(r) for r in G.inheritance(tree).collect()} == {("a", 0, 2), ("b", 1, 1), ("c", 2, 0)}


def test_queries_over_whole_tables(spark):
    from datetime import timedelta

    from codequarry.plans import manifests as M
    from codequarry.plans import metrics

    d = "/root/testdata/sf0.001"
    there = {r["name"]: r for r in M.target(spark, d).drop("content").collect()}
    stale = set()
    for r in M.man(spark, d).drop("content").collect():
        for n in (r["name"], f"orphan/{r['ordinal']}.txt"):
            t = there.get(n)
            if t is None or not t["exist"] or not t["is_dir"] and r["last_modified"] - timedelta(seconds=1) > t["last_modified"]:
                stale.add(r["name"])
    got = {r["name"] for r in M.Q["j04_out_of_date_any_all"](spark, d).collect()}
    assert got == stale and len(got) > M.Q["j04_out_of_date_any"](spark, d).count()
    e = {(r["src"], r["dst"]) for r in metrics.closed(spark, d, metrics.X.PART_TREE).collect()}
    roots = {s for s, _ in e}
    depths = {(r["node"], r["depth"]) for r in metrics.Q["h02_ancestors_all"](spark, d).collect()}
    assert depths == {(s, 0) for s in roots} | {(x, 1) for _, x in e if x not in roots}


def breadth_first(edges, roots, cap=G.ROUNDS):
    out, level, depth = {r: 0 for r in roots}, set(roots), 0
    while level and depth < cap:
        depth += 1
        level = {b for a, b in edges if a in level} - out.keys()
        out |= dict.fromkeys(level, depth)
    return out


@pytest.mark.parametrize("wide", [16, 0])
def test_closure_of_deep_graphs(spark, monkeypatch, wide):
    import random

    monkeypatch.setattr(G, "WIDE", wide)  # 0: ways of two edges are too many at once, so that strides are taken
    rng = random.Random(wide)
    graphs = [[(i, i + 1) for i in range(30)] + [(30, 5)], [(i, i + rng.randint(1, 3)) for i in range(40) for _ in range(2)], [(rng.randrange(25), rng.randrange(25)) for _ in range(40)], [(1, 1), (1, 2), (None, 3), (2, None)]]
    for edges in graphs:
        e = spark.createDataFrame(edges, "src long, dst long")
        got = {r["node"]: r["depth"] for r in G.closure(e, spark.createDataFrame([(0,), (1,), (1,)], "node long")).collect()}
        assert got == breadth_first([x for x in edges if None not in x], [0, 1])


def test_a_chain_takes_few_rounds_and_keeps_the_cap(spark, monkeypatch):
    rounds = []
    further = G._further
    monkeypatch.setattr(G, "_further", lambda *a: (rounds.append(a[2]), further(*a))[1])
    chain = lambda n: spark.range(n).selectExpr("id as src", "id + 1 as dst")
    got = G.closure(chain(900), spark.range(1).toDF("node")).agg(F.count(F.lit(1)), F.max("depth")).first()
    assert tuple(got) == (901, 900) and len(rounds) <= 10
    assert tuple(G.closure(chain(1200), spark.range(1).toDF("node")).agg(F.count(F.lit(1)), F.max("depth")).first()) == (1001, 1000)


def test_inheritance_deep_cyclic_and_wide(spark):
    e = [(2, 1), (3, 2), (3, 1), (4, 3), (5, 9), (9, 5), (6, 5), (6, 4), (7, 7), (8, 1)]
    got = {tuple(r) for r in G.inheritance(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {(1, 0, 3), (2, 1, 1), (3, 2, 1), (4, 3, 1), (8, 1, 0)}
    deep = G.inheritance(spark.range(100_000).selectExpr("id + 1 as src", "id as dst"))
    assert deep.where("node <> dit or noc <> if(node = 100000, 0, 1)").count() == 0 and deep.count() == 100_001
    assert G.inheritance(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_carry_forward_and_ranks_by_ranges(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i, rng.choice([None, None, i * 10])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, at long, v long")
    for backward in (False, True):
        for upto in (False, True):
            want, last = {}, {}
            for k, at, v in sorted(rows, key=lambda r: r[1], reverse=backward):
                if upto and v is not None:
                    last[k] = v
                want[at] = last.get(k)
                if v is not None:
                    last[k] = v
            got = carry_forward(df, ["k"], ["at"], {"c": F.col("v"), "none": F.lit(None).cast("int")}, upto, backward).collect()
            assert {r["at"]: r["c"] for r in got} == want and {r["none"] for r in got} == {None}
    ranked = global_rank(df, [F.col("v").desc(), F.col("at").asc()], "r").collect()
    order = [r["at"] for r in sorted(ranked, key=lambda r: r["r"])]
    assert [r["r"] for r in sorted(ranked, key=lambda r: r["r"])] == list(range(1, 401)) and order == [r[1] for r in sorted(rows, key=lambda r: (-(r[2] or -1), r[1]))]


def test_recorder_states_and_unfinished_targets(spark):
    ts = lambda s: f"2024-01-01 00:00:{s:02d}"
    events = spark.createDataFrame([(1, i, ts(i), 7, 1, f"m{i}") for i in range(1, 9)] + [(2, 20, ts(3), 7, 1, "other")], "build long, event_id long, ts string, target long, priority int, message string").withColumn("ts", F.to_timestamp("ts"))
    actions = spark.createDataFrame([(1, "a", 3, ts(3), "start"), (1, "a", 5, ts(5), "stop"), (1, "a", 6, ts(6), None), (1, "a", 8, ts(8), "start"), (1, "b", 2, ts(2), None), (1, "b", 4, ts(4), None)], "build long, recorder string, event_id long, ts string, action string").withColumn("ts", F.to_timestamp("ts"))
    got = {(r["recorder"], r["event_id"]) for r in recorder.record_while_on(events, actions, emacs=True).collect()}
    assert got == {("a", 3), ("a", 4), ("a", 8)} | {("b", i) for i in range(2, 9)}
    runs = [(1, "started", 0), (2, "started", 5), (3, "finished", 9), (4, "finished", 10), (5, "started", 20)]
    d = recorder.durations(spark.createDataFrame([(9, i, ts(s), k) for i, k, s in runs], "target long, event_id long, ts string, kind string"))
    assert {tuple(r)[1:] for r in d.collect()} == {(1, None, None), (2, 3, 4.0), (5, None, None)}
    assert recorder.durations(spark.createDataFrame([(9, 1, ts(0), "started"), (9, 2, ts(9), "finished")], "target long, event_id long, ts string, kind string"), within=8).first()["finished_id"] is None


def test_streams_in_several_batches_out_of_order(spark, tmp_path):
    import random

    rng, base = random.Random(5), 1_700_000_000
    rows = [(rng.randrange(4), i, rng.choice(["started", "finished"]), base + rng.randrange(3_000)) for i in range(300)]
    rng.shuffle(rows)
    schema = "target long, event_id long, kind string, at long"
    for k in range(5):
        spark.createDataFrame(rows[k * 60 : (k + 1) * 60], schema).selectExpr("*", "timestamp_seconds(at) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(None, 999, None, base + 10**6)], schema).selectExpr("*", "timestamp_seconds(at) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("target long, event_id long, kind string, at long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in recorder.run_to_table(recorder.stream_durations(stream, 400.0, "2 hours"), str(tmp_path / "out")).collect()}
    batch = spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_seconds(at) as ts")
    assert got == {tuple(r) for r in recorder.durations(batch, 400.0).collect()} and len(got) == sum(r[2] == "started" for r in rows)
    assert sum(g[2] is None for g in got) > 5 and sum(g[2] is not None for g in got) > 5


def test_line_ends_and_hashes_outside_the_basic_plane(spark):
    ends = lambda text, *a: one(spark, text, lambda t: T.normalise_ends(t, *a))
    assert ends("a\rb\r\nc", "remove") == "ab\nc" and ends("a\rb\r\nc\n", "add") == "ab\r\nc\r\n"
    assert [ends(t, "asis", "remove") for t in ("ab\x1a\n", "ab\x1a", "\x1a", "\x1a\n", "ab\n", "a\x1ab")] == ["ab", "ab", "\x1a", "\x1a\n", "ab\n", "a\x1ab"]
    assert ends("ab\x1a", "asis", "add") == "ab\x1a" and ends("ab", "asis", "add") == "ab\x1a"

    def units(text):
        h = 0
        data = text.encode("utf-16-le")
        for k in range(0, len(data), 2):
            h = (31 * h + int.from_bytes(data[k : k + 2], "little")) % 2**32
        return h - 2**32 if h >= 2**31 else h

    for text in ("é😀", "", "a" * 40, "😀𝄞x", "\uffff"):
        assert one(spark, text, N.string_hash) == units(text)
    assert units("é😀") == 1996812


def test_inheritance_of_contracted_graphs(spark, monkeypatch):
    import random

    monkeypatch.setattr(G, "CORE", 100)
    rng = random.Random(4)
    e = {(i, rng.randrange(max(0, i - 3), i)) for i in range(1, 300)} | {(i, rng.randrange(i)) for i in range(200, 260)} | {(i, i - 1) for i in range(1001, 1400)}
    e |= {(2000 + i, 2000 + (i + 1) % 40) for i in range(40)} | {(2100 + i, 2099 + i) for i in range(1, 30)} | {(2100, 2005), (3000, 3000), (3001, 3000), (3002, 3001), (3002, 1399), (4000, 4001)}
    ups, children, nodes = {}, {}, {n for pair in e for n in pair}
    for s, d in e:
        ups.setdefault(s, set()).add(d)
        children[d] = children.get(d, 0) + 1
    dit, left = {}, set(nodes)
    while ready := [n for n in left if ups.get(n, set()) <= dit.keys()]:
        dit |= {n: max((dit[u] + 1 for u in ups.get(n, ())), default=0) for n in ready}
        left -= set(ready)
    got = {tuple(r) for r in G.inheritance(spark.createDataFrame(list(e), "src long, dst long")).collect()}
    assert got == {(n, k, children.get(n, 0)) for n, k in dit.items()} and len(left) > 60


def test_work_on_a_deep_chain_goes_with_its_length(spark, monkeypatch):
    kept, cut = [], G.cut
    monkeypatch.setattr(G, "CORE", 800, raising=False)

    def counted(df):
        kept.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(G, "cut", counted)
    assert tuple(G.inheritance(spark.range(4_000).selectExpr("id + 1 as src", "id as dst")).agg(F.count(F.lit(1)), F.max("dit")).first()) == (4_001, 4_000)
    assert sum(kept) < 15 * 4_000  # doubling alone keeps more than 24 times the nodes


def test_rounds_over_a_deep_chain_are_planned_by_their_real_size(spark, monkeypatch, capsys):
    sizes, cut = [], G.cut
    monkeypatch.setattr(G, "CORE", 100)

    def seen(df):
        out = cut(df)
        out.explain(mode="cost")
        sizes.extend(re.findall(r"sizeInBytes=([^,)]+)", capsys.readouterr().out))
        return out

    monkeypatch.setattr(G, "cut", seen)
    assert tuple(G.inheritance(spark.range(400).selectExpr("id + 1 as src", "id as dst")).agg(F.count(F.lit(1)), F.max("dit")).first()) == (401, 400)
    assert len(sizes) > 20 and all(re.fullmatch(r"[\d.]+ (B|KiB)", size) for size in sizes)  # a product of both sides of each join has thousands of digits
