"""The ten operators against brute force, planted cases and edge rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import lm
from codequarry.llm.components import connected_components
from codequarry.llm.decontaminate import benchmark_matches, contaminated, distances, passages, without_contaminated
from codequarry.llm.hashing import shingle_set, word_hashes
from codequarry.llm.html import align, constants, extract_pages, fold, host_wrappers, main_text, segments, slots, stream
from codequarry.llm.imatch import fingerprints
from codequarry.llm.langid import codewords, fit_languages, identify
from codequarry.llm.licenses import TEMPLATES, LicenseModel, fit_licenses, scan_licenses
from codequarry.llm.lm import END, Lexicon, LogBilinear, Trainer, _train_task, score_documents
from codequarry.llm.mixing import mix_sources, sainte_lague
from codequarry.llm.neardup import near_duplicates
from codequarry.llm.pii import find_pii, sanitised
from codequarry.llm.toxicity import FuzzyTrie, fit_toxicity, quotations, score_toxicity, without_toxic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", None, None), (3, "word " * 30_000, "en", "a", 1), (4, "same text here again now ok", "en", "a", 1), (4, "same text here again now ok", "en", "a", 1), (5, "x", None, "b", 1)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({"score": F.lit("clash"), "key": F.lit(1), "h": F.lit(2.0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng, n, alphabet="abcdefgh"):
    return [("".join(rng.choice(list(alphabet), rng.integers(2, 7)))) for _ in range(n)]


def test_hashing():
    a = word_hashes("One  two\tONE\x0bthree x")
    assert len(a) == 4 and a[0] == a[2] and len(shingle_set("a b", 5)) == 1 and len(shingle_set(" \n", 5)) == 0
    long = "w " * 700_000 + "x" * 3_000_000
    assert len(word_hashes(long)) == 700_001 and word_hashes(long)[-1] == word_hashes("x" * 3_000_000)[0]


def test_components(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, 2001)]
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 2000: 2000, 2001: 2000}


def test_components_by_contraction(spark, monkeypatch):
    from codequarry.llm import components

    monkeypatch.setattr(components, "LOCAL", 3)
    edges = spark.createDataFrame([((i, "x"), (i + 1, "x")) for i in range(60) if i % 7] + [((9, "x"), (9, "x"))], "a struct<k:long,v:string>, b struct<k:long,v:string>")
    got = {r["id"]["k"]: r["component_id"]["k"] for r in connected_components(edges).collect()}
    least = lambda i: next(k for k in range(i, -1, -1) if not k or not (k - 1) % 7)
    assert got == {i: least(i) for i in range(1, 61)} and connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("num", [80, 85])
def test_near_duplicates_against_all_pairs(spark, num):
    rng = np.random.default_rng(num)
    rows, bases = [], [prose(rng, 120) for _ in range(8)]
    for i in range(120):
        w = list(bases[i % 8])
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w))] = "edit%d" % rng.integers(0, 50)
        rows.append((1000 - i, " ".join(w), "en", "a"))
    sets = {i: frozenset(zip(*[t.split()[k:] for k in range(5)])) for i, t, _, _ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: r for r in near_duplicates(frame(spark, rows), num, 100).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: root(i) for i in sets}
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_license_scan(spark, edge, empty):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(prose(rng, 40)) + "\n" + " ".join(prose(rng, 20)), "en", "a") for i in range(60)]
    planted = {100: "Released under the MIT License.", 101: "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", 102: "This%% work is## licensed under the GNU General Public License, version 3.", 103: "she lost her driving license near the bridge"}
    rows += [(i, " ".join(prose(rng, 30)) + "\n" + t, "en", "a") for i, t in planted.items()]
    docs = frame(spark, rows)
    model = fit_licenses(docs)
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(docs, model).collect() if r["licenses"]}
    assert got == {100: "MIT", 101: "Apache-2.0", 102: "GPL"}
    wrap = lambda t, n: "\n".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    prose_ = lambda n: " ".join(prose(rng, n))
    real = {
        1: prose_(150) + "\n\n" + wrap(TEMPLATES["MIT"][2], 6) + "\n\n" + prose_(90),
        2: wrap(prose_(100) + " " + TEMPLATES["Apache-2.0"][1] + " " + prose_(100), 9),
        3: wrap(TEMPLATES["GPL"][1], 8),
        4: wrap("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", 8),
        5: prose_(70) + "\r\n \r\n" + wrap("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear", 7),
        6: prose_(20_000) + " " + TEMPLATES["BSD"][0] + " " + prose_(20_000),
        7: prose_(300),
        8: prose_(30) + " Licensed under CC BY 4.0.",
    }
    found = {r["doc_id"]: (r["licenses"], r["n_unknown"]) for r in scan_licenses(frame(spark, [(k, t, "en", "a") for k, t in real.items()]), model).collect()}
    assert found == {1: ("MIT", 0), 2: ("Apache-2.0", 0), 3: ("GPL", 0), 4: ("", 1), 5: ("", 1), 6: ("BSD", 0), 7: ("", 0), 8: ("CC-BY", 0)}
    grams = [r["gram"] for r in model.weights.collect()]
    assert all(any(c in w for c in model.cover for w in g.split(" ")) for g in grams) and len(model.cover) < 150
    for r in scan_licenses(docs, LicenseModel(**{**vars(model), "cover": [""]})).collect():  # without the prefilter: the same
        assert (r["licenses"] or "") == got.get(r["doc_id"], "")
    assert scan_licenses(edge, model).count() == len(EDGE) and scan_licenses(empty, model).count() == 0


def test_sainte_lague(spark):
    votes = {"a": 53, "b": 24, "c": 23}
    p = spark.createDataFrame([(1, k, v, 7) for k, v in votes.items()], "g int, k string, v long, seats long")
    got = {r["k"]: r["won"] for r in sainte_lague(p, ["g"], ["k"], "v", "seats", "won").collect()}
    won = dict.fromkeys(votes, 0)
    for _ in range(7):
        best = max(votes, key=lambda k: (votes[k] / (2 * won[k] + 1), [-ord(c) for c in k]))
        won[best] += 1
    assert got == won


def test_mixing(spark, edge, empty):
    rows = [(i, "w " * (10 + i % 7), "en", s) for i, s in enumerate(["a"] * 600 + ["b"] * 60 + ["c"] * 300)] + [(9999, "w " * 50, "en", None)]
    got = mix_sources(frame(spark, rows), block_tokens=10, shard_tokens=1000).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all() and len(got) == len(rows)
    by = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by["taken"] - by["target"]) <= np.maximum(40, 0.05 * by["target"])).all()
    assert abs(got.groupby("source_size")["target"].first().sum() - got["size"].sum()) < 1
    again = mix_sources(frame(spark, rows).repartition(7), block_tokens=10, shard_tokens=1000).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert mix_sources(edge).count() == len(EDGE) and mix_sources(empty).count() == 0


def test_fingerprints(spark, edge, empty):
    rng = np.random.default_rng(1)
    vocabulary = prose(rng, 3000, "abcdefghijklmnop")
    texts = [" ".join(rng.choice(vocabulary, 150)) for _ in range(60)] + ["", None, "é"]
    rows = [(i * 700 if i < 40 else i * 10**15, t, "en", "a") for i, t in enumerate(texts)] + [(10**17, texts[0], "en", "a")]  # dense and sparse ids
    got = {r["doc_id"]: r for r in fingerprints(frame(spark, rows), low=0.01, high=0.9).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    import hashlib

    for k, (i, t, _, _) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest()
    assert got[0]["fingerprint"] == got[10**17]["fingerprint"]
    inner = [r for i, r in got.items() if i < 59 * 10**15]
    assert np.mean([r["near_edited"] for r in inner]) > 0.2 > np.mean([r["near_next"] for r in inner])
    assert fingerprints(edge).count() == len(EDGE) and fingerprints(empty).count() == 0


def test_lm(spark, edge, empty):
    rng = np.random.default_rng(2)
    make = lambda words: " ".join(rng.choice(words, 40))
    rows = [(i, make([f"{'en' if i % 2 else 'fr'}{k}" for k in range(30)]), "en", "a") for i in range(400)]
    docs = frame(spark, rows)
    got = score_documents(docs, F.col("doc_id") % 5 != 0).toPandas().set_index("doc_id")
    train = [t.split() + [None] for i, t, _, _ in rows if i % 5]
    counts: dict = {}
    for t in train:
        for w in t:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t, _, _ in rows[:10]:
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.split(), None])
        assert abs(base - got.loc[i, "base_score"]) < 1e-6 and got.loc[i, "n_tokens"] == 41 and got.loc[i, "train_tokens"] == n
    held = got[got.index % 5 == 0]
    assert held["score"].sum() > held["base_score"].sum() + 0.1 * held["n_tokens"].sum()
    assert score_documents(edge, F.col("doc_id") % 2 == 0).count() == len(EDGE) and score_documents(empty, F.lit(True)).count() == 0


def test_lm_trains_on_every_token(monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace

    hashes = np.append(np.unique(word_hashes("one two three")), END)
    words = Lexicon(hashes, np.array([3, 2, 2, 1]), 8, 4)
    seen = []
    monkeypatch.setattr(Trainer, "step", lambda self, contexts, targets: seen.append(len(targets)))
    batch = pa.RecordBatch.from_arrays([pa.array(["one two three " * 500] * 20)], ["text"])
    run = _train_task(SimpleNamespace(value=words), SimpleNamespace(value=LogBilinear.fresh(words)), 64, 0.01, 1.0)
    assert list(run([batch])) == [] and sum(seen) == 20 * 1501


def test_lm_is_normalised(monkeypatch):
    """Two levels, words that share a class, and the rest: probabilities add up to 1 and equal brute force."""
    for name, value in (("ITEMS", 40), ("SINGLE", 3), ("LARGEST", 6), ("EQUAL", 4)):
        monkeypatch.setattr(lm, name, value)
    rng = np.random.default_rng(1)
    hashes, counts = np.append(rng.integers(1 << 62, size=90, dtype=np.uint64), END), np.append(rng.integers(1, 60, 90), 25)
    words = Lexicon(hashes, counts, int(counts.sum()) + 17, 99)
    at, there = words.look_up(np.append(hashes, np.array([5, 1 << 63], np.uint64)))
    assert there[:-2].all() and not there[-2:].any() and (words.counts[at[:-2]] == counts).all()
    model = LogBilinear.fresh(words)
    trainer = Trainer(model, words, 1, 0.1, 0.1)
    contexts, targets = rng.integers(0, len(words.unigram), (4000, 4)), rng.integers(0, len(words.unigram), 4000)
    trainer.step(contexts, targets)
    model, n = trainer.model, len(words.unigram)
    assert n == 40 and words.size.max() > 1 and words.size.sum() == n and abs(words.unigram.sum() - 1) < 1e-9
    got = model.log_probabilities(words, np.repeat(contexts[:5], n, axis=0), np.tile(np.arange(n), 5)).reshape(5, n)
    assert np.allclose(np.exp(got).sum(axis=1), 1, atol=1e-5)
    for c in range(5):
        q = np.append(sum(model.context[contexts[c, i]] * model.place[i] for i in range(4)), 1)
        for item in range(n):
            k = words.klass[item]
            own = np.exp(model.output[words.first[k] : words.first[k] + words.size[k]] @ q)
            p = np.exp(model.classes @ q)[k] / np.exp(model.classes @ q).sum() * own[item - words.first[k]] / own.sum()
            assert abs(np.log(p) - got[c, item]) < 1e-3


def test_lm_averages_by_row(monkeypatch):
    import pandas as pd

    row = lambda copy, rows, seen, values: {"part": "context:0", "copy": copy, "rows": np.array(rows, np.int32).tobytes(), "seen": np.array(seen, np.float32).tobytes(), "values": np.repeat(np.array(values, np.float16), lm.DIM).tobytes()}
    got = lm._merged(pd.DataFrame([row(1, [2, 5], [1, 3], [4, 8]), row(2, [5, 7], [1, 2], [4, 1])])).iloc[0]
    assert np.frombuffer(got["rows"], np.int32).tolist() == [2, 5, 7] and np.frombuffer(got["seen"], np.float32).tolist() == [1, 4, 2]
    assert np.frombuffer(got["values"], np.float16).reshape(3, -1)[:, 0].tolist() == [4, 7, 1]


PAGE = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a>Home</a></nav><div class="{0}"><h1>{1}</h1><p>First &amp; <b>bo</b>ld.<br><p>Second {2} <!-- c --></div><div class="comments"><p>me</p></div><footer>f</footer>'


def test_html(spark):
    pages = [(i, "http://h.org/a", PAGE.format("story", f"Head {i}", f"number {i}")) for i in range(5)] + [(7, None, None), (8, "http://x.org", ""), (9, "http://h.org", "<article>Whole <i>te</i>xt</article><footer>no")]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3 First & bold. Second number 3" and got[7] == got[8] == "" and got[9] == "Whole text"
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert main_text("<nav>" * 3000 + "x", None) == ""
    s = lambda *names: [("slot", n) for n in names]
    assert fold(s("a", "b", "a", "b", "c")) == [("rep", (("slot", "a"), ("slot", "b"))), ("slot", "c")]
    assert align(s("a", "b", "c"), s("a", "c")) == [("slot", "a"), ("opt", ("slot", "b")), ("slot", "c")]
    assert align(s("a", "b", "c"), s("a", "x", "c")) == [("slot", "a"), ("opt", ("slot", "b")), ("opt", ("slot", "x")), ("slot", "c")]
    assert slots(stream(list(segments(PAGE.format("x", 1, 2))))) >= {("html/body/div.x", ""), ("html/body/nav", "out")}


def test_html_alignments_are_best_at_any_length():
    rng = np.random.default_rng(6)
    leaves = lambda n: [("slot", "pqr"[rng.integers(3)], "", int(rng.integers(4)), 1, 1) for _ in range(n)]
    part = lambda x: x[1] if x[0] == "opt" else x
    for n, m in [(0, 3), (3, 0), *rng.integers(1, 40, (60, 2)).tolist(), (90, 70), (70, 90), (200, 30)]:
        x, y = leaves(n), leaves(m)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                worth = 0 if x[i][1] != y[j][1] else 4 if x[i][3] == y[j][3] else 1
                best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + worth)
        met = [part(z) for z in align(x, y) if part(z)[5] == 2]
        assert sum(4 if z[4] == 2 else 1 for z in met) == best[0][0]
        assert len(align(x, y)) == n + m - len(met)
    x, y = leaves(3000), leaves(2500)
    found = align(x, y)
    assert len(found) == 5500 - sum(part(z)[5] == 2 for z in found) and [part(z)[1] for z in found if z[0] == "slot"] == [part(z)[1] for z in found if part(z)[5] == 2]


def test_html_wrappers_cover_every_page(spark):
    body = '<body><section class="top"><p>Our shop</p></section>{}<section class="text"><p>{}</p></section></body>'
    pages = [(i, "http://h.org", body.format("<table><td>cell</td></table>" * (i % 90), f"long text number {i} " * 50)) for i in range(120)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    rule = host_wrappers(frame).collect()
    assert len(rule) == 1 and "(body/table/td)?" in rule[0]["wrapper"] or "(body/table/td)+" in rule[0]["wrapper"]
    got = {r["page_id"]: r["text"] for r in extract_pages(frame).collect()}
    assert all(got[i] == ("long text number %d " % i * 50).strip() for i in got)


def test_html_alignment_decides(spark):
    page = "<body><div class='a'><p>Your shop for tea</div><div class='b'><p>Tea {0} of the north<p>Price in pounds<p>{0} pounds</div>{1}</body>"
    pages = [(i, "http://h.org", page.format(i, "<div class='c'>Also seen %d</div>" % i if i % 2 else "")) for i in range(40)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_pages(frame).collect()}
    assert "Your shop" not in got[3] and got[3].startswith("Tea 3 of the north") and "3 pounds" in got[3]
    assert main_text(pages[3][2], None) != got[3]  # without a wrapper the constants would stay
    assert "(body/div.c)?" in host_wrappers(frame).first()["wrapper"]
    leaf = lambda h: [("slot", "p", "", h, 1, 1)]
    assert align(leaf(5), leaf(5)) == [("slot", "p", "", 5, 2, 2)] and align(leaf(5), leaf(6)) == [("slot", "p", "", 5, 0, 2)]
    assert constants(align(align(leaf(5), leaf(5)), leaf(5)), 3) == {("p", 5)} and constants(align(align(leaf(5), leaf(6)), leaf(5)), 3) == set()


def test_html_keeps_articles_without_markup(spark):
    copy = "<body><div class='t'>One title</div><div class='b'>%s</div></body>" % ("The same long article text. " * 20)
    apart = "<body><section class='s'>Our shop sells tea</section><div class='t'>Title {0}</div><div class='b'>{1}</div></body>"
    pages = [(i, f"http://copy.org/?u={i}", copy) for i in range(4)] + [(4 + i, f"http://print.org/{i}", copy.replace("</body>", f"<div class='d'>Printed {i}</div></body>")) for i in range(4)]
    pages += [(10 + i, "http://apart.org", apart.format(i, f"body number {i} " * 40)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all("One title The same long article text." in got[i] for i in range(8))
    assert all(got[10 + i].startswith(f"Title {i} body number {i}") for i in range(6))


def _site(host, n, rng, words):
    """Pages without any telling tag or name, and their articles: menus, notes that pages share, articles, replies, footers."""
    say = lambda k: " ".join(rng.choice(words, k))
    notes = [say(7) for _ in range(3)]
    for i in range(n):
        title, paragraphs = f"{say(4)} {host} {i}", [say(int(rng.integers(20, 60))) for _ in range(int(rng.integers(2, 6)))]
        menu = "".join(f"<li><a href='/'>{say(1)}</a></li>" for _ in range(int(rng.integers(3, 7))))
        note = f"<div>{notes[i % 3]}</div>" if i % 4 else ""
        replies = "".join(f"<div><p>{say(9)}</p></div>" for _ in range(int(rng.integers(4))))
        body = "".join(f"<p>{x}</p>" for x in paragraphs)
        yield f"<body><div><ul>{menu}</ul></div>{note}<div><h1>{title}</h1>{body}</div><div>{replies}</div><div>&copy; {host} {say(2)}</div></body>", " ".join([title, *paragraphs])


def test_html_wrappers_decide_without_names(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8)))) for _ in range(400)]
    pages = [(host, *x) for host, n in (("a.org", 40), ("b.org", 12), ("c.org", 15)) for x in _site(host, n, rng, words)]
    frame = spark.createDataFrame([(i, f"http://{h}/{i}", page, "x") for i, (h, page, _) in enumerate(pages)], "page_id int, url string, html string, host string")
    frame = frame.unionByName(frame.where("page_id % 10 = 0"))  # repeated rows, a clashing column, a narrower id
    rows = extract_pages(frame).collect()
    assert len(rows) == len(pages) + len(pages[::10]) and {r["page_id"] for r in rows} == set(range(len(pages)))
    wrong = [r["page_id"] for r in rows if r["text"] != pages[r["page_id"]][2]]
    assert not wrong
    assert all(main_text(page, None) != text for _, page, text in pages)  # without a wrapper nothing is told apart


def test_html_repeated_groups():
    block = lambda leaf, h: ("slot", "p", "", h, 1, 1, leaf, 0, 10, 5, 0)
    got = fold([block("h3", 1), block("p", 2)] * 3 + [block("p", 9)])
    assert [x[0] for x in got] == ["slot", "slot", "rep", "slot", "slot", "slot"] and [y[3] for y in got[2][1]] == [1, 2]
    assert fold([block("p", 1), block("p", 2)]) == [block("p", 1), block("p", 2)]
    whole = align(fold([block("p", k) for k in range(5)]), fold([block("p", k) for k in range(7)]))
    assert [x[0] for x in whole] == ["slot", "rep", "slot"] or len(whole) == 4  # the last turns differ in their texts
    assert sum(y[8] for x in whole for y in ((x[1] if x[0] == "opt" else x)[1] if (x[1] if x[0] == "opt" else x)[0] == "rep" else [x[1] if x[0] == "opt" else x])) == 120


def test_decontamination(spark, edge, empty):
    rng = np.random.default_rng(2)
    for _ in range(200):  # both forms against the whole table
        p, t = ("".join(rng.choice(list("ab"), rng.integers(1, 9))) for _ in range(2))
        for anchored in (False, True):
            rows = [[j if anchored else 0 for j in range(len(t) + 1)]]
            for i, c in enumerate(p, 1):
                rows.append([i])
                for j, x in enumerate(t, 1):
                    rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (c != x)))
            assert list(distances(p, t, 0, anchored)) == rows[-1][1:]
    assert list(passages("abcd", "xxabcdabcdyyabxcdz", 1)) == [(0, 2, 6), (0, 6, 10), (1, 12, 17)]
    item = "the quick brown fox jumps over the lazy dog and then it runs far away from the bear " * 2
    bench = spark.createDataFrame([(1, item), (2, None), (3, "tiny"), (1, item)], "item_id long, text string")
    typo = item.replace("quick", "qu1ck", 1).upper().replace(" ", "  ")
    docs = frame(spark, [(1, "xx " + item + " yy", "en", "a"), (2, "aa " + typo, "en", "a"), (3, "clean text of no matter", "en", "a"), (4, item[:60], "en", "a"), (5, "a tiny one", "en", "a"), (6, "destiny", "en", "a")])
    assert {(r["doc_id"], r["items"]) for r in contaminated(docs, bench).collect()} == {(1, "1"), (2, "1"), (5, "3")}
    assert [r["distance"] for r in benchmark_matches(docs.where("doc_id = 2"), bench).collect()] == [1]
    two = frame(spark, [(9, "ab, " + item + item.replace("quick", "quic", 1) + "end", "en", "a"), (None, item, "en", "a")])
    assert [tuple(r)[1:] for r in benchmark_matches(two.where("doc_id = 9"), bench).orderBy("start_char").collect()] == [(1, 0, 4, 3 + len(item)), (1, 1, 4 + len(item), 2 + 2 * len(item))]
    short = spark.createDataFrame([(5, "a short item of thirty letters")], "item_id long, text string")
    assert contaminated(frame(spark, [(1, "this is a shart item of thirty letters or so", "en", "a"), (2, "a short rest", "en", "a")]), short).first()["doc_id"] == 1
    clash = docs.withColumns({"_doc": F.lit(1), "item_id": F.lit(2)})
    assert {r["doc_id"] for r in without_contaminated(clash, bench).collect()} == {3, 4, 6} and without_contaminated(clash, bench).columns == clash.columns
    assert contaminated(edge, bench).count() == 0 and contaminated(empty, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_fuzzy_trie():
    trie = FuzzyTrie(["moron", "pathetic"])
    near = ["moron", "mroron", "moon", "moran", "morons", "pathetc", "pathet1c", "oron"]
    assert all(map(trie.near, near)) and not any(map(trie.near, ["mon", "morpn5", "path", "", "normo"]))
    rng = np.random.default_rng(5)
    lexicon = ["".join(rng.choice(list("abc"), 6)) for _ in range(12)]
    trie = FuzzyTrie(lexicon)
    for _ in range(3000):
        w = "".join(rng.choice(list("abc"), rng.integers(4, 9)))
        edits = lambda x: {x[:k] + c + x[k + e :] for k in range(len(x) + 1) for c in ("", "a", "b", "c") for e in (0, 1)}
        assert trie.near(w) == any(w in edits(x) for x in lexicon)


def test_quotations():
    long = '"' + "w " * 5000 + '" x\n"open “in” \n«a» „b“ „c” "'
    assert [long[a:b][:6] for a, b in zip(*quotations(long))] == ['"w w w', "«a»", "„b“", "„c”"]
    assert quotations("„" * 1_000_000) == ([], [])
    told = lambda t: [t[a:b] for a, b in zip(*quotations(t))]
    assert told('a 5" pipe, you idiot, and a 6" pipe') == told('5" you idiot') == told('"you idiot\nhe"') == told('a " b " c') == []
    assert told('he said "you idiot", then ("go") "x"') == ['"you idiot"', '"go"', '"x"'] and told('a 5" "pipe"') == ['"pipe"']
    assert told('"a 5"x pipe"') == ['"a 5"x pipe"'] and told('"') == told('"a') == [] and told('""') == ['""']


def test_toxicity(spark, edge, empty):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        w = prose(rng, 50)
        if i % 5 == 0:
            for k in (3, 9, 20):
                w[k] = str(rng.choice(["blockhead", "numbskull"]))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(labelled.where("doc_id < 200"))
    got = {r["doc_id"]: r["score"] for r in score_toxicity(labelled, model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows)
    probe = frame(spark, [(1, "you b1ockhead and nunbskull blockheadd", "en", "a"), (2, 'they said the word "blockhead" here', "en", "a")])
    p = {r["doc_id"]: r for r in score_toxicity(probe, model).collect()}
    assert p[1]["near_hits"] > 1 and p[2]["quoted_hits"] > 0 and p[2]["word_hits"] == 0 and p[1]["score"] > p[2]["score"]
    assert score_toxicity(edge, model).count() == len(EDGE) and score_toxicity(empty, model).count() == 0
    assert without_toxic(edge, model).columns == edge.columns and without_toxic(edge, model).count() == len(EDGE)
    assert len(fit_toxicity(labelled.limit(0)).weights) == 7


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m.group())
            luhn = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark, edge, empty):
    rng = np.random.default_rng(6)
    parts = ["a@b.cc", "_x@d.ee", "é😀", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4465758382889437", "4465-7583 8288 9437", "+1 (743) 555-3824", "+12", " ", "x@y", ".", "@", "7", "\n", "+"]
    texts = ["".join(rng.choice(parts, 12)) for _ in range(200)] + ["a@b.cc_x@d.ee", ""]
    got = {r["doc_id"]: r for r in find_pii(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    import hashlib

    for i, t in enumerate(texts):
        base = ",".join(s for s in got[i]["spans"].split(",") if s and not s.startswith("term"))
        assert base == brute_pii(t), t
        assert got[i]["base_sha256"] == hashlib.sha256(brute_pii(t).encode()).hexdigest()
    lines = [f"{'abcdefgh'[k]} note from zanzibar {'hgfedcba'[k]} write ann@mail.org now {k}" for k in range(6)] + [f"nothing to see {k}" for k in range(40)]
    told = {r["doc_id"]: r["n_term"] for r in find_pii(frame(spark, [(k, t, "en", "a") for k, t in enumerate(lines)])).collect()}
    assert told[0] > 0 and told[20] == 0
    clean = {r["doc_id"]: r["text"] for r in sanitised(frame(spark, [(1, "mail a@b.cc or 1.2.3.4!", "en", "a"), (2, None, "en", "a"), (3, "ok", "en", "a")])).collect()}
    assert clean == {1: "mail [EMAIL] or [IP]!", 2: None, 3: "ok"}
    assert find_pii(edge).count() == len(EDGE) and find_pii(empty).count() == 0 and sanitised(edge).columns == edge.columns


def test_pii_survives_long_runs(spark):
    """A million digits, labels, addresses' parts: the patterns do not recurse."""
    runs = ["1" * 1_000_000, "1 " * 1_000_000, "a@b" + ".c" * 1_000_000, "1.2.3." + "4" * 1_000_000, "+1" + "(" * 1_000_000 + "2", "a" * 1_000_000, "é ann@mail.org " * 2000]
    got = {r["doc_id"]: r for r in find_pii(frame(spark, [(k, t, "en", "a") for k, t in enumerate(runs)])).collect()}
    assert [(got[k]["n_email"], got[k]["n_ip"], got[k]["n_card"], got[k]["n_phone"]) for k in range(7)] == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (2000, 0, 0, 0)]


def test_pii_terms_beyond_ascii(spark):
    rows = [(k, f"{'abcde'[k]} ÉCOLEX wrote to bob@mail.org about {'vwxyz'[k]} écolex", "en", "a") for k in range(5)] + [(k, f"other words {k} here", "en", "a") for k in range(5, 200)]
    assert sanitised(frame(spark, rows)).where("doc_id = 1").first()["text"].count("[TERM]") >= 2


def brute_terms(rows, ratio=0.8, alpha=0.05, support=3):
    """doc_id -> disclosing terms, in plain Python, of (doc_id, text) whose only values are e-mail addresses."""
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    texts = {t for _, t in rows}
    words = lambda t: [w.lower() for w in re.split(r"[^\w]+|_", t)]
    good = lambda w: len(w) >= 4 and not re.search(r"\d", w)
    own = {t: {w for m in mail.findall(t) for w in words(m)} for t in texts}
    with_term = Counter(w for t in texts for w in set(words(t)) if good(w))
    among = {}
    for t in texts:
        for e in {m.lower() for m in mail.findall(t)} | ({"any"} if mail.search(t) else set()):
            among.setdefault(e, set()).add(t)
    told = {}
    for e, ts in among.items():
        if len(ts) == len(texts):
            continue
        both, contexts = Counter(), {}
        for t in ts:
            ws, seen = words(t), {}
            for i, w in enumerate(ws):
                if good(w) and w not in own[t]:
                    seen.setdefault(w, set()).add((ws[i - 1] if i else None, ws[i + 1] if i + 1 < len(ws) else None))
            for w, c in seen.items():
                both[w] += 1
                contexts.setdefault(w, []).append(c)
        for w, c in both.items():
            p, ne, n = with_term[w] / len(texts), len(ts), len(texts)
            pmi = math.log((c + p) / (ne + 1) / p)
            k = min(c, ne - c)
            chance = math.log(len(both)) + k * math.log(ne * 2.718281828 / max(k, 1)) + c * math.log(p)
            if len(set().union(*contexts[w])) >= support and pmi >= ratio * math.log(n / ne) and chance <= math.log(alpha):
                told.setdefault(e, set()).add(w)
    return {i: {w for e in {m.lower() for m in mail.findall(t)} | ({"any"} if mail.search(t) else set()) for w in told.get(e, ()) if w in words(t) and w not in own[t]} for i, t in rows}


def test_pii_terms_against_plain_python(spark):
    rng = np.random.default_rng(9)
    common = ["".join(w) for w in rng.choice(list("abcdefgh"), (30, 5))]
    rows = []
    for k in range(900):
        w = list(rng.choice(common, rng.integers(6, 14)))
        if k < 60:
            w.insert(rng.integers(0, 6), f"user{k % 12}@mail.org")
            if k % 12 < 3:
                w.insert(rng.integers(0, 6), ["zanzibar", "timbuktu", "Quito"][k % 12])  # planted with three addresses
            w.insert(rng.integers(0, 6), "once" + "abcdefghij"[k % 10] * (k // 10 + 1))  # in no other text
        if k < 60 and rng.random() < 0.9:
            w.insert(rng.integers(0, 6), "mailbox")  # with all addresses
        rows.append((k, " ".join(w)))
    rows += [(1000, rows[3][1]), (1001, rows[3][1])]  # copies bring no evidence
    copied = "report by user30@mail.org on gizmo and widget " + " ".join(common[:8])
    rows += [(2000 + k, copied + f" {common[k]} end") for k in range(8)]  # near copies bring one context
    got = {}
    for r in find_pii(frame(spark, [(i, t, "en", "a") for i, t in rows])).collect():
        text = dict(rows)[r["doc_id"]]
        got[r["doc_id"]] = {text[int(a) : int(b)].lower() for kind, a, b in (x.split(":") for x in r["spans"].split(",") if x) if kind == "term"}
    want = brute_terms(rows)
    assert got == want
    found = set().union(*want.values())
    assert {"zanzibar", "timbuktu", "quito", "mailbox"} <= found and not any(w.startswith("once") or w in ("gizmo", "widget") for w in found)


def test_language_id(spark, edge, empty):
    rng = np.random.default_rng(8)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst"}
    rows = [(i, " ".join(prose(rng, 30, alphabets[k])), k, "a") for i, k in enumerate(list(alphabets) * 60)]
    docs = frame(spark, rows)
    model = fit_languages(docs.where("doc_id < 160"))
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs, model).collect()}
    assert all(got[i] == k for i, _, k, _ in rows)
    e = identify(edge, model).collect()
    assert len(e) == len(EDGE) and all(r["lang_pred"] == "und" for r in e if r["doc_id"] in (1, 2)) and identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in identify(frame(spark, [(1, "½ ² Ⅷ ① 12", "aa", "a")]), model).collect()} == {"und"}
    c = codewords(12)
    assert min((c[a] != c[b]).sum() for a in range(12) for b in range(a)) >= 4
    assert all(r["lang_pred"] == "und" for r in identify(docs, fit_languages(docs.limit(0))).collect())


def test_near_duplicates_edges(spark, edge, empty):
    got = near_duplicates(edge).collect()
    assert len(got) == len(EDGE) and near_duplicates(empty).count() == 0
    assert all(r["kept"] for r in got) and sum(r["n_shingles"] == 0 for r in got) == 3
    a, b = "one two three four five six", "another text of quite other words"
    repeated = near_duplicates(frame(spark, [(3, a, "en", "a"), (4, a, "en", "a"), (4, b, "en", "a"), (None, a, "en", "a")]))
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in repeated.collect() if r["doc_id"]) == [(3, 3, True), (4, 3, False), (4, 4, True)]


def test_near_duplicates_across_split_keys(spark, monkeypatch):
    """A hot passage, chains of near copies and keys in several parts, against all pairs."""
    from codequarry.llm import neardup

    monkeypatch.setattr(neardup, "PART", 16)
    rng = np.random.default_rng(11)
    passage, rows = prose(rng, 60), []
    for i in range(150):
        w = passage + prose(rng, 6 + i % 9) if i % 2 else list(passage) + ["z"] * 3
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(0, len(w))] = "edit%d" % rng.integers(0, 400)
        rows.append((i, " ".join(w), "en", "a"))
    sets = {i: frozenset(zip(*[t.split()[k:] for k in range(5)])) for i, t, _, _ in rows}
    links = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], "a long, b long")
    want = {i: i for i in sets} | {r["id"]: r["component_id"] for r in connected_components(links).collect()}
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows)).collect()} == want
