"""Each stage of the pipeline, and all of them, against brute force on a small corpus with nulls, repeats and clashes."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _key int, text_md5 string, kept boolean"
ITEM = "the capital of the northern province was moved to the river twice before the old bridge fell"


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghijklm"), rng.integers(3, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    rows = [(i, " ".join(words(rng, 40))) for i in range(240)]
    for i in range(0, 240, 4):  # toxic ones
        w = rows[i][1].split()
        w[3] = w[9] = w[20] = "numbskull"
        rows[i] = (i, " ".join(w))
    base = rows[1][1].split()
    rows += [(1000 + k, " ".join([*base[:-1], f"end{k}"])) for k in range(5)] + [(1, rows[1][1]), (2, rows[1][1]), (1010, rows[2][1])]
    rows += [(2000, f"x {ITEM} y"), (2001, "x " + ITEM.replace("capital", "capitol").upper()), (2002, ITEM[:50])]
    rows += [(3000, " ".join(words(rng, 4)) + " zanzibar mail ann@mail.org now"), (3001, "from 10.20.30.40 " + " ".join(words(rng, 4)))]
    rows += [(3010 + k, " ".join([*words(rng, 5), "timbuktu", *words(rng, 3), "bob@mail.org"])) for k in range(6)]
    rows += [(4000, None), (4001, ""), (None, "no id " + " ".join(words(rng, 12))), (4002, " \n "), (4003, "short")]
    out = [(i, t, "en", ["a", "b", None][k % 3], None if t is None else len(t), "clash", k, "c", False) for k, (i, t) in enumerate(rows)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(out, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.read.parquet(f"{corpus}/documents.parquet")


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def distance(item, text):
    """Least edit distance to any substring, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        above, row = row, [i]
        for j, x in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != x)))
    return min(row)


def test_toxicity(spark, docs, corpus):
    want = [r for r in rows_of(docs) if "numbskull" not in (r[1] or "")]
    assert rows_of(P.drop_toxic(spark, docs, corpus)) == want


def test_near_duplicates(spark, docs, corpus):
    rows = rows_of(docs)
    nodes = sorted({(r[0], sets(r[1])) for r in rows if r[0] is not None and sets(r[1])}, key=str)
    group = {n: n[0] for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if group[a] > group[b] and 100 * len(a[1] & b[1]) >= 80 * len(a[1] | b[1]):
                    group[a], changed = group[b], True
    want, seen = [], set()
    for r in rows:
        key = (r[0], r[1])
        if key not in seen and group.get((r[0], sets(r[1])), r[0]) == r[0]:
            want.append(key)
        seen.add(key)
    got = P.drop_near_duplicates(spark, docs, corpus)
    assert got.columns == docs.columns and sorted(map(str, want)) == sorted(str((r[0], r[1])) for r in got.collect())
    assert {r[0] for r in got.where("doc_id in (1, 2, 1000, 1010)").collect()} == {1, 2}  # 2 has a text of its own, too


def test_decontamination(spark, docs, corpus):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip().lower()
    want = [r for r in rows_of(docs) if distance(ITEM, normal(r[1])) > int(0.05 * len(ITEM))]
    assert rows_of(P.drop_contaminated(spark, docs, corpus)) == want and len(want) == docs.count() - 2


def test_pii(spark, docs, corpus):
    got = {(r["doc_id"], r["_key"]): r for r in P.sanitise(spark, docs, corpus).collect()}
    letters = lambda t: {w for w in re.findall(r"[^\W_]+", (t or "").lower()) if len(w) >= 4 and w.isalpha()}
    texts = {r["text"] or "" for r in docs.collect()}
    n = len(texts)
    values = {t: [m.group() for p in BASE.values() for m in re.finditer(p, t)] for t in texts}
    told = {}
    classes = [[x for x in texts if v in values[x]] for v in set().union(*values.values())] + [[x for x in texts if re.search(p, x)] for p in BASE.values()]
    for among in classes:
        own = {x: letters(" ".join(values[x])) for x in among}
        terms = set().union(*[letters(x) - own[x] for x in among])
        for term in terms:
            contexts = set()
            for x in among:
                words = re.split(r"[\W_]+", x.lower())
                contexts |= {(words[i - 1] if i else None, words[i + 1] if i + 1 < len(words) else None) for i, w in enumerate(words) if w == term and term not in own[x]}
            c, ne, p = sum(term in letters(x) - own[x] for x in among), len(among), sum(term in letters(x) for x in texts) / n
            k = min(c, ne - c)
            ways = k * math.log(ne * 2.718281828 / max(k, 1))
            if len(contexts) >= 3 and math.log((c + p) / (ne + 1) / p) >= 0.8 * math.log(n / ne) and math.log(len(terms)) + ways + c * math.log(p) <= math.log(0.05):
                for x in among:
                    if term in letters(x) - own[x]:
                        told.setdefault(x, set()).add(term)
    assert any(told.values())
    for r in docs.collect():
        t = r["text"]
        if t is not None:
            for kind, p in BASE.items():
                t = re.sub(p, f"[{kind.upper()}]", t)
            for term in told.get(r["text"], ()):
                t = re.sub(rf"(?<![^\W_]){term}(?![^\W_])", "[TERM]", t)
        new = got[r["doc_id"], r["_key"]]
        assert new["text"] == t and new["n_chars"] == (None if t is None else len(t)) and new["_doc"] == "clash"


def test_mixing(spark, docs, corpus):
    got = P.mix(spark, docs, corpus).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r["doc_id"] or -1, size(r["text"])) for r in docs.collect())
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    weights, total = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), (5, 2, 1))), sum(sizes.values())
    target, free = {}, set(sizes)
    while True:  # shares, with what stops at three times its size taken out in turn
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    target |= {s: share[s] for s in free}
    by_size = {sizes[s]: target[s] for s in sizes}
    assert len(by_size) == 3 and all(abs(r["target"] - by_size[r["source_size"]]) < 1e-5 and 0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in by_size:
        assert abs(sum(r["taken"] for r in got if r["source_size"] == s) - by_size[s]) <= 200  # two blocks


def test_stages_on_nothing(spark, docs, corpus):
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), corpus).count() == 0, name


def test_run_keeps_clean_documents(spark, corpus):
    got = {r["doc_id"] for r in P.run(spark, corpus).collect()}
    clean = {i for i in range(240) if i % 4}
    assert clean | {4000, 4001, 4002, 4003, None, 3000, 3001, 2002, *range(3010, 3016)} == got
