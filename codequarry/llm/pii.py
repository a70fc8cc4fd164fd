"""Personal data: base patterns, and terms that give a protected entity away, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "A-Za-z0-9._%+-"
#: A look-behind (or the end of the match before, \G) spares starting again inside a run that has already failed;
#: possessive groups do not recurse, however long the run.
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap necessary conditions, so that most texts are not split at all.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
}
OTHER, RUN = r"[^\p{L}\p{N}]+", r"[\p{L}\p{N}]+"
SMALL = 200_000  # rows of bounded width that may be broadcast
BYTES = 16_000_000  # of other tables


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))
    doubled = lambda v: F.when(v > 9, v - 9).otherwise(v)
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(i) * 2)).otherwise(digit(i)))
    return (total % 10) == 0


def _valid(kind: Column, x: Column) -> Column:
    n = F.length(_digits(x))
    small = F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    return F.when(kind == 0, True).when(kind == 1, small).when(kind == 2, n.between(13, 19) & _luhn(x)).when(kind == 3, n.between(9, 15)).otherwise(True)


def _cut(text: Column, pattern: Column, kind: int, gate: Column) -> Column:
    """An array of (kind, i, gap before, text) of the pattern's matches in a text."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(found, between, lambda x, g: F.struct(x.alias("x"), F.length(g).alias("gap"))), lambda p: p["x"].isNotNull())
    item = lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), p["gap"].alias("gap"), p["x"].alias("x"))
    return F.when(gate, F.transform(pairs, item)).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,x:string>>"))


def _cut_terms(text: Column, terms: Column) -> Column:
    """As :func:`_cut`, of the words of a text that are terms: each is put between two marks that the text is rid of."""
    parts = F.least(F.lit(256), F.floor(F.size(terms) / 8) + 1)
    part = lambda w: F.pmod(F.xxhash64(w), parts)
    dealt = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.filter(terms, lambda t: part(t) == k))
    clean = F.translate(text, "\x01\x02", "  ")
    marked = lambda w, deal: F.when(F.array_contains(F.get(deal, part(F.lower(w)).cast("int")), F.lower(w)), F.concat(F.lit("\x01"), w, F.lit("\x02"))).otherwise(w)
    runs = F.transform(F.array(F.struct(dealt.alias("deal"), F.regexp_extract_all(clean, F.lit(RUN), F.lit(0)).alias("w"))), lambda s: F.transform(s["w"], lambda w: marked(w, s["deal"])))[0]
    whole = F.array_join(F.zip_with(F.split(clean, RUN, -1), runs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.transform(_cut(whole, F.lit("\x01[^\x02]*\x02"), 4, F.lit(True)), lambda e: F.struct(e["kind"].alias("kind"), e["i"].alias("i"), e["gap"].alias("gap"), F.substring(e["x"], F.lit(2), F.length(e["x"]) - 2).alias("x")))


def _placed(cut: DataFrame) -> DataFrame:
    """``key, kind, start, end, x`` from rows ``(key, e)``: running sums of gaps and matches."""
    rows = cut.select("key", "e.*").dropDuplicates(["key", "kind", "i"])
    w = Window.partitionBy("key", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("x")).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("x"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with text made non-null and a key by which equal rows are one."""
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn("_key", _hash128(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text")))


def _hash128(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", *parts)))


def _cast(df: DataFrame, *widths: Column) -> DataFrame:
    """A written table, to be broadcast where it has at most SMALL rows and its columns of other width BYTES bytes."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(widths, F.lit(0)).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= SMALL and size <= BYTES else df


def base_spans(docs: DataFrame) -> DataFrame:
    """Spans of the base patterns: ``key, kind (0 to 3), start, end, x``; code points, end exclusive."""
    text = F.col("text")
    cuts = [_cut(text, F.lit(PATTERNS[k]), i, GATES[k](text)) for i, k in enumerate(KINDS[:4])]
    found = docs.select(F.col("_key").alias("key"), F.explode(F.concat(*cuts)).alias("e"))
    return _placed(found).where(_valid(F.col("kind"), F.col("x")))


def entity_of(kind: Column, x: Column) -> Column:
    return _hash128(kind.cast("string"), F.when(kind == 0, F.lower(x)).otherwise(_digits(x)))


def words_of(text: Column) -> Column:
    """Distinct lower-cased words of at least four letters that no letter or digit adjoins."""
    runs = F.array_distinct(F.transform(F.split(text, OTHER), F.lower))
    return F.filter(runs, lambda w: (F.length(w) >= 4) & ~w.rlike(r"\p{N}"))


def placed_words(text: Column) -> Column:
    """``(term, context)`` of the words as in :func:`words_of`, each time that they occur; context: a hash of the words beside it."""
    runs = F.array(F.transform(F.split(text, OTHER), F.lower))
    around = lambda r, i: F.xxhash64(F.get(r, i - 1), F.get(r, i + 1))
    placed = F.transform(runs, lambda r: F.transform(r, lambda w, i: F.struct(w.alias("term"), around(r, i).alias("context"))))[0]
    return F.array_distinct(F.filter(placed, lambda p: (F.length(p["term"]) >= 4) & ~p["term"].rlike(r"\p{N}")))


def copy_weights(docs: DataFrame) -> DataFrame:
    """``_key, weight`` of the rows of ``docs`` that do not count as one: the rows of a text have weight 1 together."""
    rows = docs.select("_key", F.unhex(F.md5("text")).alias("copy")).withColumn("r", F.xxhash64("_key"))
    many = rows.groupBy("copy").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("least")).where("n > 1").select("copy", "least")
    each = rows.join(_cast(written(many, "many")), "copy").groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("r") == F.col("least")).cast("int")).alias("one"))
    return each.where("one = 0 or n > 1").select("_key", (F.col("one") / F.col("n")).alias("weight"))


def disclosing_terms(docs: DataFrame, spans: DataFrame, ratio: float = 0.8, alpha: float = 0.05, support: int = 3) -> DataFrame:
    """``key, terms``: the words of a document that give an entity in it away.

    Entity: a matched value, and, for what is told of all values of a kind, each kind.  Terms: words of at least four
    letters anywhere in a document that holds it, but not in a matched value there.  A term needs ``support`` different
    contexts (the words beside it) in different texts of the entity: a word that stands in one text alone says nothing
    yet, and near copies of a text bring none, so what is removed does not grow with the corpus.  With one
    pseudo-document added by which the entity's terms are as frequent as everywhere, p(t | e) = (n(e, t) + p(t)) /
    (n(e) + 1); PMI = log p(t | e) / p(t) is what the term tells of the entity, -log p(e) all there is to tell, and the
    term discloses from ``ratio`` of that on; counts are of different texts.  By chance, n(e, t) of the entity's documents hold the term with
    probability C(n(e), n(e, t)) p(t)^n(e, t) at most; times the entity's number of terms this must be ``alpha`` or
    less.

    Entities that stand in the same texts are judged as one, so a text of many values costs no more than one of few.
    """
    entity = entity_of(F.col("kind"), F.col("x"))
    of_kind = _hash128(F.col("kind").cast("string"), F.lit("kind"))
    held = spans.groupBy("key").agg(F.array_union(F.collect_set(entity), F.collect_set(of_kind)).alias("entities"), F.array_distinct(F.flatten(F.collect_list(words_of(F.col("x"))))).alias("own"))
    held = written(held, "held")
    if held.isEmpty():
        return held.select("key", F.col("own").alias("terms"))
    held = _cast(held, F.size("entities") * 20, F.size("own") * 16)
    odd = _cast(written(copy_weights(docs), "weights"))
    weighted = docs.select("_key", "text").join(odd, "_key", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).where("weight > 0")
    n = float(weighted.agg(F.sum("weight")).first()[0])
    used = weighted.select("weight", F.explode(words_of(F.col("text"))).alias("term")).groupBy(F.xxhash64("term").alias("h")).agg(F.sum("weight").alias("with_term"))
    mine = docs.join(held, docs["_key"] == held["key"]).select("key", F.unhex(F.md5("text")).alias("copy"), "entities", F.filter(placed_words(F.col("text")), lambda p: ~F.array_contains("own", p["term"])).alias("terms"))
    mine = written(mine.dropDuplicates(["key"]), "texts_with")
    texts = mine.select("copy", F.explode("entities").alias("entity")).distinct()
    same = lambda f: f(F.xxhash64("copy"))
    sets = texts.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"), same(F.bit_xor).alias("x"), F.sum(F.xxhash64("copy") % (1 << 40)).alias("s"))
    sets = written(sets.where(F.col("with_entity") < n).select("entity", F.struct("with_entity", "x", "s").alias("among")), "entities")
    groups = written(mine.select("key", "copy", F.explode("entities").alias("entity")).join(_cast(sets), "entity").select("key", "copy", "among").distinct(), "groups")
    both = groups.select("copy", "among").distinct().join(mine.select("copy", "terms").dropDuplicates(["copy"]), "copy").select("among", "copy", F.explode("terms").alias("t"))
    both = both.groupBy("among", F.col("t.term").alias("term"), "copy").agg(F.min("t.context").alias("context"))  # one context a text
    both = written(both.groupBy("among", "term").agg(F.count(F.lit(1)).alias("both"), F.count_distinct("context").alias("contexts")), "pairs")
    tested = _cast(written(both.groupBy("among").agg(F.count(F.lit(1)).alias("tested")), "tested"))
    told = both.where(F.col("contexts") >= support).join(tested, "among").withColumn("h", F.xxhash64("term")).join(used, "h")
    ne, c, p = F.col("among.with_entity"), F.col("both"), F.col("with_term") / F.lit(n)
    pmi = F.log((c + p) / (ne + 1) / p)
    ways = F.least(c, ne - c) * F.log(ne * F.lit(2.718281828) / F.greatest(F.least(c, ne - c), F.lit(1)))  # at least log C(ne, c)
    chance = F.log("tested") + ways + c * F.log(p)
    told = told.where((pmi >= ratio * F.log(F.lit(n) / ne)) & (chance <= F.log(F.lit(alpha))))
    told = written(told.groupBy("among").agg(F.collect_set("term").alias("found")), "told")
    told = groups.select("key", "among").join(_cast(told, F.length(F.array_join("found", " "))), "among").groupBy("key").agg(F.flatten(F.collect_list("found")).alias("found"))
    told = told.join(mine, "key").select("key", F.array_intersect("terms.term", "found").alias("terms"))
    return told.where("size(terms) > 0")


def all_spans(docs: DataFrame) -> DataFrame:
    """``key, kind, start, end`` of every base span and every disclosing term of ``docs`` (see :func:`keyed`)."""
    spans = written(base_spans(docs), "spans")
    terms = written(disclosing_terms(docs, spans), "disclosing")
    out = spans.select("key", "kind", "start", "end")
    more = docs.join(_cast(terms, F.length(F.array_join("terms", " "))), F.col("_key") == F.col("key")).select("key", F.explode(_cut_terms(F.col("text"), F.col("terms"))).alias("e"))
    return out.unionByName(_placed(more).select("key", "kind", "start", "end"))


def _is(kind: int):
    return lambda x: x["kind"] == kind


def _in_order(spans: DataFrame) -> DataFrame:
    return spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("s"))


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans`` for each row of ``docs``.

    Base kinds are matched leftmost without overlap within a kind, and failing matches dropped without a retry; terms
    that disclose an entity of the document come after them as kind ``term``.  Null texts are empty; equal rows get
    equal results; an empty table gives an empty result.
    """
    docs = keyed(docs.select("doc_id", "text"))
    found = _in_order(all_spans(docs))
    name = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", name[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    rows = docs.select("doc_id", "_key").join(found, F.col("_key") == F.col("key"), "left")
    rows = rows.withColumn("s", F.coalesce("s", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    counts = [F.size(F.filter("s", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.filter("s", lambda x: x["kind"] < 4)), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by ``[KIND]`` (overlapping spans by the first one's kind) and n_chars anew.

    Other columns stay; null texts stay null.
    """
    rows = keyed(docs.select(F.struct("*").alias("_doc"), F.col("text").isNull().alias("_null"), "doc_id", "text"))
    found = written(_in_order(all_spans(rows.select("doc_id", "text", "_key"))), "found")
    found = _cast(found, F.size("s") * 24)
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = F.col("text")
    step = lambda a, x: F.when(x["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))).otherwise(
        F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), name[x["kind"]]).alias("out"), x["end"].alias("at"))
    )
    clean = F.aggregate(order, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    rows = rows.join(found, F.col("_key") == F.col("key"), "left")
    changed = rows.withColumn("_text", F.when(~F.col("_null"), F.when(F.col("s").isNull(), text).otherwise(clean)))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return changed.select(*[new.get(c, F.col(f"_doc.{c}")).alias(c) for c in docs.columns])
