"""Main text of web pages: union-free wrappers inferred for each host, whose parts are judged and then read from each page."""

from __future__ import annotations

import html as entities
import json
import re
from functools import reduce
from itertools import groupby
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import written

GROUP = 32  # streams, or wrappers of streams, that one call aligns on average
SMALL = 200_000  # hosts that may be broadcast
BROADCAST_BYTES = 8_000_000
BESIDE = 3  # a text that stands beside so many different articles is none's
RUNNING = 200  # characters that a part behind the article has on average, if it belongs to it
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|object|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[a-zA-Z/!?](?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
CONTAINERS = frozenset("html body div nav article section header footer aside main form ul ol dl table figure details dialog menu td blockquote fieldset".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn del em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr img".split())
EXCLUDED_TAGS = frozenset("nav header footer aside form menu dialog button head".split())
EXCLUDED_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments reply replies respond discussion notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended widget toolbar pagination pager skip".split())
EXCLUDED_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())


def _names(tag: str) -> tuple[set[str], str]:
    """The words in a tag's class and id, and its role."""
    words, role = set(), ""
    for m in ATTRIBUTE.finditer(tag):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            role = value
        elif m[1].lower() in ("class", "id", "itemprop"):
            words.update(re.split(r"[\s_-]+", value))
            words.update(re.sub(r"[_-]", "", v) for v in value.split())
    return words - {""}, role


def segments(page: str | None):
    """The page as ``(path, excluded, in_main, text, leaf, opened)`` for each block of text, decoded and with single spaces.

    path: names of the open containers.  excluded: a menu, header, footer, sidebar, advert, form, notice or comment
    stands around it.  leaf: ``+`` for the first block of a container, the block's tag, ``@`` if links hold all of it.
    opened: how many containers of the path have no block before.  A tag that is not inline ends a block; a closing tag
    closes what was left open inside.
    """
    stack: list[list] = []  # tag, name, excluded, main, whether a block came
    held: list[str] = []
    page = page or ""
    leaf, link, plain = "", False, False

    def flush():
        nonlocal plain
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            opened = sum(not s[4] for s in stack)
            first = "+" if stack and not stack[-1][4] else ""
            yield tuple(s[1] for s in stack), any(s[2] for s in stack), any(s[3] for s in stack), text, first + leaf + ("" if plain else "@"), opened
            for s in stack:
                s[4] = True
        plain = False

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
            plain = plain or not link and not held[-1].isspace()
        at = m.end()
        t = TAG.match(m.group())
        name = t[2].lower() if t else ""
        if name in INLINE or not t and not m[1]:
            link = not t[1] if name == "a" else link
            continue
        if m[1]:
            held.append(" ")
            continue
        yield from flush()
        if name not in CONTAINERS and name not in EXCLUDED_TAGS and name != "title":
            leaf = leaf if name in ("br", "hr") else "" if t[1] else name
            continue
        leaf, link = "", False
        if t[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif not m.group().endswith("/>"):
            words, role = _names(m.group())
            main = name in ("article", "main") or role in ("main", "article") or bool(words & {"articlebody"})
            if name == "body":
                stack = [s for s in stack if s[0] == "html"]
            out = (name in EXCLUDED_TAGS and not (main and name != "head")) or name == "title" or role in EXCLUDED_ROLES or (bool(words & EXCLUDED_NAMES) and name not in ("html", "body") and not (main and name == "main"))
            stack.append([name, ".".join([name, *sorted(words)[:3]]).replace("/", "|"), out, main, False])
    if at < len(page):
        held.append(page[at:])
        plain = plain or not link and not held[-1].isspace()
    yield from flush()


def folded(tokens: list):
    """``(token, start, stop)`` for tandem repeats of up to six tokens of the same shapes, and for the tokens between.

    Bare tokens that repeat become ``("rep", unit)``.  Of blocks with texts the first and the last turn stay, as they
    may be constants, and those between become the repeated group.
    """
    shapes, k = [_shape(x) for x in tokens], 0
    while k < len(tokens):
        for size in range(1, 7):
            unit, n = shapes[k : k + size], 1
            while len(unit) == size and shapes[k + n * size : k + (n + 1) * size] == unit:
                n += 1
            bare = len(tokens[k]) <= 3
            if n > 2 - bare:
                edge = 0 if bare else size
                inner, stop = (k + edge, k + n * size - edge), k + n * size
                yield from ((tokens[i], i, i + 1) for i in range(k, inner[0]))
                yield ("rep", tuple(_turns(tokens[i : inner[1] : size]) for i in range(inner[0], inner[0] + size))), *inner
                yield from ((tokens[i], i, i + 1) for i in range(inner[1], stop))
                k = stop
                break
        else:
            yield tokens[k], k, k + 1
            k += 1


def _turns(tokens: list):
    """The turns of one block of a repeated group as one token: what differs between its texts, and sums."""
    x = tokens[0]
    if len(x) <= 3:
        return x
    texts = dict.fromkeys(y[3] for y in tokens)
    return *x[:3], x[3] if len(texts) == 1 else _hash(" ".join(map(str, texts))), 1, 1, *x[6:8], *(sum(y[i] for y in tokens) for i in (8, 9)), 0


def fold(tokens: list) -> list:
    return [x for x, _, _ in folded(tokens)]


def _bare(x):
    return x[1] if x[0] == "opt" else x


def _shape(x):
    """What two tokens must share to be aligned: a block's path, kind and leaf, not its text; a group of one block is that block."""
    x = _bare(x)
    return x[:3] + x[6:7] if x[0] != "rep" else _shape(x[1][0]) if len(x[1]) == 1 else ("rep", tuple(map(_shape, x[1])))


def _text(x):
    """The text that leads at a block, or None."""
    x = _bare(x)
    return x[3] if x[0] == "slot" and len(x) > 3 else _text(x[1][0]) if x[0] == "rep" and len(x[1]) == 1 else None


def _met(x, y):
    """Two aligned tokens as one: votes for equal texts add up, those for different ones cancel out."""
    x, y = _bare(x), _bare(y)
    if x[0] == "rep" or y[0] == "rep":
        return "rep", tuple(map(_met, *(z[1] if z[0] == "rep" else (z,) for z in (x, y))))
    if len(x) == 3 or len(x) == 2:
        return x
    (h, votes, seen), (g, others, more), rest = x[3:6], y[3:6], ()
    if len(x) > 6:
        rest = x[6], max(x[7], y[7]), *(i + j for i, j in zip(x[8:], y[8:]))
    if h == g:
        return *x[:3], h, votes + others, seen + more, *rest
    return *x[:3], *((h, votes - others) if votes >= others else (g, others - votes)), seen + more, *rest


def _joined(x, y):
    return ("opt", _met(x, y)) if "opt" in (x[0], y[0]) else _met(x, y)


def _opt(x):
    return x if x[0] == "opt" else ("opt", x)


def align(wrapper: list, page: list) -> list:
    """One step of inference: the wrapper that also covers ``page``.

    Blocks at the same path meet, sooner those of the same text; a repeated group covers one instance of itself; what
    only one side has becomes optional.
    """
    return [_opt(page[j]) if i is None else _opt(wrapper[i]) if j is None else _joined(wrapper[i], page[j]) for i, j in met(wrapper, page)]


def met(wrapper: list, page: list) -> list:
    """Places of the tokens that meet, as pairs in order; None where only one side has a token."""
    n, m = len(wrapper), len(page)
    a, b = [(_shape(x), _text(x)) for x in wrapper], [(_shape(y), _text(y)) for y in page]
    head = tail = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    middle = _best(a[head : n - tail], b[head : m - tail])
    shifted = [(None if i is None else i + head, None if j is None else j + head) for i, j in middle]
    return [(k, k) for k in range(head)] + shifted + [(n - k, m - k) for k in range(tail, 0, -1)]


def _best(a: list, b: list) -> list:
    """The alignment of most worth: 4 for two blocks of the same shape and text, 1 for two of the same shape.

    ``table[i][j]`` is the most worth of ``a[i:]`` and ``b[j:]``.  A row needs the row below it alone, so about
    the square root of all rows are kept and those between are made again on the way back: memory is m * sqrt(n).
    Rows are lists where they are short and arrays where they are long, with the same values.
    """
    n, m = len(a), len(b)
    step, short = isqrt(n) + 1 if n * m > 4096 else 1, m < 64
    if not short:
        numbers = [{x: k for k, x in enumerate({*(x[p] for x in a), *(y[p] for y in b)})} for p in (0, 1)]
        shapes, texts = (np.array([known[y[p]] for y in b], np.int32) for p, known in enumerate(numbers))

    def row(i: int, below):
        shape, text = a[i]
        if not short:
            worth = (shapes == numbers[0][shape]) * np.where(texts == numbers[1][text], 4, 1).astype(np.int32)
            return np.maximum.accumulate(np.append(np.maximum(below[:-1], below[1:] + worth), below[-1])[::-1])[::-1]
        found, x = below[:], below[m]
        for j in range(m - 1, -1, -1):
            x = below[j] if below[j] >= x else x
            if shape == b[j][0]:
                y = below[j + 1] + (4 if text == b[j][1] else 1)
                x = y if y > x else x
            found[j] = x
        return found

    below = [0] * (m + 1) if short else np.zeros(m + 1, np.int32)
    kept = {n: below}
    for i in range(n - 1, -1, -1):
        below = row(i, below)
        if i % step == 0:
            kept[i] = below
    out, i, j, table = [], 0, 0, kept
    while i < n or j < m:
        if i < n and (i not in table or i + 1 not in table):
            end = min(n, (i // step + 1) * step)
            table = {end: kept[end]}
            for k in range(end - 1, i - 1, -1):
                table[k] = row(k, table[k + 1])
        w = 0 if i == n or j == m or a[i][0] != b[j][0] else 4 if a[i][1] == b[j][1] else 1
        if w and table[i][j] == table[i + 1][j + 1] + w:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j >= m or i < n and table[i + 1][j] >= table[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def tokens_of(found: list) -> list:
    """``("slot", path, kind, text's hash, votes, pages, leaf, opened, share, characters, beside)`` for each block.

    kind tells what names exclude and what main elements hold.  share: the block's part, in millionths, of the page's
    running text, which is neither excluded nor linked.  beside: 1 once the text is known from many articles.
    """
    mass = [0 if out or leaf.endswith("@") else len(text) for _, out, _, text, leaf, _ in found]
    whole = sum(mass) or 1
    return [("slot", "/".join(path), _kind(out, main), _hash(text), 1, 1, leaf, opened, n * 1_000_000 // whole, len(text), 0) for (path, out, main, text, leaf, opened), n in zip(found, mass)]


def stream(found: list) -> list:
    """A page's blocks as folded tokens; of what names exclude the place alone."""
    return fold([x[:3] if x[2] == "out" else x for x in tokens_of(found)])


def _kind(out: bool, main: bool) -> str:
    return "out" if out else "main" if main else ""


def slots(tokens) -> set[tuple[str, str]]:
    """Path and kind of every text slot of a wrapper."""
    found = set()
    for x in tokens:
        found |= {x[1:3]} if x[0] == "slot" else slots([x[1]] if x[0] == "opt" else x[1])
    return found


def constants(tokens, pages: int) -> set[tuple[str, int]]:
    """Path and text of the blocks outside main elements that are the same on all but a few of ``pages`` different pages.

    Where a text stands on nine tenths of the pages, votes less missing pages are eight tenths of the pages or more.
    """
    found = set()
    for x in tokens:
        if x[0] != "slot":
            found |= constants([x[1]] if x[0] == "opt" else x[1], pages)
        elif len(x) > 3 and x[2] == "" and _constant(x, pages):
            found.add((x[1], x[3]))
    return found


def _constant(x, pages: int) -> bool:
    return x[4] >= 3 and x[4] - (pages - x[5]) >= 0.8 * pages


def _read(tokens: str) -> list:
    tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else x
    return list(tuples(json.loads(tokens)))


def render(tokens: list) -> str:
    """The wrapper as an expression: ``?`` after an optional part, ``+`` after a repeated one."""
    def one(x):
        return f"({one(x[1])})?" if x[0] == "opt" else "(" + " ".join(map(one, x[1])) + ")+" if x[0] == "rep" else x[1]

    return " ".join(map(one, tokens))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _parts(tokens: list):
    """``(place, element, block, boxes)`` of each block of a wrapper; boxes number the containers around it."""
    chain: list[tuple[str, int]] = []
    for place, x in enumerate(tokens):
        x = _bare(x)
        for element, y in enumerate(x[1] if x[0] == "rep" else [x]):
            names = y[1].split("/") if y[1] else []
            known = len(names) - (y[7] if len(y) > 7 else 0)
            kept = next((k for k, name in enumerate(names[:known]) if k >= len(chain) or chain[k][0] != name), max(known, 0))
            chain = chain[:kept] + [(name, place * 100 + element) for name in names[kept:]]
            yield place, element, y, tuple(chain)


def judged(tokens: list, pages: int) -> list:
    """What each token of a wrapper of ``pages`` different pages holds: a list of verdicts, one for each of its blocks.

    The article's box is the deepest container that holds seven tenths of the running text, by pages and not by length,
    of what varies.  "box": within it.  "keep": plain text that varies, ahead of it, or behind it with RUNNING characters.
    "drop": excluded by name, linked, constant, a repeated container, or texts that stand beside many different articles.
    "main": in main elements.  Constants are judged as texts where they make up nine tenths, as on copies of one article.
    """
    parts = list(_parts(tokens))
    plain = [k for k, (_, _, y, _) in enumerate(parts) if y[2] == "" and len(y) > 6 and not y[6].endswith("@")]
    fixed = {k for k in plain if parts[k][2][3:4] and _constant(parts[k][2], pages)}
    whole = sum(parts[k][2][8] for k in plain)
    if 10 * sum(parts[k][2][8] for k in fixed) >= 9 * whole:
        fixed = set()
    beside = {k for k in plain if 2 * parts[k][2][10] >= parts[k][2][5]}
    lists = {_shape(y) for place, _, y, _ in parts if _bare(tokens[place])[0] == "rep" and len(y) > 6 and any(z[6].startswith("+") for z in _bare(tokens[place])[1] if len(z) > 6)}
    running = [k for k in plain if k not in fixed and k not in beside]
    running = [k for k in running if _shape(parts[k][2]) not in lists] or running
    mass: dict = {}
    for k in running:
        for n in range(1, len(parts[k][3]) + 1):
            mass[parts[k][3][:n]] = mass.get(parts[k][3][:n], 0) + parts[k][2][8]
    whole = sum(parts[k][2][8] for k in running)
    boxes = [b for b, n in mass.items() if 10 * n >= 7 * whole and n and b[-1][0].split(".")[0] not in ("html", "body")]
    box = max(boxes, key=lambda b: (len(b), mass[b]), default=())
    inside = [k for k, (*_, boxes) in enumerate(parts) if boxes[: len(box)] == box]
    verdicts: list = [[] for _ in tokens]
    for k, (place, _, y, boxes) in enumerate(parts):
        if y[2] != "":
            told = "main" if y[2] == "main" else "drop"
        elif box and boxes[: len(box)] == box:
            told = "box"
        elif k not in plain or k in fixed or k in beside:
            told = "drop"
        elif box and (_shape(y) in lists or k > inside[-1] and y[9] < RUNNING * y[5]):
            told = "drop"
        else:
            told = "keep"
        verdicts[place].append(told)
    return verdicts


def main_text(page: str | None, rule: tuple | None) -> str:
    """The page's texts, in order, that meet parts of its host's wrapper which are the article's.

    The page is aligned with the wrapper, and each block fares as the part that it meets.  Where the page has blocks in
    main elements they are its text.  What meets no part, as equal texts elsewhere are worth more, fares as the nearest part
    of its shape; without a wrapper all goes by names alone.
    """
    found = list(segments(page))
    blocks = tokens_of(found)
    told = ["drop" if x[2] == "out" else "main" if x[2] else "keep" for x in blocks]
    if rule:
        tokens, verdicts = rule
        mine = list(folded([x[:3] if x[2] == "out" else x for x in blocks]))
        shapes, last = [_shape(x) for x in tokens], 0
        for i, j in met(tokens, [x for x, _, _ in mine]):
            last = last if i is None else i
            if j is None:
                continue
            if i is None:
                alike = [k for k, shape in enumerate(shapes) if shape == _shape(mine[j][0])]
                if not alike:
                    continue
                i = min(alike, key=lambda k: abs(k - last))
            for k in range(mine[j][1], mine[j][2]):
                told[k] = verdicts[i][(k - mine[j][1]) % len(verdicts[i])]
    chosen = ("main",) if "main" in told else ("box", "keep")
    return " ".join(s[3] for s, t in zip(found, told) if t in chosen)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))


STREAMS = "host string, tokens string, h long, lead long, texts array<long>"


def _streams(batches):
    for b in batches:
        rows = []
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = list(segments(page))
            tokens, kept = stream(found), [s for s in found if not s[1]]
            lead = _hash(max(kept, key=lambda s: len(s[3]))[3]) if kept else 0
            texts = {x[3] for x in tokens if x[0] == "slot" and x[2] == "" and not x[6].endswith("@")} - {lead}
            text = json.dumps(tokens)
            rows.append({"host": host, "tokens": text, "h": _hash(text), "lead": lead, "texts": sorted(texts)})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("host", pa.string()), ("tokens", pa.string()), ("h", pa.int64()), ("lead", pa.int64()), ("texts", pa.list_(pa.int64()))]))


def _marked(batches):
    for b in batches:
        marked = []
        for tokens, texts in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
            known = set(texts or ())
            marked.append(json.dumps([(*x[:10], 1) if len(x) > 10 and x[3] in known else x for x in _read(tokens)]) if known else tokens)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marked, pa.string()), b.column(2)], ["host", "tokens", "h"])


def _with_beside(streams: DataFrame) -> DataFrame:
    """The streams with those texts marked that stand beside BESIDE different articles or more, on any hosts.

    A page's article counts as its longest text, so that copies of one page on many hosts count once.
    """
    texts = streams.select("host", "h", "lead", F.explode("texts").alias("text"))
    many = texts.select("text", "lead").distinct().groupBy("text").count().where(F.col("count") >= BESIDE).select("text")
    pages = texts.join(many, "text").groupBy("host", "h").agg(F.collect_set("text").alias("beside"))
    joined = streams.join(pages, ["host", "h"], "left").select("host", "tokens", "h", "beside")
    return joined.mapInArrow(_marked, "host string, tokens string, h long")


MERGED = "host string, tokens string, h long, pages long"


def _wrapper(pdf: pd.DataFrame) -> pd.DataFrame:
    tokens = reduce(align, map(_read, pdf.sort_values(["h", "tokens"])["tokens"]))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tokens": [json.dumps(tokens)], "h": [pdf["h"].min()], "pages": [pdf["pages"].sum()]})


def _merged(streams: DataFrame) -> DataFrame:
    """One wrapper ``host, tokens, h, pages`` of all streams of a host: rounds of groups of about GROUP streams each."""
    while True:
        parts = written(streams.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts")), "parts")
        most = parts.agg(F.max("parts")).first()[0] or 0
        hosts = F.broadcast(parts) if parts.count() <= SMALL else parts
        grouped = streams.join(hosts, "host").withColumn("part", F.pmod("h", "parts")).drop("parts")
        streams = written(grouped.groupBy("host", "part").applyInPandas(_wrapper, MERGED), "merged")
        if most <= 1:
            return streams


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper, rule`` of each host, inferred from all its pages.

    wrapper: the expression that covers every page's stream, each different stream aligned once, so that copies of a
    page count as one.  rule (JSON): the wrapper's tokens as they meet those of a page, and their verdicts.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    streams = written(rows.mapInArrow(_streams, STREAMS).dropDuplicates(["host", "h"]), "streams")
    merged = _merged(written(_with_beside(streams).withColumn("pages", F.lit(1).cast("long")), "marked"))

    def met_as(x):
        return ("rep", tuple(map(met_as, x[1]))) if x[0] == "rep" else met_as(x[1]) if x[0] == "opt" else x[:7]

    def told(batches):
        for b in batches:
            tokens = [_read(t) for t in b.column(1).to_pylist()]
            rules = [json.dumps([list(map(met_as, t)), judged(t, n)]) for t, n in zip(tokens, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(render, tokens), pa.string()), pa.array(rules, pa.string())], ["host", "wrapper", "rule"])

    return merged.select("host", "tokens", "pages").mapInArrow(told, "host string, wrapper string, rule string")


def _rule(text: str) -> tuple:
    tokens, verdicts = _read(text)
    return list(tokens), verdicts


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of each page: ``page_id, url, text, n_chars, host``, a row for each row of ``pages``.

    Null or empty html gives an empty text; a null url counts as host "".  What is no article goes by the verdicts on the
    parts of the host's wrapper (see ``judged``); what tag, role, class or id exclude always goes, and main elements are the
    text of a page that has them.  Nothing else is dropped or cut.  Broken and cut-off markup is read to its end.  An empty table gives an empty one,
    rows that repeat are read alike, a null page_id stays null, and further columns are left out.
    """
    wrappers = written(host_wrappers(pages).select("host", "rule"), "wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.length("rule") + F.length("host") + 32), F.lit(0))).first()[0]
    wrappers = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host")).join(wrappers, "host", "left").select("page_id", "url", "host", "html", "rule")

    def run(batches):
        known: dict[str, tuple] = {}
        for b in batches:
            texts = []
            for page, rule in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                if rule is not None and rule not in known:
                    known.clear() if len(known) > 1000 else None
                    known[rule] = _rule(rule)
                texts.append(main_text(page, known.get(rule)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), b.column(2)], ["page_id", "url", "text", "n_chars", "host"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, host string")
