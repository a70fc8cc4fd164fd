"""Pieces of masked Java text, cut and judged over Arrow batches of whole files.

The same pieces as those of the regular expressions in ``declarations.pieces``, found by places of the marks that end
them; only what opens a brace or ends a statement with parentheses is looked at as text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: kinds of an opening brace: a class or interface, an enum, an annotation, a body without a name (anonymous class, constant), a method, anything else
CLASS, ENUM, ANNOTATION, BODY, METHOD, BLOCK = "C", "E", "A", "N", "M", "B"
#: only until the piece before is known: a name, or a call, without a type before it
BARE = "T"
BYTES = 1 << 21  # text that is cut at a time, in whole files
DEEPEST = 9  # parentheses that stay in one piece: one and NESTED within

S = r"[ \t\n\x0b\f\r]"
W = r"\w\p{L}\p{Nd}"  # a word's characters where it ends
#: Annotations ahead of a declaration; the same for Spark and for Python.
LEAD = r"^\s*+(?:@(?!interface\b)[\w.]++\s*+(?:\((?:[^()]++|\([^()]*+\))*+\)\s*+)?+)*+"
TYPE = re.compile(rf"[^(=]*?(@interface|\bclass|\binterface|\benum){S}++([A-Za-z0-9_]++)[^(=]*+(?<=\{{)\Z")
BEGINS = rf"(?:(?:if|for|while|switch|catch|try|do|else|finally|case)[^{W}]|synchronized{S}*[({{]|default{S}*:|static{S}*\{{)"
STATEMENT = rf"^(?:return|throw|new|assert|super|this|else)[^{W}]"
CREATION = rf"(?:^|[^{W}])new{S}+[\w.$<>?, \t\n\x0b\f\r\[\]&]*\("
PUBLIC = rf"^(?:[^(]*[^{W}(])?public[^{W}]"


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


KINDS = {"enum": ord(ENUM), "@interface": ord(ANNOTATION)}
ANNOTATED = re.compile(LEAD, re.ASCII)
MARK, BLANK = _table("{};()"), _table(" \t\n\x0b\f\r")
WORD = _table("_0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
PLAIN_WORD = WORD.copy()
WORD[128:] = True  # letters beyond ASCII go on with a word
LBRACE, RBRACE, END, LPAREN, RPAREN, AT, NEWLINE = (ord(c) for c in "{};()@\n")


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about BYTES of text, the column ``code``."""
    sizes = pc.fill_null(pc.binary_length(batch["code"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // BYTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _spans(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts from start to end, exclusive, as one array."""
    offsets = np.append(0, np.cumsum(end - start))
    at = np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text[at]))


def _closed(file: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parentheses that stay in one piece, and where each closes, as indexes of marks.

    They hold no braces but those of an array of plain values, and no more than DEEPEST levels.
    """
    same = file[1:] == file[:-1]
    pair = np.flatnonzero((mark[:-1] == LBRACE) & (mark[1:] == RBRACE) & same)
    apart = (mark == LBRACE) | (mark == RBRACE)
    apart[pair] = apart[pair + 1] = False
    apart[1:] |= ~same
    held = np.flatnonzero((mark == LPAREN) | (mark == RPAREN))
    if not len(held):
        return held, held
    opens = mark[held] == LPAREN
    level = np.cumsum(np.where(opens, 1, -1)) - opens
    level -= level.min()
    key = np.cumsum(apart)[held] * np.int64(level.max() + DEEPEST + 1) + level
    order = np.argsort(key, kind="stable")
    closing = np.full(len(held), -1)
    closing[order[:-1]] = np.where(key[order][1:] == key[order][:-1], order[1:], -1)
    mine = np.flatnonzero(opens & (closing >= 0))
    if level.max() >= DEEPEST:
        keys, rank = np.unique(key, return_inverse=True)
        n = np.int64(len(held) + 1)
        inner = np.sort((rank * n + np.arange(len(held)))[opens])
        deep = np.minimum(np.searchsorted(keys, key[mine] + DEEPEST), len(keys) - 1)
        first = np.append(inner, np.iinfo(np.int64).max)[np.searchsorted(inner, deep * n + mine)]
        mine = mine[~((keys[deep] == key[mine] + DEEPEST) & (first // n == deep) & (first % n < closing[mine]))]
    return held[mine], held[closing[mine]]


def _within(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    depth = np.zeros(n + 1, np.int32)
    depth[first] += 1
    depth[last + 1] -= 1
    return np.cumsum(depth)[:-1]


def _branches(text: np.ndarray, word: np.ndarray, next_word) -> np.ndarray:
    """Where branches stand in a text that ends in blanks."""
    is_ = lambda at, s: np.all([text[at + i] == ord(c) for i, c in enumerate(s)], axis=0)
    begins = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    if word[0]:
        begins = np.append(0, begins)
    begins = begins[_table("ifwc")[text[begins]]]
    found = [begins[np.any([is_(begins, w) & ~word[begins + len(w)] for w in ("if", "for", "while", "case", "catch")], axis=0)]]
    for c in (ord("&"), ord("|")):  # pairs of a run, from its beginning
        at = np.flatnonzero(text == c)
        run = np.flatnonzero(np.append(True, np.diff(at) != 1)[: len(at)])
        nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        found.append(at[(nth % 2 == 1)] - 1)
    asks = np.flatnonzero(text == ord("?"))
    behind = next_word(asks + 1)
    bound = _table(">,")[text[behind]] | np.any([is_(behind, w) & ~word[behind + len(w)] for w in ("extends", "super")], axis=0)
    return np.sort(np.concatenate([*found, asks[~bound]]))


def _called(heads: pa.Array, among: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Which heads name something right before their first parenthesis, without ``=`` or a dot ahead of it, and the names."""
    offset, text = np.frombuffer(heads.buffers()[1], np.int64)[heads.offset :][: len(heads) + 1], np.frombuffer(heads.buffers()[2] or b"", np.uint8)
    at = np.flatnonzero(among)
    begin, parens = offset[at], np.flatnonzero(text == LPAREN)
    paren = parens[np.searchsorted(parens, begin)]
    word, blank = PLAIN_WORD[text], BLANK[text]
    solid = np.flatnonzero(blank[1:] & ~blank[:-1])  # what stands ahead of blanks
    gap = blank[paren - 1] & (paren > begin)
    last = paren - 1
    last[gap] = np.append(solid, -1)[np.searchsorted(solid, last[gap]) - 1]
    some = (last >= begin) & word[last]
    at, begin, last = at[some], begin[some], last[some]
    starts = np.flatnonzero(word & ~np.append(False, word[:-1]))
    first = starts[np.searchsorted(starts, last, "right") - 1]
    assigned = np.flatnonzero(text == ord("="))
    clear = (np.searchsorted(assigned, begin) == np.searchsorted(assigned, first)) & ((first == begin) | (text[first - 1] != ord(".")))
    return at[clear], _spans(text, first[clear], last[clear] + 1)


def _judged(heads: pa.Array, opener: np.ndarray, calls: np.ndarray) -> tuple:
    """``kind, name, bare, public`` of pieces that open a brace or end a statement with parentheses."""

    def where(pattern: str, among: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(heads), bool), np.flatnonzero(among)
        if len(at):
            part = heads if len(at) == len(heads) else heads.take(pa.array(at))
            out[at] = pc.match_substring_regex(part, pattern).to_numpy(zero_copy_only=False)
        return out

    labelled = where(rf"^\w+{S}*:", opener)
    control = where("^" + BEGINS, opener & ~labelled) | where(rf"^\w+{S}*:{S}*" + BEGINS, labelled)
    maybe = np.flatnonzero(where("class|interface|enum", opener & ~calls))
    types = [TYPE.match(h) for h in heads.take(pa.array(maybe)).to_pylist()]
    typed, types = maybe[[m is not None for m in types]], [m.groups() for m in types if m]
    called, found = _called(heads, calls & ~control & ~where(STATEMENT, calls & ~control))
    kind, call = np.zeros(len(heads), np.int64), np.zeros(len(heads), bool)
    call[called] = True
    signature = where(rf"\)[^={{()]*\{{?$", call)
    bare = where(rf"^\w+{S}*[({{]", ~control)
    kind[opener] = np.where(bare & (signature | ~calls), ord(BARE), np.where(signature, ord(METHOD), ord(BLOCK)))[opener]
    leads = where("^,", opener)
    constant = where(rf"^,{S}*(?:@\w+{S}*)*\w+{S}*[({{]", leads) & ~where("=", leads)
    made = where("new", opener & calls)
    made = where(CREATION, made) & where(rf"\){S}*\{{$", made)
    kind[constant | made] = ord(BODY)
    kind[control] = ord(BLOCK)
    kind[typed] = [KINDS.get(word, ord(CLASS)) for word, _ in types]
    kind[~opener & signature & ~bare] = ord(METHOD)
    public = where(PUBLIC, calls & np.isin(kind, [ord(METHOD), ord(BARE)]))
    place = np.full(len(heads), -1)
    place[called] = np.arange(len(called))
    place[typed] = np.arange(len(typed)) + len(called)
    place[kind == 0] = -1
    name = pa.concat_arrays([found, pa.array([name for _, name in types], pa.large_string())]).take(pa.array(place, mask=place < 0))
    return kind, name, bare, public


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with blanks behind them, and where each text begins and the last ends; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    text = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]
    return np.append(text, np.full(16, 32, np.uint8)), offset - offset[0]


def _solid(blank: np.ndarray):
    """Of places in a text that ends in blanks, the first one from there on that is not blank; one behind the text if none is."""
    begins = np.append(np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, len(blank) - 9)
    return lambda p: np.where(blank[p], begins[np.searchsorted(begins, p)], p)


def code_lines(texts: pa.Array, of: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Lines of code from the line ``first`` to ``last`` of text ``of``, as ``functions.lines.code_lines`` counts them.

    A line opens a comment, closes one or leaves all as it is; so whether a line is in a comment is told by the last one
    before that opens or closes.  Ranges begin outside: up to the first such line nothing is in a comment.
    """
    text, offset = _bytes(texts)
    ends_of_line = np.flatnonzero(text == NEWLINE)
    before = np.searchsorted(ends_of_line, offset)
    line = before[:-1] + np.arange(len(texts))  # the first line of each text
    place = np.arange(len(ends_of_line)) + np.repeat(np.arange(len(texts)), np.diff(before))
    n = len(ends_of_line) + len(texts)
    start, end = np.empty(n, np.int64), np.empty(n, np.int64)
    start[line], start[place + 1], end[place], end[np.append(line[1:], n) - 1] = offset[:-1], ends_of_line + 1, ends_of_line, offset[1:]
    solid = _solid(text <= 32)
    pair = lambda p, a, b: (text[p] == ord(a)) & (text[p + 1] == ord(b)) & (p + 1 < end)
    begin = solid(start)
    empty = begin >= end
    closing = np.flatnonzero((text[:-1] == ord("*")) & (text[1:] == ord("/")))
    close = np.append(closing, len(text) - 12)[np.searchsorted(closing, begin)]
    closed = ~empty & (close + 1 < end)
    rest = solid(close + 2)
    after = closed & (rest < end) & ~pair(rest, "/", "/") & ~pair(rest, "/", "*")
    block = ~empty & pair(begin, "/", "*")
    outside = np.where(block, after, ~empty & ~pair(begin, "/", "/") & (text[begin] != ord("*")))
    opened = block & ~closed
    told = np.flatnonzero(opened | closed)
    latest = np.append(-1, told)[np.searchsorted(told, np.arange(n))]  # the last line before that opens or closes
    inside = (latest >= np.repeat(line, np.diff(np.append(line, n)))) & opened[latest]
    plain, all_ = (np.append(0, np.cumsum(c)) for c in (outside, np.where(inside, after, outside)))
    a = line[of] + first - 1
    b = np.maximum(a, np.minimum(line[of] + last, np.append(line[1:], n)[of]))
    k = np.minimum(np.append(told, n)[np.searchsorted(told, a)] + 1, b)
    return plain[k] - plain[a] + all_[b] - all_[k]


def cut(code: pa.Array, complexity: bool) -> tuple:
    """``start, file, name, step, kind, typed, public, lines, lead, branches``: the first piece of each file that has any, which file that is, and what is told of each piece."""
    text, offset = _bytes(code)
    at = np.flatnonzero(MARK[text])
    mark, file = text[at], np.repeat(np.arange(len(code)), np.diff(np.searchsorted(at, offset)))
    first, last = _closed(file, mark)
    depth = _within(len(at), first, last)
    # behind the last end of a file no piece holds its parentheses: pieces begin within them
    ending = np.full(len(code), -1)
    ending[file[depth == 0]] = np.flatnonzero(depth == 0)
    loose = (depth[first] == 1) & (first > ending[file[first]])
    skipped = np.zeros(len(at), bool)
    if loose.any():
        skipped[first[loose]] = True
        depth = _within(len(at), first[~loose], last[~loose])
    end = np.flatnonzero(depth == 0)
    begin_mark = np.searchsorted(at, offset)[:-1]
    where, mark, file, skip = at[end], mark[end], file[end], skipped[end]
    new = np.append(True, file[1:] != file[:-1])[: len(end)]
    before = np.where(new, begin_mark[file] - 1, np.append(-1, end[:-1])[: len(end)])
    start = np.where(new, offset[file], np.append(0, where[:-1] + 1)[: len(end)])
    next_word = _solid(BLANK[text])
    calls = end - before > 1
    plain = (mark == END) & ~calls
    behind = ~new & np.append(False, plain[:-1])[: len(end)]
    shut = np.flatnonzero(behind & (mark == RBRACE) & ~calls)
    joined = behind & plain
    joined[shut] = next_word(start[shut]) == where[shut]
    begins = np.flatnonzero(~joined)
    ends = np.append(begins[1:], len(end))[: len(begins)] - 1
    kept = ~skip[begins]
    begins, ends = begins[kept], ends[kept]
    start, where, mark, calls, file = start[begins], where[ends], mark[ends], calls[begins], file[begins]
    opener = mark == LBRACE
    told = np.flatnonzero(opener | ((mark == END) & calls))
    head = next_word(start[told])
    heads, calls, opens = _spans(text, head, where[told] + 1), calls[told], opener[told]
    if (text == AT).any():
        noted = pc.match_substring(heads, "@").to_numpy(zero_copy_only=False)
        bared = [ANNOTATED.sub("", h, count=1) for h in heads.filter(pa.array(noted)).to_pylist()]
        heads = pc.replace_with_mask(heads, pa.array(noted), pa.array(bared, pa.large_string()))
        calls = calls & (~noted | pc.match_substring(heads, "(").to_numpy(zero_copy_only=False))
    kind, names, bare, public = _judged(heads, opens, calls)
    n = len(start)
    all_kind, lead, all_bare, all_public = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    all_kind[told], all_bare[told], all_public[told] = kind, bare, public
    place = np.full(n, -1)
    place[told] = np.arange(len(told))
    ends_of_line = np.flatnonzero(text == NEWLINE)
    count = lambda places, a, b: np.searchsorted(places, b) - np.searchsorted(places, a)
    lead[told] = np.where(kind != 0, count(ends_of_line, start[told], head), 0)
    branches = count(_branches(text, WORD[text], next_word), start, where) if complexity else np.zeros(n, np.int64)
    held = np.flatnonzero(np.append(True, file[1:] != file[:-1])[:n])
    return held, file[held], names.take(pa.array(place, mask=place < 0)).cast(pa.string()), opener.astype(np.int64) - (mark == RBRACE), all_kind, ~all_bare, all_public, count(ends_of_line, start, where), lead, branches
