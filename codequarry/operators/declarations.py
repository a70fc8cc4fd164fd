"""Declarations in Java source text: mask, cut at braces, track scopes, name types.

A file's text is one row, so all that is told of it is told where it is read: Spark masks it, pieces are cut and judged
over batches of whole files, as is what runs along a file (depths, lines, what encloses what).  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import code_lines, physical_lines
from .cutting import ANNOTATION, BARE, BLOCK, BODY, CLASS, ENUM, LEAD, METHOD, chunks, cut
from .cutting import code_lines as lines_of_code

LITERAL = r'"(?:[^"\\\n]++|\\.)*+"|\'(?:[^\'\\\n]++|\\.)*+\''  # possessive here and below: long texts do not recurse
#: A literal, a line comment, or one line of a block comment; a further line of it begins where the one before ended.  All
#: others take the line ends after them along, so that none begins there.  What stays are quotes and line ends, as groups.
HIDDEN = r'(?=["\'/\n])(?:(?:(")(?:[^"\\\n]++|\\.)*+(")|(\')(?:[^\'\\\n]++|\\.)*+(\')|//[^\n]*+)(\n*+)|(?:/\*|(?!\A)\G(\n))(?:[^*\n]++|\*(?!/))*+(?:\*/(\n*+)|(?=\n)|\z))'
#: A text in which a comment begins that does not end.
OPEN_COMMENT = r'\A(?:[^"\'/]++|' + LITERAL + r'|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/|/(?!\*)|["\'])*+/\*'
BLANK = " \t\n\x0b\f\r"  # what \s is
NESTED = 8  # parentheses within parentheses that stay in one piece


def _balanced(depth: int) -> str:
    """Parentheses that hold no braces but those of an array of plain values."""
    inside = r"[^(){}]++|\{[^(){};]*+\}" + ("|" + _balanced(depth - 1) if depth else "")
    return rf"\((?:{inside})*+\)"


#: Statements without parentheses declare nothing: those that follow each other are one piece, with a brace that closes behind them.
PIECE = r"(?:[^{};()]*+;)++(?:\s*+\})?+|(?:[^{};()]++|" + _balanced(NESTED) + r")*+[{};()]"
TYPE = r"^[^(=]*?(@interface|\bclass|\binterface|\benum)\s++(\w++)[^(=]*+(?<=\{)$"
CALL = r"^[^=({};]*?(?<![\w.])(\w++)\s*+\("
SIGNATURE_END = r"\)[^={()]*+\{?+$"
CONTROL = r"^(?:\w++\s*+:\s*+)?+(?:(?:if|for|while|switch|catch|try|do|else|finally|case)\b|synchronized\s*+[({]|default\s*+:|static\s*+\{)"
STATEMENT = r"^(?:return|throw|new|assert|super|this|else)\b"
CREATION = r"\bnew\s++[\w.$<>?,\s\[\]&]*+\("
BRANCHES = r"(?=[ifwc])\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?!\s*(?:extends\b|super\b|[>,]))"
BRANCH_WORDS = ("if", "for", "while", "ca", "&&", "||", "?")  # no branch without one of them


def masked(text: Column) -> Column:
    """Text without comments and literals: literals become a pair of quotes, comments their line ends alone."""
    return F.regexp_replace(text, HIDDEN, "$1$2$3$4$5$6$7")


def _newlines(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))  # bytes: no code points are counted


def _code(files: DataFrame, carry: str | None) -> DataFrame:
    """``path, pkg, code`` and ``_carried``: masked texts with their packages."""
    kept = ["_carried"] if carry else []
    code = files.select("path", *([F.col(carry).alias("_carried")] if carry else []), masked(F.col("text")).alias("code"))
    return code.select("path", F.regexp_extract("code", r"(?:^|[;\s])package\s++([\w.]++)\s*+;", 1).alias("pkg"), "code", *kept)


def pieces(files: DataFrame, carry: str | None = None, complexity: bool = True) -> DataFrame:
    """``said, told, more``: the text between braces and statement ends, a row for each piece, as few columns as can be.

    A piece ends at a brace, at ``;`` outside parentheses, or at a parenthesis that holds a body.  A file's pieces are
    rows that follow each other; the first has ``_carried``, the column ``carry``.  said is the piece's name, in the first
    of a file ``name package path``; told packs lines and branches, more the leading lines, the kind (0: it declares
    nothing) and flags, as ``unpacked`` reads them.  Without ``complexity`` no branches are counted.  ``declarations``
    cuts the same pieces from bytes, several times as fast; these are for those who want pieces as rows, and say by
    regular expressions what a piece is.

    The outer explode keeps Spark from testing ahead of it whether a text has pieces, which would mask and cut each text
    once more for every such test; a text without pieces is left out behind it.
    """
    kept = ["_carried"] if carry else []
    code = _code(files, carry).select("path", "pkg", *kept, F.regexp_extract_all("code", F.lit(PIECE), F.lit(0)).alias("cut"))
    cut = code.select("path", "pkg", *kept, F.posexplode_outer("cut").alias("stmt", "text")).where("stmt is not null")
    opener, closer, calls = F.endswith("text", F.lit("{")), F.endswith("text", F.lit("}")), F.col("text").contains("(")
    told = opener | (F.endswith("text", F.lit(";")) & calls)  # nothing else declares anything
    trimmed = F.ltrim("text", F.lit(BLANK))
    cut = cut.withColumn("head", F.when(told & F.col("text").contains("@"), F.regexp_replace("text", LEAD, "")).when(told, trimmed))
    calls = F.col("head").contains("(")
    cut = cut.withColumn("control", opener & F.col("head").rlike(CONTROL))
    cut = cut.withColumns({"word": F.when(opener & (F.col("head").contains("class") | F.col("head").contains("interface") | F.col("head").contains("enum")), F.regexp_extract("head", TYPE, 1)).otherwise(""), "call": F.when(told & calls & ~F.col("control") & ~F.col("head").rlike(STATEMENT), F.regexp_extract("head", CALL, 1)).otherwise("")})
    cut = cut.withColumns({"signature": (F.col("call") != "") & F.col("head").rlike(SIGNATURE_END), "bare": told & ~F.col("control") & F.col("head").rlike(r"^\w++\s*+[({]")})
    signature, bare = F.col("signature"), F.col("bare")
    opens = (
        F.when(F.col("word").isin("class", "interface"), CLASS).when(F.col("word") == "enum", ENUM).when(F.col("word") == "@interface", ANNOTATION)
        .when(F.col("control"), BLOCK)
        .when(calls & F.col("head").rlike(CREATION) & F.col("head").rlike(r"\)\s*+\{$"), BODY)
        .when(F.startswith("head", F.lit(",")) & F.col("head").rlike(r"^,\s*+(?:@\w++\s*+)*+\w++\s*+[({]") & ~F.col("head").contains("="), BODY)
        .when(bare & (signature | ~calls), BARE).when(signature, METHOD).otherwise(BLOCK)
    )
    cut = cut.withColumn("kind", F.when(opener, opens).when(F.endswith("text", F.lit(";")) & signature & ~bare, METHOD))
    kind, first = F.col("kind"), F.col("stmt") == 0
    name = F.when(F.col("word") != "", F.regexp_extract("head", TYPE, 2)).when(F.col("call") != "", F.col("call"))
    public = kind.isin(METHOD, BARE) & F.col("head").contains("public") & F.regexp_extract("head", r"^([^(]*+)\(", 1).rlike(r"\bpublic\b")
    lead = F.when(kind.isNotNull(), _newlines(F.col("text")) - _newlines(trimmed)).otherwise(0)
    may_branch = reduce(or_, (F.col("text").contains(w) for w in BRANCH_WORDS))
    branches = F.when(may_branch, F.size(F.regexp_extract_all("text", F.lit(BRANCHES), F.lit(0)))).otherwise(0) if complexity else F.lit(0)
    name, flag = F.when(kind.isNotNull(), name), lambda c, at: F.when(c, 1 << at).otherwise(0)
    begins = F.concat(F.coalesce(name, F.lit("")), F.lit(" "), "pkg", F.coalesce(F.concat(F.lit(" "), "path"), F.lit("")))
    packed = F.shiftleft(_newlines(F.col("text")).cast("long"), 32) + branches
    more = F.shiftleft(lead.cast("long"), 16) + F.shiftleft(F.coalesce(F.ascii(kind), F.lit(0)), 5) + flag(opener, 4) + flag(closer, 3) + flag(~bare, 2) + flag(F.coalesce(public, F.lit(False)), 1) + flag(first, 0)
    return cut.select(F.when(first, begins).otherwise(name).alias("said"), packed.alias("told"), more.cast("long").alias("more"), *[F.when(first, F.col(c)).alias(c) for c in kept])


def unpacked(t: pa.Table) -> tuple:
    """``start, paths, pkgs`` of the files among the pieces, and ``name, step, kind, typed, public, lines, lead, branches`` of each piece."""
    told, more = (t[c].combine_chunks().to_numpy() for c in ("told", "more"))
    start, said = np.flatnonzero(more & 1), t["said"].combine_chunks()
    begins = pc.split_pattern(said.take(pa.array(start)), " ", max_splits=2)
    offset, parts = begins.offsets.to_numpy(), begins.flatten()  # two parts where the path is null
    part = lambda k: parts.take(pa.array(offset[:-1] - offset[0] + k, mask=np.diff(offset) <= k))
    names = pc.if_else(pc.equal(part(0), ""), None, part(0))
    begin = pa.array(more & 1 == 1)
    name = pc.replace_with_mask(said, begin, names)
    bit = lambda at: (more >> at) & 1
    return start, part(2), part(1), name, bit(4) - bit(3), (more >> 5) & 0x7FF, bit(2) == 1, bit(1) == 1, told >> 32, more >> 16, told & 0xFFFFFFFF


def _latest(file: np.ndarray, level: np.ndarray, opener: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each row the last opener before it in its file whose inside is of the row's level, as an index; -1: none."""
    own, n = np.flatnonzero(opener), len(file)
    at, role = np.concatenate([np.arange(n), own]), np.concatenate([np.zeros(n, bool), np.ones(len(own), bool)])
    key = np.concatenate([level, after[own]]) + file[at] * (2 * np.int64(max(abs(level).max(), abs(after).max())) + 3)
    order = np.lexsort((at, key))
    last = np.maximum.accumulate(np.where(role[order], np.arange(len(order)), -1))
    up = np.where((last >= 0) & (key[order][last] == key[order]), at[order][last], -1)
    found = np.full(n, -1)
    found[at[order][~role[order]]] = up[~role[order]]
    return np.where(level > 0, found, -1)


def _following(*keys: np.ndarray) -> np.ndarray:
    """For each row the next one of the same keys, as an index; -1: none."""
    order = np.lexsort((np.arange(len(keys[0])), *keys))
    same = np.all([k[order][1:] == k[order][:-1] for k in keys], axis=0)
    found = np.full(len(order), -1)
    found[order[:-1]] = np.where(same, order[1:], -1)
    return found


FOUND = "path string, pkg string, stmt int, kind string, name string, outer string, is_public boolean, before long, first_line int, last_line int, npm long, methods long, cc long, own_wmc long, own_max long, own_n long"


def declared(start, paths, pkgs, name, step, kind, typed, public, lines, lead, branches) -> tuple[pa.RecordBatch, np.ndarray]:
    """The declarations among the pieces of whole files, and which of the files each is of.  Takes what ``unpacked`` gives."""
    begin = np.zeros(len(step), bool)
    begin[start] = True
    file = np.cumsum(begin) - 1
    stmt = np.arange(len(step)) - start[file]

    def run(c: np.ndarray) -> np.ndarray:  # running sums over each file
        s = np.cumsum(c, dtype=np.int64)
        return s - (s[start] - c[start])[file]

    code = {k: ord(k) for k in (CLASS, ENUM, ANNOTATION, BODY, METHOD, BLOCK, BARE)}
    among = lambda c, *kinds: np.isin(c, [code[k] for k in kinds])
    first = np.append(False, kind[:-1] == code[ENUM]) & (stmt > 0) & among(kind, BARE, BLOCK)  # an enum's first constant has a body
    kind = np.where(first, code[BODY], np.where(kind == code[BARE], code[METHOD], kind))
    after, line, c_branches = run(step), run(lines) + 1, run(branches)
    before, rows = after - step, np.flatnonzero((step != 0) | (kind != 0))
    stmt, step, kind, typed, public, lines, lead, file, after, before, line, c_branches = (c[rows] for c in (stmt, step, kind, typed, public, lines, lead, file, after, before, line, c_branches))
    name, start = name.take(pa.array(rows)), np.searchsorted(file, np.arange(len(start)))
    if not len(rows):
        return pa.RecordBatch.from_pylist([], SCHEMA), rows
    file_of, held = file, np.unique(file)  # files of which any piece is left
    start, file = start[held], np.searchsorted(held, file)
    opener, closer = step == 1, step == -1
    up = _latest(file, before, opener, after)
    of = np.where(up >= 0, kind[up], 0)
    upper = name.take(pa.array(up, mask=up < 0))
    named, its = among(kind, CLASS, ENUM, ANNOTATION), pc.fill_null(pc.equal(name, upper), False).to_numpy(zero_copy_only=False)
    method = (kind == code[METHOD]) & among(of, CLASS, ENUM, BODY) & (typed | its)
    mine, other = opener & (kind == code[METHOD]), opener & (kind != code[CLASS])
    in_method = run(mine.astype(np.int64) - (closer & (of == code[METHOD])))
    in_other = run(other.astype(np.int64) - (closer & (of != 0) & (of != code[CLASS])))
    counted = method & (in_method - mine == 0)
    listed = named & ((before == 0) | ((kind == code[CLASS]) & (in_other - other == 0)))
    c_public, c_methods = run((counted & public).astype(np.int64)), run(counted.astype(np.int64))
    kept = np.flatnonzero(counted | (opener & named) | (closer & among(of, CLASS, ENUM, ANNOTATION, METHOD)))
    # of what is left, an opener's closer is the next row of its level
    end = np.full(len(rows), -1)
    brace = kept[(opener | closer)[kept]]
    after_it = _following(np.where(closer, after, before)[brace], file[brace])
    end[brace] = np.where(after_it >= 0, brace[after_it], -1)
    ended = opener & (end >= 0)
    close = lambda c: np.where(ended, c[end] - c, 0)
    cc = np.where(counted, 1 + close(c_branches), 0)
    direct, size = np.flatnonzero(counted & (up >= 0)), len(rows)
    own_wmc, own_n, own_max = np.zeros(size, np.int64), np.bincount(up[direct], minlength=size), np.zeros(size, np.int64)
    np.add.at(own_wmc, up[direct], cc[direct])
    np.maximum.at(own_max, up[direct], cc[direct])
    out = kept[~closer[kept]]
    m, files = counted[out], pa.array(file_of[out])
    of_type = lambda c: pa.array(c[out], pa.int64(), mask=m)
    within = up[out]
    values = [
        paths.take(files), pc.if_else(pa.array(~m & named[out]), pkgs.take(files), None), pa.array(stmt[out], pa.int32()), pa.array(np.where(m, "method", np.where(listed[out], "type", "hidden")).astype(object), pa.string()), name.take(pa.array(out)),
        name.take(pa.array(within, mask=~among(of[out], CLASS, ENUM, ANNOTATION))), pa.array(public[out], pa.bool_(), mask=~m), pa.array(before[out], pa.int64()), pa.array((line - lines + lead)[out], pa.int32()),
        pa.array(np.where(ended, line[end], line)[out], pa.int32()), of_type(close(c_public)), of_type(close(c_methods)), pa.array(cc[out], pa.int64(), mask=~m), of_type(own_wmc), of_type(own_max), of_type(own_n),
    ]
    return pa.RecordBatch.from_arrays([v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in values], schema=SCHEMA), file_of[out]


SCHEMA = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for c, t in (f.split() for f in FOUND.split(", "))])


def _found(batches: Iterator[pa.RecordBatch], complexity: bool) -> Iterator[tuple]:
    """Files with pieces, their declarations, and which of the files each declaration is of."""
    for batch in batches:
        for part in chunks(batch):
            start, files, *told = cut(part["code"], complexity)
            if len(start):
                held = part.drop_columns(["code"]).take(pa.array(files))
                yield held, *declared(start, held["path"], held["pkg"], *told)


def _rows(complexity: bool):
    return lambda batches: (found for _, found, _ in _found(batches, complexity))


def _by_file(complexity: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a file carries once, with the list of its declarations."""
        for files, found, file in _found(batches, complexity):
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(file, np.arange(len(files) + 1)), pa.int32()), found.to_struct_array())
            yield pa.RecordBatch.from_arrays([files["_carried"], lists], names=["carried", "found"])

    return run


def _with_loc(complexity: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The declarations with the code lines of what each holds; files carry their texts."""
        for files, found, file in _found(batches, complexity):
            loc = lines_of_code(files["_carried"], file, found["first_line"].to_numpy(), found["last_line"].to_numpy())
            yield found.append_column("loc", pa.array(loc, pa.int64()))

    return run


COMPLEXITY = ("cc", "own_wmc", "own_max")


def declarations(files: DataFrame, carry: str | None = None, complexity: bool = True) -> DataFrame:
    """Types and methods: ``path, pkg, stmt, kind, name, outer, is_public, before, first_line, last_line, npm, methods, cc, own_wmc, own_max, own_n``.

    kind is ``type``, ``hidden`` (a type that makes no row: nested enums and annotations, types in them, in anonymous
    classes and in bodies) or ``method``.  outer is the enclosing type's name.  Methods are those of classes, interfaces,
    enums, their constants and anonymous classes in field initialisers and initialiser blocks; what stands inside the
    body of a method, and members of annotations, are none.  npm and methods of a type count all methods between its
    braces.  cc counts a method's branches, those of local classes too; own_* aggregate it over a type's direct methods.
    npm, methods and own_* are null for methods, is_public and cc for types.  ``carry`` names a text column of the files
    that comes along.  Without ``complexity`` branches are not counted, and cc, own_wmc and own_max are left out.
    """
    unknown = () if complexity else COMPLEXITY
    if carry is None:
        return _code(files, None).mapInArrow(_rows(complexity), FOUND).drop(*unknown)
    found = ", ".join(f.replace(" ", ": ", 1) for f in FOUND.split(", "))
    by_file = _code(files, carry).mapInArrow(_by_file(complexity), f"carried string, found array<struct<{found}>>")
    return by_file.select(F.col("carried").alias(carry), F.inline("found")).drop(*unknown)


def types(files: DataFrame, carry: str | None = None, complexity: bool = True) -> DataFrame:
    """A row for each top-level type, and each class or interface directly within classes: ``path, name, outer`` and counts.

    A nested type is named by its immediate outer type: ``pkg.Outer$Inner``.
    """
    return _named(declarations(files, carry, complexity))


def _named(found: DataFrame) -> DataFrame:
    t = found.where("kind = 'type'")
    local = F.when(F.col("outer").isNotNull(), F.concat("outer", F.lit("$"), "name")).otherwise(F.col("name"))
    return t.withColumn("simple", F.col("name")).withColumn("name", F.when(F.col("pkg") != "", F.concat("pkg", F.lit("."), local)).otherwise(local))


def counts_by_file(found: DataFrame) -> DataFrame:
    """``path, npm, methods`` of a file's top-level types, which hold all that is nested in them; files without types are absent."""
    return found.where("before = 0").groupBy("path").agg(F.sum("npm").alias("npm"), F.sum("methods").alias("methods"))


def loc_by_type(files: DataFrame, found: DataFrame | None = None, complexity: bool = True) -> DataFrame:
    """Types with ``loc``: code lines from the declaration to its closing brace, nested types included."""
    if found is None:
        rows = _named(_code(files, "text").mapInArrow(_with_loc(complexity), f"{FOUND}, loc long").drop(*(() if complexity else COMPLEXITY)))
        return rows.select(*[c for c in rows.columns if c != "loc"], "loc")
    rows = found.join(files.select("path", "text"), "path")
    lines = F.slice(physical_lines(F.col("text")), F.col("first_line"), F.greatest(F.lit(0), F.col("last_line") - F.col("first_line") + 1))
    return rows.withColumn("loc", code_lines(lines).cast("long")).drop("text")


def loc_by_file(files: DataFrame) -> DataFrame:
    """``path, loc``: code lines of the whole file; 0 where it declares no type."""
    has = masked(F.col("text")).rlike(r"(?:@interface|\bclass|\binterface|\benum)\s++\w++[^(=;{}]*+\{")
    return files.select("path", F.when(has, code_lines(physical_lines(F.col("text")))).otherwise(0).cast("long").alias("loc"))


def problems(files: DataFrame) -> DataFrame:
    """``path, problem`` of every file: ``unterminated comment``, ``unbalanced braces`` or null."""
    told = files.select("path", F.col("text").rlike(OPEN_COMMENT).alias("open"), masked(F.col("text")).alias("code"))
    count = lambda c: F.octet_length("code") - F.octet_length(F.replace("code", F.lit(c), F.lit("")))
    return told.select("path", F.when(F.col("open"), "unterminated comment").when(count("{") != count("}"), "unbalanced braces").alias("problem"))


def diagnostics(files: DataFrame) -> DataFrame:
    """``path, problem`` of files that do not parse; others are absent."""
    # a filter on an exploded column is not pushed ahead of it, where it would mask each text again
    return problems(files).select("path", F.explode_outer(F.array("problem")).alias("problem")).where("problem is not null")


def dependency_edges(files: DataFrame) -> DataFrame:
    """``path, src, dst, relation`` from imports, extends and implements of the source text."""
    all_of = lambda pattern, group: F.regexp_extract_all("code", F.lit(pattern), F.lit(group))
    code = files.select("path", masked(F.col("text")).alias("code"))
    code = code.select("path", all_of(r"\bimport\s+(?:static\s+)?([\w.*]+)\s*;", 1).alias("imports"), all_of(r"\b(?:class|interface)\s+\w+[^{;]*\{", 0).alias("heads"))
    named = lambda names, relation: F.transform(names, lambda n: F.struct(F.lit(relation).alias("relation"), n.alias("dst")))
    bases = lambda word: F.flatten(F.transform("heads", lambda h: F.split(F.regexp_extract(h, rf"\b{word}\s+([\w.,\s]+?)\s*(?:\bimplements\b|\{{)", 1), r"\s*,\s*")))
    found = code.select("path", F.explode(F.concat(named(F.col("imports"), "import"), named(bases("extends"), "extends"), named(bases("implements"), "implements"))).alias("e"))
    return found.select("path", "e.relation", "e.dst").where("relation = 'import' or dst <> ''").distinct()
