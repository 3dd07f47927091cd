"""Calls, decorators and attributes in source texts, over any number of lines.

A text becomes tokens, and a running sum over brackets gives each its level.  What stands between a bracket and its end
is one level deeper, so the latest opening bracket of a level is the one around the tokens that follow on that level.  A file is read where its row
lies, in time linear in its tokens: tokens are neither rows nor shuffled.
Comments must be blanked before; brackets within strings don't count.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from topolake.operators.lines import DOUBLE, SINGLE, TICKS

#: A dotted name, which may go on over lines, with the mark of a decorator before it or a dot where it goes on from a bracket.
NAME = r"[@.]?[A-Za-z_$][A-Za-z0-9_$]*+(?:\s*+\.\s*+[A-Za-z_$][A-Za-z0-9_$]*+)*+"
STRING = rf"(?:\b[rRbBfFuU]{{1,2}}|[@$]{{1,2}})?(?:{DOUBLE}|{SINGLE}|{TICKS})"
TOKEN = rf"{STRING}|{NAME}|[0-9][A-Za-z0-9_.]*+|\S"
#: In Rust a single quote may begin a lifetime.
RUST_TOKEN = rf"b?r?{DOUBLE}|{NAME}|[0-9][A-Za-z0-9_.]*+|\S"
BLANKS = re.compile(r"\s+", re.ASCII)
#: A token is a name by its first character, if it doesn't end as a string; what a bracket adds to the level.
FIRST, QUOTES = frozenset("@._$ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), frozenset("\"'`")
BRACKETS = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}
#: A dot stands for fewer characters in Java's patterns than in Python's.
PLAIN = lambda pattern: pattern.replace(r"\\.", r"\\[^\n\r\x85\u2028\u2029]")
OWN = "pos int, level long, callee string, inside string, declared string, declared_out string, args array<string>"
IS_STRING = r"^[A-Za-z@$]{0,2}[\"'`].*[\"'`]$"


def unquoted(token: Column) -> Column:
    """Content of a string token; null for others."""
    return F.when(token.rlike(f"(?s){IS_STRING}") & ~token.contains("\u0002"), F.regexp_replace(token, r"(?s)^[A-Za-z@$]*[\"'`]|.$", ""))


class Call:
    """A call, decorator or attribute of one text; parent is the bracket around it as (call, inside, pos)."""

    def __init__(self, pos: int, level: int, callee: str, parent: tuple | None):
        self.pos, self.level, self.callee, self.parent, self.args = pos, level, callee, parent, []


def calls_of(text: str, token: re.Pattern, callee: Callable[[str], object]) -> list[tuple[Call, str | None, str | None, list[str]]]:
    """(call, declared, declared_out, args) of one text in order, in two passes over its tokens."""
    marks, found, around, depth, before, second, callable_ = [], {}, {}, 0, None, None, False
    for pos, t in enumerate(token.findall(text)):
        named = t[0] in FIRST and t[-1] not in QUOTES
        if named and "." in t:  # only there it may hold blanks
            t = BLANKS.sub("", t)  # noqa: PLW2901
        turn = BRACKETS.get(t, 0)
        if turn < 0:
            depth -= 1
        name = before if callable_ and t == "(" else t if t == "class" else None
        parent, call = around.get(depth), None
        if parent and parent[0]:
            parent[0].args.append((pos, t))
        if name and callee(name):
            call = found[pos] = Call(pos, depth, name, parent)
        if turn > 0 or call:
            marks.append((pos, depth, name if turn > 0 else None))
        if turn > 0:
            around[depth + 1] = (call, t if before is None else f"{before} {t}" if second is None else f"{second} {before} {t}", pos)
            depth += 1
        second, before, callable_ = before, t, named
    if not found:
        return []
    declared, later = {}, {}
    for pos, level, name in reversed(marks):
        declared[pos] = later.get(level)
        if name and not name.startswith("@"):
            later[level] = name
    inner = {c.pos: "".join(t for _, t in c.args) for c in found.values()}
    return [(c, declared[c.pos], c.parent and declared[c.parent[2]], [t + inner.get(pos, "") for pos, t in c.args]) for c in found.values()]


def calls(files: DataFrame, callee: str, keep: list[str], more: tuple[str, Callable] | None = None, kinds: tuple[str, list[str]] | None = None) -> DataFrame:
    """Calls in files (rel_path, content and keep) whose name matches the pattern ``callee``; the word ``class`` counts as a call without arguments.

    keep, rel_path, pos, level, callee, ``inside`` (the bracket around it behind the two tokens before that, apart by blanks), ``args`` (the tokens between its
    brackets; of what lies within further ones only that of wanted calls, behind their bracket), ``declared`` and ``declared_out`` (the name of the next call on its level, or on that of the
    bracket around it, that isn't a decorator: what a decorator or an attribute stands before).  Unbalanced texts give what their brackets allow.
    more: a schema of further columns and a function that gives their values for each of a text's calls, or None for a call to leave out.
    kinds: a column of ``keep`` with a number for each file, and by that number a pattern of the names that count there; other calls only stand among the arguments of these.
    """
    kept = ["rel_path", *[c for c in keep if c != "rel_path"]]
    own = files.select(*kept, F.col("content").alias("_content"), F.col("rel_path").endswith(".rs").alias("_rust")).filter("_content is not null")
    added = T._parse_datatype_string(f"{OWN}, {more[0]}" if more else OWN)
    schema = T.StructType([*own.select(*kept).schema.fields, *added.fields])
    finish = more[1] if more else None

    def run(batches):
        other, rust, name = re.compile(PLAIN(TOKEN), re.ASCII), re.compile(PLAIN(RUST_TOKEN), re.ASCII), re.compile(callee, re.ASCII)
        known = lru_cache(100_000)(lambda n: bool(name.search(n)))
        types = to_arrow_schema(added)
        counts = [lru_cache(100_000)(re.compile(p, re.ASCII).search) for p in kinds[1]] if kinds else [lambda _: True]
        for batch in batches:
            at, rows = [], []
            numbers = batch.column(kinds[0]).to_pylist() if kinds else [0] * batch.num_rows
            for i, (text, is_rust, number) in enumerate(zip(batch.column("_content").to_pylist(), batch.column("_rust").to_pylist(), numbers, strict=True)):
                found = calls_of(text, rust if is_rust else other, known)
                values = finish(found) if finish and found else [()] * len(found)
                for (c, declared, out, args), v in zip(found, values, strict=True):
                    if v is not None and counts[number](c.callee):
                        at.append(i)
                        rows.append((c.pos, c.level, c.callee, c.parent and c.parent[1], declared, out, args, *v))
            columns = [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(types)]
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in kept]
            yield pa.RecordBatch.from_arrays([*keys, *columns], names=schema.names)

    return own.mapInArrow(run, schema)


def parted(args: Column) -> Column:
    """Arguments, the tokens of each apart by the character U+0002."""
    return F.split(F.array_join(F.transform(args, lambda t: F.when(t == ",", "\u0001").otherwise(t)), "\u0002"), "\u0002?\u0001\u0002?")


def arguments(args: Column) -> Column:
    """Texts of the arguments; of brackets within them only the ends are left."""
    return F.filter(F.transform(parted(args), lambda a: F.replace(a, F.lit("\u0002"), F.lit(""))), lambda a: a != "")


def strings(args: Column, names: str = "") -> Column:
    """Contents of the arguments that are one string, or one behind a name of the pattern ``names`` and an equals sign, in order."""
    bare = (lambda a: F.regexp_replace(a, f"^(?:{names})\u0002=\u0002", "")) if names else (lambda a: a)
    return F.filter(F.transform(parted(args), lambda a: unquoted(bare(a))), lambda s: s.isNotNull())


def string_arguments(args: list[str], names: tuple[str, ...] = ()) -> list[str]:
    """strings of one call, outside of columns."""
    out, own = [], []
    for t in [*args, ","]:
        if t != ",":
            own.append(t)
            continue
        if len(own) == 3 and own[0] in names and own[1] == "=":
            own = own[2:]
        if len(own) == 1 and re.match(rf"(?s){IS_STRING}", own[0]):
            out.append(re.sub(r"(?s)^[A-Za-z@$]*[\"'`]|.\Z", "", own[0]))
        own = []
    return out
