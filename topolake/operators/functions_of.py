"""Functions in source files as (name, body) rows."""

from __future__ import annotations

import re
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: What opens a function, by language; the name is group 1.
HEADS = {
    "typescript": r"function\s+([A-Za-z0-9_$]+)\s*\(|(?:const|let|var)\s+([A-Za-z0-9_$]+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>|^\s+(?:async\s+)?([A-Za-z0-9_$]+)\s*\([^)]*\)\s*(?::[^{]+)?\{",
    "go": r"func\s+(?:\([^)]*\)\s*)?([A-Za-z0-9_]+)\s*\(",
    "rust": r"fn\s+([A-Za-z0-9_]+)",
    "java": r"(?:pub |private |protected |static )[^=;(]*?([A-Za-z0-9_]+)\s*\(",
    "csharp": r"(?:public |private |protected |static )[^=;(]*?([A-Za-z0-9_]+)\s*\(",
    "ruby": r"def\s+([A-Za-z0-9_?!]+)",
}
NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function"}


def _indented(lines: list[str]) -> list[tuple[str, str]]:
    """Bodies by indentation, in one pass: a line that isn't blank closes the open functions that are indented as far as it or farther."""
    found, open_ = [], []
    for i, line in enumerate([*lines, ""]):
        if i < len(lines) and not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and (indent <= open_[-1][0] or i == len(lines)):
            _, name, start = open_.pop()
            found.append((start, name, i))
        head = re.match(r"(\s*)(?:async\s+)?def\s+([A-Za-z0-9_]+)", line)
        if head:
            open_.append((indent, head[2], i))
    return [(name, "\n".join(lines[start:end])) for start, name, end in sorted(found)]


def _braced(lines: list[str], head: str) -> list[tuple[str, str]]:
    """Bodies by counting braces, in one pass; one that never closes is none.

    A function is over at the first line from its head on that has seen a brace since and after which no more are open than before the head.
    """
    found, open_, waiting, depth = [], [], [], 0  # waiting: heads that no brace has followed yet
    for i, line in enumerate(lines):
        at = re.search(head, line)
        name = at and next(g for g in at.groups() if g)
        if at and name not in NOT_NAMES:
            waiting.append((-depth, i, name))
        depth += line.count("{") - line.count("}")
        if "{" in line:
            for f in waiting:
                heappush(open_, f)
            waiting = []
        while open_ and depth <= -open_[0][0]:  # the deepest first
            _, start, name = heappop(open_)
            found.append((start, name, i + 1))
    return [(name, "\n".join(lines[start:end])) for start, name, end in sorted(found)]


FUNCTION = T.StructType([T.StructField("name", T.StringType()), T.StructField("body", T.StringType())])
CUT = T.StructType([T.StructField("functions", T.ArrayType(FUNCTION)), T.StructField("error", T.StringType())])


def _cut(language: str, text: str | None) -> tuple[list[tuple[str, str]], str | None]:
    if text is None:
        return [], "no text"
    try:
        return (_indented(text.splitlines()) if language == "python" else _braced(text.splitlines(), HEADS[language]) if language in HEADS else []), None
    except Exception as error:  # whatever a text brings up is that file's fault, not the job's
        return [], f"{type(error).__name__}: {error}"[:200]


@F.pandas_udf(CUT)
def bodies(language: pd.Series, content: pd.Series) -> pd.DataFrame:
    found = [_cut(lang, text) for lang, text in zip(language, content, strict=True)]
    return pd.DataFrame({"functions": [[{"name": n, "body": b} for n, b in own] for own, _ in found], "error": [error for _, error in found]})


def cut_files(files: DataFrame) -> DataFrame:
    """(language, rel_path, file_ord, cut) of files (language, rel_path, file_ord, content): functions of each, or the error that its text brought up; one pass for both."""
    return files.filter(F.col("language").isNotNull()).select("language", "rel_path", "file_ord", bodies("language", "content").alias("cut"))


def functions_in(found: DataFrame) -> DataFrame:
    """(language, rel_path, file_ord, name, body)."""
    return found.select("language", "rel_path", "file_ord", F.explode("cut.functions").alias("f")).select("language", "rel_path", "file_ord", "f.name", "f.body")


def faults_in(found: DataFrame) -> DataFrame:
    return found.filter("cut.error is not null").select("rel_path", F.lit("functions").alias("extractor"), F.col("cut.error").alias("error"))


def functions(files: DataFrame) -> DataFrame:
    """(language, rel_path, file_ord, name, body) of files (language, rel_path, file_ord, content); files that can't be read have none."""
    return functions_in(cut_files(files))
