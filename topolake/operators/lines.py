"""Files as lines, with comments and docstrings marked.

All order-dependent state is a window over one file's lines; files are bounded by the size guard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from topolake.functions.strings import trimmed

COMMENT = "^(//|#|/\\*|\\*|r#\"|r\")"
COMMENT_ONLY = "^(//|#|/\\*|\\*)"


#: A string in double or single quotes on one line, or in backticks, and what to blank: comments of C's kind and scripts', and texts in triple quotes.
DOUBLE, SINGLE, TICKS = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'", r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
_BLOCK, _LINE, _HASH, _TRIPLE = r"/\*[\s\S]*?\*/", r"//[^\n]*+", r"#[^\n]*+", r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\''
_CODE = {
    r"\.py$": f"{_TRIPLE}|({DOUBLE}|{SINGLE})|{_HASH}",
    r"\.rb$": f"({DOUBLE}|{SINGLE})|{_HASH}",
    r"\.rs$": rf"({DOUBLE}|'(?:\\.|[^'\\\n])')|{_BLOCK}|{_LINE}",
    r"\.(ts|tsx|js|jsx|go|java|cs)$": f"({DOUBLE}|{SINGLE}|{TICKS})|{_BLOCK}|{_LINE}",
}


def without_comments(content: Column, path: Column) -> Column:
    """A source text without its comments and, in Python, texts in triple quotes; strings stay as they are.  Other files stay whole."""
    out = content
    for names, pattern in _CODE.items():
        out = F.when(path.rlike(names), F.regexp_replace(content, pattern, "$1")).otherwise(out)
    return out


def split_lines(content: Column) -> Column:
    """Lines without their ends; a final line end opens no line, and an empty text has none."""
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(content, r"\r?\n\z", ""), "\r?\n"))


def lines_of(files: DataFrame, content: str = "content") -> DataFrame:
    """files without content, once per line, with line_no from 1 and line."""
    keep = [c for c in files.columns if c != content]
    each = files.select(*keep, F.posexplode_outer(split_lines(F.col(content))).alias("line_no", "line"))  # outer: else texts are split once more to see that there are lines
    return each.filter("line is not null").withColumn("line_no", F.col("line_no") + 1)


def is_comment(line: Column) -> Column:
    """Comment starts, raw strings and lines that are one string literal."""
    bare = trimmed(line)
    return bare.rlike(COMMENT) | (bare.startswith('"') & bare.endswith('"'))


def is_comment_only(line: Column) -> Column:
    return trimmed(line).rlike(COMMENT_ONLY)


def _count(line: Column, mark: str) -> Column:
    return ((F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def with_docstrings(lines: DataFrame, file: str, order: str = "line_no") -> DataFrame:
    """lines with ``in_doc``: marker lines and those between them.

    The marker is three double quotes where a line has them, else three single ones.  A line with one
    toggles the state, an odd number from three on ends it, an even number leaves it; so the
    state is the parity of toggles since the last such end.
    """
    n = F.when(F.col("line").contains('"""'), _count(F.col("line"), '"""')).otherwise(_count(F.col("line"), "'''"))
    seen = Window.partitionBy(file).orderBy(order)
    marked = lines.withColumn("_n", n).withColumn("_toggles", F.sum((F.col("_n") == 1).cast("int")).over(seen))
    at_end = F.when((F.col("_n") >= 3) & (F.col("_n") % 2 == 1), F.col("_toggles"))
    state = (F.col("_toggles") - F.coalesce(F.last(at_end, True).over(seen), F.lit(0))) % 2
    return marked.withColumn("in_doc", (state == 1) | (F.col("_n") > 0)).drop("_n", "_toggles")


def with_docstring_parity(lines: DataFrame, file: str, order: str = "line_no") -> DataFrame:
    """lines with ``in_doc`` by the parity of three double quotes so far."""
    n = _count(F.col("line"), '"""')
    so_far = F.sum(n).over(Window.partitionBy(file).orderBy(order))
    return lines.withColumn("in_doc", (so_far % 2 == 1) | (n > 0))
