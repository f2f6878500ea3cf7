"""Output of git commands as tables. Each input row is one command's whole output in ``text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import since  # noqa: F401  (part of this source's interface)


def _lines(df: DataFrame, text: str) -> DataFrame:
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))


def commit_log(df: DataFrame, text: str = "text") -> DataFrame:
    """Records split by U+001E, fields by U+001F: hash, short hash, epoch seconds, author, mail, message."""
    record = F.split(F.col("record"), "\x1f")
    field = lambda i: F.trim(F.get(record, F.lit(i)))
    others = [c for c in df.columns if c != text]
    rows = df.select(*others, F.posexplode(F.split(text, "\x1e")).alias("ord", "record")).filter(F.col("record").rlike(r"\S"))
    return rows.select(
        *others, "ord", F.regexp_replace(field(0), r"^\s+", "").alias("hash"), field(1).alias("short_hash"), F.timestamp_seconds(field(2).try_cast("long")).alias("ts"),
        field(3).alias("author_name"), field(4).alias("author_email"), field(5).alias("message"),
    )


def _unquoted(path: Column) -> Column:
    return F.regexp_replace(path, '^"|"$', "")


def status(df: DataFrame, text: str = "text") -> DataFrame:
    """Porcelain status: (path, kind). A rename removes the old path and adds the new one."""
    lines = _lines(df, text).filter(F.length("line") >= 4)
    code, rest = F.substring("line", 1, 2), F.substring("line", 4, 1 << 30)
    names = F.split(rest, " -> ")
    change = lambda path, kind: F.struct(_unquoted(path).alias("path"), F.lit(kind).alias("kind"))
    renamed = code.contains("R") & (F.size(names) == 2)
    changes = (
        F.when(code == "??", F.array(change(rest, "added")))
        .when(renamed, F.array(change(F.get(names, F.lit(0)), "removed"), change(F.get(names, F.lit(1)), "added")))
        .when(code.contains("D"), F.array(change(rest, "removed")))
        .when(code.contains("A"), F.array(change(rest, "added")))
        .when(code.rlike("[MTU]"), F.array(change(rest, "modified")))
    )
    others = [c for c in df.columns if c != text]
    return lines.select(*others, "line_no", F.explode(changes).alias("c")).select(*others, "line_no", "c.*")


def name_status(df: DataFrame, text: str = "text") -> DataFrame:
    """``--name-status``: a copy only adds its target; a rename also removes its origin."""
    parts = F.split("line", "\t")
    code, first, last = F.substring(F.get(parts, F.lit(0)), 1, 1), F.get(parts, F.lit(1)), F.element_at(parts, -1)
    change = lambda path, kind: F.struct(path.alias("path"), F.lit(kind).alias("kind"))
    changes = (
        F.when(code == "R", F.array(change(first, "removed"), change(last, "added")))
        .when(code == "C", F.array(change(last, "added")))
        .when(code == "D", F.array(change(first, "removed")))
        .when(code == "A", F.array(change(first, "added")))
        .otherwise(F.array(change(first, "modified")))
    )
    others = [c for c in df.columns if c != text]
    return _lines(df, text).filter(F.size(parts) >= 2).select(*others, "line_no", F.explode(changes).alias("c")).select(*others, "line_no", "c.*")


def new_path(path: Column) -> Column:
    """``a/{b => c}/d`` and ``a => b`` as the new path."""
    braced = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(braced, r"^.* => ", ""), "//+", "/")


def numstat(df: DataFrame, text: str = "text") -> DataFrame:
    """(path, added, deleted); binary files, marked by dashes, are left out."""
    parts = F.split("line", "\t")
    added, deleted = F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1)).try_cast("long")
    others = [c for c in df.columns if c != text]
    rows = _lines(df, text).filter(F.size(parts) >= 3).select(*others, "line_no", new_path(F.get(parts, F.lit(2))).alias("path"), added.alias("added"), deleted.alias("deleted"))
    return rows.filter("added is not null and deleted is not null")


HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def hunks(df: DataFrame, text: str = "text") -> DataFrame:
    """Unified diff hunks (path, old_start, old_lines, new_start, new_lines); a missing count is 1.

    A text is cut at its ``+++`` lines into one row a file; removed files (``/dev/null``) have no hunks.
    """

    def number(line: Column, group: int) -> Column:
        got = F.regexp_extract(line, HUNK, group)
        return F.when(got == "", 1).otherwise(got.try_cast("int"))

    others = [c for c in df.columns if c != text]
    parts = df.select(*others, F.explode(F.filter(F.split(text, r"(?md)^\+\+\+ "), lambda _, i: i > 0)).alias("__part"))
    lines = parts.select(*others, F.split("__part", "\r?\n").alias("__lines"))
    path = F.regexp_replace(F.get("__lines", F.lit(0)), r"^b/|\t.*$", "")
    marks = F.filter("__lines", lambda line, i: (i > 0) & line.rlike(HUNK))
    found = lines.select(*others, path.alias("__path"), F.explode(marks).alias("__mark")).filter("__path <> '/dev/null'")
    mark = F.col("__mark")
    return found.select(*others, F.col("__path").alias("path"), number(mark, 1).alias("old_start"), number(mark, 2).alias("old_lines"), number(mark, 3).alias("new_start"), number(mark, 4).alias("new_lines"))


def touched_lines(new_lines: Column, old_lines: Column) -> Column:
    return F.when(new_lines > 0, new_lines).otherwise(old_lines)
