"""The id grammar as column expressions.

Files are ``file:<path>`` in snapshots and bare paths in graphs; symbols are
``symbol:<path>:<kind>:<name>:<line>``; cells of a file may be ``<path>#<suffix>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "(root)"
#: Paths of tests by naming convention (a fixed pattern).
TEST_PATH = r"(\.(test|spec)\.[cm]?[jt]sx?$)|(_test\.go$)|(_(test|wbtest)\.mbt$)|((^|/)(__tests__|tests?)/)"


def symbol_id(path: Column, kind: Column, name: Column, line: Column) -> Column:
    return F.concat(F.lit("symbol:"), F.concat_ws(":", path, kind, name, line.cast("string")))


def parent_file(node: Column) -> Column:
    """The file of a symbol or cell id; other ids are their own file. A symbol's pieces count from the end, so paths may hold colons."""
    parts = F.split(node, ":")
    path = F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 4, F.lit(0))), ":")).otherwise(F.get(parts, F.lit(1)))
    return F.when(node.startswith("symbol:"), path).otherwise(F.split_part(node, F.lit("#"), F.lit(1)))


def line_of(symbol: Column) -> Column:
    """The integer after the last colon; 1 where there is none."""
    return F.coalesce(F.regexp_extract(symbol, r":(\d+)$", 1).try_cast("int"), F.lit(1))


#: Kinds of symbols (fixed values).
SYMBOL_KINDS = ("function", "class", "variable", "type", "interface", "enum", "method", "property", "static-method", "static-property")


def symbol_kind(node: Column) -> Column:
    """The kind in a symbol's id, the third piece from its end; null for other ids and unknown kinds."""
    parts = F.split(node, ":")
    kind = F.get(parts, F.size(parts) - 3)
    return F.when(node.startswith("symbol:") & (F.size(parts) >= 5) & kind.isin(*SYMBOL_KINDS), kind)


def symbol_name(symbol: Column) -> Column:
    """The name in a symbol's id, the second piece from its end."""
    parts = F.split(symbol, ":")
    return F.when(F.size(parts) >= 5, F.get(parts, F.size(parts) - 2)).otherwise("")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; empty at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def module_of(path: Column) -> Column:
    """The first two directory segments, fewer where there are fewer, ``(root)`` at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.lit(ROOT)).otherwise(F.array_join(F.slice(parts, 1, F.least(F.lit(2), F.size(parts) - 1)), "/"))


def scope_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit(ROOT))


def directory_group(path: Column, depth: int) -> Column:
    """The directory cut to ``depth`` segments; ``(root)`` at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.lit(ROOT)).otherwise(F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "/"))


def layer_of(path: Column, stamp: Column | None = None) -> Column:
    """A stamped layer wins; else the path's convention decides between test and source."""
    rule = F.when(path.rlike(TEST_PATH), F.lit("test")).otherwise(F.lit("source"))
    return rule if stamp is None else F.coalesce(stamp, rule)


def normalised(path: Column) -> Column:
    """A slash path without ``.`` and ``..`` segments; null where it leaves the root."""

    def step(acc: Column, part: Column) -> Column:
        up = F.when(acc.isNull() | (F.size(acc) == 0), F.lit(None)).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.when(acc.isNotNull(), F.concat(acc, F.array(part))))

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))
