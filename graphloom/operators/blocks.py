"""Declarations and their blocks in texts with braces, by windows over lines.

A line's balance is its opening less its closing braces, those behind ``//`` not counted. With the running
sum of balances, a line is at the top where the sum before it is the least so far and not above zero. A
block ends where the sum first comes back to its value before the declaration after having been above it.
A line crosses each value between the sums before and after it: at most one crossing a brace. So the
end is found among crossings of one value, up and down in turn, and nested blocks cost nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Declarations at the top (fixed forms): pattern with its export mark, qualifier and name groups, and kinds.
FUNCTION = r"^(pub\s+)?fn\s+(?:([A-Za-z_]\w*)::)?([A-Za-z_]\w*)"
TYPE = r"^(pub\s+)?(struct|enum|trait|type!?)\s+([A-Za-z_]\w*)"
VALUE = r"^(pub\s+)?(let|const)\s+([A-Za-z_]\w*)"
TYPE_KINDS = {"struct": "class", "enum": "enum", "trait": "interface", "type": "type", "type!": "type"}


def numbered_lines(texts: DataFrame) -> DataFrame:
    """(file, line, text) of texts (file, text), counted from 1; null texts have one empty line."""
    return texts.select("file", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def balance(line: Column) -> Column:
    code = F.split_part(line, F.lit("//"), F.lit(1))
    return F.length(F.regexp_replace(code, r"[^{]", "")) - F.length(F.regexp_replace(code, r"[^}]", ""))


def _declared(line: Column) -> Column:
    """Struct of kind, name, parent_class and exported of a declaring line; null for others."""

    def of(pattern: str, kind: Column, parent: Column) -> Column:
        got = lambda group: F.regexp_extract(line, pattern, group)
        return F.when(line.rlike(pattern), F.struct(kind.alias("kind"), got(3).alias("name"), parent.alias("parent_class"), (got(1) != "").alias("exported")))

    owner, none = F.regexp_extract(line, FUNCTION, 2), F.lit(None).cast("string")
    kinds = F.create_map(*[F.lit(x) for pair in TYPE_KINDS.items() for x in pair])
    function = of(FUNCTION, F.when(owner != "", "method").otherwise("function"), F.when(owner != "", owner))
    return F.coalesce(function, of(TYPE, F.element_at(kinds, F.regexp_extract(line, TYPE, 2)), none), of(VALUE, F.lit("variable"), none))


def block_symbols(texts: DataFrame) -> DataFrame:
    """(id, file, kind, name, parent_class, exported, start_line, end_line, loc, complexity) of the top declarations.

    ``texts``: (file, text), files are unique. A declaration without a closed block ends on its own line.
    """
    order = Window.partitionBy("file").orderBy("line")
    lines = numbered_lines(texts).select("file", "line", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("code"), balance(F.col("text")).alias("step"))
    lines = lines.withColumn("after", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col("step"))
    lines = lines.withColumn("floor", F.least(F.lit(0), F.min("before").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    crossed = F.when(F.col("step") != 0, F.sequence(F.least("before", "after"), F.greatest("before", "after") - 1))
    shared = ("file", "line", "value")
    ups = lines.filter("step <> 0").select("file", "line", F.explode(crossed).alias("value"), (F.col("step") > 0).alias("up"), F.lit(None).cast("struct<kind:string,name:string,parent_class:string,exported:boolean>").alias("own"))
    top = lines.filter((F.col("before") == F.col("floor")) & (F.col("code") != "") & ~F.col("code").startswith("//"))
    heads = top.select("file", "line", F.col("before").alias("value"), F.lit(None).cast("boolean").alias("up"), _declared(F.col("code")).alias("own")).filter("own is not null")
    along = Window.partitionBy("file", "value").orderBy("line", F.col("own").isNull())
    crossings = Window.partitionBy("file", "value", F.col("own").isNull()).orderBy("line")
    met = ups.unionByName(heads).withColumn("closed", F.when(F.col("up"), F.lead("line").over(crossings)))
    opened = F.first(F.when(F.col("up"), F.struct("closed")), ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))
    found = met.withColumn("opened", opened).filter("own is not null").select(*shared, "own.*", F.coalesce("opened.closed", "line").alias("end_line"))
    full = F.when(F.col("parent_class").isNotNull(), F.concat_ws(".", "parent_class", "name")).otherwise(F.col("name"))
    return found.select(F.concat_ws(":", F.lit("symbol"), "file", "kind", full, F.col("line").cast("string")).alias("id"), "file", "kind", "name", "parent_class", "exported", F.col("line").alias("start_line"), "end_line", (F.col("end_line") - F.col("line") + 1).alias("loc"), F.lit(1).alias("complexity"))
