"""Trees of test files: shared prefix stripped, chains of single folders folded.

The prefix that all folders share is that of the least and the greatest of them in segment order. A folder
that holds one folder and no file is passed through: chains of those are contracted by pointer jumping,
so a chain of ``n`` folders takes about ``log2(n)`` joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.durable import settle
from graphloom.functions.ids import basename


def shared_segments(low: Column, high: Column) -> Column:
    """Number of leading segments that two arrays share."""
    places = F.when(F.least(F.size(low), F.size(high)) > 0, F.sequence(F.lit(1), F.least(F.size(low), F.size(high)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(low, i - 1) == F.get(high, i - 1)), i).otherwise(n))


def chain_ends(links: DataFrame) -> DataFrame:
    """(id, end): where each node's chain ends. ``links``: (id, next), the node itself at an end; no loops."""
    at = settle(links.select("id", F.col("next").alias("end")))
    while True:
        after = at.select(F.col("id").alias("end"), F.col("end").alias("far"))
        jumped = settle(at.join(after, "end").select("id", F.col("far").alias("end"), (F.col("far") != F.col("end")).alias("moved")))
        at = jumped.select("id", "end")
        if jumped.filter("moved").isEmpty():
            return at


def test_tree(files: DataFrame) -> DataFrame:
    """(id, kind, name, parent, file) of folders and files with tests; the root is ``testroot``, its parent null.

    ``files``: (file) with at least one test each; repeats count once; none give no rows. A folded chain is
    one node that is named by all its folders and identified by its last one, relative to the shared prefix.
    """
    own = settle(files.select("file", F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1).alias("dirs")).distinct())
    ends = own.agg(F.min("dirs").alias("low"), F.max("dirs").alias("high"))
    n = F.broadcast(ends.select(shared_segments(F.col("low"), F.col("high")).alias("shared")))  # one row
    own = own.crossJoin(n).select("file", F.slice("dirs", F.col("shared") + 1, F.size("dirs") - F.col("shared")).alias("dirs"))
    joined = lambda parts, k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    homes = settle(own.select("file", F.array_join("dirs", "/").alias("dir"), "dirs"))

    # Every folder once, with the folder above it; the root is the empty path.
    steps = F.when(F.size("dirs") > 0, F.transform(F.sequence(F.lit(1), F.size("dirs")), lambda k: F.struct(joined(F.col("dirs"), k).alias("dir"), joined(F.col("dirs"), k - 1).alias("above"))))
    below = homes.select(F.explode(steps).alias("s")).select("s.*").distinct()
    counted = below.groupBy(F.col("above").alias("dir")).agg(F.count(F.lit(1)).alias("dirs"), F.min("dir").alias("only"))
    held = homes.groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    folders = below.select("dir", "above").unionByName(homes.limit(1).select(F.lit("").alias("dir"), F.lit(None).cast("string").alias("above")))
    passed = F.col("files").isNull() & (F.col("dirs") == 1)
    folders = settle(folders.join(counted, "dir", "left").join(held, "dir", "left").select("dir", "above", F.coalesce(passed, F.lit(False)).alias("passed"), F.when(passed, F.col("only")).otherwise(F.col("dir")).alias("next")))

    # A chain starts where the folder above is not passed through.
    above = folders.select(F.col("dir").alias("above"), F.col("passed").alias("inside"))
    heads = folders.join(above, "above", "left").filter("inside is null or not inside").select(F.col("dir").alias("id"), "above")
    tails = chain_ends(folders.select(F.col("dir").alias("id"), "next"))
    named = settle(heads.join(tails, "id").select("id", "above", "end", F.when(F.col("id") == "", "testroot").otherwise(F.concat(F.lit("testdir:"), "end")).alias("node")))
    owner = named.select(F.col("end").alias("dir"), F.col("node").alias("parent"))
    cut = F.when(F.coalesce("above", F.lit("")) == "", F.col("end")).otherwise(F.substring("end", F.length("above") + 2, F.length("end")))
    dirs = named.join(owner.withColumnRenamed("dir", "above"), "above", "left").select(F.col("node").alias("id"), F.lit("dir").alias("kind"), cut.alias("name"), "parent", F.lit(None).cast("string").alias("file"))
    leaves = homes.join(owner, "dir").select(F.concat(F.lit("testfile:"), "file").alias("id"), F.lit("file").alias("kind"), basename(F.col("file")).alias("name"), "parent", "file")
    return dirs.unionByName(leaves)
