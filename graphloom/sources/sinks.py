"""Sinks: metrics CSV, flowcharts of a diff, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import FLOWCHART, escaped

CAP = 50


def write_csv(df: DataFrame, path: str) -> None:
    """A header and rows; fields are quoted only where they hold a quote, a comma or a line break."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flowchart_nodes(changed: DataFrame, links: DataFrame, cap: int = CAP) -> DataFrame:
    """(position, id, change): changed nodes in order, then their neighbours, ``cap`` in all (a report's size)."""
    ids = changed.select("id")
    near = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    near = near.union(links.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))).distinct().join(ids, "id", "left_anti")
    rows = changed.select("id", "change", F.lit(0).alias("rank")).unionByName(near.select("id", F.lit(None).cast("string").alias("change"), F.lit(1).alias("rank")))
    return rows.orderBy("rank", "id").limit(cap).select("rank", "id", "change")


def flowchart(changed: DataFrame, links: DataFrame, cap: int = CAP) -> str:
    """A flowchart of a diff as text; at most ``cap`` nodes, so it is drawn on the driver."""
    nodes = flowchart_nodes(changed, links, cap).withColumn("label", escaped(F.col("id"), FLOWCHART)).orderBy("rank", "id").collect()
    slot = {r["id"]: i for i, r in enumerate(nodes)}
    shown = links.sparkSession.createDataFrame([(k,) for k in slot] or [("",)], "id string")
    inner = links.join(F.broadcast(shown.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(shown.withColumnRenamed("id", "target")), "target", "left_semi")
    edges = sorted({(slot[r["source"]], slot[r["target"]]) for r in inner.select("source", "target").distinct().collect()})
    lines = ["flowchart LR"] + [f'  n{i}["{r["label"]}"]' + (f":::{r['change']}" if r["change"] else "") for i, r in enumerate(nodes)] + [f"  n{a} --> n{b}" for a, b in edges]
    return "\n".join(lines) + "\n"
