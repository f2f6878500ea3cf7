"""Runtime traces, timelines, overlays and test runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAIL, DECAY = 24, 0.85


def timeline(samples: DataFrame, plane: str = "plane") -> DataFrame:
    """(plane, step, symbol_id, t_us, dur_us, samples): runs of samples with the same active symbol.

    ``samples``: (plane, seq, symbol_id or null, slice_us). A sample without a symbol is charged to the
    open step; before the first step it only moves the clock. Planes are independent groups.
    """
    order = Window.partitionBy(plane).orderBy("seq")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    act = samples.withColumn("active", F.last("symbol_id", ignorenulls=True).over(running)).withColumn("t", F.coalesce(F.sum("slice_us").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    change = F.when(F.lag("active").over(order).eqNullSafe(F.col("active")), 0).otherwise(1)
    steps = act.withColumn("change", F.when(F.col("active").isNotNull(), change)).filter("active is not null").withColumn("step", F.sum("change").over(running))
    return steps.groupBy(plane, "step").agg(F.min("active").alias("symbol_id"), F.min("t").cast("long").alias("t_us"), F.sum("slice_us").cast("long").alias("dur_us"), F.count(F.lit(1)).alias("samples"))


def merged_timeline(steps: DataFrame, planes: DataFrame) -> DataFrame:
    """Timelines one after the other: each plane starts where the earlier ones end. ``planes``: (plane, position, length_us)."""
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)  # one row a plane
    offset = planes.select("plane", F.coalesce(F.sum("length_us").over(before), F.lit(0)).cast("long").alias("offset"))
    return steps.join(offset, "plane").withColumn("t_us", F.col("t_us") + F.col("offset")).drop("offset")


def trace_overlay(nodes: DataFrame) -> DataFrame:
    """(symbol_id, weight, heat): self time, else self samples, else calls; heat is the share of the largest."""
    weight = F.coalesce("self_time_us", "self_samples", "calls")
    sums = nodes.filter("symbol_id is not null").groupBy("symbol_id").agg(F.sum(weight).cast("long").alias("weight"))
    top = sums.agg(F.max("weight").alias("top"))
    return sums.crossJoin(top).select("symbol_id", "weight", F.when(F.col("top") > 0, F.col("weight") / F.col("top")).otherwise(0.0).alias("heat"))


def folded_stacks(lines: DataFrame, text: str = "line") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines ``a;b;c 5``: leaves' own samples, and samples over each adjacent pair."""
    count = F.regexp_extract(text, r"\s(\d+)\s*$", 1).try_cast("long")
    frames = F.transform(F.split(F.regexp_replace(text, r"\s+\d+\s*$", ""), ";"), lambda f: F.regexp_replace(F.trim(f), r"::h[0-9a-f]{16}$", ""))
    rows = lines.select(frames.alias("frames"), count.alias("n")).filter("n is not null")
    nodes = rows.select(F.explode(F.transform(F.array_distinct("frames"), lambda f: F.struct(f.alias("name"), F.when(f == F.element_at("frames", -1), F.col("n")).otherwise(0).alias("own")))).alias("x")).select("x.*")
    pairs = F.arrays_zip(F.slice("frames", 1, F.size("frames") - 1).alias("a"), F.slice("frames", 2, F.size("frames") - 1).alias("b"))
    edges = rows.filter(F.size("frames") > 1).select("n", F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("source"), F.col("p.b").alias("target")).agg(F.sum("n").alias("count"))
    return nodes.groupBy("name").agg(F.sum("own").alias("self_samples")), edges


def comet(steps: DataFrame, at: int, trail: int = TRAIL, decay: float = DECAY, plane: str = "plane") -> DataFrame:
    """(plane, symbol_id, heat): in every plane the last ``trail`` steps up to step ``at``, fading by age."""
    age = F.lit(at) - F.col("step")
    return steps.filter(F.col("step").between(at - trail, at)).groupBy(plane, "symbol_id").agg(F.max(F.pow(F.lit(decay), age)).alias("heat"))


def transitions(steps: DataFrame, plane: str = "plane") -> DataFrame:
    """(source, target, count) of consecutive steps."""
    order = Window.partitionBy(plane).orderBy("step")
    met = steps.select(F.lag("symbol_id").over(order).alias("source"), F.col("symbol_id").alias("target")).filter("source is not null and source <> target")
    return met.groupBy("source", "target").agg(F.count(F.lit(1)).alias("count"))


def inclusive_tree(nodes: DataFrame) -> DataFrame:
    """(profile_id, id, self_samples, total_samples): own and inclusive samples of a call tree.

    ``nodes``: (profile_id, id, parent_id, self_samples). One join round a level of the tree.
    """
    from graphloom.durable import settle

    parent = nodes.select("profile_id", "id", "parent_id")
    at = settle(nodes.select("profile_id", F.col("id").alias("leaf"), "id", "self_samples"))
    parts = at
    while True:
        at = settle(at.join(parent, ["profile_id", "id"]).filter("parent_id is not null").select("profile_id", "leaf", F.col("parent_id").alias("id"), "self_samples"))
        if at.isEmpty():
            break
        parts = parts.unionByName(at)
    total = parts.groupBy("profile_id", "id").agg(F.sum("self_samples").cast("long").alias("total_samples"))
    return nodes.join(total, ["profile_id", "id"]).select("profile_id", "id", "self_samples", "total_samples")


def lift_path(steps: DataFrame, mapping: DataFrame) -> DataFrame:
    """A path overlay on coarser nodes: unmapped steps go, repeats in a row keep the first time.

    ``steps``: (overlay_id, seq, node_id, at); ``mapping``: (node_id, group).
    """
    met = steps.join(mapping, "node_id").filter("group is not null")
    order = Window.partitionBy("overlay_id").orderBy("seq")
    return met.withColumn("prev", F.lag("group").over(order)).filter(~F.col("prev").eqNullSafe(F.col("group"))).select("overlay_id", "seq", F.col("group").alias("node_id"), "at")


def lift_heat(hits: DataFrame, mapping: DataFrame) -> DataFrame:
    return hits.join(mapping, "node_id").filter("group is not null").groupBy("overlay_id", F.col("group").alias("node_id")).agg(F.sum("hits").cast("long").alias("hits"))


#: Panel order of states.
STATES = ("fail", "todo", "pass", "skip")


def status_counts(results: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status"))
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("duration_ms")).withColumn("position", rank.cast("long"))


def resolve_results(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Add ``case_id``: by test id, else by file and full title."""
    by_id = cases.select(F.col("id").alias("test_id"), F.col("id").alias("by_id"))
    by_title = cases.groupBy("file", "name").agg(F.min("id").alias("by_title"))
    return results.join(by_id, "test_id", "left").join(by_title, ["file", "name"], "left").withColumn("case_id", F.coalesce("by_id", "by_title")).drop("by_id", "by_title")


def tests_by_symbol(results: DataFrame) -> DataFrame:
    """(symbol_id, tests): the tests that cover each symbol. ``results``: (test_id, covers array)."""
    return results.select("test_id", F.explode("covers").alias("symbol_id")).groupBy("symbol_id").agg(F.array_sort(F.collect_set("test_id")).alias("tests"))


def merged_covers(results: DataFrame, traced: DataFrame) -> DataFrame:
    """Results with traced covers; cases known from traces only are appended as passes."""
    met = results.join(traced.withColumnRenamed("covers", "more"), "test_id", "full_outer")
    empty = F.array().cast("array<string>")
    return met.select("test_id", F.coalesce("status", F.lit("pass")).alias("status"), F.array_sort(F.array_union(F.coalesce("covers", empty), F.coalesce("more", empty))).alias("covers"))


def debounced(events: DataFrame, key: str, ts: str, gap_us: int) -> DataFrame:
    """Bursts of a key whose events lie less than ``gap_us`` apart: (key, burst, first, last, events)."""
    order = Window.partitionBy(key).orderBy(ts)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    start = F.when(us - F.lag(us).over(order) < gap_us, 0).otherwise(1)
    marked = events.withColumn("start", start).withColumn("burst", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "burst").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("events"))


def slice_of(value: Column) -> Column:
    return F.round(value * 100).cast("long")
