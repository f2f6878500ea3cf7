"""Differences between snapshots, their history, and change overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import module_of

METRICS = ("loc", "file_count", "directory_count", "import_edge_count", "unresolved_count", "max_fan_in", "max_fan_out", "cycles", "largest_component")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (id, loc, fan_in, fan_out) that are new, gone, or differ in LoC or fans.

    Where both sides say ``in_cycle``, ``new_cycle`` marks files that only now lie in a cycle.
    """
    cycles = "in_cycle" in before.columns and "in_cycle" in after.columns
    columns = ("loc", "fan_in", "fan_out", *(["in_cycle"] if cycles else []))
    b = before.select("id", *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("was"))
    a = after.select("id", *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("now"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = a.join(b, "id", "full_outer").select(
        "id",
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("modified").alias("change"),
        *[(zero(f"a_{c}") - zero(f"b_{c}")).alias(f"{c}_delta") for c in columns[:3]],
        *([(F.coalesce("a_in_cycle", F.lit(False)) & ~F.coalesce("b_in_cycle", F.lit(False))).alias("new_cycle")] if cycles else []),
    )
    return rows.filter("change <> 'modified' or loc_delta <> 0 or fan_in_delta <> 0 or fan_out_delta <> 0")


def hotspots(changes: DataFrame, new_unresolved: DataFrame | None = None) -> DataFrame:
    """(id, score, reasons): growth, risky new files, rising fans, new cycles, new unresolved imports."""
    missing = (new_unresolved.select("id").distinct() if new_unresolved is not None else changes.select("id").limit(0)).withColumn("unresolved", F.lit(True))
    up = lambda c: F.greatest(F.col(c), F.lit(0))
    lost = F.coalesce("unresolved", F.lit(False))
    big_new = (F.col("change") == "added") & (F.col("loc_delta") >= 100)
    score = up("loc_delta") / 20 + F.when(big_new, 20).otherwise(0) + 2 * up("fan_in_delta") + 2 * up("fan_out_delta") + F.when(F.col("new_cycle"), 30).otherwise(0) + F.when(lost, 10).otherwise(0)
    reasons = F.array_compact(F.array(
        F.when(F.col("loc_delta") >= 100, "large-growth"), F.when(big_new, "large-new-file"), F.when(F.col("fan_in_delta") > 0, "fan-in-growth"),
        F.when(F.col("fan_out_delta") > 0, "fan-out-growth"), F.when(F.col("new_cycle"), "new-cycle"), F.when(lost, "new-unresolved-import"),
    ))
    rows = changes.filter("change <> 'removed'").join(missing, "id", "left").select("id", F.round(score, 2).alias("score"), reasons.alias("reasons"))
    return rows.filter((F.col("score") > 0) | (F.size("reasons") > 0))


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.select(*[F.col(c).alias(f"b_{c}") for c in METRICS])
    return after.crossJoin(b).select(*[(F.col(c) - F.col(f"b_{c}")).alias(c) for c in METRICS])


def graph_delta(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = ("loc", "complexity", "exported")) -> DataFrame:
    """(id, change) of graph nodes; modified where one of the columns differs."""
    own = [c for c in columns if c in before.columns]
    b = before.select("id", *[F.col(c).alias(f"b_{c}") for c in own], F.lit(True).alias("was"))
    met = after.select("id", *own, F.lit(True).alias("now")).join(b, "id", "full_outer")
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~same, "modified")
    return met.select("id", change.alias("change")).filter("change is not null")


def edge_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    pair = ("source", "target")
    b, a = before.select(*pair).distinct(), after.select(*pair).distinct()
    return a.join(b, list(pair), "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, list(pair), "left_anti").withColumn("change", F.lit("removed")))


def affected_groups(nodes: DataFrame, edges: DataFrame, group: DataFrame) -> DataFrame:
    """Distinct groups of changed nodes and of changed edges' ends; nodes without a group are passed over."""
    ids = nodes.select("id").union(edges.select("source")).union(edges.select("target")).toDF("id")
    return ids.join(group, "id").filter("group is not null").select("group").distinct()


def symbol_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols matched by (path, name, kind): added, or modified where LoC or complexity differ."""
    keys = ["path", "name", "kind"]
    b = before.groupBy(*keys).agg(F.max("loc").alias("b_loc"), F.max("complexity").alias("b_complexity"), F.lit(True).alias("was"))
    met = after.join(b, keys, "left")
    change = F.when(F.col("was").isNull(), "added").when(~(F.col("loc").eqNullSafe(F.col("b_loc")) & F.col("complexity").eqNullSafe(F.col("b_complexity"))), "modified")
    return met.select("symbol_id", change.alias("change")).filter("change is not null")


def signature(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: a digest of a graph's content that does not depend on row order.

    Rows are hashed one by one and summed, so nothing is gathered in one place.
    """
    wide = lambda df: df.agg(F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n"))
    a, b = wide(nodes), wide(edges)
    return a.crossJoin(b.select(F.col("h").alias("h2"), F.col("n").alias("n2"))).select(F.sha2(F.concat_ws(":", "h", "n", "h2", "n2"), 256).alias("signature"))


def change_spectrum(edges: DataFrame, changed: DataFrame, removed: int = 0) -> DataFrame:
    """One row: touched files, distinct unchanged importers of changed files, distinct unchanged imports of them."""
    ids = changed.select("id").distinct()
    src, dst = ids.withColumnRenamed("id", "source"), ids.withColumnRenamed("id", "target")
    up = edges.join(dst, "target", "left_semi").join(src, "source", "left_anti").agg(F.count_distinct("source").alias("upstream"))
    down = edges.join(src, "source", "left_semi").join(dst, "target", "left_anti").agg(F.count_distinct("target").alias("downstream"))
    return ids.agg((F.count(F.lit(1)) + removed).alias("touched")).crossJoin(up).crossJoin(down)


def module_changes(files: DataFrame, module: Column) -> DataFrame:
    """(id, kind): added where every file of the module is added, else modified. ``files``: (id, kind or null)."""
    rows = files.groupBy(module.alias("module")).agg(F.bool_and(F.coalesce(F.col("kind") == "added", F.lit(False))).alias("all_added"), F.count("kind").alias("n"))
    return rows.filter("n > 0").select(F.col("module").alias("id"), F.when(F.col("all_added"), "added").otherwise("modified").alias("kind"))


def file_stats(changes: DataFrame) -> DataFrame:
    """Normalised change: total = max(1, loc, else graph loc, else added); ratio 1 if new, else touched / total in [0, 1].

    ``changes``: (path, kind, loc, graph_loc, added, touched); without counts a modified file has ratio 0.18.
    """
    total = F.greatest(F.lit(1), F.coalesce("loc", "graph_loc", "added", F.lit(1)))
    ratio = F.when(F.col("kind") == "added", 1.0).when(F.col("touched").isNull(), 0.18).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("touched") / total)))
    return changes.select("path", "kind", total.alias("total"), ratio.alias("ratio"))


def working_graph(nodes: DataFrame, edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with a working diff applied: LoC retargeted, added files inserted, removed ones and their edges dropped."""
    gone = changes.filter("kind = 'removed'").select(F.col("path").alias("id"))
    fresh = changes.filter("kind <> 'removed'").select(F.col("path").alias("id"), F.col("loc").alias("new_loc"))
    met = nodes.join(gone, "id", "left_anti").join(fresh, "id", "full_outer")
    out = met.select("id", F.greatest(F.coalesce("new_loc", "loc"), F.lit(1)).alias("loc"))
    ids = gone.select("id")
    return out, edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")


def adjacent_pairs(snapshots: DataFrame) -> DataFrame:
    """(before, after) of neighbouring snapshots (graph_id, ts) in time order; one row a snapshot, so one window."""
    return snapshots.select(F.lag("graph_id").over(Window.orderBy("ts", "graph_id")).alias("before"), F.col("graph_id").alias("after")).filter("before is not null")


def history(files: DataFrame, order: DataFrame) -> DataFrame:
    """(id, position, change) of every file over a history: ``files`` (graph_id, id, loc), ``order`` (graph_id, position from 0)."""
    at = files.join(order, "graph_id").select("id", "position", "loc")
    last = order.agg(F.max("position").alias("last"))
    mine = Window.partitionBy("id").orderBy("position")
    seen = at.withColumn("p", F.lag("position").over(mine)).withColumn("l", F.lag("loc").over(mine)).withColumn("n", F.lead("position").over(mine))
    fresh = F.when((F.col("p").isNull() & (F.col("position") > 0)) | (F.col("p") < F.col("position") - 1), "added").when((F.col("p") == F.col("position") - 1) & (F.col("l") != F.col("loc")), "modified")
    here = seen.select("id", "position", fresh.alias("change")).filter("change is not null")
    gone = seen.crossJoin(last).filter("(n is null and position < last) or n > position + 1").select("id", (F.col("position") + 1).alias("position"), F.lit("removed").alias("change"))
    return here.unionByName(gone)


def range_changes(changes: DataFrame, first: int, last: int) -> DataFrame:
    """(id, change) over a span of commits, the latest change winning."""
    return changes.filter(F.col("position").between(first, last)).groupBy("id").agg(F.max_by("change", "position").alias("change"))


def weekly(commits: DataFrame) -> DataFrame:
    """The last commit (by ``ord``) of each week from Monday, UTC."""
    week = Window.partitionBy(F.date_trunc("week", "ts"))
    return commits.withColumn("_n", F.row_number().over(week.orderBy(F.desc("ord")))).filter("_n = 1").drop("_n")


#: Marks of assisted commits: indicator and pattern, in order (fixed values).
ASSISTED = (
    ("claude-code", r"(?i)\bclaude\s+code\b"),
    ("claude-code", r"(?i)\bgenerated\s+with\s+claude\b"),
    ("claude-code", r"(?i)\bco-authored-by:\s*claude\b"),
    ("claude-code", r"(?i)\bclaude\b"),
    ("codex", r"(?i)\bcodex\b"),
    ("codex", r"(?i)\bopenai\b"),
    ("copilot", r"(?i)\bgithub\s+copilot\b"),
    ("copilot", r"(?i)\bcopilot\b"),
    ("cursor", r"(?i)\bcursor\b"),
    ("devin", r"(?i)\bdevin\b"),
    ("aider", r"(?i)\baider\b"),
)


def _evidence(name: Column, email: Column, message: Column) -> Column:
    return F.concat(name, F.lit("\n"), F.coalesce(email, F.lit("")), F.lit("\n"), message)


def assisted(name: Column, email: Column, message: Column) -> Column:
    """Distinct indicators whose pattern occurs in name, mail or message, in rule order."""
    text = _evidence(name, email, message)
    return F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in ASSISTED])))


def raw_marks(name: Column, email: Column, message: Column) -> Column:
    """The first match of every pattern that occurs."""
    text = _evidence(name, email, message)
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.regexp_extract(text, p, 0)) for _, p in ASSISTED]))


def details(changed: DataFrame, numstat: DataFrame, hunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stats, hunks) of the changed files only.

    ``changed``: (path, kind, loc), ``numstat``: (path, added, deleted), ``hunks``: (path, old_start,
    old_lines, new_start, new_lines). Touched lines are those of the hunks, else added and deleted ones.
    An added file without counts counts whole, as one hunk if it has none; a modified one has no stat.
    """
    cut = hunks.join(changed.select("path"), "path", "left_semi")
    per_path = cut.groupBy("path").agg(F.sum(F.when(F.col("new_lines") > 0, F.col("new_lines")).otherwise(F.col("old_lines"))).alias("cut"))
    met = changed.join(numstat.select("path", "added", "deleted"), "path", "left").join(per_path, "path", "left")
    lines = F.coalesce("loc", F.lit(0)).cast("long")
    counted = F.col("added").isNotNull()
    touched = F.when(F.col("cut") > 0, F.col("cut")).otherwise(F.col("added") + F.col("deleted"))
    kept = met.filter(counted | (F.col("kind") == "added"))
    stats = kept.select("path", F.coalesce("added", lines).alias("added"), F.coalesce("deleted", F.lit(0)).alias("deleted"), F.when(counted, touched).otherwise(lines).alias("touched"))
    whole = met.filter(~counted & (F.col("kind") == "added") & (lines > 0) & F.col("cut").isNull())
    return stats, cut.unionByName(whole.select("path", F.lit(0).alias("old_start"), F.lit(0).alias("old_lines"), F.lit(1).alias("new_start"), lines.alias("new_lines")))


def estimated_stats(changes: DataFrame) -> DataFrame:
    """(path, added, deleted, touched, total, ratio) of changes (path, kind, total) that nothing was counted for."""
    total = F.greatest(F.lit(1), F.floor(F.coalesce("total", F.lit(1)) + 0.5).cast("long"))
    new = F.col("kind") == "added"
    touched = F.when(new, total).otherwise(F.greatest(F.lit(1), F.floor(total * 0.18 + 0.5).cast("long")))
    return changes.select("path", F.when(new, total).otherwise(0).alias("added"), F.lit(0).cast("long").alias("deleted"), touched.alias("touched"), total.alias("total"), F.when(new, 1.0).otherwise(0.18).alias("ratio"))


def preview_focus(files: DataFrame, changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(kind, id) of what a change shows: its modules, files and symbols.

    ``files``: changed files (id), ``changed``: changed symbols (id, file), ``symbols``: all (id, file).
    Of a changed file without changed symbols, all symbols show.
    """
    exact = changed.select("id", "file").distinct()
    paths = files.select(F.col("id").alias("file")).union(exact.select("file")).distinct()
    rest = symbols.select("id", "file").join(paths, "file", "left_semi").join(exact.select("file").distinct(), "file", "left_anti")
    shown = exact.select("id").union(rest.select("id")).distinct()
    row = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), c.alias("id"))
    return row("module", paths.select(module_of(F.col("file")).alias("m")).distinct(), F.col("m")).union(row("file", paths, F.col("file"))).union(row("symbol", shown, F.col("id")))


def added_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """The edges of ``after`` whose id ``before`` has not."""
    return after.join(before.select("id").distinct(), "id", "left_anti")


def recent_changes(changes: DataFrame, most: int = 20) -> DataFrame:
    """The newest change of each id, newest first, at most ``most``.

    ``changes``: (id, kind, at, pos); of changes seen together, those of lesser ``pos`` come first.
    """
    last = changes.groupBy("id").agg(F.max_by(F.struct("kind", "at", "pos"), F.struct(F.col("at"), -F.col("pos"))).alias("c"))
    return last.select("id", "c.*").orderBy(F.desc("at"), "pos", "id").limit(most)
