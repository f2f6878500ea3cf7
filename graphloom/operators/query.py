"""Query intents over an indexed graph: neighbourhood lens, find, describe, structure, palette search."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import parent_file
from graphloom.operators import graph


def neighbourhood(links: DataFrame, target: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
    """(id, depth, role): the target and what lies within ``depth`` before and behind it."""
    parts = [target.select("id", F.lit(0).alias("depth"), F.lit("target").alias("role"))]
    if direction != "dependents":
        parts.append(graph.reach(links, target, depth).select("id", "depth", F.lit("dependency").alias("role")))
    if direction != "dependencies":
        parts.append(graph.reach(graph.reversed_links(links), target, depth).select("id", "depth", F.lit("dependent").alias("role")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    role = F.when(F.max(F.col("role") == "target"), "target").when(F.count_distinct("role") > 1, "both").otherwise(F.min("role"))
    return rows.groupBy("id").agg(F.min("depth").alias("depth"), role.alias("role"))


def lens(links: DataFrame, target: DataFrame, depth: int = 1, direction: str = "both", most: int = 48, signals: DataFrame | None = None, named: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(id, depth, role, score): the best ``most`` nodes around a target, which always stays.

    ``signals``: (id, changed boolean, heat double, failed boolean, tested boolean). Scores: target 100,
    others 80 less 8 a hop; changed 8, heat times 6, failing tests 6, else tests 2. Where links hold keys, ``named``
    gives the nodes that are found (id, depth, role) their names, by which equals are ordered.
    """
    rows = named(neighbourhood(links, target, depth, direction))
    score = F.when(F.col("role") == "target", 100).otherwise(80 - 8 * F.col("depth"))
    if signals is not None:
        rows = rows.join(signals, "id", "left")
        flag = lambda c: F.coalesce(F.col(c), F.lit(False))
        score = score + F.when(flag("changed"), 8).otherwise(0) + 6 * F.coalesce("heat", F.lit(0.0)) + F.when(flag("failed"), 6).when(flag("tested"), 2).otherwise(0)
    rows = rows.select("id", "depth", "role", score.cast("double").alias("score"))
    top = rows.orderBy(F.desc("score"), "depth", "id").limit(most)
    return top.unionByName(rows.filter("role = 'target'")).distinct()


def lens_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends in a lens."""
    ids = nodes.select("id")
    return links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target").distinct()


def find_score(text: Column, query: str) -> Column:
    """100 exact, 70 prefix, 40 less the position of a substring, 10 subsequence, else -1."""
    q = query.lower()
    low = F.lower(text)
    at = F.instr(low, q)
    loose = ".*".join(re.escape(c) for c in q)
    return F.when(low == q, 100).when(low.startswith(q), 70).when(at > 0, 40 - (at - 1)).when(low.rlike(loose), 10).otherwise(-1)


def find(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, label, score): best matches of labels, and of ids at 5 less."""
    score = F.greatest(find_score(F.col("label"), query), find_score(F.col("id"), query) - 5)
    scored = nodes.select("id", "label", score.alias("score")).filter("score >= 0")
    return scored.orderBy(F.desc("score"), F.length("label"), "id").limit(limit)


def _match_score(text: Column, query: str) -> Column:
    """1000 exact, 800 prefix, 600 substring, 400 scattered plus 40 (at most 150) for each letter found at a word start; else null.

    Scattered letters are taken at their next place each. A word starts at the first letter, after what is
    neither letter nor digit, and at a capital after a small letter or digit.
    """
    q = query.lower()
    low = F.lower(text)

    def starts(at: Column) -> Column:
        before, here = F.substring(text, at - 1, F.lit(1)), F.substring(text, at, F.lit(1))
        return (at == 1) | ~before.rlike("[A-Za-z0-9]") | (here.rlike("[A-Z]") & before.rlike("[a-z0-9]"))

    def step(state: Column, letter: Column) -> Column:
        """Places count from 1; 0 before the first letter, -1 once a letter is missing."""
        place = F.when(state["at"] >= 0, F.position(letter, low, state["at"] + 1)).otherwise(0)
        at = F.when(place > 0, place).otherwise(-1)
        return F.struct(at.cast("int").alias("at"), (state["hits"] + F.when((place > 0) & starts(place), 1).otherwise(0)).cast("int").alias("hits"))

    walk = F.aggregate(F.array(*[F.lit(c) for c in q]), F.struct(F.lit(0).alias("at"), F.lit(0).alias("hits")), step)
    scattered = F.when(walk["at"] > 0, 400 + F.least(F.lit(150), 40 * walk["hits"]))
    return F.when(low == q, 1000).when(low.startswith(q), 800).when(F.instr(low, q) > 0, 600).otherwise(scattered)


def palette_score(label: Column, node: Column, query: str) -> Column:
    """The label's match; where it has none, 0.39 of the id's; null where neither fits."""
    return F.coalesce(_match_score(label, query).cast("double"), _match_score(node, query) / 1000 * 390)


def palette(nodes: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """(id, label, kind, score): best first, ties by shorter label, by kind (leaves before what holds them), by id.

    The query is trimmed; an empty one finds nothing. Unknown kinds come last.
    """
    wanted = query.strip()
    kind = F.col("kind")
    rank = F.when(kind.isin("symbol", "block"), 0).when(kind.isin("class", "file"), 1).when(kind == "directory", 2).when(kind == "module", 3).when(kind == "service", 4).otherwise(9)
    score = palette_score(F.col("label"), F.col("id"), wanted) if wanted else F.lit(None).cast("double")
    scored = nodes.select("id", "label", "kind", score.alias("score")).filter("score is not null")
    return scored.orderBy(F.desc("score"), F.length("label"), rank, "id").limit(limit)


def describe(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with their degrees over distinct links."""
    pairs = links.select("source", "target").distinct()
    out = pairs.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = pairs.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.join(into, "id", "left").join(out, "id", "left").select(*nodes.columns, zero("in_degree"), zero("out_degree"))


def index_links(nodes: DataFrame, edges: DataFrame, file_of: Column, module: Column) -> DataFrame:
    """(level, source, target): distinct links of symbols, files and modules, without self links.

    ``nodes``: (id, kind). Symbol links keep edges with a symbol at either end; file and module links
    fold both ends; file ends must be known files. ``file_of`` and ``module`` are expressions of ``id``.
    """
    home = nodes.select("id", "kind", file_of.alias("file"))
    files = nodes.filter("kind = 'file'").select(F.col("id").alias("file"))
    ends = home.join(files.withColumn("known", F.lit(True)), "file", "left").withColumn("module", F.when(F.col("known"), module))
    a = ends.select(F.col("id").alias("source"), F.col("kind").alias("sk"), F.when(F.col("known"), F.col("file")).alias("sf"), F.col("module").alias("sm"))
    b = ends.select(F.col("id").alias("target"), F.col("kind").alias("tk"), F.when(F.col("known"), F.col("file")).alias("tf"), F.col("module").alias("tm"))
    met = edges.join(a, "source").join(b, "target")
    rows = F.array(
        F.when((F.col("sk") == "symbol") | (F.col("tk") == "symbol"), F.struct(F.lit("symbol").alias("level"), F.col("source").alias("source"), F.col("target").alias("target"))),
        F.struct(F.lit("file").alias("level"), F.col("sf").alias("source"), F.col("tf").alias("target")),
        F.struct(F.lit("module").alias("level"), F.col("sm").alias("source"), F.col("tm").alias("target")),
    )
    return met.select(F.explode(F.array_compact(rows)).alias("l")).select("l.*").filter("source <> target").distinct()


def propagate_tints(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, tint): tints of seeds carried forward; the nearest seed's, of equally near ones the least."""
    from graphloom.durable import settle

    pairs = links.select("source", "target").distinct()
    seen = settle(seeds.groupBy("id").agg(F.min("tint").alias("tint")))
    frontier = seen
    while not frontier.isEmpty():
        step = frontier.join(pairs, frontier["id"] == pairs["source"]).groupBy(F.col("target").alias("id")).agg(F.min("tint").alias("tint"))
        frontier = settle(step.join(seen, "id", "left_anti"))
        seen = settle(seen.unionByName(frontier))
    return seen


def focus_dim(inside: Column) -> Column:
    """Full where in focus, else a tenth; everything is full without a focus (null)."""
    return F.when(F.coalesce(inside, F.lit(True)), 1.0).otherwise(0.1)


def leaf_fill(dependency: Column, dependent: Column, cyclic: Column, test: Column) -> Column:
    """What colours a leaf, the first that holds; ``tint`` is that of its top group."""
    return F.when(dependency, "dependency").when(dependent, "dependent").when(cyclic, "cycle").when(test, "test").otherwise("tint")


def signals(nodes: DataFrame, homes: DataFrame, changed: DataFrame, heat: DataFrame, tests: DataFrame) -> DataFrame:
    """(level, id, changed, heat, tests) of nodes (level ``symbol``, ``file`` or ``module``; id): signals folded up the levels.

    One membership table says which nodes a signal's id belongs to: itself, its file, that file's module
    (``homes``: file, module). ``changed`` (id, kind): a symbol's own change counts before its file's, a
    module is modified if one of its files is, else added if one is. ``heat`` (id, heat): the greatest.
    ``tests`` (signal_id, test_id, status): each once, by status and id. Nodes without a signal have
    null, null and an empty list.
    """
    ids = heat.select("id").union(tests.select("signal_id")).distinct()
    home = homes.select(F.col("file").alias("home"), "module").distinct()
    placed = ids.withColumn("home", parent_file(F.col("id"))).join(home, "home", "left")
    levels = F.array(F.struct(F.lit("symbol").alias("level"), F.col("id").alias("node")), F.struct(F.lit("file").alias("level"), F.col("id").alias("node")), F.struct(F.lit("file").alias("level"), F.col("home").alias("node")), F.struct(F.lit("module").alias("level"), F.col("module").alias("node")), F.struct(F.lit("module").alias("level"), F.col("id").alias("node")))
    member = placed.select(F.col("id").alias("signal_id"), F.explode(F.array_distinct(levels)).alias("m")).select("signal_id", "m.level", F.col("m.node").alias("id")).filter("id is not null")

    hot = member.join(heat.withColumnRenamed("id", "signal_id"), "signal_id").groupBy("level", "id").agg(F.max("heat").alias("heat"))
    run = member.join(tests, "signal_id").select("level", "id", "status", "test_id").groupBy("level", "id", "test_id").agg(F.min("status").alias("status"))
    run = run.groupBy("level", "id").agg(F.array_sort(F.collect_list(F.struct("status", "test_id"))).alias("tests"))

    own = changed.select("id", "kind").groupBy("id").agg(F.max("kind").alias("kind"))  # "modified" is the greater word
    above = own.join(home.withColumnRenamed("home", "id"), "id").groupBy(F.col("module").alias("id")).agg(F.max("kind").alias("by_module"))
    met = nodes.withColumn("home", F.when(F.col("level") != "module", parent_file(F.col("id"))))
    met = met.join(own.withColumnRenamed("kind", "by_id"), "id", "left").join(own.select(F.col("id").alias("home"), F.col("kind").alias("by_file")), "home", "left").join(above, "id", "left")
    kind = F.when(F.col("level") == "symbol", F.coalesce("by_id", "by_file")).when(F.col("level") == "file", F.col("by_file")).otherwise(F.col("by_module"))
    out = met.select("level", "id", kind.alias("changed")).join(hot, ["level", "id"], "left").join(run, ["level", "id"], "left")
    return out.select("level", "id", "changed", "heat", F.coalesce("tests", F.array().cast("array<struct<status:string,test_id:string>>")).alias("tests"))
