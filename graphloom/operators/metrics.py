"""Graph metrics, module derivation and hierarchical roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.durable import settle, stored
from graphloom.functions.ids import dirname, module_of
from graphloom.operators import graph


def fans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out): repeated edges count."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.array(F.struct(F.col("source").alias("id"), none.alias("i"), one.alias("o")), F.struct(F.col("target").alias("id"), one.alias("i"), none.alias("o")))
    each = edges.select(F.inline(ends)).groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    met = nodes.select("id").join(each, "id", "left")
    return met.select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def file_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, in_cycle) of every file."""
    cyclic = graph.strong_components(edges).filter("cyclic").select("id", F.lit(True).alias("c"))
    return fans(nodes, edges).join(cyclic, "id", "left").select("id", "fan_in", "fan_out", F.coalesce("c", F.lit(False)).alias("in_cycle"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """One row: loc, files, directories, edges, unresolved, greatest fans, cycles, largest component."""
    nodes, edges = stored(nodes), stored(edges)  # read by every part
    each = fans(nodes, edges).agg(F.max("fan_in").alias("max_fan_in"), F.max("fan_out").alias("max_fan_out"))
    sums = nodes.agg(F.sum("loc").cast("long").alias("loc"), F.count(F.lit(1)).alias("file_count"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    cycles = graph.strong_components(edges).filter("cyclic").agg(F.count_distinct("component").alias("cycles"))
    weak = graph.weak_components(edges).groupBy("component").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n"))
    largest = weak.select(F.greatest("n", F.lit(1)).alias("largest_component"))
    out = sums
    missing = unresolved if unresolved is not None else edges.limit(0)
    for part in (count(directories(nodes), "directory_count"), count(edges, "import_edge_count"), count(missing, "unresolved_count"), each, cycles, largest):
        out = out.crossJoin(part)  # one row each
    return out


def directories(nodes: DataFrame) -> DataFrame:
    """(path) of every ancestor directory of the files, each once."""
    parts = F.split("id", "/")
    ancestors = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    return nodes.select(F.explode(ancestors).alias("path")).distinct()


def contains_edges(nodes: DataFrame) -> DataFrame:
    """(source, target): each directory or the root to what lies directly in it."""
    dirs = directories(nodes).select(F.col("path").alias("id"), F.lit("dir:").alias("kind"))
    both = dirs.unionByName(nodes.select("id", F.lit("file:").alias("kind")))
    above = dirname(F.col("id"))
    return both.select(F.when(above == "", F.lit("repo")).otherwise(F.concat(F.lit("dir:"), above)).alias("source"), F.concat("kind", "id").alias("target"))


def importance(dependents: Column, area: Column) -> Column:
    return F.greatest(dependents, F.lit(1)) * F.sqrt(F.greatest(area, F.lit(1)))


def complexity(loc: Column, given: Column | None = None) -> Column:
    """The given complexity, else one more than a twelfth of the lines."""
    guess = 1 + loc / 12
    return guess if given is None else F.coalesce(given, guess)


def modules(nodes: DataFrame, group: Column | None = None) -> DataFrame:
    """(id, loc, files) of each module."""
    return nodes.groupBy((module_of(F.col("id")) if group is None else group).alias("id")).agg(F.sum("loc").cast("long").alias("loc"), F.count(F.lit(1)).alias("files"))


def lifted_edges(nodes: DataFrame, edges: DataFrame, group: Column | None = None) -> DataFrame:
    """(source, target, weight) between modules: the number, or the summed weight, of their edges."""
    home = nodes.select("id", (module_of(F.col("id")) if group is None else group).alias("group"))
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    met = edges.withColumn("w", weight).join(home.select(F.col("id").alias("source"), F.col("group").alias("s")), "source").join(home.select(F.col("id").alias("target"), F.col("group").alias("t")), "target")
    return met.filter("s <> t").groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.sum("w").cast("long").alias("weight"))


def levels(nodes: DataFrame, edges: DataFrame, groupings: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hierarchical roll-up: (level nodes, level edges, membership).

    ``groupings``: from the outermost to the innermost, a name and the group of a leaf id. A group's
    parent is the group one level out; a group that is named like a leaf or its own parent becomes
    ``<group>/(root)``. Edges carry Σ weight, a kind only where it is uniform, and the union of refs.
    """
    member = nodes.select("id", "loc", *[g.alias(f"_g{i}") for i, (_, g) in enumerate(groupings)])
    for i in range(len(groupings)):
        clash = F.col(f"_g{i}") == F.col("id")
        if i:
            clash = clash | (F.col(f"_g{i}") == F.col(f"_g{i - 1}"))
        member = member.withColumn(f"_g{i}", F.when(clash, F.concat(f"_g{i}", F.lit("/(root)"))).otherwise(F.col(f"_g{i}")))
    rows = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(name).alias("kind"), F.col(f"_g{i}").alias("group"), (F.col(f"_g{i - 1}") if i else F.lit(None).cast("string")).alias("parent")) for i, (name, _) in enumerate(groupings)])
    closure = member.select("id", "loc", F.explode(rows).alias("r")).select("id", "loc", "r.*")
    level_nodes = closure.groupBy("level", "kind", "group").agg(F.min("parent").alias("parent"), F.sum("loc").cast("long").alias("loc"), F.count(F.lit(1)).alias("leaves"))
    weight = F.coalesce(F.col("weight"), F.lit(1)) if "weight" in edges.columns else F.lit(1)
    extra = [F.col(c).alias(f"edge_{c}") for c in ("kind", "refs") if c in edges.columns]  # lists are only gathered where there are any
    plain = edges.select("source", "target", weight.alias("w"), *extra)
    a, b = closure.select(F.col("id").alias("source"), "level", F.col("group").alias("s")), closure.select(F.col("id").alias("target"), "level", F.col("group").alias("t"))
    met = plain.join(a, "source").join(b, ["target", "level"]).filter("s <> t")
    gathered = [F.sum("w").cast("long").alias("weight")]
    if "kind" in edges.columns:
        gathered.append(F.when((F.min("edge_kind") == F.max("edge_kind")) & (F.count("edge_kind") == F.count(F.lit(1))), F.min("edge_kind")).alias("kind"))
    if "refs" in edges.columns:
        gathered.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("edge_refs")))).alias("refs"))
    level_edges = met.groupBy("level", F.col("s").alias("source"), F.col("t").alias("target")).agg(*gathered)
    given = lambda c, empty: F.col(c) if c in edges.columns else empty.alias(c)
    level_edges = level_edges.select("level", "source", "target", "weight", given("kind", F.lit(None).cast("string")), given("refs", F.array().cast("array<string>")))
    return level_nodes, level_edges, closure.drop("loc")


def fold_symbol_edges(edges: DataFrame, file_of: Column, target_of: Column) -> DataFrame:
    """Symbol edges between files: self edges go, weights (1 if absent) are summed."""
    weight = F.coalesce(F.col("weight"), F.lit(1)) if "weight" in edges.columns else F.lit(1)
    met = edges.select(file_of.alias("source"), target_of.alias("target"), weight.alias("w")).filter("source <> target")
    return met.groupBy("source", "target").agg(F.sum("w").cast("long").alias("weight"))


def reweighted(nodes: DataFrame, links: DataFrame, given: Column | None = None) -> DataFrame:
    """(id, total): transitive complexity."""
    own = nodes.select("id", complexity(F.col("loc"), given).alias("complexity"))
    return graph.transitive_weights(own, links, "complexity")


def elevation(nodes: DataFrame, links: DataFrame, closed: bool = False) -> DataFrame:
    """(id, rank, height): ranks among all that entries reach, by the highest; entries import but are not imported."""
    ranks = stored(graph.entered_ranks(nodes, links, closed))
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.crossJoin(top).select("id", "rank", F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(0.0).alias("height"))


def external_importers(dependencies: DataFrame) -> DataFrame:
    """(specifier, importers) of external packages."""
    return dependencies.groupBy("specifier").agg(F.count_distinct("source").alias("importers"))


def outbound(edges: DataFrame, home: DataFrame, group: str) -> DataFrame:
    """(group, source, targets): what each node of a group links to outside that group, sorted.

    ``home``: (id, group), one row an id; targets without a group are outside of every group.
    """
    a, b = home.select(F.col("id").alias("source"), F.col(group).alias("own")), home.select(F.col("id").alias("target"), F.col(group).alias("other"))
    out = edges.join(a, "source").join(b, "target", "left").filter(~F.col("own").eqNullSafe(F.col("other")))
    return out.groupBy(F.col("own").alias(group), "source").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def realised_rate(edges: DataFrame, adjacent: DataFrame) -> DataFrame:
    """One row: the share of edges whose ends' cells touch; 1 without edges."""
    both = adjacent.select("source", "target").union(adjacent.select("target", "source")).distinct().withColumn("hit", F.lit(1))
    met = edges.join(both, ["source", "target"], "left")
    return met.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), F.lit(1.0)).alias("rate"))


def worst_change(paths: DataFrame) -> DataFrame:
    """(path, kind): the most severe change in each directory's subtree. ``paths``: (id, kind)."""
    parts = F.split("id", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    rank = F.when(F.col("kind") == "modified", 2).when(F.col("kind") == "added", 1).otherwise(0)
    top = paths.select(F.explode(above).alias("path"), rank.alias("r")).groupBy("path").agg(F.max("r").alias("r"))
    return top.select("path", F.when(F.col("r") == 2, "modified").when(F.col("r") == 1, "added").otherwise("none").alias("kind"))


def test_weight(tree: DataFrame) -> DataFrame:
    """(id, weight): Σ line spans of the test cases under each node. ``tree``: (id, parent_id, kind, start_line, end_line)."""
    leaves = tree.filter("kind = 'case'").select(F.col("id").alias("leaf"), "id", (F.col("end_line") - F.col("start_line") + 1).alias("span"))
    up = tree.select("id", "parent_id")
    out, at = leaves, leaves
    while not (at := at.join(up, "id").filter("parent_id is not null").select("leaf", F.col("parent_id").alias("id"), "span")).isEmpty():
        out = out.unionByName(at)
    return out.groupBy("id").agg(F.sum("span").cast("long").alias("weight"))


def ancestors(tree: DataFrame, wanted: Column) -> DataFrame:
    """(id, ancestor): the nearest of a node and its ancestors for which ``wanted`` holds; null where none does.

    ``tree``: (id, parent, ...), without loops; ids are unique. One join a level of the tree.
    """
    marks = settle(tree.select("id", "parent", F.coalesce(wanted, F.lit(False)).alias("hit")))
    above = marks.select(F.col("id").alias("at"), "parent", "hit")
    rows, found = marks.select("id", F.col("id").alias("at"), "parent", "hit"), None
    while not rows.isEmpty():
        hits = rows.filter("hit").select("id", F.col("at").alias("ancestor"))
        found = hits if found is None else found.unionByName(hits)
        up = rows.filter("not hit and parent is not null").select("id", F.col("parent").alias("at"))
        rows = settle(up.join(above, "at").select("id", "at", "parent", "hit"))
    return marks.select("id").join(found, "id", "left") if found is not None else marks.select("id", F.lit(None).cast("string").alias("ancestor"))


def service_levels(files: DataFrame, edges: DataFrame, services: DataFrame, flows: DataFrame, groupings: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(level nodes, level edges) below a service level, whose edges are the services' flows.

    ``services``: (id, service), at most one a file; files without one belong to ``(no service)``.
    ``flows``: (source, target, weight), one an edge; their weight is 1 where it is null.
    """
    homes = files.join(services.select("id", "service"), "id", "left").withColumn("service", F.coalesce("service", F.lit("(no service)")))
    nodes, lifted, _ = levels(homes, edges, [("service", F.col("service")), *groupings])
    native = flows.select(F.lit(0).alias("level"), "source", "target", F.coalesce("weight", F.lit(1)).cast("long").alias("weight"), F.lit("flow").alias("kind"))
    return nodes, lifted.filter("level > 0").select(*native.columns).unionByName(native)
