"""Projections of snapshots to graphs: files, symbol cells, symbol edges, layers, public interfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ids import basename, layer_of, parent_file, symbol_name


def file_nodes(nodes: DataFrame) -> DataFrame:
    """File rows as graph nodes: the id is the path, the label its last segment, LoC at least 1."""
    return nodes.filter(F.col("type") == "file").select(
        F.col("path").alias("id"), F.lit("file").alias("kind"), basename(F.col("path")).alias("label"), F.greatest("loc", F.lit(1)).alias("loc"), "layer"
    )


def file_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Resolved internal imports between known files; ``refs``: distinct imported symbols in first-seen order."""
    names = F.array_distinct(F.filter(F.transform("symbol_imports", lambda s: symbol_name(s["to_symbol_id"])), lambda n: n.isNotNull() & (n != "")))
    own = edges.filter((F.col("type") == "imports") & F.col("resolved") & ~F.coalesce("external", F.lit(False)))
    bare = lambda c: F.regexp_replace(c, "^file:", "")
    own = own.select(bare("src").alias("source"), bare("dst").alias("target"), F.when(F.size(names) > 0, names).alias("refs"))
    return between(own, files)


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def symbol_cells(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Cells of each file: its symbols, and a ``#rest`` cell for lines in no symbol.

    ``files``: (path, loc); ``symbols``: (path, symbol_id, name, kind, loc, exported). A file without
    symbols is one cell of its own.
    """
    inside = symbols.groupBy("path").agg(F.sum("loc").alias("covered"))
    own = symbols.select(F.col("symbol_id").alias("id"), F.col("path").alias("file"), F.col("name").alias("label"), "loc", F.coalesce("exported", F.lit(False)).alias("exported"))
    rest = files.join(inside, "path", "left").withColumn("left", F.col("loc") - F.coalesce("covered", F.lit(0)))
    rest = rest.filter("covered is null or left > 0")
    rest = rest.select(F.when(F.col("covered").isNull(), F.col("path")).otherwise(F.concat("path", F.lit("#rest"))).alias("id"), F.col("path").alias("file"), basename(F.col("path")).alias("label"), F.when(F.col("covered").isNull(), F.greatest("loc", F.lit(1))).otherwise(F.col("left")).alias("loc"), F.lit(False).alias("exported"))
    return own.unionByName(rest)


def symbol_edges(edges: DataFrame) -> DataFrame:
    """(source, target) of symbol imports: the importing symbol, else the file, to the imported symbol."""
    used = edges.filter("resolved").select(F.regexp_replace("src", "^file:", "").alias("file"), F.explode("symbol_imports").alias("s"))
    return used.select(F.coalesce("s.from_symbol_id", "file").alias("source"), F.col("s.to_symbol_id").alias("target")).filter("target is not null").distinct()


def external_dependencies(edges: DataFrame) -> DataFrame:
    return edges.filter(F.coalesce("external", F.lit(False)) & ~F.coalesce("stdlib", F.lit(False))).select(F.regexp_replace("src", "^file:", "").alias("source"), "specifier").distinct()


def split_by_layer(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(test nodes, source nodes, edges within source); other layers are in none of them."""
    stamped = nodes.withColumn("layer", layer_of(F.col("id"), F.col("layer")))
    tests, source = stamped.filter("layer = 'test'"), stamped.filter("layer = 'source'")
    return tests, source, between(edges, source)


def glob_pattern(glob: str) -> str:
    """A path glob as a pattern: ``**`` crosses slashes, ``*`` and ``?`` do not, braces are choices."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if c in r"\.[]()+^$|{}" else c
        i += 1
    return f"^{out}$"


def apply_layers(nodes: DataFrame, edges: DataFrame, layers: list[tuple[str, list[str]]], ignored: list[str]) -> tuple[DataFrame, DataFrame]:
    """Drop ignored files and edges touching them; stamp the first layer one of whose globs fits."""
    any_of = lambda globs: F.lit(False) if not globs else F.col("id").rlike("|".join(glob_pattern(g) for g in globs))
    kept = nodes.filter(~any_of(ignored))
    stamp: Column = F.lit(None).cast("string")
    for name, globs in reversed(layers):
        stamp = F.when(any_of(globs), F.lit(name)).otherwise(stamp)
    kept = kept.withColumn("layer", F.coalesce("layer", stamp)) if "layer" in nodes.columns else kept.withColumn("layer", stamp)
    return kept, between(edges, kept)


def api_graph(symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exported symbols and their edges; an end that is a file stands for its only export, if it has one.

    ``symbols``: (id, file, exported, ...); ``edges``: (source, target) of symbols or files.
    """
    public = symbols.filter("exported")
    single = public.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file"))).filter("n = 1").select(F.col("file").alias("end"), F.col("id").alias("to"))
    lift = public.select(F.col("id").alias("end"), F.col("id").alias("to")).unionByName(single)
    ends = edges.join(lift.select(F.col("end").alias("source"), F.col("to").alias("s")), "source").join(lift.select(F.col("end").alias("target"), F.col("to").alias("t")), "target")
    return public, ends.filter("s <> t").select(F.col("s").alias("source"), F.col("t").alias("target")).distinct()


def api_ports(edges: DataFrame, module: DataFrame) -> DataFrame:
    """Targets of edges that cross modules. ``module``: (id, module)."""
    a, b = module.select(F.col("id").alias("source"), F.col("module").alias("sm")), module.select(F.col("id").alias("target"), F.col("module").alias("tm"))
    return edges.join(a, "source").join(b, "target").filter("sm <> tm").select(F.col("target").alias("id")).distinct()


def selection_directions(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges around a selection with their direction; an end counts itself or through its file."""
    ids = selected.select("id").distinct()
    marked = edges
    for end in ("source", "target"):
        hit = ids.select(F.col("id").alias(f"{end}_hit"))
        direct = marked.join(hit, F.col(end) == F.col(f"{end}_hit"), "left")
        through = ids.select(F.col("id").alias(f"{end}_file"))
        marked = direct.join(through, parent_file(F.col(end)) == F.col(f"{end}_file"), "left").withColumn(f"{end}_in", F.coalesce(f"{end}_hit", f"{end}_file").isNotNull()).drop(f"{end}_hit", f"{end}_file")
    kept = marked.filter(F.col("source_in") != F.col("target_in"))
    return kept.select("source", "target", F.when(F.col("source_in"), "outgoing").otherwise("incoming").alias("direction"))


def symbol_budget(symbols: DataFrame, budget: int, ensured: DataFrame | None = None) -> DataFrame:
    """Top ``budget`` symbols by priority, the best of each ensured file besides, the rest folded.

    ``symbols``: (id, file, group, loc, priority). Folded symbols of a group become one row with id
    ``<group>/(scope)`` and their summed LoC.
    """
    top = symbols.orderBy(F.desc("priority"), "id").limit(budget).select("id").withColumn("kept", F.lit(True))
    ranked = symbols.join(top, "id", "left")
    if ensured is not None:
        best = Window.partitionBy("file").orderBy(F.desc("priority"), "id")
        files = ensured.select("file").distinct().withColumn("must", F.lit(True))
        ranked = ranked.withColumn("nth", F.row_number().over(best)).join(files, "file", "left").withColumn("kept", F.coalesce("kept", (F.col("must") & (F.col("nth") == 1)), F.lit(False)))
    else:
        ranked = ranked.withColumn("kept", F.coalesce("kept", F.lit(False)))
    shown = ranked.filter("kept").select("id", "group", "loc", F.lit(False).alias("folded"))
    rest = ranked.filter("not kept").groupBy("group").agg(F.sum("loc").alias("loc"))
    return shown.unionByName(rest.select(F.concat("group", F.lit("/(scope)")).alias("id"), "group", "loc", F.lit(True).alias("folded")))


def port_partners(edges: DataFrame, module: DataFrame) -> DataFrame:
    """(id, module): each port with the other modules that refer to it. ``module``: (id, module)."""
    a, b = module.select(F.col("id").alias("source"), F.col("module").alias("sm")), module.select(F.col("id").alias("target"), F.col("module").alias("tm"))
    return edges.join(a, "source").join(b, "target").filter("sm <> tm").select(F.col("target").alias("id"), F.col("sm").alias("module")).distinct()


def budget_priority(weight: Column, changed: Column, dx: Column | None = None, dy: Column | None = None, width: float = 1.0) -> Column:
    """Priority in a budget: √weight, less with the distance to the centre of a map of ``width``; changed symbols first.

    Where no place is known (``dx`` or ``dy`` null or not given) it is the weight itself.
    """
    boost = F.when(changed, 1e6).otherwise(0.0)
    if dx is None or dy is None:
        return weight + boost
    near = 1 / (1 + (dx * dx + dy * dy) / (0.6 * width * 0.6 * width))
    return F.coalesce(F.sqrt(weight) * near, weight.cast("double")) + boost
