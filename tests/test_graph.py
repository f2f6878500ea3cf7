import random

import pytest

from graphloom.operators import graph, kernels, metrics, project, query, resolve
from graphloom.functions import ids
from pyspark.sql import functions as F

from .conftest import rows

EDGES = [("src/app/main", "src/app/util"), ("src/app/main", "src/core/lib"), ("src/app/util", "src/core/lib"), ("src/core/lib", "src/db/store")]


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame(EDGES, "source string, target string")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(n, "file", n.split("/")[-1], 10) for n in sorted({x for e in EDGES for x in e})], "id string, kind string, label string, loc long")


def one(spark, name):
    return spark.createDataFrame([(name,)], "id string")


def test_reach_gives_least_depths(spark, links):
    assert rows(graph.reach(links, one(spark, "src/app/main")), "id", "depth") == [("src/app/util", 1), ("src/core/lib", 1), ("src/db/store", 2)]
    assert rows(graph.reach(graph.reversed_links(links), one(spark, "src/db/store"), 1), "id", "depth") == [("src/core/lib", 1)]
    assert graph.reach(links, one(spark, "nowhere")).count() == 0


def test_shortest_path(spark, links):
    assert [r["id"] for r in graph.shortest_path(links, "src/app/main", "src/db/store").orderBy("step").collect()] == ["src/app/main", "src/core/lib", "src/db/store"]
    assert graph.shortest_path(links, "src/db/store", "src/app/main").count() == 0
    assert [r["id"] for r in graph.shortest_path(links, "src/db/store", "src/db/store").collect()] == ["src/db/store"]


def test_strong_components_by_kernel_and_by_loop_agree(spark):
    random.seed(5)
    edges = list({(f"n{random.randrange(24)}", f"n{random.randrange(24)}") for _ in range(34)})
    df = spark.createDataFrame(edges, "source string, target string")
    by_kernel = rows(graph.strong_components(df), "id", "component", "size", "cyclic")
    assert rows(graph.strong_components(df, limit=0), "id", "component", "size", "cyclic") == by_kernel
    reach = {n: {n} for e in edges for n in e}
    for _ in range(30):
        for a, b in edges:
            reach[a] |= reach[b]
    want = sorted(((n, min(m for m in reach[n] if n in reach[m])) for n in reach), key=repr)
    assert [r[:2] for r in by_kernel] == want


def test_transitive_weights_count_diamonds_once(spark, nodes, links):
    want = [("src/app/main", 40.0), ("src/app/util", 30.0), ("src/core/lib", 20.0), ("src/db/store", 10.0)]
    assert rows(graph.transitive_weights(nodes, links, "loc"), "id", "total") == want


def test_topo_rank_shares_cycles(spark, nodes, links):
    assert rows(graph.topo_rank(nodes, links), "id", "rank") == [("src/app/main", 3), ("src/app/util", 2), ("src/core/lib", 1), ("src/db/store", 0)]
    cyclic = links.union(spark.createDataFrame([("src/core/lib", "src/app/util")], links.schema))
    assert rows(graph.topo_rank(nodes, cyclic), "id", "rank") == [("src/app/main", 2), ("src/app/util", 1), ("src/core/lib", 1), ("src/db/store", 0)]


def test_metrics_of_a_cycle_and_an_isolated_file(spark):
    nodes = spark.createDataFrame([(n, 1) for n in "abcd"], "id string, loc long")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    got = metrics.graph_metrics(nodes, edges).first()
    assert (got["loc"], got["import_edge_count"], got["cycles"], got["largest_component"], got["max_fan_in"]) == (4, 3, 1, 3, 1)


def test_lens_keeps_its_target(spark, links):
    got = query.lens(links, one(spark, "src/core/lib"), 1)
    assert rows(got, "id", "role") == [("src/app/main", "dependent"), ("src/app/util", "dependent"), ("src/core/lib", "target"), ("src/db/store", "dependency")]
    assert "src/core/lib" in {r["id"] for r in query.lens(links, one(spark, "src/core/lib"), 1, most=1).collect()}


def test_find_ranks_exact_prefix_substring(spark):
    nodes = spark.createDataFrame([("a/store", "store"), ("a/storefront", "storefront"), ("a/restore", "restore"), ("a/x", "x")], "id string, label string")
    assert [r["label"] for r in query.find(nodes, "store").collect()] == ["store", "storefront", "restore"]


def plain_palette(q, nodes, limit=12):
    """The scores in plain Python."""
    ranks = {"symbol": 0, "block": 0, "class": 1, "file": 1, "directory": 2, "module": 3, "service": 4}

    def match(target):
        a, b, at, hits = q.strip().lower(), target.lower(), -1, 0
        if a == b or b.startswith(a) or a in b:
            return 1000 if a == b else 800 if b.startswith(a) else 600
        for c in a:
            at = b.find(c, at + 1)
            if at < 0:
                return None
            before = target[at - 1] if at else " "
            hits += not before.isalnum() or (target[at].isupper() and (before.islower() or before.isdigit()))
        return 400 + min(150, 40 * hits)

    out = []
    for node, label, kind in nodes if q.strip() else []:
        own, other = match(label), match(node)
        if own is not None or other is not None:
            out.append((node, label, kind, own if own is not None else other / 1000 * 390))
    return sorted(out, key=lambda r: (-r[3], len(r[1]), ranks.get(r[2], 9), r[0]))[:limit]


@pytest.mark.parametrize("q", ["rms", " RMS ", "map", "Rings", "a.b", "r/m", "", "  ", "zzz", "mm"])
def test_palette(spark, q):
    labels = ("RingsMapSvg", "map", "rings-map", "aMapOfMany", "Rings", "arms", "rIMmS2M", "a.b", "")
    kinds = ("service", "module", "directory", "file", "class", "symbol", "block", "other")
    nodes = [(f"src/{k}/r/{n}", n, k) for n in labels for k in kinds]
    df = spark.createDataFrame(nodes, "id string, label string, kind string")
    got = [tuple(r) for r in query.palette(df, q, 30).select("id", "label", "kind", "score").collect()]
    assert got == plain_palette(q, nodes, 30)


def test_tests_point_to_their_subjects(spark):
    ids = ["a.test.ts", "b.spec.mjs", "c_test.go", "d_wbtest.mbt", "e_test.ts", "f.test.py"]
    tests = spark.createDataFrame([(i,) for i in ids], "id string")
    sources = spark.createDataFrame([(i,) for i in ("a.ts", "b.mjs", "c.go", "d.mbt", "e.ts", "f.py")], "id string")
    edges = spark.createDataFrame([("e_test.ts", "a.ts", 1), ("e_test.ts", "c.go", 2), ("e_test.ts", "c.go", 2)], "source string, target string, ord int")
    assert rows(resolve.tested_subjects(tests, sources, edges), "test", "subject") == [("a.test.ts", "a.ts"), ("b.spec.mjs", "b.mjs"), ("c_test.go", "c.go"), ("d_wbtest.mbt", "d.mbt"), ("e_test.ts", "c.go")]


def test_outbound_of_each_group(spark):
    home = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, scope string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b"), ("c", "a"), ("b", "else"), ("else", "a")], "source string, target string")
    assert rows(metrics.outbound(edges, home, "scope"), "scope", "source", "targets") == [("x", "a", ["c"]), ("x", "b", ["else"]), ("y", "c", ["a", "b"])]


def test_interval_join_takes_the_latest_start(spark):
    symbols = spark.createDataFrame([("f", "outer", 1, 20, 0), ("f", "inner", 5, 10, 1)], "path string, symbol_id string, start_line int, end_line int, ord int")
    points = spark.createDataFrame([("f", 7), ("f", 15), ("f", 30), ("g", 1)], "file string, line int")
    assert rows(resolve.enclosing(points, symbols), "file", "line", "symbol_id") == [("f", 15, "outer"), ("f", 30, None), ("f", 7, "inner"), ("g", 1, None)]


def test_longest_prefix(spark):
    got = resolve.longest_prefix(spark.createDataFrame([("@a/b/c/d",), ("@a/b",), ("@a/bc",)], "spec string"), spark.createDataFrame([("@a/b",), ("@a",), ("@a/b/c",)], "name string"))
    assert rows(got, "spec", "package", "rest") == [("@a/b", "@a/b", ""), ("@a/b/c/d", "@a/b/c", "d"), ("@a/bc", "@a", "bc")]


def test_relative_specifiers(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("lib/c.js",)], "path string")
    imports = spark.createDataFrame([("src/x.ts", "./a"), ("src/x.ts", "./b"), ("src/x.ts", "../lib/c.js"), ("src/x.ts", "../../out"), ("src/x.ts", "react"), ("src/x.ts", "./a.js")], "source string, specifier string")
    assert rows(resolve.resolve_relative(imports, files), "specifier", "resolved") == [("../../out", None), ("../lib/c.js", "lib/c.js"), ("./a", "src/a.ts"), ("./a.js", "src/a.ts"), ("./b", "src/b/index.ts"), ("react", None)]


def test_reexports_end_in_cycles(spark):
    rows_ = [("a", "f", None, None, 0), ("b", "*", "a", None, 0), ("c", "g", "b", "f", 0), ("b", "*", "c", None, 1), ("d", "x", "d", "x", 0)]
    got = resolve.reexport_targets(spark.createDataFrame(rows_, "file string, name string, from_file string, original string, ord int"))
    assert rows(got, "file", "name", "home", "original") == [("a", "f", "a", "f"), ("b", "f", "a", "f"), ("b", "g", "a", "f"), ("c", "g", "a", "f")]


def test_levels_lift_edges(spark):
    leaves = spark.createDataFrame([("s/a/x", 1), ("s/a/y", 2), ("s/b/z", 3)], "id string, loc long")
    edges = spark.createDataFrame([("s/a/x", "s/b/z", 2, "import"), ("s/a/y", "s/b/z", 1, "call"), ("s/a/x", "s/a/y", 5, "import")], "source string, target string, weight long, kind string")
    level_nodes, level_edges, _ = metrics.levels(leaves, edges, [("module", ids.module_of(F.col("id")))])
    assert rows(level_nodes, "group", "loc", "leaves") == [("s/a", 3, 2), ("s/b", 3, 1)]
    assert rows(level_edges, "source", "target", "weight", "kind") == [("s/a", "s/b", 3, None)]


def test_symbol_cells_cover_the_rest(spark):
    files = spark.createDataFrame([("f", 10), ("g", 0)], "path string, loc long")
    symbols = spark.createDataFrame([("f", "s1", "s1", "function", 4, True)], "path string, symbol_id string, name string, kind string, loc long, exported boolean")
    assert rows(project.symbol_cells(files, symbols), "id", "loc", "exported") == [("f#rest", 6, False), ("g", 1, False), ("s1", 4, True)]


@pytest.mark.parametrize(("glob", "path", "fits"), [("src/**", "src/a/b.ts", True), ("src/*.ts", "src/a/b.ts", False), ("**/*.{ts,tsx}", "a.tsx", True), ("a?c", "abc", True), ("a?c", "a/c", False)])
def test_globs(glob, path, fits):
    import re

    assert bool(re.match(project.glob_pattern(glob), path)) == fits


def test_kernels():
    assert kernels.feedback([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")]) == [("c", "a"), ("d", "d")]
    cliques = [(a, b, 1.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 1.0)]
    found = kernels.louvain(cliques)
    assert len({found[n] for n in "abcd"}) == 1 and len({found[n] for n in "wxyz"}) == 1 and found["a"] != found["w"]
    placed = kernels.squarify([("a", 6), ("b", 6), ("c", 4), ("d", 3), ("e", 2), ("f", 2), ("g", 1), ("h", 0)], 0, 0, 6, 4)
    assert len(placed) == 7 and sum(w * h for *_, w, h in placed) == pytest.approx(24)
    draw = kernels.mulberry32(1)
    values = [draw() for _ in range(1000)]
    assert all(0 <= v < 1 for v in values) and abs(sum(values) / 1000 - 0.5) < 0.05
