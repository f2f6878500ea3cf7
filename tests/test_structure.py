"""Closures, intervals, trees, blocks, chains and geometry against plain Python on small or stretched cases."""

import math
import random

import pytest

from graphloom.operators import blocks, diff, graph, intervals, kernels, layout, metrics, resolve, testtree
from tests.conftest import rows


@pytest.mark.parametrize("slab", [1 << 25, 300])
def test_closure_sums_of_a_graph_over_many_blocks(spark, monkeypatch, slab):
    monkeypatch.setattr(graph, "WORDS", 1)  # blocks of 64 columns
    monkeypatch.setattr(graph, "SLAB_ROWS", slab)
    rng = random.Random(3)
    nodes = [(f"n{i}", i % 13 + 1) for i in range(200)]
    links = list({(f"n{a}", f"n{b}") for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(260)) if a // 40 <= b // 40})
    links += [("n1", "n1"), ("n5", "gone")]
    reach = {n: {n} for n, _ in nodes}
    while True:
        before = sum(map(len, reach.values()))
        for a, b in links:
            if b in reach:
                reach[a] |= reach[b]
        if sum(map(len, reach.values())) == before:
            break
    weight = dict(nodes)
    want = sorted((n, float(sum(weight[m] for m in reach[n]))) for n in reach)
    got = graph.transitive_weights(spark.createDataFrame(nodes, "id string, w int"), spark.createDataFrame(links, "source string, target string"), "w")
    assert rows(got, "id", "total") == sorted(want, key=repr)


def test_closure_of_nothing_and_of_lone_nodes(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert graph.transitive_weights(spark.createDataFrame([], "id string, w int"), none, "w").count() == 0
    assert rows(graph.transitive_weights(spark.createDataFrame([("a", 2)], "id string, w int"), none, "w"), "id", "total") == [("a", 2.0)]


def test_component_loop_equals_the_kernel_on_small_cycles(spark):
    rng = random.Random(5)
    links = list({(rng.randrange(60), rng.randrange(60)) for _ in range(70)})
    df = spark.createDataFrame(links, "source long, target long")
    want = sorted((n, min(p), len(p)) for p in kernels.strong_components(links) for n in p)
    for limit in (0, 10**6):
        got = graph.strong_components(df, limit=limit)
        assert sorted((r["id"], r["component"], r["size"]) for r in got.collect()) == want


def test_a_chain_of_barrels_and_a_cycle(spark):
    chain = [("f0", "x", None, None, 0)] + [(f"f{i}", "*", f"f{i - 1}", None, 0) for i in range(1, 101)]
    cycle = [("a", "*", "b", None, 0), ("b", "*", "a", None, 0), ("b", "y", "f7", "x", 1), ("b", "default", "f0", "x", 2)]
    got = {(r["file"], r["name"]): (r["home"], r["original"]) for r in resolve.reexport_targets(spark.createDataFrame(chain + cycle, "file string, name string, from_file string, original string, ord int")).collect()}
    assert all(got[f"f{i}", "x"] == ("f0", "x") for i in range(101))
    assert got["a", "y"] == got["b", "y"] == ("f0", "x") and ("a", "default") not in got and len(got) == 104


def test_pieces_cover_spans_exactly(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.choice([0, 1, 5, 63, 64, 1000])) for a in (rng.randint(-200, 5000) for _ in range(80))] + [(3, 2), (None, 4)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, low int, high int")
    for r in df.select("i", "low", "high", intervals.pieces(df["low"], df["high"]).alias("p")).collect():
        got = [n for x in r["p"] or [] for n in range(x["index"] << x["level"], (x["index"] + 1) << x["level"])]
        assert sorted(got) == (list(range(r["low"], r["high"] + 1)) if r["low"] is not None and r["low"] <= r["high"] else [])


def test_interval_joins_against_brute_force(spark):
    rng = random.Random(2)
    a = [(rng.choice("xy"), s, s + rng.choice([-1, 0, 3, 40]), f"a{i}") for i, s in enumerate(rng.randint(0, 120) for _ in range(60))] + [(None, 1, 2, "null")]
    b = [(rng.choice("xy"), s, s + rng.choice([0, 1, 9, 100]), f"b{i}") for i, s in enumerate(rng.randint(0, 120) for _ in range(60))]
    one, other = spark.createDataFrame(a, "f string, low int, high int, a string"), spark.createDataFrame(b, "f string, low int, high int, b string")
    want = sorted((x[0], x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= x[2] and max(x[1], y[1]) <= min(x[2], y[2]))
    assert sorted(map(tuple, intervals.overlapping(one, other, "f", "a", "b").collect())) == want


def test_a_file_of_very_many_spans(spark):
    n = 100_000
    spans = spark.range(n).selectExpr("'f' as path", "concat('s', id) as symbol_id", "cast(id as int) as start_line", f"cast({2 * n} - id as int) as end_line", "id as ord")
    points = spark.range(n).selectExpr("'f' as file", "cast(id * 2 as int) as line")
    got = resolve.enclosing(points, spans)
    wrong = got.filter(f"symbol_id <> concat('s', least(line, {2 * n} - line, {n - 1}))")
    assert got.count() == n and wrong.count() == 0 and got.filter("symbol_id is null").count() == 0


def test_references_are_located_by_span_then_name_then_file(spark):
    symbols = spark.createDataFrame([("f", "A", "a", 5, 3, 1), ("f", "B", "b", 6, 9, 0), ("f", "C", "a", 50, 1, 2)], "path string, symbol_id string, name string, start_line int, loc int, ord int")
    asked = [("f", 5, "z"), ("f", 6, "z"), ("f", 8, "z"), ("f", 30, "a"), ("f", 30, "z"), ("g", 1, "a"), ("h", 1, "a")]
    got = resolve.located(spark.createDataFrame(asked, "file string, line int, name string"), symbols, spark.createDataFrame([("f",), ("g",)], "id string"))
    assert {(r["file"], r["line"], r["name"]): r["node"] for r in got.collect()} == dict(zip(asked, ["A", "B", "B", "A", "f", "g", None]))


def plain_tree(files):
    """Folders folded one by one, from the definition."""
    dirs = [f.split("/")[:-1] for f in files]
    shared = 0
    while all(len(d) > shared for d in dirs) and len({d[shared] for d in dirs}) == 1:
        shared += 1
    tree = {}
    for f in files:
        at = tree
        for part in f.split("/")[shared:-1]:
            at = at.setdefault(part + "/", {})
        at[f] = None
    out = []

    def walk(at, path, name, parent, root):
        while len(at) == 1 and next(iter(at)).endswith("/") and isinstance(next(iter(at.values())), dict):
            ((part, below),) = at.items()
            part = part[:-1]
            path, name, at = f"{path}/{part}" if path else part, f"{name}/{part}" if name else part, below
        own = "testroot" if root else f"testdir:{path}"
        out.append((own, "dir", name, parent))
        for part, below in at.items():
            if below is None:
                out.append((f"testfile:{part}", "file", part.split("/")[-1], own))
            else:
                walk(below, f"{path}/{part[:-1]}" if path else part[:-1], part[:-1], own, False)

    walk(tree, "", "", None, True)
    return sorted(out, key=repr)


@pytest.mark.parametrize("files", [
    ["a.ts"], ["x/y/a.ts"], ["x/a.ts", "x/b/c/d/e.ts", "x/b/c/f/g.ts"], ["p/a/b/1.ts", "p/c/2.ts", "p/c/d/3.ts"],
    ["r/1.ts", "r/" + "/".join(f"d{i}" for i in range(50)) + "/2.ts", "r/s/t/3.ts"], ["a/1.ts", "b/1.ts", "1.ts"],
])
def test_trees_of_tests(spark, files):
    got = testtree.test_tree(spark.createDataFrame([(f,) for f in [*files, files[0]]], "file string"))
    assert rows(got, "id", "kind", "name", "parent") == plain_tree(files)


def test_no_tests_no_tree(spark):
    assert testtree.test_tree(spark.createDataFrame([], "file string")).count() == 0


def test_blocks_end_at_their_brace(spark):
    text = "pub fn a() {\n  fn inner() {\n  }\n} // }\nfn b {}\nlet c = 1\n}\npub struct D { // {\n x }\nfn E::f() {\n{\n}\n  // fn g {\ntrait H {\n}"
    got = blocks.block_symbols(spark.createDataFrame([("f", text), ("g", None), ("h", "fn only")], "file string, text string"))
    assert rows(got, "file", "kind", "name", "parent_class", "exported", "start_line", "end_line") == sorted([
        ("f", "function", "a", None, True, 1, 4), ("f", "function", "b", None, False, 5, 12), ("f", "variable", "c", None, False, 6, 12),
        ("f", "class", "D", None, True, 8, 9), ("f", "method", "f", "E", False, 10, 10), ("h", "function", "only", None, False, 1, 1),
    ], key=repr)


def test_hotspots_score_cycles_and_lost_imports(spark):
    schema = "id string, loc long, fan_in long, fan_out long, in_cycle boolean"
    before = spark.createDataFrame([("a", 10, 0, 1, False), ("b", 10, 1, 0, True)], schema)
    after = spark.createDataFrame([("a", 130, 0, 1, True), ("b", 11, 1, 0, True), ("n", 200, 1, 0, False)], schema)
    lost = spark.createDataFrame([("b",), ("b",)], "id string")
    got = diff.hotspots(diff.changed_files(before, after), lost)
    assert rows(got, "id", "score", "reasons") == [("a", 36.0, ["large-growth", "new-cycle"]), ("b", 10.05, ["new-unresolved-import"]), ("n", 32.0, ["large-growth", "large-new-file", "fan-in-growth"])]


def test_elevation_of_a_cycle_behind_an_entry(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdx"], "id string")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "x")], "source string, target string")
    assert rows(metrics.elevation(nodes, links), "id", "rank", "height") == [("a", 2, 1.0), ("b", 1, 0.5), ("c", 1, 0.5), ("d", 0, 0.0), ("x", 0, 0.0)]


def test_nearest_points_far_apart(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(60)] + [(90, 900.0, 3.0), (91, -4000.0, 10.0), (92, 0.0, 0.0), (93, 0.0, 0.0)]
    want = sorted((a, *min(((x - u) ** 2 + (y - v) ** 2, b) for b, u, v in points if b != a)) for a, x, y in points)
    got = layout.nearest(spark.createDataFrame(points, "id int, x double, y double"), 2.0).collect()
    assert [(a, b) for a, b, _ in sorted((r["id"], r["neighbor"], 0) for r in got)] == [(a, b) for a, _, b in want]
    assert layout.nearest(spark.createDataFrame(points[:1], "id int, x double, y double"), 2.0).count() == 0


def test_edges_are_picked_like_one_by_one(spark):
    rng = random.Random(6)
    spot = lambda: (rng.uniform(-30, 30), rng.uniform(-30, 30))
    edges = [(f"s{i}", f"t{i}", [spot() for _ in range(rng.choice([1, 2, 2, 3]))], i) for i in range(40)] + [("up", "right", [(5.0, -9.0), (5.0, 9.0)], 40)]
    points = [(i, *spot()) for i in range(150)]

    def far(p, line):
        best = math.inf
        for (ax, ay), (bx, by) in zip(line, line[1:] or line):
            dx, dy = bx - ax, by - ay
            u = max(0.0, min(1.0, ((p[0] - ax) * dx + (p[1] - ay) * dy) / (dx * dx + dy * dy))) if dx * dx + dy * dy > 1e-12 else 0.0
            best = min(best, math.hypot(p[0] - ax - u * dx, p[1] - ay - u * dy))
        return best

    want = []
    for i, *p in points:
        (d1, o), (d2, _) = sorted((far(p, e[2]), e[3]) for e in edges)[:2]
        if d1 <= 2 and d1 <= d2 * 0.8:
            want.append((i, edges[o][0], edges[o][1]))
    df = spark.createDataFrame(edges, "source string, target string, line array<struct<x:double,y:double>>, ord int")
    got = layout.picked_edges(spark.createDataFrame(points, "id int, x double, y double"), df, 2.0, 0.8)
    assert sorted((r["id"], r["source"], r["target"]) for r in got.collect()) == want and want
