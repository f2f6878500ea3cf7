"""Graphs of many undirected components, whose facts are found component by component."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, kernels, metrics
from tests.conftest import rows


def _islands(n, seed):
    """(weights, links) of ``n`` islands of nine nodes each, with cycles, diamonds and self links."""
    rng = random.Random(seed)
    links = [(9 * i + rng.randrange(9), 9 * i + rng.randrange(9)) for i in range(n) for _ in range(rng.randint(1, 12))]
    return {i: i % 7 + 1 for i in range(9 * n)}, links


@pytest.fixture
def islands(spark):
    weights, links = _islands(40, 2)
    nodes = spark.createDataFrame(list(weights.items()), "id long, w int")
    return weights, links, nodes, spark.createDataFrame(links, "source long, target long").repartition(3)


def _fail(*_, **__):
    raise AssertionError("small components need no loop of joins")


def test_many_small_components_need_no_loops(islands, monkeypatch):
    weights, links, nodes, df = islands
    for name in ("_components_by_colour", "dag_ranks", "closure_sums"):
        monkeypatch.setattr(graph, name, _fail)
    monkeypatch.setattr(graph, "KERNEL_EDGES", 12)  # the whole has more links, each component has at most twelve
    monkeypatch.setattr(graph, "CHUNK", 16)
    want = sorted((n, min(p), len(p), len(p) > 1 or (n, n) in links) for p in kernels.strong_components(links) for n in p)
    assert sorted(tuple(r) for r in graph.strong_components(df, limit=12).select("id", "component", "size", "cyclic").collect()) == want
    closure = {n: float(t) for n, t in kernels.closure_weights(weights, links).items()}
    assert {r["id"]: r["total"] for r in graph.transitive_weights(nodes, df, "w").collect()} == closure
    home = {n: i for i, p in enumerate(kernels.strong_components([*links, *((n, n) for n in weights)])) for n in p}
    rank = [0] * len(weights)
    for a, b in sorted(((home[a], home[b]) for a, b in links if home[a] != home[b])):
        rank[a] = max(rank[a], rank[b] + 1)
    assert {r["id"]: r["rank"] for r in graph.topo_rank(nodes, df, limit=12).collect()} == {n: rank[home[n]] for n in weights}


def test_large_and_small_components_together(islands, monkeypatch):
    weights, links, nodes, df = islands
    monkeypatch.setattr(graph, "CLOSURE_NODES", 4)
    closure = {n: float(t) for n, t in kernels.closure_weights(weights, links).items()}
    assert {r["id"]: r["total"] for r in graph.transitive_weights(nodes, df, "w").collect()} == closure


def test_entered_ranks_by_kernel_and_by_loop_agree(islands):
    weights, links, nodes, df = islands
    by_kernel = rows(graph.entered_ranks(nodes, df), "id", "rank")
    assert rows(graph.entered_ranks(nodes, df, limit=6), "id", "rank") == by_kernel


@pytest.mark.parametrize("chunk", [2, 1 << 20])
def test_weak_components_across_stars(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    links = [(f"n{i}", f"n{i + 1}") for i in range(40) if i % 10 != 9] + [("x", "x")]
    random.Random(1).shuffle(links)
    got = {r["id"]: r["component"] for r in graph.weak_components(spark.createDataFrame(links, "source string, target string").repartition(4)).collect()}
    want = {f"n{i}": min(f"n{j}" for j in range(i // 10 * 10, i // 10 * 10 + 10)) for i in range(40)} | {"x": "x"}
    assert got == want


def test_fans_of_repeated_and_missing_links(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "gone")], "source string, target string")
    assert rows(metrics.fans(nodes, edges), "id", "fan_in", "fan_out") == [("a", 1, 3), ("b", 2, 1), ("c", 0, 0)]


def test_level_edges_without_lists_gather_none(spark):
    nodes = spark.createDataFrame([("a/x", 1), ("b/y", 2)], "id string, loc long")
    links = spark.createDataFrame([("a/x", "b/y")] * 3, "source string, target string")
    found = metrics.levels(nodes, links, [("scope", F.split_part("id", F.lit("/"), F.lit(1)))])[1]
    assert [tuple(r) for r in found.collect()] == [(0, "a", "b", 3, None, [])]
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_strong_components_around_a_pivot(spark):
    rng = random.Random(5)
    edges = [(10 * g + rng.randrange(60) * 1000, 10 * g + rng.randrange(60) * 1000) for g in range(3) for _ in range(70)]
    edges += [(i, i + 7) for i in range(10**6, 10**6 + 70)] + [(-1, -1), (-1, -2), (-3, -2), (-3, -4), (-4, -3)]
    parts = kernels.strong_components(edges)
    loops = {a for a, b in edges if a == b}
    want = sorted((n, min(p), len(p), len(p) > 1 or n in loops) for p in parts for n in p)
    assert len({len(p) for p in parts}) > 2
    df = spark.createDataFrame(edges, "source long, target long")
    for limit in (4, 40):
        got = graph.strong_components(df, limit)
        assert rows(got, "id", "component", "size", "cyclic") == sorted(want, key=repr)


def test_a_dense_component_needs_no_rounds_of_colours(spark, monkeypatch):
    monkeypatch.setattr(graph, "_components_by_colour", _fail)
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(400)] + [(100, 0), (0, 200)]
    want = sorted((n, len(p)) for p in kernels.strong_components(edges) for n in p)
    assert rows(graph.strong_components(spark.createDataFrame(edges, "source long, target long"), 40), "id", "size") == sorted(want, key=repr)


@pytest.mark.parametrize("some", [4, 1 << 21])
def test_shapes_by_arrays_and_by_joins_agree(spark, islands, monkeypatch, some):
    weights, links, _, _ = islands
    monkeypatch.setattr(kernels, "SOME", some)
    years = {1: [*links, *links[:50]], 2: [(i, i + 1) for i in range(300)] + [(300, 0), (40, 7), (9, 9), (350, 351), (9999, 1), (5, -3)], 3: [(9, 900), (901, 9)]}
    nodes = spark.createDataFrame([(n,) for n in weights] + [(None,)], "id long")
    frame = spark.createDataFrame([(y, a, b) for y, own in years.items() for a, b in own], "year int, source long, target long")
    want = []
    for y, own in years.items():
        known = {(a, b) for a, b in own if a in weights and b in weights}
        home = {n: n for link in known for n in link}
        for _ in home:
            for a, b in known:
                home[a] = home[b] = min(home[a], home[b])
            if all(home[a] == home[b] for a, b in known):
                break
        most = lambda ends: max((ends.count(n) for n in set(ends)), default=None)
        cycles = sum(len(p) > 1 or (p[0], p[0]) in known for p in kernels.strong_components(known))
        want.append((y, len(known), most([b for _, b in known]), most([a for a, _ in known]), cycles, most(list(home.values())) or 1))
    columns = ("year", "links", "fan_in", "fan_out", "cycles", "largest")
    assert rows(graph.shape(nodes, frame, "year"), *columns) == want[:2]
    monkeypatch.setattr(graph, "SHAPE_BYTES", 0)
    assert rows(graph.shape(nodes, frame, "year"), *columns) == want[:2]
    assert rows(graph.shape(nodes.limit(0), frame, "year"), *columns) == []
