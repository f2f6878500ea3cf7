"""What joins shuffle and broadcast: counted on cases that once made far more rows than they read."""

import random

import duckdb
from pyspark.sql import functions as F

from graphloom.operators import graph, layout, metrics, query, resolve
from graphloom.plans import catalogue
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def _shuffled(spark, run):
    """Result of ``run`` and the rows that its stages wrote to shuffles."""
    context = spark.sparkContext
    store, gateway = context._jsc.sc().statusStore(), context._gateway

    def total():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    out = run()
    return out, sum(n for s, n in total().items() if s not in before)


def test_names_of_files_are_not_broadcast(spark):
    for name in ("enclosing_symbol", "hunk_overlap", "nearest_files"):
        assert "Broadcast" not in _plan(catalogue.QUERIES[name](spark, FOLDER))[1], name


def test_pairs_of_a_package_are_not_shuffled(spark):
    n = 300
    files = spark.createDataFrame([(f"a/p{i}",) for i in range(n)], "path string")
    imports = spark.createDataFrame([(f"a/p{i}", "pkg:a") for i in range(n)] * 2, "source string, spec string")
    packages = spark.createDataFrame([("pkg:a", "a")] * 2, "spec string, dir string")
    got, moved = _shuffled(spark, lambda: resolve.package_directory_edges(imports, packages, files).select("source", "target").collect())
    assert len(got) == len(set(got)) == n * (n - 1)
    assert moved < n * 40


def test_pairs_of_packages_are_stored_small(spark, tmp_path, monkeypatch):
    n = 1500
    files = spark.createDataFrame([(f"standard/brand11/p{i}.ts",) for i in range(n)], "path string")
    imports = files.select(F.col("path").alias("source"), F.lit("pkg:a").alias("spec"))
    packages = spark.createDataFrame([("pkg:a", "standard/brand11")], "spec string, dir string")
    _, moved = _shuffled(spark, lambda: resolve.package_directory_edges(imports, packages, files).select("source", "target").write.parquet(f"{tmp_path}/pairs"))
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == n * (n - 1)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").iterdir()) < n * n / 2
    assert moved < n * 12
    for name, value in (("BLOCK", 16), ("SIDE", 2), ("RUN", 5), ("TASK_PAIRS", 1000)):
        monkeypatch.setattr(resolve, name, value)
    some = imports.filter("length(source) < 24").unionByName(spark.createDataFrame([("x/y", "pkg:a"), ("x/y", "pkg:b"), ("x/y", "pkg:none")], "source string, spec string"))
    both = packages.unionByName(spark.createDataFrame([("pkg:b", "standard/brand11"), ("pkg:b", "nowhere")], "spec string, dir string"))
    got = rows(resolve.package_directory_edges(some, both, files.filter("length(path) < 25")), "source", "target", "spec")
    own, held = [f"standard/brand11/p{i}.ts" for i in range(100)], [f"standard/brand11/p{i}.ts" for i in range(1000)]
    want = [(a, b, "pkg:a") for a in own for b in held if a != b] + [("x/y", b, f"pkg:{s}") for b in held for s in "ab"]
    assert got == sorted(want, key=repr)


def test_a_name_of_many_symbols_and_qualifiers_is_met_once(spark):
    n = 400
    symbols = spark.createDataFrame([("x", f"s{i}", i % 2 == 0, f"c{i}", i) for i in range(n)] + [("y", "t", False, "c1", 0)], "name string, symbol_id string, exported boolean, parent_class string, ord int")
    wanted = spark.createDataFrame([("x", f"c{i}") for i in range(n)] + [("x", None), ("y", "c1"), ("z", None)], "name string, qualifier string")
    got, moved = _shuffled(spark, lambda: rows(resolve.preferred_export(wanted, symbols), "name", "qualifier", "symbol_id"))
    want = [("x", f"c{i}", f"s{i}" if i % 2 == 0 else "s0") for i in range(n)] + [("x", None, "s0"), ("y", "c1", None), ("z", None, None)]
    assert got == sorted(want, key=repr)
    assert moved < n * 10


def test_references_to_whole_files_meet_names_last(spark):
    symbols = [(f"f{i}", f"f{i}#{j}", f"n{j}", j, j + 3, j % 2 == 0, j) for i in range(20) for j in range(30)]
    symbols = spark.createDataFrame(symbols, "path string, symbol_id string, name string, start_line int, end_line int, exported boolean, ord int")
    refs = spark.createDataFrame([(f"f{a}", 7 if a else 99, f"f{b}") for a in range(20) for b in range(20)], "file string, line int, target_file string")
    by_name = refs.join(symbols.filter("exported").select(symbols.path.alias("target_file"), "name"), "target_file")
    want = rows(resolve.reference_edges(by_name, symbols), "from_symbol_id", "to_symbol_id")
    got, moved = _shuffled(spark, lambda: rows(resolve.file_reference_edges(refs, symbols), "from_symbol_id", "to_symbol_id"))
    assert got == want and (None, "f3#2") in got
    assert moved < len(want)


def test_crowded_points_have_their_nearest(spark):
    rng = random.Random(4)
    at = [(f"p{i:04}", rng.randrange(60) / 100, rng.randrange(60) / 100) for i in range(1500)] + [("far", 900.0, 1.0), ("farther", 999.0, 1.0)]
    got, moved = _shuffled(spark, lambda: rows(layout.nearest(spark.createDataFrame(at, "id string, x double, y double"), 1.0), "id", "neighbor", "distance2"))
    want = []
    for p, x, y in at:
        d, q = min(((x - a) * (x - a) + (y - b) * (y - b), q) for q, a, b in at if q != p)
        want.append((p, q, d))
    assert got == sorted(want, key=repr)
    assert moved < 100_000


def test_picked_edges_of_crowded_tiles(spark, monkeypatch):
    monkeypatch.setattr(layout, "TILES", 3)
    monkeypatch.setattr(layout, "GROUP", 40)
    monkeypatch.setattr(layout, "SPOTS", 30)
    rng = random.Random(9)
    spot = lambda: (rng.randrange(100) / 2, rng.randrange(100) / 2)
    edges = [(f"s{i}", f"t{i}", [dict(zip("xy", spot())) for _ in range(1 + i % 3)], i) for i in range(300)]
    edges += [("s0", "twin", edges[0][2], 1000), ("none", "none", [], 1001)]
    points = [(f"p{i}", *spot()) for i in range(250)]

    def distance(x, y, line):
        found = []
        for a, b in zip(line, line[1:] or line):
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            u = min(1.0, max(0.0, ((x - a["x"]) * dx + (y - a["y"]) * dy) / (dx * dx + dy * dy))) if dx * dx + dy * dy > 1e-12 else 0.0
            found.append((x - (a["x"] + u * dx)) ** 2 + (y - (a["y"] + u * dy)) ** 2)
        return min(found) ** 0.5

    frame = spark.createDataFrame(edges, "source string, target string, line array<struct<x: double, y: double>>, ord int")
    for most, dominance in ((2.0, 0.8), (1.0, 1.0)):
        want = []
        for p, x, y in points:
            (d, _, s, t), (e, *_) = sorted((distance(x, y, line), o, s, t) for s, t, line, o in edges if line)[:2]
            if d <= most and not d > e * dominance:
                want.append((p, s, t, round(d, 9)))
        got, moved = _shuffled(spark, lambda: layout.picked_edges(spark.createDataFrame(points, "id string, x double, y double"), frame, most, dominance).collect())  # noqa: B023
        assert sorted((r["id"], r["source"], r["target"], round(r["distance"], 9)) for r in got) == sorted(want)
        assert len(want) > 20 and moved < 60_000


def test_a_lens_over_keys_orders_equals_by_name(spark):
    links = spark.createDataFrame([(1, n) for n in range(2, 9)], "source long, target long")
    names = spark.createDataFrame([(n, f"n{9 - n}") for n in range(1, 9)], "k long, name string")
    target = spark.createDataFrame([(1,)], "id long")
    got = query.lens(links, target, 1, most=3, named=lambda df: df.join(names, df["id"] == names["k"]).select(F.col("name").alias("id"), "depth", "role"))
    assert rows(got, "id", "role") == [("n1", "dependency"), ("n2", "dependency"), ("n8", "target")]


def test_frames_of_unknown_files_take_the_first_place(spark):
    symbols = spark.createDataFrame([(1, 11, "f", 1, 2, 0, "z.ts"), (2, 12, "f", 1, 2, 0, "a.ts")], "path long, symbol_id long, name string, start_line int, end_line int, ord int, place string")
    frames = spark.createDataFrame([(None, "f", 9), (1, "f", 9), (2, "x", 2)], "file long, name string, line int")
    assert rows(resolve.frames_to_symbols(frames, symbols, "place"), "file", "symbol_id") == [(1, 11), (2, 12), (None, 12)]


def test_lines_of_unknown_parts(spark, tmp_path):
    for name in ("part", "lineitem"):
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        (df.filter("p_partkey % 5 <> 0") if name == "part" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("located_references", "resolved_frames", "bound_imports"):
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(catalogue.SQL[name])
        names = [d[0] for d in cursor.description]
        assert rows(df, *names) == sorted(cursor.fetchall(), key=repr), name


def test_small_rounds_of_a_walk_do_not_shuffle_links(spark):
    n = 3000
    links = spark.createDataFrame([(i, 2 * i + k) for i in range(n) for k in (1, 2)], "source long, target long")
    got, moved = _shuffled(spark, lambda: graph.reach(links, spark.createDataFrame([(0,)], "id long")).count())
    assert got == 2 * n
    assert moved < 8 * n


def test_hotspots_work_on_keys(spark, monkeypatch):
    kinds = []
    known = metrics.file_metrics
    monkeypatch.setattr(metrics, "file_metrics", lambda nodes, edges: kinds.append(edges.schema["source"].dataType.simpleString()) or known(nodes, edges))
    catalogue.QUERIES["hotspots"](spark, FOLDER)
    assert kinds == ["bigint"] * 2


def test_changed_files_are_named_last(spark, monkeypatch):
    kinds = []
    known = metrics.fans
    monkeypatch.setattr(metrics, "fans", lambda nodes, edges: kinds.append(edges.schema["source"].dataType.simpleString()) or known(nodes, edges))
    catalogue.QUERIES["snapshot_diff_files"](spark, FOLDER)
    assert kinds == ["bigint"] * 2


def test_metrics_of_years_do_not_shuffle_names(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    for name in ("snapshot_metrics", "metric_delta"):
        _, moved = _shuffled(spark, lambda: catalogue.QUERIES[name](spark, FOLDER).collect())  # noqa: B023
        assert moved < 2 * lines, name


def test_metrics_of_odd_years(spark, tmp_path):
    """The most imported file has no line of its own in the year, parts and line numbers are missing, a year is empty."""
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT i::BIGINT AS p_partkey, CASE WHEN i % 5 = 0 THEN 'B' ELSE 'A' END AS p_type, 'Brand#1' AS p_brand, i::INTEGER AS p_size FROM range(2, 20) r(i) WHERE i <> 6")
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_extendedprice DOUBLE, l_shipdate TIMESTAMP)")
    for order, year in [(i, 1996) for i in range(3, 9)] + [(i, 1997) for i in range(9, 12)]:
        for line, part, when in ((-1, order, year), (0, 18, 2000), (1, order + 2, year), (1, order + 2, 1996), (2, order, 1996), (3, 40, year)):
            con.execute("INSERT INTO lineitem VALUES (?, ?, ?, ?, 1.0, make_timestamp(?, 5, 1, 0, 0, 0.0))", [order, part, line % 2, line, when])
    con.execute("INSERT INTO lineitem VALUES (99, 4, 1, NULL, 1.0, TIMESTAMP '1996-03-01'), (98, 1, 1, 1, 1.0, NULL)")
    for folder, lines in (("all", "true"), ("one", "year(l_shipdate) <> 1997")):
        (tmp_path / folder).mkdir()
        con.execute(f"COPY part TO '{tmp_path}/{folder}/part.parquet' (FORMAT parquet)")
        con.execute(f"COPY (FROM lineitem WHERE {lines}) TO '{tmp_path}/{folder}/lineitem.parquet' (FORMAT parquet)")
        own = duckdb.connect()
        for name in ("part", "lineitem"):
            own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{folder}/{name}.parquet'")
        for name in ("snapshot_metrics", "metric_delta"):
            cursor = own.execute(catalogue.SQL[name])
            names = [d[0] for d in cursor.description]
            assert rows(catalogue.QUERIES[name](spark, f"{tmp_path}/{folder}"), *names) == sorted(cursor.fetchall(), key=repr), (name, folder)
