import json

from pyspark.sql import functions as F

from graphloom.functions import ids, text
from graphloom.operators import diff, layout, services, traces
from graphloom.sources import artifacts, git, sinks
from graphloom.streaming import changes

from .conftest import rows


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def test_status_and_hunks(spark):
    got = git.status(texts(spark, " M a.ts\n?? b.ts\nR  c.ts -> d.ts\n D e.ts\nx"))
    assert rows(got, "path", "kind") == [("a.ts", "modified"), ("b.ts", "added"), ("c.ts", "removed"), ("d.ts", "added"), ("e.ts", "removed")]
    patch = "+++ b/x\n@@ -10,2 +10,4 @@\n@@ -30 +32,0 @@\n+++ /dev/null\n@@ -1 +1 @@\n+++ b/y\n@@ -1 +1 @@\n"
    got = git.hunks(texts(spark, patch, "")).select("*", git.touched_lines(F.col("new_lines"), F.col("old_lines")).alias("touched"))
    assert rows(got, "path", "old_start", "old_lines", "new_start", "new_lines", "touched") == [("x", 10, 2, 10, 4, 4), ("x", 30, 1, 32, 0, 1), ("y", 1, 1, 1, 1, 1)]


def test_name_status_and_numstat(spark):
    got = git.name_status(texts(spark, "R100\ta.ts\tb.ts\nC75\tc.ts\tc2.ts\nD\td.ts\nM\te.ts\n"))
    assert rows(got, "path", "kind") == [("a.ts", "removed"), ("b.ts", "added"), ("c2.ts", "added"), ("d.ts", "removed"), ("e.ts", "modified")]
    got = git.numstat(texts(spark, "3\t1\tsrc/a.ts\n-\t-\timg.png\n5\t0\tsrc/{old => new}/x.ts\n0\t2\ta.ts => b.ts\n"))
    assert rows(got, "path", "added", "deleted") == [("b.ts", 0, 2), ("src/a.ts", 3, 1), ("src/new/x.ts", 5, 0)]


def test_hunks_of_many_files_and_of_none(spark):
    parts = "".join(f"diff --git a/f{i} b/f{i}\n--- a/f{i}\n+++ b/f{i}\t2020\r\n@@ -{i} +{i},2 @@ f()\r\n+x\r\n" for i in range(1, 500))
    got = rows(git.hunks(texts(spark, parts, None, "@@ -1 +1 @@\n", "x +++ b/y\n@@ -1 +1 @@\n")), "path", "old_start", "old_lines", "new_start", "new_lines")
    assert got == sorted([(f"f{i}", i, 1, i, 2) for i in range(1, 500)], key=repr)


def test_comet_keeps_planes_apart(spark):
    steps = spark.createDataFrame([(1, 1, "a"), (1, 3, "a"), (1, 2, "b"), (2, 3, "b"), (2, 4, "a")], "plane int, step int, symbol_id string")
    got = {(r["plane"], r["symbol_id"]): r["heat"] for r in traces.comet(steps, 3, trail=1, decay=0.5).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 0.5, (2, "b"): 1.0}


def test_since(spark):
    df = spark.createDataFrame([("6.months",), ("2 weeks",), ("2024-01-01",)], "s string").select(text.since(F.col("s")).alias("s"))
    assert rows(df, "s") == [("2 weeks ago",), ("2024-01-01",), ("6 months ago",)]


def test_line_counts(spark):
    df = texts(spark, "", "a", "a\n", "a\r\nb", "\n\n").select(text.count_loc(F.col("text")).alias("n"))
    assert [r["n"] for r in df.collect()] == [0, 1, 1, 2, 2]


def test_ids(spark):
    df = spark.createDataFrame([("symbol:a/b.ts:function:f:12",), ("a/b.ts#rest",), ("a/b.ts",)], "id string")
    assert [tuple(r) for r in df.select(ids.parent_file(F.col("id")), ids.line_of(F.col("id"))).collect()] == [("a/b.ts", 12), ("a/b.ts", 1), ("a/b.ts", 1)]
    df = spark.createDataFrame([("x.ts",), ("a/x.ts",), ("a/b/c/x.ts",), ("tests/x.ts",), ("a/x.spec.ts",)], "id string")
    assert [tuple(r) for r in df.select(ids.module_of(F.col("id")), ids.layer_of(F.col("id"))).collect()] == [("(root)", "source"), ("a", "source"), ("a/b", "source"), ("tests", "test"), ("a", "test")]


def test_timeline_charges_unknown_frames_to_the_open_step(spark):
    samples = [("p", 0, None, 100), ("p", 1, "foo", 100), ("p", 2, "foo", 100), ("p", 3, None, 50), ("p", 4, "bar", 100), ("p", 5, "foo", 10)]
    got = traces.timeline(spark.createDataFrame(samples, "plane string, seq int, symbol_id string, slice_us long"))
    assert rows(got, "step", "symbol_id", "t_us", "dur_us") == [(1, "foo", 100, 250), (2, "bar", 350, 100), (3, "foo", 450, 10)]


def test_folded_stacks(spark):
    nodes, edges = traces.folded_stacks(spark.createDataFrame([("a;b;c 5",), ("a;b 3",), ("nonsense",)], "line string"))
    assert rows(nodes, "name", "self_samples") == [("a", 0), ("b", 3), ("c", 5)]
    assert rows(edges, "source", "target", "count") == [("a", "b", 8), ("b", "c", 5)]


def test_cpu_profile(spark):
    frame = lambda name: {"functionName": name, "url": "file:///r/src/a.ts", "lineNumber": 4}
    profile = {"nodes": [{"id": 1, "callFrame": frame("main"), "children": [2]}, {"id": 2, "callFrame": frame("f")}], "samples": [1, 2, 2], "timeDeltas": [5, 10, 20]}
    df = spark.createDataFrame([("p", json.dumps(profile))], "profile_id string, text string")
    nodes, _ = artifacts.cpu_profile(df, "/r")
    assert rows(nodes, "name", "file", "line", "self_samples", "self_time_us") == [("f", "src/a.ts", 5, 2, 30), ("main", "src/a.ts", 5, 1, 5)]
    assert rows(traces.inclusive_tree(nodes), "id", "total_samples") == [(1, 3), (2, 2)]


def test_test_report(spark):
    report = {"testResults": [{"name": "/r/a.test.ts", "assertionResults": [{"ancestorTitles": ["s"], "title": "t", "status": "passed", "duration": 1.0, "location": {"line": 3}}, {"ancestorTitles": [], "title": "u", "status": "pending"}]}]}
    got = artifacts.test_report(texts(spark, json.dumps(report)), "/r")
    assert rows(got, "test_id", "name", "status") == [("test:a.test.ts:3:t", "s › t", "pass"), ("test:a.test.ts:?:u", "u", "skip")]


def test_services(spark):
    resources = [("fn.a", "aws_lambda_function", "a", None), ("fn.b", "aws_lambda_function", "b", None), ("q", "aws_sqs_queue", "q", None), ("m", "aws_lambda_event_source_mapping", "m", None), ("t", "aws_dynamodb_table", "t", None)]
    refs = [("fn.a", "env.URL", "q"), ("m", "event_source_arn", "q"), ("m", "function_name", "fn.b"), ("fn.b", "env.T", "t"), ("fn.b", "env.A", "fn.a")]
    assigned = services.assign(spark.createDataFrame(resources, "address string, type string, name string, module string"))
    df = spark.createDataFrame(refs, "address string, attr string, ref_address string")
    assert rows(services.service_edges(assigned, df), "source", "target", "kind", "weight") == [("fn.a", "fn.b", "queue", 1), ("fn.b", "fn.a", "depends", 1)]
    assert rows(services.store_edges(assigned, df), "service", "store") == [("fn.b", "t")]


def test_hotspots(spark):
    schema = "id string, loc long, fan_in long, fan_out long, in_cycle boolean"
    before = spark.createDataFrame([("a", 20, 0, 0, False), ("b", 20, 0, 0, False)], schema)
    after = spark.createDataFrame([("a", 150, 1, 1, True), ("b", 20, 0, 0, False), ("c", 140, 1, 1, True)], schema)
    changes_ = diff.changed_files(before, after)
    assert rows(changes_, "id", "change", "loc_delta") == [("a", "modified", 130), ("c", "added", 140)]
    assert rows(diff.hotspots(changes_), "id", "score") == [("a", 40.5), ("c", 61.0)]


def test_signature_ignores_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, loc long")
    e = spark.createDataFrame([("x", "y")], "source string, target string")
    assert diff.signature(a, e).collect() == diff.signature(a.orderBy(F.desc("id")), e).collect()
    assert diff.signature(a, e).collect() != diff.signature(a.filter("id = 'x'"), e).collect()


def test_geometry(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    got = spark.range(1).select(layout.signed_area(ring).alias("a"), layout.centroid(ring).alias("c"), layout.contains(ring, F.lit(1.0), F.lit(1.0)).alias("i"), layout.contains(ring, F.lit(5.0), F.lit(1.0)).alias("o")).first()
    assert (got["a"], tuple(got["c"]), got["i"], got["o"]) == (8.0, (2.0, 1.0), True, False)


def test_flowchart(spark):
    changed = spark.createDataFrame([("a<b", "added")], "id string, change string")
    links = spark.createDataFrame([("a<b", "c")], "source string, target string")
    assert sinks.flowchart(changed, links).splitlines() == ["flowchart LR", '  n0["a&lt;b"]:::added', '  n1["c"]', "  n0 --> n1"]


def test_distinct_until_changed_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"k": "x", "content": c, "dirty": d}) for c, d in [("1", False), ("1", False), ("1", True), ("2", False)]))
    stream = spark.readStream.schema("k string, content string, dirty boolean").json(str(source))
    query = changes.distinct_until_changed(stream, "k", "content", "dirty").writeStream.format("memory").queryName("changed").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert [r["content"] for r in spark.table("changed").collect()] == ["1", "1", "2"]


def test_debounce_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"k": "x", "ts": f"2024-01-01T00:00:0{s}Z"}) for s in ("0.0", "0.2", "0.4", "2.0", "9.0")))
    stream = spark.readStream.schema("k string, ts timestamp").json(str(source))
    query = changes.debounced(stream, "k").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert sorted(r["events"] for r in spark.table("bursts").collect()) == [1, 3]


def test_refreshed_parse_table(spark):
    listing = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "path string, mtime long, size long")
    parsed = spark.createDataFrame([("a", 1, 1, "old"), ("b", 1, 1, "old"), ("gone", 1, 1, "old")], "path string, mtime long, size long, result string")
    got = changes.refreshed(listing, parsed, lambda df: df.withColumn("result", F.lit("new")))
    assert rows(got, "path", "result") == [("a", "old"), ("b", "new")]
