"""Small cases of import edges, ancestors, diff details, previews and budgets."""

from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.operators import diff, layout, metrics, project, query, resolve
from tests.conftest import rows


def test_import_edges_tell_files_packages_and_the_rest(spark):
    imports = spark.createDataFrame([("a/x.ts", "./y"), ("a/x.ts", "./y"), ("a/x.ts", "./no"), ("a/x.ts", "pkg/sub/z"), ("a/x.ts", "pkg"), ("a/x.ts", "other")], "source string, specifier string")
    files = spark.createDataFrame([("a/x.ts",), ("a/y.ts",), ("pkg/index.ts",)], "path string")
    packages = spark.createDataFrame([("pkg", "pkg/index.ts"), ("pkg/sub", "pkg/gone.ts")], "name string, entry string")
    got = rows(resolve.import_edges(imports, files, packages), "target", "specifier", "resolved", "external")
    # The longest package decides, even where its entry is no file.
    assert got == sorted([("file:a/y.ts", "./y", True, False), ("unresolved:a/x.ts:./no", "./no", False, False), ("external:pkg/sub/z", "pkg/sub/z", True, True), ("file:pkg/index.ts", "pkg", True, False), ("external:other", "other", True, True)], key=repr)
    assert resolve.import_edges(imports.limit(0), files, packages).count() == 0


def test_merged_symbol_imports_keep_the_first_of_new_pairs(spark):
    kind = "from_symbol_id string, to_symbol_id string, ord long"
    known = spark.createDataFrame([(None, "t", 0), ("f", "t", 1)], kind)
    added = spark.createDataFrame([(None, "t", 2), ("g", "t", 4), ("g", "t", 3), (None, "u", 5)], kind)
    assert rows(resolve.merged_symbol_imports(known, added), "from_symbol_id", "to_symbol_id", "ord") == sorted([(None, "t", 0), ("f", "t", 1), ("g", "t", 3), (None, "u", 5)], key=repr)


def test_ancestors_stop_at_the_nearest(spark):
    tree = spark.createDataFrame([("f", "d", "file"), ("d", "m", "dir"), ("m", None, "module"), ("lone", "gone", "file")], "id string, parent string, kind string")
    assert rows(metrics.ancestors(tree, F.col("kind") == "module"), "id", "ancestor") == sorted([("f", "m"), ("d", "m"), ("m", "m"), ("lone", None)], key=repr)
    assert rows(metrics.ancestors(tree, F.col("kind") == "service"), "ancestor") == [(None,)] * 4
    assert metrics.ancestors(tree.limit(0), F.col("kind") == "module").count() == 0


def test_details_fall_back_to_whole_added_files(spark):
    changed = spark.createDataFrame([("new", "added", 7), ("old", "modified", 9), ("bare", "modified", 5), ("void", "added", None)], "path string, kind string, loc long")
    counts = spark.createDataFrame([("old", 2, 3), ("elsewhere", 1, 1)], "path string, added long, deleted long")
    hunks = spark.createDataFrame([("old", 4, 3, 4, 0), ("elsewhere", 1, 1, 1, 1)], "path string, old_start long, old_lines long, new_start long, new_lines long")
    stats, kept = diff.details(changed, counts, hunks)
    assert rows(stats, "path", "added", "deleted", "touched") == [("new", 7, 0, 7), ("old", 2, 3, 3), ("void", 0, 0, 0)]
    assert rows(kept, "path", "new_start", "new_lines") == [("new", 1, 7), ("old", 4, 0)]


def test_estimates_previews_and_recent_changes(spark):
    changes = spark.createDataFrame([("a", "added", 10), ("m", "modified", 10), ("n", "modified", None)], "path string, kind string, total long")
    assert rows(diff.estimated_stats(changes), "path", "added", "touched", "total", "ratio") == [("a", 10, 10, 10, 1.0), ("m", 0, 2, 10, 0.18), ("n", 0, 1, 1, 0.18)]
    symbols = spark.createDataFrame([("s1", "a/b/x"), ("s2", "a/b/x"), ("s3", "y")], "id string, file string")
    shown = diff.preview_focus(spark.createDataFrame([("y",)], "id string"), symbols.filter("id = 's1'"), symbols)
    assert rows(shown, "kind", "id") == [("file", "a/b/x"), ("file", "y"), ("module", "(root)"), ("module", "a/b"), ("symbol", "s1"), ("symbol", "s3")]
    seen = spark.createDataFrame([("a", "added", 1, 0), ("a", "modified", 2, 1), ("b", "added", 2, 0)], "id string, kind string, at long, pos long")
    assert [(r.id, r.kind) for r in diff.recent_changes(seen).collect()] == [("b", "added"), ("a", "modified")]
    assert [r.id for r in diff.recent_changes(seen, 1).collect()] == ["b"]


def test_kinds_fills_priorities_and_adjacency(spark):
    nodes = spark.createDataFrame([("symbol:a.ts:function:f:3",), ("symbol:a.ts:thing:f:3",), ("a.ts",), (None,)], "id string")
    assert rows(nodes.select(ids.symbol_kind(F.col("id")).alias("kind")), "kind") == sorted([("function",), (None,), (None,), (None,)], key=repr)
    marks = spark.createDataFrame([(None, True, True), (None, None, True), (None, None, None)], "d boolean, u boolean, c boolean")
    assert rows(marks.select(query.leaf_fill(F.col("d"), F.col("u"), F.col("c"), F.lit(False)).alias("fill"), query.focus_dim(F.col("u")).alias("dim")), "fill", "dim") == [("cycle", 1.0), ("dependent", 1.0), ("tint", 1.0)]
    weights = spark.createDataFrame([(4.0, True, 0.0, 0.0), (4.0, None, None, 0.0)], "w double, changed boolean, x double, y double")
    assert rows(weights.select(project.budget_priority(F.col("w"), F.col("changed"), F.col("x"), F.col("y"), 10.0).alias("p")), "p") == [(1000002.0,), (4.0,)]
    cells = spark.createDataFrame([("a",), ("b",)], "id string")
    borders = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", None), ("a", "gone")], "id string, neighbor string")
    assert rows(layout.adjacency(cells, borders), "id", "neighbor") == [("a", "b"), ("b", "a")]
