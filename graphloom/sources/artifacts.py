"""Trace, coverage and test artifacts (JSON or folded text, one artifact a row) as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = "struct<functionName:string,url:string,lineNumber:int>"
CPU = f"struct<nodes:array<struct<id:int,callFrame:{FRAME},children:array<int>>>,samples:array<int>,timeDeltas:array<bigint>>"
V8 = "struct<result:array<struct<url:string,functions:array<struct<functionName:string,ranges:array<struct<startOffset:int,endOffset:int,count:bigint>>>>>>>"
LLVM = "struct<data:array<struct<functions:array<struct<name:string,count:bigint,filenames:array<string>,regions:array<array<bigint>>>>>>>"
ISTANBUL = "map<string,struct<path:string,fnMap:map<string,struct<name:string,line:int>>,f:map<string,bigint>>>"
REPORT = "struct<testResults:array<struct<name:string,assertionResults:array<struct<ancestorTitles:array<string>,title:string,status:string,duration:double,location:struct<line:int>,failureMessages:array<string>>>>>>"


def kind_of(text: Column) -> Column:
    """cpuprofile, v8, llvm or folded, by the document's shape."""
    has = lambda path: F.get_json_object(text, path).isNotNull()
    return F.when(has("$.nodes") & has("$.samples"), "cpuprofile").when(has("$.result[0].functions"), "v8").when(has("$.data[0].functions"), "llvm").otherwise("folded")


def relative(url: Column, root: str) -> Column:
    """A file url or absolute path below ``root`` as a repository path; null elsewhere and in dependencies."""
    plain = F.url_decode(F.replace(F.regexp_replace(url, "^file://", ""), F.lit("+"), F.lit("%2B")))
    base = root.rstrip("/") + "/"
    return F.when(plain.startswith(base) & ~plain.contains("/node_modules/"), F.substring(plain, len(base) + 1, 1 << 30))


def cpu_profile(df: DataFrame, root: str, key: str = "profile_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, samples) of cpu profiles: call tree with own samples and time, and samples in order."""
    parsed = df.select(key, F.from_json(text, CPU).alias("p"))
    flat = parsed.select(key, F.explode("p.nodes").alias("n"))
    parents = flat.select(key, F.col("n.id").alias("parent_id"), F.explode("n.children").alias("id"))
    samples = parsed.select(key, F.posexplode(F.arrays_zip(F.col("p.samples").alias("id"), F.col("p.timeDeltas").alias("delta"))).alias("seq", "s")).select(key, "seq", F.col("s.id").alias("id"), F.col("s.delta").alias("delta_us"))
    own = samples.groupBy(key, "id").agg(F.count(F.lit(1)).alias("self_samples"), F.sum("delta_us").alias("self_time_us"))
    nodes = flat.select(key, F.col("n.id").alias("id"), F.col("n.callFrame.functionName").alias("name"), relative(F.col("n.callFrame.url"), root).alias("file"), (F.col("n.callFrame.lineNumber") + 1).alias("line"))
    nodes = nodes.join(parents, [key, "id"], "left").join(own, [key, "id"], "left")
    return nodes.select(key, "id", "parent_id", "name", "file", "line", F.coalesce("self_samples", F.lit(0)).alias("self_samples"), F.coalesce("self_time_us", F.lit(0)).alias("self_time_us")), samples


def v8_coverage(df: DataFrame, root: str, text: str = "text") -> DataFrame:
    """(file, name, count) of named functions that ran."""
    files = df.select(F.explode(F.from_json(text, V8)["result"]).alias("r")).select(relative(F.col("r.url"), root).alias("file"), F.explode("r.functions").alias("f"))
    return files.select("file", F.col("f.functionName").alias("name"), F.get("f.ranges", F.lit(0))["count"].alias("count")).filter("file is not null and name <> '' and count > 0")


def demangled(name: Column) -> Column:
    """The last segment of a mangled or scoped name."""
    legacy = F.regexp_replace(name, r"17h[0-9a-f]{16}E?$", "")
    last = F.regexp_extract(legacy, r"(?:^|\d)([A-Za-z_][A-Za-z_0-9]*?)E?$", 1)
    scoped = F.element_at(F.split(F.regexp_replace(name, r"::h[0-9a-f]{16}$", ""), "::"), -1)
    return F.when(name.rlike("^_(ZN|R)"), last).otherwise(scoped)


def llvm_coverage(df: DataFrame, root: str, text: str = "text") -> DataFrame:
    """(file, name, line, count) of functions that ran."""
    rows = df.select(F.explode(F.flatten(F.transform(F.from_json(text, LLVM)["data"], lambda d: d["functions"]))).alias("f"))
    file = relative(F.get("f.filenames", F.lit(0)), root)
    return rows.select(file.alias("file"), demangled(F.col("f.name")).alias("name"), F.get(F.get("f.regions", F.lit(0)), F.lit(0)).cast("int").alias("line"), F.col("f.count").alias("count")).filter("file is not null and count > 0")


def istanbul_coverage(df: DataFrame, root: str, text: str = "text") -> DataFrame:
    """(file, name, line) of named functions that ran."""
    files = df.select(F.explode(F.from_json(text, ISTANBUL)).alias("path", "c")).select(relative(F.coalesce("c.path", "path"), root).alias("file"), F.col("c.f").alias("hits"), F.explode("c.fnMap").alias("slot", "fn"))
    return files.filter((F.try_element_at("hits", F.col("slot")) > 0) & F.col("file").isNotNull() & ~F.col("fn.name").rlike(r"^\(")).select("file", "fn.name", "fn.line")


def test_report(df: DataFrame, root: str, text: str = "text") -> DataFrame:
    """(test_id, file, name, status, duration_ms, message) of a test report."""
    files = df.select(F.explode(F.from_json(text, REPORT)["testResults"]).alias("t")).select(relative(F.col("t.name"), root).alias("file"), F.explode("t.assertionResults").alias("a"))
    status = F.when(F.col("a.status") == "passed", "pass").when(F.col("a.status") == "failed", "fail").when(F.col("a.status") == "todo", "todo").otherwise("skip")
    title = F.concat_ws(" › ", F.concat(F.coalesce("a.ancestorTitles", F.array().cast("array<string>")), F.array("a.title")))
    test_id = F.concat(F.lit("test:"), F.concat_ws(":", "file", F.coalesce(F.col("a.location.line").cast("string"), F.lit("?")), "a.title"))
    return files.select(test_id.alias("test_id"), "file", title.alias("name"), status.alias("status"), F.col("a.duration").alias("duration_ms"), F.get("a.failureMessages", F.lit(0)).alias("message"))


def symbol_dump(df: DataFrame, text: str = "line") -> DataFrame:
    """(name, kind, exported) of a compiler's symbol lines with hexadecimal tags; the low bit marks exports."""
    tag = F.conv(F.regexp_replace(F.get_json_object(text, "$.tag"), "^0[xX]", ""), 16, 10).cast("long")
    kinds = F.create_map(*[F.lit(x) for pair in {0: "function", 1: "type", 2: "trait", 3: "constant"}.items() for x in pair])
    return df.select(F.get_json_object(text, "$.name").alias("name"), F.coalesce(F.try_element_at(kinds, F.shiftright(tag, 1).bitwiseAND(F.lit(3)).cast("int")), F.lit("variable")).alias("kind"), (tag.bitwiseAND(F.lit(1)) == 1).alias("exported"))


def references(df: DataFrame, text: str = "line") -> DataFrame:
    """(path, line) of ``path:line:column`` lists, without the first location, the definition. ``df``: (query, ord, line)."""
    at = F.regexp_extract_all(F.col(text), F.lit(r"^(.*?):(\d+)(?::\d+)?"), F.lit(0))
    own = df.filter(F.size(at) > 0)
    first = own.groupBy("query").agg(F.min("ord").alias("first"))
    met = own.join(first, "query").filter("ord > first")
    return met.select("query", F.regexp_extract(text, r"^(.*?):(\d+)", 1).alias("path"), F.regexp_extract(text, r"^(.*?):(\d+)", 2).cast("int").alias("line"))
