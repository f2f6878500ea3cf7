"""URL filter rules as a sort-merge range join.

A host written with its labels reversed makes all of its subdomains share a prefix, so a rule's host
is an interval of such keys. Pages and rule openings are merged in key order: both are dealt by
ranges of the key into slices, sorted, and swept once. The sweep keeps a stack of the hosts whose
intervals are open (each nested in the one below it); a page asks the stack from the top, and each
host on it has its path prefixes at hand. A slice in the middle of an interval gets that rule too:
the hosts open at a slice's first key are the suffixes of that key's host, which an equi-join finds.

Slices are cut at quantiles of a bounded sample of (key, page) pairs, which decides balance only;
equal urls are told apart by the page id, so one host or one url may hold any share of the pages.

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule fits;
pages that no rule fits get the default verdict and a null rule; of rules that fit, the one with the
longest host, then path, wins; repeated rules with different verdicts: ``block`` wins; repeated pages
are each judged; null rule hosts or paths count as empty, and an empty host fits every host.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower

RULES = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])
#: Sampled keys for each slice boundary.
SAMPLE = 64


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    """Labels from the last to the first, each closed by U+0001, which sorts before all of them."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "\x01"), F.lit("\x01")))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", slices: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page. ``rules``: rows of (host, path, verdict)."""
    spark = pages.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    address = pages[url].cast("string")
    keyed = pages.select(pages[page_id].alias("page_id"), host_of(address).alias("host"), path_of(address).alias("path"))
    keyed = keyed.withColumn("key", reversed_key(F.col("host"))).withColumn("tie", F.xxhash64("page_id", "path"))
    sample = keyed.select("key", "tie").orderBy(F.xxhash64("key", "tie")).limit(SAMPLE * slices).collect()
    marks = sorted((r["key"].encode(), r["tie"]) for r in sample)
    cuts = sorted({marks[i * len(marks) // slices] for i in range(1, slices)}) if marks else []

    own = rules.select(F.coalesce(ascii_lower(F.col("host")), F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict"))
    own = own.groupBy("host", "path").agg(F.min_by("verdict", F.col("verdict") != "block").alias("verdict")).withColumn("key", reversed_key(F.col("host")))
    # The slices in which each rule's interval is open: the one its key falls in, and those that begin inside it.
    starts = spark.createDataFrame([(i + 1, k.decode(), p) for i, (k, _) in enumerate(cuts) for p in _open_at(k.decode())], "slice int, at string, key string")
    opened = _sliced(own.withColumn("tie", F.lit(-(1 << 63)).cast("long")), cuts)
    events = opened.unionByName(own.withColumn("tie", F.lit(-(1 << 63)).cast("long")).join(starts.select("slice", "key"), "key")).dropDuplicates(["slice", "key", "path"])
    lines = _sliced(keyed, cuts).select("slice", "key", F.lit(1).alias("kind"), "tie", "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    both = lines.unionByName(events.select("slice", "key", F.lit(0).alias("kind"), "tie", F.lit(None).cast(lines.schema["page_id"].dataType).alias("page_id"), "host", "path", "verdict"))
    schema = T.StructType([lines.schema["page_id"], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    return both.repartition(slices, "slice").sortWithinPartitions("slice", "key", "kind", "tie").mapInArrow(lambda batches: _sweep(batches, default), schema)


def _open_at(key: str) -> list[str]:
    """The keys of all hosts whose intervals contain ``key``, from the widest."""
    return [""] + [key[: i + 1] for i, c in enumerate(key) if c == "\x01"]


def _sliced(df: DataFrame, cuts: list[tuple[bytes, int]]) -> DataFrame:
    """Add the slice of each (key, tie): how many cuts lie at or before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = zip(batch.column("key").cast(pa.binary()).to_pylist(), batch.column("tie").to_pylist(), strict=True)
            found = pa.array([bisect.bisect_right(cuts, m) for m in marks], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "slice"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("slice", T.IntegerType())]))


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, str, dict[str, str], list[int]]] = []  # key, host, verdicts by path, path lengths from the longest
    at = None
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("slice", "key", "kind", "page_id", "host", "path", "verdict")), strict=True)
        out: list[tuple] = []
        for part, key, kind, page, host, path, verdict in rows:
            if part != at:
                stack, at = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, host, {}, []))
                stack[-1][2][path] = verdict
                if len(path) not in stack[-1][3]:
                    bisect.insort(stack[-1][3], len(path), key=lambda n: -n)
                continue
            rule = None
            for _, rule_host, paths, sizes in reversed(stack) if key else ():
                fit = next((path[:n] for n in sizes if path[:n] in paths and len(path) >= n), None)
                if fit is not None:
                    rule = (rule_host + fit, paths[fit])
                    break
            out.append((page, host, path, *(rule or (None, default))))
        if out:
            kinds = (batch.schema.field("page_id").type, *(pa.string(),) * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "host", "path", "rule", "verdict"])
