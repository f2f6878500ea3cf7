"""How far sources of a language are apart: exact triangular divergences of their term counts.

Terms are runs of ASCII letters and of code points beyond ASCII, A-Z lower-cased. Each language keeps the
terms of at least ``least`` of its documents. A group is a language and one of its sources; a group's
share of a kept term is a whole number of thousand-millionths, ``1 + floor(1e9 * (c + 2) / (N + 2 * V))``.

Terms with the same sparse vector of counts (their sources and how often each has them) cannot be told
apart by any pair of sources. So terms are first grouped by identical vector; every pair of sources that
a vector names is evaluated once for the vector and multiplied by the number of its terms. Pairs of which
a vector names one source only depend on that source's count alone: they are evaluated once for each
distinct (source, count), and pairs that a vector does not name once for each pair of sources. The
ranking goes back to terms: of terms with one vector only the first few by name can have a rank.

Counting is the only pass over texts; a task sums its own documents first and holds at most ``HELD``
different counts at a time. Everything after it works on (language, term) rows. Joins with the facts of
groups are broadcast only while there are at most ``BROADCAST_GROUPS`` of them.

Defined results: null texts, languages and sources are empty strings; documents without terms, also empty
ones, still make their group known; ties in value go by the item's UTF-8 bytes; repeated rows count
repeatedly; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SCALE = 1_000_000_000
#: Different (group, term) counts that a task holds before it passes them on.
HELD = 400_000
#: Groups whose facts are broadcast (each a few dozen bytes); beyond that they are joined by shuffles.
BROADCAST_GROUPS = 100_000
#: Bytes of terms as they are, A-Z lower-cased, all others blank: UTF-8 puts code points beyond ASCII into bytes from 0x80.
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """(lang, source, text) without nulls, or the first of them."""
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(name) for c, name in zip(columns, ("lang", "source", "text"), strict=False)])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, dealt by (lang, term)."""
    rows = plain(docs, lang, source, text)
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (a, b), (n, d) in seen.items():
                for terms in (list(d)[i : i + 50_000] for i in range(0, len(d), 50_000)):
                    yield pa.RecordBatch.from_pydict({"lang": [a] * len(terms), "source": [b] * len(terms), "term": terms, "n": [n[t] for t in terms], "docs": [d[t] for t in terms]}, schema=kind)
            seen.clear()

        held = 0
        for batch in batches:
            for a, b, body in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                found = Counter(body.as_py().translate(_TERMS).split())
                n, d = seen.setdefault((a, b), (Counter(), Counter()))
                held -= len(d)
                n.update(found)
                d.update(found.keys())
                held += len(d)
                if held >= HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    counted = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    # Tasks have summed already; dealt like this, sums by source and then by term need no further shuffle.
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 * (c + 2) / (N + 2V)), by decimals, as the product may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, low = wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * terms)
    return F.lit(1).cast("long") + F.call_function("div", top, F.when(low > 0, low))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both at most 1e9 + 1, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def beside(rows: DataFrame, facts: DataFrame, on: list[str], few: bool) -> DataFrame:
    return rows.join(F.broadcast(facts) if few else facts, on)


def audit(docs: DataFrame, least: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for parts ``pair`` (other sources) and ``term`` (own terms)."""
    groups = settle(plain(docs, lang, source).distinct())
    terms = term_counts(docs, lang, source, text).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    terms = settle(terms.filter(F.col("docs") >= least).select("lang", F.col("term").cast("string").alias("term"), "total", "vector"))
    vectors = terms.groupBy("lang", "vector", "total").agg(F.count(F.lit(1)).alias("m"))
    vectors = settle(vectors.withColumn("vid", F.monotonically_increasing_id()))

    langs = groups.select("lang").distinct().join(vectors.groupBy("lang").agg(F.sum("m").alias("v"), F.sum(F.col("m") * F.col("total")).alias("lang_n")), "lang", "left").na.fill(0, ["v", "lang_n"])
    cells = vectors.select("lang", "vid", "m", "total", F.explode("vector").alias("e")).select("lang", "vid", "m", "total", "e.source", "e.n")
    sums = cells.groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("group_n"))
    facts = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["group_n"]).join(langs, "lang")
    facts = settle(facts.withColumn("zero", share(F.lit(0).cast("long"), F.col("group_n"), F.col("v"))))
    few = facts.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    shared = settle(beside(cells, facts, ["lang", "source"], few).select("lang", "vid", "m", "source", "zero", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q")))

    # Pairs that a vector names: once a vector, as what they add to the value of their sources' single counts.
    named = shared.groupBy("lang", "vid", "m").agg(F.array_sort(F.collect_list(F.struct("source", "p", "zero"))).alias("own"))
    pairs = named.select("lang", "m", "own", F.posexplode("own").alias("at", "a")).select("lang", "m", "a", F.explode(F.slice("own", F.col("at") + 2, F.greatest(F.size("own") - F.col("at") - 1, F.lit(0)))).alias("b"))
    more = divergence(F.col("a.p"), F.col("b.p")) - divergence(F.col("a.p"), F.col("b.zero")) - divergence(F.col("a.zero"), F.col("b.p")) + divergence(F.col("a.zero"), F.col("b.zero"))
    both = pairs.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.sum(F.col("m") * more).alias("value"))
    both = both.union(both.select("lang", "item", "source", "value"))

    # One source's counts against the empty share of every other source: once for each distinct count.
    other = facts.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    single = shared.groupBy("lang", "source", "p", "zero").agg(F.sum("m").alias("m"))
    alone = beside(single, other, ["lang"], few).filter("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (divergence(F.col("p"), F.col("item_zero")) - divergence(F.col("zero"), F.col("item_zero")))).alias("value"))
    alone = alone.union(alone.select("lang", "item", "source", "value"))
    none = beside(facts, other, ["lang"], few).filter("source <> item").select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * divergence(F.col("zero"), F.col("item_zero"))).otherwise(0).alias("value"))
    apart = none.union(alone).union(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    # Terms: of one vector's terms only the first few by name can rank, so no source ranks more than those.
    over = shared.filter("p > q").select("lang", "vid", "source", divergence(F.col("p"), F.col("q")).alias("value"))
    nth = F.row_number().over(Window.partitionBy("lang", "vector").orderBy("term"))
    first = terms.select("lang", "vector", "term", nth.alias("nth")).filter(F.col("nth") <= top)
    first = first.join(vectors.select("lang", "vector", "vid"), ["lang", "vector"]).select("lang", "vid", "term")
    ranked = over.join(first, ["lang", "vid"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return apart.union(ranked)
