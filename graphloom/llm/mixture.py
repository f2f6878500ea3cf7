"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Rows of a source are dealt to blocks of about ``block_words`` words by a hash, which is also the
permutation in which blocks are drawn: a source's mix is as many whole passes over its blocks as its
target holds, then the leading blocks of one more pass until the target is met. How many of the drawn
blocks each output shard gets is decided by a binary tree over the shards: at each node the blocks of
every source are split between both halves by one multivariate-hypergeometric draw, so quotas are met
exactly and every shard holds a fair sample. A shard takes a consecutive, disjoint run of each
source's draws and orders its rows by a hash of its own.

Only the table of sources (one row each) is handled on the driver; ``max_sources`` bounds it and more
are an error. A source's offsets are prefix sums in two steps over its blocks (a thousand in one
group) and one step inside each block, so no group grows with the data. Reruns agree: every choice
is a hash or a seeded draw.

Defined results: null texts have size 0; a null source is a source of its own and sorts last; sources
without words get target 0; rows without words have no draws, except with ``whole``, where they are drawn
like any other row of their source (never of a source with target 0); repeated rows are separate rows, and
rows whose hashes tie are ordered by a hash of all their columns (columns must not be maps); an empty table gives no rows; all other
columns are carried along, the result being one struct column ``into``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, settle

WEIGHTS = (3, 1, 2)
GROUP = 1000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words for each source: ``share`` of all by weight, none above ``most`` times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, free = share * sum(sizes), set(range(len(sizes)))
    while free:
        total = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(sources x shards) exact block quotas from the splitting tree."""
    out = np.zeros((len(quotas), shards), np.int64)

    def node(own: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = own
            return
        middle = (low + high) // 2
        take = int(own.sum()) * (middle - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(own, take, method="marginals")
        node(left, low, middle)
        node(own - left, middle, high)

    if len(quotas):
        node(quotas.astype(np.int64), 0, shards)
    return out


def mix(
    docs: DataFrame, source: str = "source", size: Column | None = None, key: str = "doc_id", text: str = "text", shards: int = 16, seed: int = 7,
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 50_000, whole: bool = False, into: str = "mix", max_sources: int = 1_000_000,
) -> DataFrame:
    """Add ``into``: struct(size, source_size, target, taken, draws of (pass, shard, order, words)).

    With ``whole`` no row is cut: the row on the border is taken where its middle is inside.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    measured = docs.select(F.struct(*kept).alias("row"), docs[source].cast("string").alias("source"), (n_words(docs[text]) if size is None else size).alias("size"))
    hashed = measured.withColumn("hash", F.xxhash64(F.lit(seed), F.col("row").getField(key), F.col("source"), "size"))
    load = F.greatest("size", F.lit(1)) if whole else F.col("size")
    found = hashed.groupBy("source").agg(F.sum("size").alias("words"), F.sum(load).alias("load")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["words"] for r in found]
    wanted = targets(sizes, weights, share, most)
    rows = [(r["source"], s, t, max(1, -(-r["load"] // block_words)), int(t) // s if s else 0, int(t) % s if s else 0) for r, s, t in zip(found, sizes, wanted, strict=True)]
    facts = spark.createDataFrame(rows, "name string, source_size long, target double, blocks long, passes long, rest long")
    small = (lambda df: F.broadcast(df)) if len(rows) <= 100_000 else (lambda df: df)

    dealt = hashed.join(small(facts), F.col("source").eqNullSafe(F.col("name")))
    dealt = dealt.withColumn("block", F.pmod(F.col("hash"), F.col("blocks"))).drop("name")
    blocks = settle(dealt.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")))
    outer = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("source", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    grouped = blocks.withColumn("group", F.floor(F.col("block") / GROUP))
    groups = grouped.groupBy("source", "group").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"))
    groups = groups.select(F.col("source").alias("g_source"), F.col("group").alias("g"), F.coalesce(F.sum("words").over(outer), F.lit(0)).alias("words_before"), F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("n_before"))
    placed = grouped.join(groups, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("group") == F.col("g")))
    placed = settle(placed.select(
        F.col("source").alias("b_source"), F.col("block").alias("b"), (F.col("words_before") + F.coalesce(F.sum("words").over(inner), F.lit(0))).alias("block_at"),
        (F.col("n_before") + F.count(F.lit(1)).over(inner)).alias("rank"), "rest",
    ))
    drawn = {r["b_source"]: (r["n"], r["last"]) for r in placed.groupBy("b_source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("block_at") < F.col("rest"), 1)).alias("last")).collect()}
    quotas = np.array([p * drawn[name][0] + drawn[name][1] for name, _, _, _, p, _ in rows], np.int64)
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=1).tolist()
    cuts = spark.createDataFrame([(r[0], drawn[r[0]][0], e) for r, e in zip(rows, ends, strict=True)], "c_source string, source_blocks long, ends array<long>")

    within = Window.partitionBy("source", "block").orderBy("hash", "tie").rowsBetween(Window.unboundedPreceding, 0)
    lined = dealt.withColumn("tie", F.xxhash64("row")).withColumn("upto", F.sum("size").over(within))
    lined = lined.join(placed.drop("rest"), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b"))).join(small(cuts), F.col("source").eqNullSafe(F.col("c_source")))
    room = F.col("rest") - (F.col("block_at") + F.col("upto") - F.col("size"))
    inside = (room > 0) & (2 * room >= F.col("size"))
    part = F.when(inside, F.col("size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least(room, F.col("size")))
    part = F.when(room > 0, part).otherwise(F.lit(0)).cast("long")

    def draw(turn: Column) -> Column:
        at = turn * F.col("source_blocks") + F.col("rank")
        shard = F.size(F.filter("ends", lambda e: e <= at))
        words = F.when(turn < F.col("passes"), F.col("size")).otherwise(part)
        return F.struct(turn.cast("int").alias("pass"), shard.alias("shard"), F.xxhash64(F.lit(seed), shard, turn, F.col("hash")).alias("order"), words.alias("words"))

    kept_draw = (lambda d: (d["pass"] < F.col("passes")) | inside) if whole else (lambda d: d["words"] > 0)
    draws = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), draw), kept_draw)
    taken = F.col("passes") * F.col("size") + part
    result = F.struct("size", "source_size", "target", taken.alias("taken"), draws.alias("draws"))
    return lined.select("row", result.alias("__mix")).select("row.*", F.col("__mix").alias(into))


def drawn_rows(mixed: DataFrame, into: str = "mix") -> DataFrame:
    """The mix itself: every row as often as it was drawn, with its shard and its order there."""
    return mixed.withColumn("__draw", F.explode(f"{into}.draws")).withColumn(into, F.col("__draw")).drop("__draw")
