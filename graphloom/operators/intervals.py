"""Interval joins by dyadic cover: spans wait on aligned pieces, a point asks the pieces that hold it.

A piece is a level and an index: the numbers from ``index * 2^level`` to ``(index + 1) * 2^level - 1``. Every
span of whole numbers is the union of at most two disjoint pieces a level, and a number lies in one piece
of each level. So "the point lies in the span" is an equality of pieces, which holds for exactly one piece
of the span: an equi-join with twice the logarithm of the length as its cost, whatever a key holds.

Numbers may be negative; spans that end before they start cover nothing; null ends or keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces(low: Column, high: Column) -> Column:
    """Levels and indexes of the pieces that make up ``low .. high``."""
    low, high = low.cast("long"), high.cast("long")

    def at(level: Column) -> Column:
        first = -F.call_function("shiftright", -low, level)  # rounded up
        after = F.call_function("shiftright", high + 1, level)
        piece = lambda index: F.struct(level.alias("level"), index.alias("index"))
        odd = lambda n: n.bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(first < after, F.array_compact(F.array(F.when(odd(first), piece(first)), F.when(odd(after), piece(after - 1)))))

    # Above the bit length of the span's size no piece fits; the two top levels' ends meet.
    levels = F.when(low <= high, F.sequence(F.lit(0), F.length(F.bin(high - low + 1))))
    return F.flatten(F.filter(F.transform(levels, at), lambda p: p.isNotNull()))


def holders(at: Column, top: int) -> Column:
    """The piece of each level up to ``top`` that holds a number."""
    return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", at.cast("long"), level).alias("index")))


def _top(spans: DataFrame) -> int:
    """The highest level that any span uses; one number."""
    longest = spans.agg(F.max(F.col("high").cast("long") - F.col("low").cast("long") + 1)).first()[0]
    return max(longest or 1, 1).bit_length()


def _dealt(spans: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    return spans.filter("low <= high").select(key, *columns, F.explode(pieces(F.col("low"), F.col("high"))).alias("piece"))


def _asked(points: DataFrame, key: str, at: str, top: int, *columns: str | Column) -> DataFrame:
    return points.filter(F.col(at).isNotNull()).select(key, at, *columns, F.explode(holders(F.col(at), top)).alias("piece"))


def best_at(points: DataFrame, spans: DataFrame, key: str, at: str, value: str, rank: str) -> DataFrame:
    """(key, at, value) of the greatest ``rank`` among the spans (key, low, high, value, rank) that hold each point (key, at).

    Points without a span are left out. A piece keeps its best span only, so nested spans cost nothing more.
    """
    waiting = _dealt(spans, key, value, rank).groupBy(key, "piece").agg(F.max_by(F.struct(value, rank), rank).alias("best"))
    met = _asked(points.select(key, at).distinct(), key, at, _top(spans)).join(waiting, [key, "piece"])
    return met.groupBy(key, at).agg(F.max_by(f"best.{value}", f"best.{rank}").alias(value))


def containing(points: DataFrame, spans: DataFrame, key: str, at: str, point: str, span: str) -> DataFrame:
    """(key, point, span) of each point (key, at, point) and each span (key, low, high, span) that holds it."""
    return _asked(points, key, at, _top(spans), point).join(_dealt(spans, key, span), [key, "piece"]).select(key, point, span)


def overlapping(a: DataFrame, b: DataFrame, key: str, one: str, other: str) -> DataFrame:
    """(key, one, other) of the spans of ``a`` (key, low, high, one) and ``b`` (key, low, high, other) that meet.

    Of two such spans one holds the first number of the other: of equal starts ``b`` counts as the holder.
    """
    a, b = a.filter("low <= high"), b.filter("low <= high")
    inside = containing(a.select(key, F.col("low").alias("at"), one), b, key, "at", one, other)
    later = containing(b.select(key, F.col("low").alias("at"), other), a.withColumn("low", F.col("low") + 1), key, "at", other, one)
    return inside.select(key, one, other).unionByName(later.select(key, one, other))
