"""Exact Jaccard join of n-gram sets by skipping along set relations.

A set is kept as its sorted 64-bit prints. The print space is cut into equal ranges, so a range is a
block of consecutive positions of every sorted set. Two sets of at most ``u`` members and similarity
``t`` differ in at most ``H = 2u(1-t)/(1+t)`` members, so of ``H + 1 + s`` blocks at least ``s + 1``
are equal in both. The index has one list for each block content; whole lists are skipped unless a
block is equal, and a set skips its blocks of few members where they are at most half of ``s``, so
that no list is made of sets that share little. Sets are blocked once for each class of sizes that a
partner may have, so lists also never mix sizes that cannot meet.

``set_links`` does the rest along those lists: only a list's leader is compared, and the answers of sets
similar to it are derived from the leader's, by their differences. Links that are implied by others are
not listed, but connectivity is exact: every linked pair is connected. Its defined results hold here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import set_links
from .common import mix64
from .set_links import Index, Maker, shingles

__all__ = ["block_keys", "components", "shingles", "sketch"]

#: Least bits of a sketch; larger sets have one bit a member, rounded up to a power of two.
BITS = 512


def class_starts(most: int = 1 << 40) -> list[int]:
    starts = [1]
    while starts[-1] < most:
        starts.append(max(starts[-1] + 1, starts[-1] * 13 // 10))
    return starts


STARTS = class_starts()


def families(n: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """(class, blocks, spare) for each size class of the larger set of a pair that a set of n can be in."""
    f = int(np.searchsorted(STARTS, n, "right")) - 1
    while STARTS[f] * percent <= 100 * n:
        differ = 2 * (STARTS[f + 1] - 1) * (100 - percent) // (100 + percent)
        if differ:
            spare = -(-(differ + 1) * 15 // 100)
            yield f, differ + 1 + spare, spare
        f += 1


def few_blocks(spare: int) -> int:
    """Blocks of few members that a set may skip."""
    return (spare + 1) // 2


def block_keys(members: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the index lists that a sorted set is on; the six low bits are those of the size class."""
    out = []
    mixed = mix64(members)
    top = members >> np.uint64(32)
    for f, blocks, spare in families(len(members), percent):
        where = ((top * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
        sizes = np.bincount(where, minlength=blocks)
        sums = np.zeros(blocks, np.uint64)
        filled = np.flatnonzero(sizes)
        sums[filled] = np.add.reduceat(mixed, np.concatenate([[0], np.cumsum(sizes[filled])[:-1]]))
        few = sizes < max(1, len(members) // (2 * blocks))
        keys = mix64(sums + mix64(np.arange(blocks, dtype=np.uint64) + np.uint64(f << 40)))
        keys = keys & ~np.uint64(63) | np.uint64(f & 63)
        out.append(keys[~few] if few.sum() <= few_blocks(spare) else keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(members: np.ndarray) -> np.ndarray:
    """Parities of the members in hash classes: two sets differ in at least as many as their sketches.

    A longer sketch folds to half its length by the exclusive or of its halves.
    """
    bits = max(BITS, 1 << (len(members) - 1).bit_length())
    odd = np.bincount((mix64(members) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def index_of(percent: int) -> Index:
    """Blocks as lists; sketches and sizes bound the number of differing members from below."""

    def near(x: str, y: str) -> Column:
        most = (100 - percent) * (F.col(f"{x}.size") + F.col(f"{y}.size"))  # times 100 + percent
        width = F.least(F.size(f"{x}.sketch"), F.size(f"{y}.sketch"))
        halves = lambda s: F.zip_with(F.slice(s, F.lit(1), width), F.slice(s, width + 1, width), lambda p, q: p.bitwiseXOR(q))
        p, q = (F.when(F.size(s) > width, halves(s)).otherwise(s) for s in (F.col(f"{x}.sketch"), F.col(f"{y}.sketch")))
        differ = F.aggregate(F.zip_with(p, q, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, d: n + F.coalesce(d, F.lit(0)))
        apart = F.abs(F.col(f"{x}.size") - F.col(f"{y}.size"))
        return F.when(apart * (100 + percent) <= most, differ * (100 + percent) <= most).otherwise(F.lit(False))

    return Index(lambda members: block_keys(members, percent), sketch, near)


def components(docs: DataFrame, make: Maker, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, component) of every row: set size and the least id reachable by links.

    Sets link where 100 * |x & y| >= percent * |x | y|.
    """
    return set_links.components(docs, make, index_of(percent), percent, doc_id, text)
