"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A set's signature has ``VALUES`` symbols of 16 bits: the low bits of its least members under as many hash
functions. The distance of two signatures is the number of symbols that differ. Signatures are split into
``CHUNKS`` chunks of ``WIDTH`` symbols. By the pigeonhole principle two signatures at a distance under
``2 * CHUNKS`` have a chunk with at most one differing symbol. That one error is enumerated: each chunk is
entered under each of its symbols left out, so such a pair shares a key, and every pair under the
threshold ``DISTANCE`` is found - for the signatures there is no miss.

Symbols of two sets differ with a probability of 1 - J. For a pair at a similarity of exactly 0.8 the
number of 160 symbols that differ has the mean 32; it passes 63 with a probability of 5.4e-9 (and far less
for more similar pairs; ``miss`` gives the value for any threshold). That is the only way to lose a link.
Thresholds for which it is over 1e-6 are refused.

Keys are the lists of ``set_links``: equal sets are one from the start, only a list's leader is compared
with the others, first by the distance of signatures, and what stays open is dealt anew. Each link is
confirmed on the full sets. The defined results of ``set_links`` hold here.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import set_links
from .common import mix64
from .set_links import Index, Maker, shingles

__all__ = ["chunk_keys", "components", "miss", "shingles", "signature"]

CHUNKS, WIDTH = 32, 5
VALUES = CHUNKS * WIDTH
#: Largest distance of signatures that are compared further: one less than two errors in every chunk.
DISTANCE = 2 * CHUNKS - 1
#: Members that are hashed at once by all functions.
STEP = 1024
_FACTORS = mix64(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
#: Factors of a key's symbols; one row a left-out place, which counts as nothing.
_PLACES = mix64(np.arange(1000, 1000 + WIDTH, dtype=np.uint64)) | np.uint64(1)
_LEFT = np.where(np.eye(WIDTH, dtype=bool), np.uint64(0), _PLACES[None, :])
_NAMES = mix64(np.arange(2000, 2000 + VALUES, dtype=np.uint64)).reshape(CHUNKS, WIDTH)
#: The lowest bit of each of the four symbols in a long.
_LOWEST = 0x0001000100010001


def symbols(members: np.ndarray) -> np.ndarray:
    """16 bits of the least member under each hash function (the product's high bits decide)."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(members), STEP):
        np.minimum(low, (members[None, i : i + STEP] * _FACTORS[:, None]).min(axis=1), out=low)
    return (mix64(low) & np.uint64(0xFFFF)).astype(np.uint16)


def signature(members: np.ndarray) -> np.ndarray:
    """The symbols, four in a long."""
    return symbols(members).view(np.int64)


def chunk_keys(members: np.ndarray) -> np.ndarray:
    """One key for each chunk and each of its places left out."""
    chunks = symbols(members).astype(np.uint64).reshape(CHUNKS, WIDTH) + np.uint64(1)
    return mix64((mix64(chunks)[:, None, :] * _LEFT[None, :, :]).sum(axis=2, dtype=np.uint64) + _NAMES).ravel()


def miss(percent: int, distance: int = DISTANCE, values: int = VALUES) -> float:
    """Probability that a pair at exactly this similarity is farther than ``distance``."""
    p = 1 - percent / 100
    return sum(comb(values, i) * p**i * (1 - p) ** (values - i) for i in range(distance + 1, values + 1))


def differing(x: Column, y: Column) -> Column:
    """Number of symbols that differ."""

    def mark(v: Column) -> Column:  # the lowest bit of each symbol tells whether any of its bits is set
        for step in (8, 4, 2, 1):
            v = v.bitwiseOR(F.shiftrightunsigned(v, step))
        return F.bit_count(v.bitwiseAND(F.lit(_LOWEST)))

    return F.aggregate(F.zip_with(x, y, lambda p, q: mark(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + F.coalesce(d, F.lit(0)))


def index_of(percent: int) -> Index:
    def near(x: str, y: str) -> Column:
        apart = F.abs(F.col(f"{x}.size") - F.col(f"{y}.size"))
        sizes = apart * (100 + percent) <= (100 - percent) * (F.col(f"{x}.size") + F.col(f"{y}.size"))
        return F.when(sizes, differing(F.col(f"{x}.sketch"), F.col(f"{y}.sketch")) <= DISTANCE).otherwise(F.lit(False))

    return Index(chunk_keys, signature, near)


def components(docs: DataFrame, make: Maker, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, component) of every row: set size and the least id reachable by links.

    Sets link where 100 * |x & y| >= percent * |x | y|; ``percent`` is at least what ``miss`` allows (78).
    """
    if miss(percent) > 1e-6:
        raise ValueError(f"signatures of {VALUES} symbols miss pairs at {percent} percent with a probability of {miss(percent):.1e}")
    return set_links.components(docs, make, index_of(percent), percent, doc_id, text)
