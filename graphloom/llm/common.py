"""What the training-data operators share: table access, durable intermediates, word splitting."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows in one Arrow batch: texts are a few kilobytes, some a hundred times that.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a scale folder, in a session whose Arrow batches suit long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset
    (a local session, as in tests) is a temporary one chosen.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared checkpoint folder.

    Like ``settle``, for loops of many rounds: a table read back has neither lineage nor what the optimiser
    derived about earlier rounds, which a checkpointed frame carries along and which doubles by rounds.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(taken: list[str], name: str = "text") -> str:
    """A column name that none of ``taken`` has, whatever their case."""
    known = {c.lower() for c in taken}
    while name in known:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(text, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), elementwise on uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
#: A fixed random 64-bit value for each byte.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        n = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def word_prints(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and 64-bit prints of the words in a byte array (all words of it at once)."""
    blank = SPACES[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(flat) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[flat] * up[: len(flat)])])
    return starts, mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
