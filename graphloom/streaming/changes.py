"""Change feeds as structured streams: trailing debounce, distinct until changed, incremental analysis."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Paths that a watcher passes over (a fixed pattern).
IGNORED = r"(^|/)(\.git|node_modules|dist|build|coverage|\.cache)(/|$)"


def watched(events: DataFrame, path: str = "path") -> DataFrame:
    return events.filter(~F.col(path).rlike(IGNORED))


def debounced(events: DataFrame, key: str, ts: str = "ts", gap: str = "300 milliseconds") -> DataFrame:
    """One row for each burst of a key, closed once nothing has come for ``gap``; later events are dropped."""
    bursts = events.withWatermark(ts, gap).groupBy(key, F.session_window(ts, gap).alias("burst"))
    return bursts.agg(F.count(F.lit(1)).alias("events")).select(key, F.col("burst.start").alias("first"), F.col("burst.end").alias("closed"), "events")


def windowed_counts(events: DataFrame, key: str, ts: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling, or with ``slide`` sliding, counts and sums of a key."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def distinct_until_changed(updates: DataFrame, key: str, content: str, dirty: str) -> DataFrame:
    """Updates whose content differs from the key's last one, or that are marked dirty."""
    kind = updates.schema[key].dataType.simpleString()

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for text, forced in zip(frame[content], frame[dirty], strict=True):
                if text != last or forced:
                    out.append((name[0], text))
                last = text
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, content])

    return updates.select(key, content, dirty).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {content} string", "last string", "update", GroupStateTimeout.NoTimeout)


def stale_files(listing: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files (path, mtime, size) that have no parse of the same time and size."""
    return listing.join(parsed.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def refreshed(listing: DataFrame, parsed: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The parse table after a change: kept rows of unchanged files, new parses of the rest; deleted files go."""
    kept = parsed.join(listing.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")
    return kept.unionByName(parse(stale_files(listing, parsed)))


def on_change(stream: DataFrame, emit: Callable[[DataFrame], None], digest: Callable[[DataFrame], str], checkpoint: str):
    """Run batches one at a time; ``emit`` is called only where the digest of the batch's result differs."""
    last: dict[str, str] = {}

    def batch(df: DataFrame, _: int) -> None:
        now = digest(df)
        if last.get("digest") != now:
            last["digest"] = now
            emit(df)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
