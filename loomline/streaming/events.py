"""Event streams: windows with late data, sessions, keyed ordered chains, block rollover.

Every function takes a streaming or a batch frame; only the keyed chain needs streaming state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHAIN_SCHEMA = "key string, block_index int, ts timestamp, accepted boolean, previous_hash string, block_hash string"
_STATE = "last_index int, last_ts timestamp, last_hash string"


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """The time as an instant, with a watermark on a stream."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late) if rows.isStreaming else rows


def window_stats(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums per tumbling window and key; rows later than the watermark are dropped by the engine."""
    rows = _timed(events, time, late)
    return (
        rows.groupBy(F.window(time, width).alias("w"), by)
        .agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
        .select(F.col("w.start").alias("start"), by, "n", "total")
    )


def session_stats(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of each key: a session ends where the gap to the next event is longer."""
    rows = _timed(events, time, late)
    return (
        rows.groupBy(F.session_window(time, gap).alias("w"), by)
        .agg(F.count("*").alias("n"))
        .select(by, F.col("w.start").alias("start"), F.unix_timestamp(F.col("w.end")).alias("end_s"), "n")
    )


def block_rollover(events: DataFrame, position: str, size: int = 8) -> DataFrame:
    """(block_id, n): blocks of ``size`` events by a position without gaps; full blocks only."""
    return events.groupBy((F.floor(F.col(position) / size) + 1).alias("block_id")).agg(F.count("*").alias("n")).filter(F.col("n") == size)


def _link(previous: str | None, index: int, ts: pd.Timestamp) -> str:
    return hashlib.sha256(f"{previous or ''}|{index}|{ts.isoformat()}".encode()).hexdigest()


def append_to_chain(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState, time: str) -> Iterator[pd.DataFrame]:
    """One batch of a key's events. Its rows can come in several parts: all are put in order together."""
    index, last, digest = state.get if state.exists else (-1, None, None)
    rows = []
    for ts in sorted(ts for part in parts for ts in part[time]):
        ok = last is None or ts >= pd.Timestamp(last)
        if ok:
            before, index, last = digest, index + 1, ts
            digest = _link(before, index, ts)
            rows.append((str(k[0]), index, ts, True, before, digest))
        else:
            rows.append((str(k[0]), None, ts, False, digest, None))
    if last is not None:
        state.update((index, pd.Timestamp(last).to_pydatetime(), digest))
    yield pd.DataFrame(rows, columns=["key", "block_index", "ts", "accepted", "previous_hash", "block_hash"])


def keyed_chain(events: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """Append each key's events to its own hash chain; an event older than the chain's last one is refused.

    State holds a chain's last index, time and hash, whatever its length.
    """

    def append(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return append_to_chain(k, parts, state, time)

    return events.select(key, F.col(time).cast("timestamp").alias(time)).groupBy(key).applyInPandasWithState(append, CHAIN_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)
