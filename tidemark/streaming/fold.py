"""The change-suppressing fold over a stream of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.snapshots import HEARTBEAT_HOURS, OVERWRITE_MINUTES
from tidemark.runtime import ship


def fold_stream(samples: DataFrame, keys: list[str], heartbeat_hours: float = HEARTBEAT_HOURS, overwrite_minutes: float = OVERWRITE_MINUTES) -> DataFrame:
    """Rows to write from a stream of (keys, sampled_at timestamp, floor double): keys, seq, sampled_at, floor.

    A row replaces the earlier one of the same key and seq; so a sink keeps the newest of each. The state of a key is its
    last written sample, however long the stream. Samples of a key that come older than the last written are dropped.
    """
    ship(samples.sparkSession)
    beat, soon = pd.Timedelta(hours=heartbeat_hours), pd.Timedelta(minutes=overwrite_minutes)
    kinds = dict(samples.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, at, floor = state.get if state.exists else (0, None, None)
        at = None if at is None else pd.Timestamp(at)
        rows = pd.concat(list(batches)).sort_values(["sampled_at"], kind="stable")
        out: dict[int, tuple] = {}
        for t, v in zip(rows["sampled_at"], rows["floor"], strict=True):
            if at is not None:
                if t < at or (t - at < beat and abs(v - floor) <= 1e-6):
                    continue
                seq += t - at >= soon
            else:
                seq += 1
            at, floor = t, v
            out[seq] = (t, v)
        if at is not None:
            state.update((int(seq), at.to_pydatetime(), float(floor)))
        yield pd.DataFrame([(*key, int(s), t, float(v)) for s, (t, v) in out.items()], columns=[*keys, "seq", "sampled_at", "floor"])

    return samples.groupBy(*keys).applyInPandasWithState(step, f"{head}, seq long, sampled_at timestamp, floor double", "seq long, at timestamp, floor double", "append", GroupStateTimeout.NoTimeout)
