"""Frames of a stream that arrive out of order, put in order before the sequence is worked out.

Each recording holds its rows until a later one is ``delay`` ahead of them, then gives them out in frame order with their
transition, visits and time in the area. So any order in which no row is more than ``delay`` behind gives what a batch
over the same rows gives, whatever the micro-batches and restarts. A row behind those given out is late: it comes out
marked as such, without values, and ``write_ordered`` puts it into a table of its own. A row with ``last`` ends its recording: all
that is held is given out. What is held spans at most ``delay`` of a recording's time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.labels import NO_AOI

INPUT = ["recording", "frame_idx", "ts_ms", "label", "last"]
OUTPUT = "recording bigint, frame_idx int, ts_ms bigint, label string, aoi_transition string, visits bigint, time_in_current_aoi_ms double, late boolean"
#: What is held, the newest time seen, and where the sequence stands.
STATE = "frames array<int>, times array<bigint>, labels array<string>, newest bigint, given int, label string, entry int, areas array<string>, counts array<bigint>"


def released(times: np.ndarray, newest: int, delay: int, ended: bool) -> np.ndarray:
    """Which held rows may be given out: those that lie ``delay`` or more behind the newest time."""
    return np.ones(len(times), bool) if ended else times <= newest - delay


def sequence(frames: np.ndarray, labels: np.ndarray, before: str, entry: int | None, visits: dict[str, int]):
    """Transition, visits and entry frame of rows in order, after a row of the label ``before`` entered at ``entry``.

    ``visits`` is brought up to date. All is worked out on whole arrays.
    """
    previous = np.concatenate(([before], labels[:-1]))
    changed = labels != previous
    transition = np.where(changed, previous + "->" + labels, None) if len(labels) else np.empty(0, object)
    begun = np.maximum.accumulate(np.where(changed, np.arange(len(frames)), -1))
    first = frames[0] if entry is None else entry
    entered = np.where(begun >= 0, frames[begun], first)
    entries = changed & (labels != NO_AOI)
    names, codes = np.unique(labels.astype(str), return_inverse=True)
    counted = pd.Series(entries.astype(np.int64)).groupby(codes).cumsum().to_numpy() + np.array([visits.get(n, 0) for n in names], np.int64)[codes]
    for n, more in zip(names, np.bincount(codes, entries, len(names)).astype(int), strict=True):
        if n != NO_AOI:
            visits[str(n)] = visits.get(str(n), 0) + int(more)
    return transition, np.where(labels == NO_AOI, 0, counted), entered


def reordered_stream(frames: DataFrame, frame_ms: float, delay_ms: int) -> DataFrame:
    """``OUTPUT`` rows of a stream of recording, frame_idx, ts_ms (milliseconds), label and last; repeated frames are late."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held_f, held_t, held_l, newest, given, label, entry, areas, counts = state.get if state.exists else ([], [], [], None, -1, NO_AOI, None, [], [])
        rows = pd.concat(list(batches))
        late = rows[rows["frame_idx"] <= given]
        fresh = rows[rows["frame_idx"] > given]
        f = np.concatenate((np.array(held_f, np.int64), fresh["frame_idx"].to_numpy(np.int64)))
        t = np.concatenate((np.array(held_t, np.int64), fresh["ts_ms"].to_numpy(np.int64)))
        names = np.concatenate((np.array(held_l, object), fresh["label"].to_numpy(object)))
        order = np.argsort(f, kind="stable")
        f, t, names = f[order], t[order], names[order]
        again = np.concatenate((np.zeros(min(1, len(f)), bool), f[1:] == f[:-1]))
        double = pd.DataFrame({"frame_idx": f[again], "ts_ms": t[again], "label": names[again]})
        f, t, names = f[~again], t[~again], names[~again]
        if len(rows):
            newest = max(int(rows["ts_ms"].max()), newest if newest is not None else int(rows["ts_ms"].max()))
        # Frames go out in order: the last one whose time has come takes those before it along.
        free = released(t, newest, delay_ms, bool(rows["last"].any()))
        n = int(np.flatnonzero(free)[-1]) + 1 if free.any() else 0
        visits = dict(zip(areas, map(int, counts), strict=True))
        out = []
        if n:
            transition, seen, entered = sequence(f[:n], names[:n], label, None if given < 0 else entry, visits)
            out.append(pd.DataFrame({"frame_idx": f[:n], "ts_ms": t[:n], "label": names[:n], "aoi_transition": transition, "visits": seen, "time_in_current_aoi_ms": (f[:n] - entered) * frame_ms, "late": False}))
            given, label, entry = int(f[n - 1]), str(names[n - 1]), int(entered[-1])
        for behind in (late[["frame_idx", "ts_ms", "label"]], double):
            if len(behind):
                out.append(behind.assign(aoi_transition=None, visits=None, time_in_current_aoi_ms=None, late=True))
        state.update((f[n:].tolist(), t[n:].tolist(), names[n:].tolist(), newest, given, label, None if entry is None else int(entry), list(visits), list(visits.values())))
        for part in out:
            part = part.assign(recording=key[0], visits=part["visits"].astype("Int64"))
            yield part[["recording", "frame_idx", "ts_ms", "label", "aoi_transition", "visits", "time_in_current_aoi_ms", "late"]]

    rows = frames.select(F.col("recording").cast("long").alias("recording"), F.col("frame_idx").cast("int").alias("frame_idx"), F.col("ts_ms").cast("long").alias("ts_ms"), F.coalesce("label", F.lit(NO_AOI)).alias("label"), F.coalesce("last", F.lit(False)).alias("last"))
    return rows.where(F.col("recording").isNotNull() & F.col("frame_idx").isNotNull() & F.col("ts_ms").isNotNull()).groupBy("recording").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def write_ordered(ordered: DataFrame, out: str, late: str, checkpoint: str, **trigger):
    """Start the stream: rows in order go to ``out``, late ones to ``late``.

    A micro-batch writes folders of its own number; when it is repeated after a failure it replaces them, so each row
    stands in the tables once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for path, rows in ((out, ~F.col("late")), (late, F.col("late"))):
                batch.where(rows).drop("late").write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return ordered.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
