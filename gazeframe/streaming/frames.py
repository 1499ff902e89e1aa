"""The frame sequence as a stream: the same transitions, visits and time-in-area as the batch windows.

State of a recording: last label, its first frame, visits of each area and the last frame seen. Rows of one
micro-batch are put in frame order; a row behind a frame already given out is late and is dropped, which a batch never
does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.labels import NO_AOI
from ..operators.ordered import lagged

OUTPUT = "recording bigint, frame_idx int, label string, aoi_transition string, visits bigint, time_in_current_aoi_ms double"
STATE = "last_frame int, label string, entry int, areas array<string>, counts array<bigint>"


def sequence_stream(frames: DataFrame, frame_ms: float) -> DataFrame:
    """aoi_transition, visits and time_in_current_aoi_ms of a stream of recording, frame_idx, label."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, label, entry, areas, counts = state.get if state.exists else (-1, NO_AOI, 0, [], [])
        visits = dict(zip(areas, counts, strict=True))
        rows = pd.concat(list(batches)).sort_values("frame_idx")
        rows = rows[rows["frame_idx"] > last]
        out = []
        for frame, now in zip(rows["frame_idx"], rows["label"], strict=True):
            change = None
            if now != label:
                change = f"{label}->{now}"
                if now != NO_AOI:
                    visits[now] = visits.get(now, 0) + 1
                label, entry = now, frame
            elif last < 0:
                entry = frame
            out.append((key[0], frame, now, change, 0 if now == NO_AOI else visits[now], (frame - entry) * frame_ms))
            last = frame
        state.update((int(last), label, int(entry), list(visits), [int(n) for n in visits.values()]))
        yield pd.DataFrame(out, columns=["recording", "frame_idx", "label", "aoi_transition", "visits", "time_in_current_aoi_ms"])

    return frames.select("recording", "frame_idx", "label").groupBy("recording").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def dwell_stream(frames: DataFrame) -> DataFrame:
    """Running frames of each area of each recording, for update or complete mode."""
    return frames.groupBy("recording", "label").agg(F.count("*").alias("n_label"))


def session_stream(frames: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: sessions of a recording by event-time gap, late rows dropped after ``late``."""
    w = F.session_window("ts", gap)
    return frames.withWatermark("ts", late).groupBy("recording", w.alias("w")).agg(F.count("*").alias("n_frames")).select("recording", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_frames")


def new_recordings(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str):
    """Take up the files that have come since the last call, once each, and end; what failed is taken up again.

    Returns the query; ``processAllAvailable`` or ``awaitTermination`` waits for its end.
    """
    files = spark.readStream.schema(schema).format("parquet").load(source)
    return files.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def out_of_order(gaze: DataFrame) -> DataFrame:
    """recording, disordered: whether a recording's samples came back in time; as-of joins order them anyway."""
    back = lagged(gaze, ["recording"], "pos", F.col("ts_us"), "__before")
    return back.groupBy("recording").agg(F.coalesce(F.max(F.col("ts_us") < F.col("__before")), F.lit(False)).alias("disordered"))
