"""Rows by their place: numbering, zipping two streams, slices and durations that fall back to places.

A row's place in its key is a running count over chunks of the order column, so no task numbers a whole key. ``order``
is unique in its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import CHUNK, running


def positioned(rows: DataFrame, keys: list[str], order: str, name: str = "position", size: int = CHUNK) -> DataFrame:
    """``name``: the row's place in its key, from 0."""
    counted = running(rows, keys, order, F.lit(1), name, size=size)
    return counted.withColumn(name, (F.col(name) - 1).cast("long"))


def zipped(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str, left_size: int = CHUNK, right_size: int = CHUNK) -> DataFrame:
    """The first row of ``left`` with the first of ``right`` in each key, and so on; the shorter side ends it.

    Columns of ``right`` that ``left`` has as well get the suffix ``_right``; ``position`` is the place.
    """
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    a = positioned(left, keys, left_order, size=left_size)
    b = positioned(right, keys, right_order, size=right_size).withColumnsRenamed({c: f"{c}_right" for c in clash})
    return a.join(b, [*keys, "position"])


def _gaps(frames: DataFrame) -> DataFrame:
    """Of each recording whether a frame lacks its index, and the number of its rows."""
    return frames.groupBy("recording").agg(F.max(F.col("frame_idx").isNull().cast("int")).alias("__gap"), F.count("*").alias("__rows"))


def _ranged(frames: DataFrame, order: str, size: int) -> DataFrame:
    """``frames`` with ``__at``: the frame index, or the place in recordings in which an index is missing."""
    known = positioned(frames, ["recording"], order, "__place", size).join(_gaps(frames), "recording")
    return known.withColumn("__at", F.when(F.col("__gap") == 1, F.col("__place")).otherwise(F.col("frame_idx").cast("long")))


def sliced(frames: DataFrame, ranges: DataFrame, order: str, size: int = CHUNK) -> DataFrame:
    """Rows of each recording's range (recording, start_frame, end_frame; one a recording), both ends included.

    An end that isn't after the start gives nothing. Where any frame index of the recording is missing, places count
    instead, and the range is held inside the recording first.
    """
    met = _ranged(frames, order, size).join(ranges.select("recording", F.col("start_frame").alias("__s"), F.col("end_frame").alias("__e")), "recording")
    gap = F.col("__gap") == 1
    low = F.when(gap, F.greatest(F.lit(0), F.col("__s"))).otherwise(F.col("__s"))
    high = F.when(gap, F.least(F.col("__e"), F.col("__rows") - 1)).otherwise(F.col("__e"))
    return met.where((F.col("__e") > F.col("__s")) & (high > low) & F.col("__at").between(low, high)).select(*frames.columns)


def durations(frames: DataFrame, ranges: DataFrame, fps: Column, order: str, size: int = CHUNK) -> DataFrame:
    """recording and duration_s of each recording's range (recording, start_frame, end_frame and what ``fps`` names).

    With all frame indices known and more than one time inside the range: the last time less the first. With an index
    missing: the time at the end's place less that at the start's, if both are known. Else the number of frames over
    ``fps``. Never below zero.
    """
    span = ranges.withColumn("__s", F.col("start_frame")).withColumn("__e", F.col("end_frame")).withColumn("__fps", fps)
    known = _ranged(frames.select("recording", "frame_idx", "time_s", order), order, size).join(span.select("recording", "__s", "__e"), "recording")
    inside = F.col("__at").between(F.col("__s"), F.col("__e")) & F.col("time_s").isNotNull() & ~F.isnan("time_s")
    at = lambda place: F.max(F.when((F.col("__at") == place) & ~F.isnan("time_s"), F.col("time_s")))
    times = known.groupBy("recording").agg(
        F.max("__gap").alias("__gap"), F.count_if(inside).alias("__n"), F.max_by("time_s", F.when(inside, F.col("__place"))).alias("__last"), F.min_by("time_s", F.when(inside, F.col("__place"))).alias("__first"),
        at(F.col("__e")).alias("__at_e"), at(F.col("__s")).alias("__at_s"),
    )
    both = span.join(times, "recording", "left")
    by_index = F.when((F.col("__gap") == 0) & (F.col("__n") > 1), F.col("__last") - F.col("__first"))
    by_place = F.when(F.col("__gap") == 1, F.col("__at_e") - F.col("__at_s"))
    frames_over = (F.col("__e") - F.col("__s") + 1) / F.col("__fps")
    return both.select("recording", F.greatest(F.lit(0.0), F.coalesce(by_index, by_place, frames_over)).alias("duration_s"))
