"""Label sequences: transitions, visits, time in an area, runs, transition matrices and carried values.

Frames have ``recording``, ``frame_idx`` and ``label`` (normalised); equal orders don't occur within a recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import NO_AOI, pair_label, safe_div
from .ordered import lagged, running, trailing

KEY = ["recording"]


def transitions(frames: DataFrame) -> DataFrame:
    """aoi_transition: ``previous->label`` where the label changes; a recording begins from NoAOI."""
    out = lagged(frames, KEY, "frame_idx", F.col("label"), "prev_label", F.lit(NO_AOI))
    return out.withColumn("aoi_transition", F.when(F.col("prev_label") != F.col("label"), pair_label(F.col("prev_label"), F.col("label"))))


def cumulative_visits(frames: DataFrame) -> DataFrame:
    """visits: how often the row's area has been entered so far; 0 outside all areas."""
    entered = transitions(frames).withColumn("entry", ((F.col("prev_label") != F.col("label")) & (F.col("label") != NO_AOI)).cast("long"))
    counted = running(entered, ["recording", "label"], "frame_idx", F.col("entry"), "visits")
    return counted.withColumn("visits", F.when(F.col("label") == NO_AOI, F.lit(0)).otherwise(F.col("visits")).cast("long"))


def with_runs(frames: DataFrame) -> DataFrame:
    """run_id: the number of the row's run of equal labels, from 1."""
    out = lagged(frames, KEY, "frame_idx", F.col("label"), "__prev")
    return running(out, KEY, "frame_idx", (F.col("__prev").isNull() | (F.col("__prev") != F.col("label"))).cast("long"), "run_id").drop("__prev")


def label_runs(frames: DataFrame) -> DataFrame:
    """One row for each run: first and last frame, frames."""
    return with_runs(frames).groupBy("recording", "run_id", "label").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("n_frames"))


def time_in_area(frames: DataFrame, frame_ms: float) -> DataFrame:
    """time_in_current_aoi_ms: frames since the label began times the frame's length; 0 in the row of the change."""
    runs = label_runs(frames).select("recording", "run_id", "start_frame")
    out = with_runs(frames).join(runs, ["recording", "run_id"])
    return out.withColumn("time_in_current_aoi_ms", (F.col("frame_idx") - F.col("start_frame")) * F.lit(frame_ms)).drop("start_frame")


def transition_edges(frames: DataFrame) -> DataFrame:
    """n of each recording's adjacent pairs of different areas; frames outside all areas break the chain."""
    out = lagged(frames, KEY, "frame_idx", F.col("label"), "src")
    real = (F.col("src") != NO_AOI) & (F.col("label") != NO_AOI) & (F.col("src") != F.col("label"))
    return out.where(real).groupBy("recording", "src", F.col("label").alias("dst")).agg(F.count("*").alias("n"))


def dense_matrix(edges: DataFrame, recordings: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with a zero for every missing pair of the given labels (a short list of names), in each recording."""
    names = labels.select(F.collect_set("label").alias("names"))
    grid = recordings.select("recording").join(F.broadcast(names)).select("recording", F.explode("names").alias("src"), "names").select("recording", "src", F.explode("names").alias("dst"))
    return grid.join(edges, ["recording", "src", "dst"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def transition_percent(edges: DataFrame) -> DataFrame:
    """pct: share of a source's outgoing transitions, one decimal half to even; 0 for a source without any."""
    total = F.sum("n").over(Window.partitionBy("recording", "src"))
    return edges.withColumn("pct", F.bround(safe_div(F.col("n"), total) * 100.0, 1))


def mean_transition_percent(percent: DataFrame, by: list[str]) -> DataFrame:
    """Mean over recordings of the rounded shares, rounded again."""
    return percent.groupBy(*by, "src", "dst").agg(F.bround(F.avg("pct"), 1).alias("mean_pct"))


def transition_count(frames: DataFrame) -> DataFrame:
    """n_transitions: adjacent frames with different labels, NoAOI included."""
    out = lagged(frames, KEY, "frame_idx", F.col("label"), "__prev")
    return out.groupBy("recording").agg(F.count_if(F.col("__prev") != F.col("label")).alias("n_transitions"))


def carry_forward(frames: DataFrame, value: str, name: str) -> DataFrame:
    """The last non-null value up to and with each frame."""
    return running(frames, KEY, "frame_idx", F.col(value), name, "last")


def scanpath(frames: DataFrame, last: int = 5) -> DataFrame:
    """One row for each fixation in order of its first frame, with the ids of the last ``last`` distinct fixations."""
    entries = frames.where(F.col("fixation_id").isNotNull()).groupBy("recording", "fixation_id").agg(F.min("frame_idx").alias("start_frame"))
    entries = trailing(entries, KEY, "start_frame", F.col("fixation_id"), "__before", last - 1)
    ids = F.array_append("__before", F.col("fixation_id"))
    return entries.select("recording", "fixation_id", "start_frame", F.array_join(ids.cast("array<string>"), ";").alias("scanpath"))


def every_nth_fixation(frames: DataFrame, n: int = 5) -> DataFrame:
    """Every n-th of the recording's fixation frames in order, from the first."""
    marked = running(frames.where("is_fixation"), KEY, "frame_idx", F.lit(1), "__k")
    return marked.where((F.col("__k") - 1) % n == 0).drop("__k")
