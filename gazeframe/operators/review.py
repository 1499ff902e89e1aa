"""Manual review: labels put on frames, gaps between equal anchors filled, exports, undo, crop and trim.

``edits``: recording, start_frame, end_frame, label, seq. Ends may come in either order; the largest seq wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import normal_label
from .align import range_join
from .ordered import lagged, running

#: Longest gap, in frames, that is filled between two equal manual labels.
MAX_GAP = 15
EDIT_BUCKET = 4096


def frame_edits(edits: DataFrame, frames: DataFrame) -> DataFrame:
    """recording, frame_idx, edit_label: the last edit of each edited frame."""
    ranges = edits.select("recording", F.least("start_frame", "end_frame").alias("__lo"), F.greatest("start_frame", "end_frame").alias("__hi"), F.col("label").alias("edit_label"), "seq")
    hit = range_join(frames.select("recording", "frame_idx"), ranges, ["recording"], "frame_idx", "__lo", "__hi", EDIT_BUCKET)
    return hit.groupBy("recording", "frame_idx").agg(F.max_by("edit_label", "seq").alias("edit_label"))


def apply_edits(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """final_label and edit_source (manual or auto) of every frame."""
    out = frames.join(frame_edits(edits, frames), ["recording", "frame_idx"], "left")
    manual = F.col("edit_label").isNotNull()
    return out.withColumn("edit_source", F.when(manual, "manual").otherwise("auto")).withColumn("final_label", F.when(manual, normal_label(F.col("edit_label"))).otherwise(F.col("label"))).drop("edit_label")


def fill_gaps(edited: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Automatic frames between neighbouring manual ones of one label, at most ``max_gap`` apart, take that label."""
    anchor = F.when(F.col("edit_source") == "manual", F.struct("frame_idx", F.col("final_label").alias("label")))
    out = running(edited, ["recording"], "frame_idx", anchor, "__before", "last")
    out = running(out, ["recording"], "frame_idx", anchor, "__after", "last", ahead=True)
    gap = F.col("__after.frame_idx") - F.col("__before.frame_idx")
    fill = (F.col("edit_source") == "auto") & (F.col("__before.label") == F.col("__after.label")) & gap.between(2, max_gap + 1)
    fill = F.coalesce(fill, F.lit(False))
    return out.withColumn("final_label", F.when(fill, F.col("__before.label")).otherwise(F.col("final_label"))).withColumn("edit_source", F.when(fill, "auto_gap_fill").otherwise(F.col("edit_source"))).drop("__before", "__after")


def reviewed(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """final_primary_aoi and edit_source as the reviewed export has them."""
    return fill_gaps(apply_edits(frames, edits)).withColumnRenamed("final_label", "final_primary_aoi")


def edit_counts(reviewed_frames: DataFrame) -> DataFrame:
    source = F.col("edit_source")
    return reviewed_frames.groupBy("recording").agg(F.count_if(source == "manual").alias("manual_frames"), F.count_if(source == "auto_gap_fill").alias("gap_filled_frames"))


def changed_after_edits(edited: DataFrame) -> DataFrame:
    """is_transition: the label differs from the row before; true in a first row with a label."""
    out = lagged(edited, ["recording"], "frame_idx", F.col("final_label"), "__prev")
    return out.withColumn("is_transition", F.coalesce(~F.col("final_label").eqNullSafe(F.col("__prev")) & F.col("final_label").isNotNull(), F.lit(False))).drop("__prev")


def undo_last(edits: DataFrame) -> DataFrame:
    """Edits without the last one of each recording."""
    last = edits.groupBy("recording").agg(F.max("seq").alias("__last"))
    return edits.join(last, "recording").where(F.col("seq") < F.col("__last")).drop("__last")


def timeline(rows: DataFrame, recordings: DataFrame) -> DataFrame:
    """Labels scattered over frames 0 .. n_frames - 1; of repeated frames the largest seq wins; null where there is none."""
    grid = recordings.select("recording", F.explode(F.sequence(F.lit(0), F.col("n_frames").cast("int") - 1)).alias("frame_idx"))
    last = rows.groupBy("recording", "frame_idx").agg(F.max_by("label", "seq").alias("label"))
    return grid.join(last, ["recording", "frame_idx"], "left")


def trimmed(frames: DataFrame, trims: DataFrame, fps: Column, last_frame: Column) -> DataFrame:
    """Frames of each recording's trim range widened by round(padding_s * fps) and held inside the stream."""
    pad = F.bround(F.col("padding_s") * fps, 0).cast("int")
    met = frames.join(trims, "recording")
    return met.where(F.col("frame_idx").between(F.greatest(F.lit(0), F.col("start_frame") - pad), F.least(last_frame, F.col("end_frame") + pad))).select(*frames.columns)


def overlapping(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Spans that share a frame with their recording's range."""
    met = spans.join(ranges.select("recording", F.col("start_frame").alias("__s"), F.col("end_frame").alias("__e")), "recording")
    return met.where((F.col("end_frame") >= F.col("__s")) & (F.col("start_frame") <= F.col("__e"))).drop("__s", "__e")


def frame_slice(frames: DataFrame, start: int, stop: int) -> DataFrame:
    """Frames start to stop, both included; none unless stop is after start."""
    return frames.where(F.lit(stop > start) & F.col("frame_idx").between(start, stop))
