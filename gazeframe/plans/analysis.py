"""From raw streams to the frame fact: alignment, fixations, hits and the sequence columns, in one lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NO_AOI, filled_label
from ..operators import align, sequence, spatial
from ..operators.ordered import settled

#: Microseconds of a time chunk: 30 minutes of one recording.
CHUNK_US = 1_800_000_000


def build_gaze_frames(gaze: DataFrame, frames: DataFrame, fixations: DataFrame, quads: DataFrame, trim: DataFrame | None = None, direction: str = "nearest", frame_ms: float = 1000 / 30, stride: int = 1) -> DataFrame:
    """One row for each scene frame.

    ``frames``: recording, frame_idx, ts_us. ``gaze``: recording, ts_us, x, y. ``fixations``: recording, fixation_id,
    start, stop, mean_x, mean_y. ``quads``: recording, frame_idx, surface, own_tags and eight corner numbers.
    ``trim``: recording, start_frame, end_frame (padding already added). ``stride``: quads were found on every n-th
    frame only and hold until the next.
    """
    if trim is not None:
        kept = frames.join(trim, "recording").where(F.col("frame_idx").between(F.col("start_frame"), F.col("end_frame")))
        frames = kept.select(*frames.columns)
    base = frames.groupBy("recording").agg(F.min("ts_us").alias("base_us"))
    seen = align.asof_join(frames, gaze, ["recording"], "ts_us", ["x", "y"], direction, CHUNK_US)
    seen = settled(seen).withColumnRenamed("ts_us_right", "gaze_us").withColumn("x_px", F.when(~F.isnan("x"), F.round("x", 2))).withColumn("y_px", F.when(~F.isnan("y"), F.round("y", 2))).drop("x", "y")
    fixed = align.interval_join(seen, fixations, ["recording"], "ts_us", "fixation_id", "start", "stop", ["mean_x", "mean_y"], CHUNK_US)
    fixed = settled(fixed)
    if stride > 1:
        quads = quads.withColumn("__off", F.explode(F.sequence(F.lit(0), F.lit(stride - 1)))).withColumn("frame_idx", F.col("frame_idx") + F.col("__off")).drop("__off")
    hits = spatial.surface_hits(fixed.select("recording", "frame_idx", "x_px", "y_px"), quads)
    primary = spatial.primary_hits(hits, spatial.area_ranks(quads))
    out = fixed.join(primary, ["recording", "frame_idx"], "left").join(base, "recording")
    out = out.withColumn("label", filled_label(F.col("primary_aoi"))).withColumn("is_fixation", F.col("fixation_id").isNotNull())
    out = out.withColumn("fixation_dur_ms", F.bround((F.col("stop") - F.col("start")) / 1000.0, 1)).withColumn("time_s", F.bround((F.col("gaze_us") - F.col("base_us")) / 1e6, 4)).drop("start", "stop", "base_us")
    out = settled(sequence.transitions(settled(out)).drop("prev_label"))
    out = sequence.cumulative_visits(out).drop("prev_label", "entry", "aoi_transition").join(out.select("recording", "frame_idx", "aoi_transition"), ["recording", "frame_idx"])
    out = settled(out)
    return sequence.time_in_area(out, frame_ms).drop("run_id").withColumn("any_aoi_hit", F.col("label") != NO_AOI)


def sparse_detection(detections: DataFrame, frames: DataFrame, tags: list[int], every: int = 100, least_tags: int = 2, least_share: float = 0.03) -> DataFrame:
    """recording, share, sparse: whether fewer than ``least_share`` of about ``every`` sampled frames show two of the tags."""
    n = frames.groupBy("recording").agg(F.count("*").alias("n"), F.min("frame_idx").alias("lo"))
    sampled = frames.join(n, "recording").where((F.col("frame_idx") - F.col("lo")) % F.greatest(F.lit(1), F.floor(F.col("n") / every)) == 0).select("recording", "frame_idx")
    seen = detections.where(F.col("tag_id").isin(tags)).groupBy("recording", "frame_idx").agg(F.count_distinct("tag_id").alias("k"))
    met = sampled.join(seen, ["recording", "frame_idx"], "left")
    return met.groupBy("recording").agg(F.avg((F.coalesce("k", F.lit(0)) >= least_tags).cast("int")).alias("share")).withColumn("sparse", F.col("share") < least_share)


def merged_detections(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two detector passes; where both saw a tag in a frame, the second's corners count."""
    both = first.withColumn("__p", F.lit(1)).unionByName(second.withColumn("__p", F.lit(2)))
    return both.groupBy("recording", "frame_idx", "tag_id").agg(F.max_by("corners", "__p").alias("corners"))
