"""Aggregates over frames: dwell, durations, fixations, quality, task and recording summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NO_AOI, quality_band, safe_div, task_index
from .align import range_join
from .ordered import settled
from .sequence import transition_count

DEFAULT_FPS = 30.0
TASK_BUCKET = 4096


def timing(frames: DataFrame, by: list[str]) -> DataFrame:
    """n_frames, first_us, last_us (in frame order), fps = (n - 1) / seconds, at least 1, 30 where it can't be told."""
    timed = F.when(F.col("ts_us").isNotNull(), F.col("frame_idx"))
    out = frames.groupBy(*by).agg(F.count("*").alias("n_frames"), F.count("ts_us").alias("n_timed"), F.min_by("ts_us", timed).alias("first_us"), F.max_by("ts_us", timed).alias("last_us"))
    span = (F.col("last_us") - F.col("first_us")) / 1e6
    out = out.withColumn("fps", F.when((F.col("n_timed") > 1) & (span > 0), F.greatest(F.lit(1.0), (F.col("n_timed") - 1) / span)).otherwise(F.lit(DEFAULT_FPS)))
    return out.withColumn("duration_s", F.when(F.col("n_timed") > 1, span).otherwise(F.col("n_frames") / F.col("fps")))


def dwell(frames: DataFrame, by: list[str], with_no_aoi: bool = False) -> DataFrame:
    """n_label and dwell_pct of each label over all frames of its group, NoAOI frames included in the total."""
    counts = frames.groupBy(*by, "label").agg(F.count("*").alias("n_label"))
    totals = counts.groupBy(*by).agg(F.sum("n_label").alias("n_all"))
    out = counts.join(totals, by).withColumn("dwell_pct", F.col("n_label") * 100.0 / F.col("n_all"))
    return out if with_no_aoi else out.where(F.col("label") != NO_AOI)


def entropy(frames: DataFrame, by: list[str]) -> DataFrame:
    """entropy_bits over label shares, NoAOI included; + 0.0 keeps a constant sequence from being -0."""
    share = F.col("n_label") / F.col("n_all")
    return dwell(frames, by, with_no_aoi=True).groupBy(*by).agg((F.round(-F.sum(share * F.log2(share)), 9) + F.lit(0.0)).alias("entropy_bits"))


def flagged_ratio(flag: Column) -> Column:
    return F.coalesce(F.avg(flag.cast("int")), F.lit(0.0))


def fixation_summary(frames: DataFrame) -> DataFrame:
    """One row for each fixation: frames, seconds, dominant label (the smallest of equally frequent ones), mean gaze."""
    fixed = frames.where(F.col("fixation_id").isNotNull())
    time_s = F.col("time_s")
    return fixed.groupBy("recording", "fixation_id").agg(
        F.min("frame_idx").alias("start_frame"),
        F.max("frame_idx").alias("end_frame"),
        F.min(time_s).alias("start_time_s"),
        F.max(time_s).alias("end_time_s"),
        F.coalesce(F.min_by("fixation_dur_ms", F.when(F.col("fixation_dur_ms").isNotNull(), F.col("frame_idx"))) / 1000.0, F.max(time_s) - F.min(time_s)).alias("duration_s"),
        F.mode("label", True).alias("dominant_aoi"),
        F.avg("x_px").alias("centroid_x"),
        F.avg("y_px").alias("centroid_y"),
    )


def fixation_by_area(fixations: DataFrame, recordings: DataFrame, labels: DataFrame) -> DataFrame:
    """n_fixations, mean_dur_s, total_dur_s of every area in every recording; zeros where there were none."""
    names = labels.where(F.col("label") != NO_AOI).select(F.collect_set("label").alias("names"))
    grid = recordings.select("recording").distinct().join(F.broadcast(names)).select("recording", F.explode("names").alias("label"))
    own = fixations.groupBy("recording", F.col("dominant_aoi").alias("label")).agg(F.count("*").alias("n_fixations"), F.avg("duration_s").alias("mean_dur_s"), F.sum("duration_s").alias("total_dur_s"))
    return grid.join(own, ["recording", "label"], "left").na.fill(0, ["n_fixations", "mean_dur_s", "total_dur_s"])


def data_quality(frames: DataFrame) -> DataFrame:
    valid = F.col("x_px").isNotNull() & F.col("y_px").isNotNull()
    counts = frames.groupBy("recording").agg(F.count("*").alias("total_frames"), F.count_if(valid).alias("valid_gaze_frames"), F.count_distinct("fixation_id").alias("fixation_count"))
    times = timing(frames, ["recording"]).select("recording", F.col("duration_s").alias("recording_duration_s"), "fps")
    out = counts.join(times, "recording")
    return out.withColumn("missing_gaze_pct", safe_div(F.col("total_frames") - F.col("valid_gaze_frames"), F.col("total_frames")) * 100.0).withColumn("band", quality_band(100.0 - F.col("missing_gaze_pct")))


def preprocessing_report(frames: DataFrame) -> DataFrame:
    """Counts and shares of frames by how their area was found, with the dwell of each area as maps."""
    none, source = F.col("label") == NO_AOI, F.col("aoi_hit_source")
    counts = frames.groupBy("recording").agg(
        F.count("*").alias("total_frames"),
        F.count_if(~none).alias("aoi_detected_frames"),
        F.count_if(none).alias("no_aoi_frames"),
        F.count_if(source == "direct").alias("surface_3d_frames"),
        F.count_if(source == "projected").alias("fallback_2d_frames"),
        F.count_distinct("fixation_id").alias("fixation_count"),
    )
    share = lambda c: (safe_div(F.col(c), F.col("total_frames")) * 100.0).alias(c.replace("_frames", "_pct"))
    maps = dwell(frames, ["recording"]).groupBy("recording").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n_label")))).alias("aoi_dwell_frames"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "dwell_pct")))).alias("aoi_dwell_pct"),
    )
    return counts.select("*", share("no_aoi_frames"), share("surface_3d_frames"), share("fallback_2d_frames")).join(maps, "recording", "left")


def recording_summary(frames: DataFrame) -> DataFrame:
    """One row for each recording: counts, ratios, transitions, entropy."""
    base = frames.groupBy("recording", "difficulty", "condition").agg(
        flagged_ratio(F.col("label") == NO_AOI).alias("none_ratio"), flagged_ratio(F.col("edit_source") == "manual").alias("manual_edit_ratio"), flagged_ratio(F.col("edit_source") == "auto_gap_fill").alias("auto_gap_fill_ratio")
    )
    times = timing(frames, ["recording"]).select("recording", F.col("n_frames").alias("frame_count"), "duration_s", F.col("fps").alias("estimated_fps"))
    return base.join(times, "recording").join(transition_count(frames), "recording").join(entropy(frames, ["recording"]), "recording")


def recording_dwell(frames: DataFrame) -> DataFrame:
    """dwell_s = frames / fps and dwell_ratio of each area."""
    times = timing(frames, ["recording"]).select("recording", "fps")
    out = dwell(frames, ["recording"]).join(times, "recording")
    return out.select("recording", "label", (F.col("n_label") / F.col("fps")).alias("dwell_s"), (F.col("n_label") / F.col("n_all")).alias("dwell_ratio"))


def task_frames(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """Frames of each valid task (both ends known, end after start), ends included; tasks may overlap."""
    valid = tasks.where(F.col("start_frame").isNotNull() & (F.col("end_frame") > F.col("start_frame")))
    return range_join(frames, valid, ["recording"], "frame_idx", "start_frame", "end_frame", TASK_BUCKET)


def task_metrics(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row for each task with frames; the frame rate is the whole recording's."""
    inside = settled(task_frames(frames, tasks))  # read by four aggregates
    by = ["recording", "task_name", "start_frame", "end_frame"]
    fps = timing(frames, ["recording"]).select("recording", "fps")
    times = timing(inside, by).select(*by, "n_frames", "n_timed", ((F.col("last_us") - F.col("first_us")) / 1e6).alias("span_s"))
    runs = inside.withColumn("recording", F.struct(*by))
    changes = transition_count(runs).select(*[F.col(f"recording.{c}").alias(c) for c in by], "n_transitions")
    counts = inside.groupBy(*by).agg(
        F.first("difficulty").alias("difficulty"),
        F.first("condition").alias("condition"),
        flagged_ratio(F.col("label") == NO_AOI).alias("none_ratio"),
        F.count_if(F.col("label") == "Screen").alias("n_screen"),
        F.count_if(F.col("label") == "Board").alias("n_board"),
    )
    out = counts.join(times, by).join(changes, by).join(entropy(inside, by), by).join(fps, "recording")
    duration = F.when(F.col("n_timed") > 1, F.col("span_s")).otherwise((F.col("end_frame") - F.col("start_frame") + 1) / F.col("fps"))
    focus = (F.col("n_screen") + F.col("n_board")) / F.col("fps")
    out = out.withColumn("duration_s", duration)
    return out.select(
        *by, task_index(F.col("task_name")).alias("task_index"), "difficulty", "condition", F.col("n_frames").alias("frame_count"), "duration_s", "none_ratio", F.col("n_transitions").alias("aoi_transition_count"),
        F.col("entropy_bits").alias("aoi_entropy_bits"), safe_div(F.col("n_screen"), F.col("n_board")).alias("screen_to_board_ratio"), safe_div(focus, F.col("duration_s")).alias("task_focus_ratio"),
    )


def learning_by_frames(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """By task: mean, deviation (0 for one), median and n of (end - start) over the recording's own frame rate, of valid tasks."""
    fps = timing(frames, ["recording"]).select("recording", "fps")
    valid = tasks.where(F.col("start_frame").isNotNull() & (F.col("end_frame") > F.col("start_frame"))).join(fps, "recording")
    own = valid.select(task_index(F.col("task_name")).alias("task_index"), ((F.col("end_frame") - F.col("start_frame")) / F.col("fps")).alias("duration_s"))
    return own.groupBy("task_index").agg(F.avg("duration_s").alias("mean"), F.coalesce(F.stddev_samp("duration_s"), F.lit(0.0)).alias("std"), F.median("duration_s").alias("median"), F.count("*").alias("n"))


def learning_summary(metrics: DataFrame) -> DataFrame:
    """By difficulty and task, null groups kept: participants, duration statistics, means, SEM and CI95."""
    means = ["none_ratio", "aoi_transition_count", "aoi_entropy_bits", "screen_to_board_ratio", "task_focus_ratio"]
    out = metrics.groupBy("difficulty", "task_index", "task_name").agg(
        F.count_distinct("recording").alias("participants"),
        F.avg("duration_s").alias("mean_duration_s"),
        F.median("duration_s").alias("median_duration_s"),
        F.stddev_samp("duration_s").alias("std_duration_s"),
        *[F.avg(c).alias(f"mean_{c}") for c in means],
    )
    sem = F.col("std_duration_s") / F.sqrt(F.greatest(F.col("participants"), F.lit(1)))
    return out.withColumn("sem_duration_s", F.coalesce(sem, F.lit(0.0))).withColumn("ci95_duration_s", F.col("sem_duration_s") * 1.96)


def area_by_difficulty(dwell_rows: DataFrame, recordings: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean and median dwell ratio of each area by difficulty (missing areas count as 0); recordings without one are left out."""
    names = labels.where(F.col("label") != NO_AOI).select(F.collect_set("label").alias("names"))
    grid = recordings.where(F.col("difficulty").isNotNull()).join(F.broadcast(names)).select("recording", "difficulty", F.explode("names").alias("label"))
    filled = grid.join(dwell_rows, ["recording", "label"], "left")
    ratio = F.coalesce("dwell_ratio", F.lit(0.0))
    return filled.groupBy("difficulty", "label").agg(F.avg(ratio).alias("mean_ratio"), F.median(ratio).alias("median_ratio"), F.count("dwell_ratio").alias("n"))


def quality_summary(summaries: DataFrame, metrics: DataFrame) -> DataFrame:
    """Recording means and task means by difficulty, outer-joined."""
    a = summaries.groupBy("difficulty").agg(F.count("*").alias("recordings"), F.avg("none_ratio").alias("mean_none_ratio"), F.avg("manual_edit_ratio").alias("mean_manual_edit_ratio"), F.avg("duration_s").alias("mean_duration_s"))
    b = metrics.groupBy("difficulty").agg(F.count("*").alias("tasks"), F.avg("none_ratio").alias("mean_task_none_ratio"))
    return a.join(b, "difficulty", "full")


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median, sample deviation (0 for one), least, greatest and count of a value."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def error_rollup(errors: DataFrame) -> DataFrame:
    """Component and cable errors of each task: type; position = number + orientation; colour; position; two totals."""
    type_, pos = F.col("comp_type"), F.col("comp_number") + F.col("comp_orientation")
    colour, place = F.col("cable_colour"), F.col("cable_position")
    sums = [F.sum(c).alias(n) for c, n in ((type_, "comp_type"), (pos, "comp_pos"), (colour, "cable_type"), (place, "cable_pos"), (type_ + pos, "comp_tot"), (colour + place, "cable_tot"))]
    return errors.groupBy("recording", task_index(F.col("task_name")).alias("task_index")).agg(*sums)


def area_first_last(frames: DataFrame) -> DataFrame:
    """What a pass over the frames adds up for each area: frames, first and last time, sums of gaze, fixations."""
    return frames.where(F.col("label") != NO_AOI).groupBy("recording", "label").agg(
        F.count("*").alias("n_frames"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.sum("x_px").alias("sum_x"), F.sum("y_px").alias("sum_y"), F.count_distinct("fixation_id").alias("n_fixations")
    )
