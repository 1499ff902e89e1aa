"""Whole reports as bundles of lazy tables: the master workbook, the comparison of two conditions, single dashboards.

Frames: recording, condition, difficulty, frame_idx, ts_us, label, u, v, x_px, y_px, is_fixation, fixation_id, time_s,
fixation_dur_ms, aoi_hit_source, edit_source. Persist them once; every table of a bundle branches from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NO_AOI, safe_div
from ..operators import compare, metrics, sequence, spatial
from ..sources.sinks import readme_sheet


def recordings_of(frames: DataFrame) -> DataFrame:
    return frames.select("recording", "condition", "difficulty").distinct()


def labels_of(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("label") != NO_AOI).select("label").distinct()


def master_tables(frames: DataFrame, tasks: DataFrame) -> dict[str, DataFrame]:
    """The workbook's sheets by name; rows in the order of the files."""
    summary, tm = metrics.recording_summary(frames), metrics.task_metrics(frames, tasks)
    own = metrics.recording_dwell(frames)
    return {
        "README": readme_sheet(frames.sparkSession),
        "Recording_Summary": summary.orderBy("difficulty", "recording"),
        "Task_Metrics": tm.orderBy("difficulty", "recording", "task_index"),
        "Learning_Summary": metrics.learning_summary(tm).orderBy("difficulty", "task_index"),
        "AOI_By_Difficulty": metrics.area_by_difficulty(own, recordings_of(frames), labels_of(frames)).orderBy("difficulty", "label"),
        "Data_Quality": metrics.quality_summary(summary, tm).orderBy("difficulty"),
        "Recording_Dwell": own.orderBy("recording", "label"),
    }


@dataclass
class Comparison:
    """Two conditions compared; all tables lazy."""

    aoi_stats: DataFrame
    overall_stats: DataFrame
    transition_means: DataFrame
    learning: DataFrame
    screen_tests: DataFrame
    screen_position: DataFrame
    dwell_points: DataFrame
    fixation_points: DataFrame


def compare_conditions(frames: DataFrame, tasks: DataFrame, a: str = "A", b: str = "B", screen: str = "Screen") -> Comparison:
    frames = frames.where(F.col("condition").isin(a, b))
    recs, names = recordings_of(frames), labels_of(frames)
    own = compare.zero_filled(metrics.dwell(frames, ["recording"]), recs, names, "dwell_pct")
    fix = metrics.fixation_by_area(metrics.fixation_summary(frames), recs, names).join(recs, "recording")
    long = lambda df, m, c: df.select(F.lit(m).alias("metric"), "label", "condition", F.col(c).cast("double").alias("value"))
    cells = long(own, "Dwell %", "value").unionByName(long(fix, "Fixation count", "n_fixations")).unionByName(long(fix, "Mean fixation duration", "mean_dur_s"))
    rate = sequence.transition_count(frames).join(metrics.timing(frames, ["recording"]), "recording").select("recording", F.lit("Transition rate").alias("metric"), safe_div(F.col("n_transitions"), F.col("duration_s")).alias("value"))
    bits = metrics.entropy(frames, ["recording"]).select("recording", F.lit("Entropy").alias("metric"), F.col("entropy_bits").alias("value"))
    percent = sequence.transition_percent(sequence.dense_matrix(sequence.transition_edges(frames), recs, names))
    on_screen = frames.where(F.col("label") == screen)
    points = spatial.unit_points(spatial.preferred_points(on_screen, ["recording", "condition"]), ["recording", "condition"])
    # The vertical axis of the stored frame is x: names follow the stored convention. Equal means are ties of the rank
    # test, in whatever order their points were summed.
    mean = spatial.mean_position(points, ["recording", "condition"]).withColumn("mean_x", F.round("mean_x", 9)).withColumn("mean_y", F.round("mean_y", 9))
    axis = mean.select("condition", F.explode(F.array(F.struct(F.lit("Vertical position").alias("metric"), F.col("mean_x").alias("value")), F.struct(F.lit("Horizontal position").alias("metric"), F.col("mean_y").alias("value")))).alias("m")).select("condition", "m.metric", "m.value")
    occupancy = spatial.grid_occupancy(points, ["recording", "condition"]).withColumnRenamed("share", "value")
    return Comparison(
        aoi_stats=compare.stat_rows(cells, ["metric", "label"], "condition", a, b),
        overall_stats=compare.stat_rows(bits.unionByName(rate).join(recs, "recording"), ["metric"], "condition", a, b),
        transition_means=sequence.mean_transition_percent(percent.join(recs, "recording"), ["condition"]),
        learning=compare.learning_by_condition(metrics.task_metrics(frames, tasks)),
        screen_tests=compare.false_discovery(compare.stat_rows(occupancy, ["cell"], "condition", a, b), []),
        screen_position=compare.stat_rows(axis, ["metric"], "condition", a, b),
        dwell_points=own,
        fixation_points=fix,
    )


def dashboard(frames: DataFrame, tasks: DataFrame, errors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables behind the charts of single recordings and of all together."""
    recs, names = recordings_of(frames), labels_of(frames)
    tm = metrics.task_metrics(frames, tasks)
    by = ["recording", "label"]
    heat = spatial.smoothed(spatial.histogram_2d(spatial.unit_points(spatial.preferred_points(frames, by), by), by), by)
    pooled = spatial.smoothed(spatial.histogram_2d(spatial.unit_points(spatial.preferred_points(frames, by), by), ["label"]), ["label"])
    percent = sequence.transition_percent(sequence.dense_matrix(sequence.transition_edges(frames), recs, names))
    fix = metrics.fixation_by_area(metrics.fixation_summary(frames), recs, names)
    own = compare.zero_filled(metrics.dwell(frames, ["recording"]), recs, names, "dwell_pct")
    trend = compare.linear_trend(tm, ["recording"], "task_index", "duration_s")
    out = {
        "quality": metrics.data_quality(frames),
        "preprocessing": metrics.preprocessing_report(frames),
        "dwell": metrics.recording_dwell(frames),
        "fixations": fix,
        "heatmaps": heat,
        "transitions": percent,
        "learning_curve": tm.select("recording", "task_index", "duration_s"),
        "trend": compare.trend_grid(trend, ["recording"]),
        "all_dwell": metrics.spread(own, ["label"], "value"),
        "all_fixations": metrics.spread(fix, ["label"], "n_fixations"),
        "all_heatmap": pooled,
        "all_transitions": sequence.mean_transition_percent(percent, []),
        "all_learning": metrics.learning_by_frames(frames, tasks),
        "all_quality": metrics.data_quality(frames).agg(F.avg("missing_gaze_pct").alias("mean_missing_pct"), F.stddev_samp("missing_gaze_pct").alias("sd_missing_pct")),
        "timeline": sequence.label_runs(frames),
        "fixation_ticks": sequence.every_nth_fixation(frames).select("recording", "frame_idx"),
    }
    if errors is not None:
        per_task = tm.select("recording", "task_index").distinct().join(metrics.error_rollup(errors), ["recording", "task_index"], "left")
        out["errors"] = per_task.na.fill(0)
        out["all_errors"] = metrics.error_rollup(errors).groupBy("task_index").agg(*[F.avg(c).alias(c) for c in ("comp_type", "comp_pos", "cable_type", "cable_pos", "comp_tot", "cable_tot")])
    return out
