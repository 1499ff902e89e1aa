"""Writers: frame tables, summaries, reviewed exports, workbook tables, configuration JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import joined_ints

#: What each sheet of the workbook holds.
SHEETS = [
    ("Recording_Summary", "Each recording once: length, frame rate, shares of frames, changes of area, entropy."),
    ("Task_Metrics", "Each task of a recording once; tests between groups start here."),
    ("Learning_Summary", "Durations of each task over all recordings of one difficulty."),
    ("AOI_By_Difficulty", "How much of the time each area was looked at, by difficulty."),
    ("Data_Quality", "Shares of frames without an area, edited by hand or filled, by difficulty."),
]


def _fixed(c: str, digits: int) -> Column:
    """Fixed decimals; nan for a missing number."""
    return F.when(F.col(c).isNull(), "nan").otherwise(F.format_string(f"%.{digits}f", F.bround(c, digits)))


def _optional(c: str, digits: int | None = None) -> Column:
    text = F.col(c).cast("string") if digits is None else F.format_string(f"%.{digits}f", F.bround(c, digits))
    return F.coalesce(F.when(F.col(c).isNotNull(), text), F.lit(""))


def wide_frames(frames: DataFrame, areas: list[str]) -> DataFrame:
    """The frame table as its file has it: quantised text, one hit and one visit column for each configured area.

    ``hits`` map<string,boolean>, ``visits`` map<string,int> and ``markers`` array<int> are spread here only.
    """
    flag = lambda c: F.when(c, "True").otherwise("False")
    digits = {"gaze_x_px": 2, "gaze_y_px": 2, "time_s": 4}
    plain = [F.col("timestamp_ns").cast("string").alias("timestamp_ns"), _fixed("time_s", 4).alias("time_s"), F.col("frame_idx").cast("string").alias("frame_idx"), *[_fixed(c, digits[c]).alias(c) for c in ("gaze_x_px", "gaze_y_px")], flag(F.col("is_fixation")).alias("is_fixation")]
    optional = [_optional(c, d).alias(c) for c, d in (("fixation_id", None), ("fixation_dur_ms", 1), ("fixation_gaze_x", 2), ("fixation_gaze_y", 2))]
    hit = [flag(F.size(F.map_filter("hits", lambda k, v: v)) > 0).alias("any_aoi_hit")]
    main = [_optional(c, d).alias(c) for c, d in (("primary_aoi", None), ("gaze_on_aoi_x", 5), ("gaze_on_aoi_y", 5), ("primary_surface", None), ("aoi_hit_source", None), ("primary_marker_count", None))]
    hits = [flag(F.coalesce(F.try_element_at("hits", F.lit(a)), F.lit(False))).alias(f"{a}_hit") for a in areas]
    visits = [F.coalesce(F.try_element_at("visits", F.lit(a)), F.lit(0)).cast("string").alias(f"{a}_visits") for a in areas]
    start = [F.when(F.col("primary_aoi").isNotNull(), "True").otherwise("").alias("primary_surface_initialized")]
    change = [_optional("aoi_transition").alias("aoi_transition"), _fixed("time_in_current_aoi_ms", 1).alias("time_in_current_aoi_ms")]
    return frames.select("recording", *plain, *optional, *hit, *main, *start, *hits, *change, *visits, joined_ints(F.col("markers")).alias("markers_detected"))


def write_frames(frames: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by recording, rows in frame order for row-group skipping; only the written recordings are replaced. Long recordings are dealt to several tasks."""
    frames.repartitionByRange("recording", "frame_idx").sortWithinPartitions("recording", "frame_idx").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("recording").parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV files with a header, in the given order."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_recording_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files for each recording."""
    df.repartitionByRange("recording", F.col("frame_idx").cast("int")).sortWithinPartitions("recording", F.col("frame_idx").cast("int")).write.mode("overwrite").option("header", True).partitionBy("recording").csv(path)


def as_json(df: DataFrame, key: str = "recording") -> DataFrame:
    """key and json: each row as one JSON object, maps as objects."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))


def task_json(tasks: DataFrame) -> DataFrame:
    """recording, json: each recording's tasks as {name: {start, end}}; missing bounds stay null."""
    entry = F.struct(F.col("task_name"), F.struct(F.col("start_frame").alias("start"), F.col("end_frame").alias("end")))
    return tasks.groupBy("recording").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry))), {"ignoreNullFields": "false"}).alias("json"))


def trim_json(trims: DataFrame) -> DataFrame:
    """recording, json: each recording's trim; an open end stays null."""
    return trims.select("recording", F.to_json(F.struct("start_frame", "end_frame", "padding_s"), {"ignoreNullFields": "false"}).alias("json"))


def error_json(errors: DataFrame) -> DataFrame:
    """recording, json: each recording's errors as {task: counts}; of repeated rows of a task the counts add up."""
    counts = ["comp_number", "comp_type", "comp_orientation", "cable_position", "cable_colour"]
    of_task = errors.groupBy("recording", "task_name").agg(*[F.sum(c).cast("int").alias(c) for c in counts])
    return of_task.groupBy("recording").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task_name", F.struct(*counts)))))).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """The json column as one file for each recording's folder."""
    df.select("recording", F.col("json").alias("value")).write.mode("overwrite").partitionBy("recording").text(path)


def readme_sheet(spark) -> DataFrame:
    return spark.createDataFrame(SHEETS, "Sheet string, Description string")


def region_json(regions: DataFrame) -> DataFrame:
    """The configuration of generated masks: surface, its masks with priority 200 less their place."""
    item = F.struct((-F.col("priority")).alias("o"), F.struct("name", "priority", F.col("mask_path").alias("path")).alias("i"))
    masks = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"])
    return regions.groupBy("surface").agg(F.to_json(F.struct(masks.alias("masks"))).alias("json"))
