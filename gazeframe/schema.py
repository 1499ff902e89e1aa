"""Schemas of the tables that the operators take and give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

RECORDINGS = "recording string, condition string, difficulty string, path string"
FRAMES = "recording string, frame_idx int, ts_ns bigint"
GAZE = "recording string, ts_ns bigint, x double, y double"
FIXATIONS = "recording string, fixation_id int, start_ns bigint, stop_ns bigint, mean_x double, mean_y double"
CAMERAS = "recording string, k array<array<double>>, d array<double>"
DETECTIONS = "recording string, frame_idx int, tag_id int, corners array<struct<x:double,y:double>>"
AOI_TAGS = "aoi string, tag_id int, pos int"
ZONES = "zone_group string, zone string, x0 double, y0 double, x1 double, y1 double"
REGIONS = "name string, surface string, kind string, priority int, bounds struct<u1:double,u2:double,v1:double,v2:double>, points array<struct<x:double,y:double>>, mask_path string"
EDITS = "recording string, start_frame int, end_frame int, label string, seq bigint"
TASKS = "recording string, task_name string, start_frame int, end_frame int"
ERRORS = "recording string, task_name string, comp_number int, comp_type int, comp_orientation int, cable_position int, cable_colour int"
#: Columns of a frame table file that don't depend on the configured areas, in file order.
ANALYSIS = (
    "timestamp_ns bigint, time_s double, frame_idx int, gaze_x_px double, gaze_y_px double, is_fixation boolean, fixation_id int, fixation_dur_ms double, fixation_gaze_x double, fixation_gaze_y double, any_aoi_hit boolean, "
    "primary_aoi string, gaze_on_aoi_x double, gaze_on_aoi_y double, primary_surface string, aoi_hit_source string, primary_marker_count int, primary_surface_initialized boolean"
)
TASK_JSON = "map<string,struct<start:int,end:int>>"
TRIM_JSON = "start_frame int, end_frame int, padding_s double"
QUALITY_JSON = "recording string, total_frames int, valid_gaze_frames int, missing_gaze_pct double, recording_duration_s double, fixation_count int, fps double"
ERROR_JSON = "map<string,struct<comp_number:int,comp_type:int,comp_orientation:int,cable_position:int,cable_colour:int>>"


def no_nans(df: DataFrame) -> DataFrame:
    """Every NaN as null, so that aggregates skip it as missing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])
