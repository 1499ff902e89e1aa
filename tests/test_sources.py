import json
import os

import pytest
from pyspark.sql import functions as F

from gazeframe.schema import no_nans
from gazeframe.sources import readers, sinks

HEAD = "timestamp_ns,time_s,frame_idx,gaze_x_px,gaze_y_px,is_fixation,fixation_id,primary_aoi,Board_hit,Screen_hit,any_aoi_hit,markers_detected"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = str(tmp_path_factory.mktemp("study") / "hard")
    rows = ["1,0.0333,0,10.50,nan,True,3,Board,True,False,True,1;2", "2,0.0667,1,nan,nan,False,,,False,False,False,"]
    for name in ("2024-01-02-03-04-05", "rec b", "rec c"):
        write(f"{top}/{name}/info.json", "{}")
    write(f"{top}/aoi_results/info.json", "{}")
    write(f"{top}/.hidden/info.json", "{}")
    a, b, c = (f"{top}/{n}/aoi_results" for n in ("2024-01-02-03-04-05", "rec b", "rec c"))
    write(f"{a}/raw/analysis.csv", "\n".join([HEAD, *rows]) + "\n")
    write(f"{a}/analysis.csv", "﻿" + "\n".join([HEAD + ",final_primary_aoi,edit_source", rows[0] + ",Screen,manual", rows[1] + ",,auto"]) + "\n")
    write(f"{b}/raw/analysis.csv", "\n".join([HEAD, *rows]) + "\n")
    write(f"{b}/analysis.csv", "")
    write(f"{a}/raw/tasks.json", "﻿" + json.dumps({"Task 1": {"start": 0, "end": 9}, "Task 2": {"start": None, "end": 4}}))
    write(f"{a}/tasks.json", json.dumps({"Task 9": {"start": 1, "end": 2}}))
    write(f"{b}/tasks.json", "{broken")
    write(f"{c}/raw/errors.json", json.dumps({"Task 1": {"comp_number": 1, "comp_type": 2, "comp_orientation": 3, "cable_position": 5, "cable_colour": 4}}))
    write(f"{c}/raw/trim.json", json.dumps({"start_frame": 3, "end_frame": 30, "padding_s": 0.5}))
    write(f"{c}/raw/data_quality.json", json.dumps({"recording": "rec c", "total_frames": 5, "valid_gaze_frames": 4, "missing_gaze_pct": 20.0, "recording_duration_s": 1.5, "fixation_count": 2, "fps": 30.0}))
    write(f"{c}/raw/fixation_summary.csv", "fixation_id,start_frame,end_frame,start_time_s,end_time_s,duration_s,dominant_aoi,centroid_x,centroid_y\n0,1,3,0.1,0.2,0.1,Board,nan,2.5\n")
    return top


def test_recordings(spark, folder):
    rows = readers.recording_dirs(spark, folder).collect()
    assert [(r["recording"], r["difficulty"]) for r in rows] == [("2024-01-02-03-04-05", "Hard"), ("rec b", "Hard"), ("rec c", "Hard")]
    assert readers.recording_dirs(spark, folder, named=True).count() == 1


def test_distinct_sources(spark):
    df = spark.createDataFrame([("/b", 0), ("/a", 1), ("/b", 2)], "path string, pos int")
    assert [r["path"] for r in readers.distinct_sources(df).collect()] == ["/b", "/a"]


def test_frame_tables_take_the_first_file_with_rows(spark, folder):
    rows = {(r["recording"], r["frame_idx"]): r for r in readers.frame_table(spark, folder).collect()}
    assert len(rows) == 4
    a, b = rows["2024-01-02-03-04-05", 0], rows["rec b", 0]
    assert (a["final_primary_aoi"], a["has_final"], b["final_primary_aoi"], b["has_final"]) == ("Screen", True, None, False)
    assert (a["gaze_x_px"], a["gaze_y_px"], a["is_fixation"], a["fixation_id"], a["hits"]) == (10.5, None, True, 3, {"Board": True, "Screen": False})
    assert rows["rec b", 1]["primary_aoi"] is None and rows["rec b", 1]["fixation_id"] is None
    assert {r["recording"] for r in readers.frame_table(spark, folder, readers.FINAL_ONLY).collect()} == {"2024-01-02-03-04-05"}


def test_side_files(spark, folder):
    raw = {(r["task_name"], r["start_frame"], r["end_frame"]) for r in readers.task_table(spark, folder).collect()}
    assert raw == {("Task 1", 0, 9), ("Task 2", None, 4)}
    assert {r["task_name"] for r in readers.task_table(spark, folder, readers.FINAL_FIRST).collect()} == {"Task 9"}
    assert readers.error_table(spark, folder).collect()[0]["cable_position"] == 5
    assert readers.trim_table(spark, folder).collect()[0]["padding_s"] == 0.5
    assert readers.quality_table(spark, folder).collect()[0]["valid_gaze_frames"] == 4
    f = readers.fixation_table(spark, folder).collect()[0]
    assert (f["recording"], f["centroid_x"], f["centroid_y"]) == ("rec c", None, 2.5)


def test_configurations(spark, tmp_path):
    write(f"{tmp_path}/aois.json", json.dumps({"aois": {"Board": [3, 2], "Deck": [6]}, "colors": {}}))
    assert {tuple(r) for r in readers.aoi_tags(spark, f"{tmp_path}/aois.json").collect()} == {("Board", 0, 3), ("Board", 1, 2), ("Deck", 0, 6)}
    write(f"{tmp_path}/zones.json", json.dumps({"zones": {"task": {"Card": {"x0": 0.1, "y0": 0.2, "x1": 0.3, "y1": 0.4}}}}))
    assert tuple(readers.zones(spark, f"{tmp_path}/zones.json").collect()[0]) == ("task", "Card", 0.1, 0.2, 0.3, 0.4)


ITEMS = [{"name": " A ", "bounds": {"u_min": 0, "u_max": 1, "v_min": 0, "v_max": 0.5}}, {"label": "B", "points": [[0, 0], [1, 0], [1, 1]], "priority": 7}, {"name": "C", "path": "c.png"}, {"name": "", "path": "x.png"}, {"name": "D", "bounds": [0, 1, 0]}, {"name": "E", "points": [[0, 0]]}, {"name": "F", "bounds": [0, 0.5, 0, 1]}]


@pytest.mark.parametrize("layout", ["surfaces", "regions", "list"])
def test_region_layouts(spark, tmp_path, layout):
    items = ITEMS if layout == "surfaces" else [{**i, "surface": "Screen"} for i in ITEMS]
    payload = {"surfaces": {"Screen": {"masks": items}}} if layout == "surfaces" else {"regions": items} if layout == "regions" else items
    write(f"{tmp_path}/{layout}.json", json.dumps(payload))
    got = {r["name"]: r for r in readers.regions(spark, f"{tmp_path}/{layout}.json").collect()}
    assert {n: (r["kind"], r["priority"]) for n, r in got.items()} == {"A": ("bbox", 100), "B": ("polygon", 7), "C": ("mask", 98), "F": ("bbox", 94)}
    assert got["A"]["bounds"]["v2"] == 0.5 and len(got["B"]["points"]) == 3 and got["C"]["mask_path"] == f"{tmp_path}/c.png" and {r["surface"] for r in got.values()} == {"Screen"}


def test_writers(spark, tmp_path):
    f = spark.createDataFrame(
        [("r", 5, 0.03333, 0, None, 2.345, True, 3, 12.34, 1.0, 2.0, "Board", 0.123456, 1.0, "Board", "direct", 2, "NoAOI->Board", 0.0, {"Board": True}, {"Board": 1}, [2, 1])],
        "recording string, timestamp_ns long, time_s double, frame_idx int, gaze_x_px double, gaze_y_px double, is_fixation boolean, fixation_id int, fixation_dur_ms double, fixation_gaze_x double, fixation_gaze_y double, primary_aoi string, gaze_on_aoi_x double, gaze_on_aoi_y double, primary_surface string, aoi_hit_source string, primary_marker_count int, aoi_transition string, time_in_current_aoi_ms double, hits map<string,boolean>, visits map<string,int>, markers array<int>",
    )
    wide = sinks.wide_frames(f, ["Board", "Screen"])
    r = wide.collect()[0]
    assert (r["time_s"], r["gaze_x_px"], r["gaze_y_px"], r["Board_hit"], r["Screen_hit"], r["Screen_visits"], r["markers_detected"], r["gaze_on_aoi_x"]) == ("0.0333", "nan", "2.34", "True", "False", "0", "1;2", "0.12346")
    sinks.write_recording_csv(wide, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 1
    sinks.write_frames(f, f"{tmp_path}/pq")
    sinks.write_frames(f.withColumn("recording", F.lit("s")), f"{tmp_path}/pq")
    assert spark.read.parquet(f"{tmp_path}/pq").count() == 2
    t = spark.createDataFrame([("r", "Task 1", 1, None)], "recording string, task_name string, start_frame int, end_frame int")
    assert json.loads(sinks.task_json(t).collect()[0]["json"]) == {"Task 1": {"start": 1, "end": None}}
    assert json.loads(sinks.as_json(t).collect()[0]["json"])["task_name"] == "Task 1"
    assert sinks.readme_sheet(spark).count() == 5


def test_nan_becomes_null(spark):
    df = no_nans(spark.createDataFrame([(float("nan"), 1)], "x double, i int"))
    assert df.collect()[0]["x"] is None


def test_trim_and_error_files_read_back(spark, tmp_path):
    trims = spark.createDataFrame([("r", 3, None, 0.5)], "recording string, start_frame int, end_frame int, padding_s double")
    assert json.loads(sinks.trim_json(trims).collect()[0]["json"]) == {"start_frame": 3, "end_frame": None, "padding_s": 0.5}
    rows = [("r", "Task 1", 1, 2, 3, 5, 4), ("r", "Task 2", 0, 0, 1, 0, 0)]
    errors = spark.createDataFrame(rows, "recording string, task_name string, comp_number int, comp_type int, comp_orientation int, cable_position int, cable_colour int")
    (tmp_path / "r" / "aoi_results").mkdir(parents=True)
    (tmp_path / "r" / "aoi_results" / "errors.json").write_text(sinks.error_json(errors).collect()[0]["json"])
    (tmp_path / "r" / "aoi_results" / "trim.json").write_text(sinks.trim_json(trims).collect()[0]["json"])
    names = ["recording", "task_name", "comp_number", "comp_type", "comp_orientation", "cable_position", "cable_colour"]
    assert sorted(map(tuple, readers.error_table(spark, str(tmp_path)).select(names).collect())) == rows
    assert [tuple(x) for x in readers.trim_table(spark, str(tmp_path)).collect()] == [("r", 3, None, 0.5)]
