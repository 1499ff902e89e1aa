"""Runs with broken files, racing generations and reruns; pruned scans of files whose headers differ."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from gazeframe.sources import readers, scans
from gazeframe.streaming import runs

SCHEMA, OUT = "frame_idx int, label string", "n long"


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def frames(source, name, n, bad=None):
    put(f"{source}/{name}/frames.csv", "frame_idx,label\n" + "".join(f"{i},Board\n" for i in range(n)) + (bad or ""))


def counted(rows):
    return rows.groupBy("recording").agg(F.count("*").alias("n"))


def shown(spark, root):
    return {x["recording"]: (x["n"], x["generation"]) for x in runs.results(spark, root, OUT).collect()}


def test_a_broken_file_is_set_aside_and_the_others_go_on(spark):
    source, root = folder(), folder()
    frames(source, "r1", 3)
    frames(source, "r2", 4, "x7,Board\n")
    frames(source, "r3", 5)
    os.makedirs(f"{source}/empty")
    assert runs.run(spark, source, root, SCHEMA, counted) == 1
    assert shown(spark, root) == {"r1": (3, 1), "r3": (5, 1)}
    aside = runs.quarantined(spark, root).collect()
    assert [(x["recording"], x["line"], x["generation"]) for x in aside] == [("r2", "x7,Board", 1)]
    assert [tuple(x) for x in runs.progress(spark, root).collect()] == [(1, "done", 3, 13, 1)]
    assert not os.listdir(f"{root}/work")


def test_a_rerun_takes_up_only_what_is_new(spark):
    source, root = folder(), folder()
    frames(source, "r1", 3)
    runs.run(spark, source, root, SCHEMA, counted)
    before = sorted(os.path.join(d, f) for d, _, fs in os.walk(f"{root}/results") for f in fs)
    frames(source, "r1", 9)
    frames(source, "r2", 2)
    assert runs.run(spark, source, root, SCHEMA, counted) == 2
    assert shown(spark, root) == {"r1": (3, 1), "r2": (2, 2)}
    assert set(before) <= {os.path.join(d, f) for d, _, fs in os.walk(f"{root}/results") for f in fs}
    assert runs.run(spark, source, root, SCHEMA, counted) == 3
    assert {x["status"] for x in runs.progress(spark, root).collect()} == {"done", "nothing to do"}


def test_an_older_generation_is_discarded(spark):
    source, root = folder(), folder()
    frames(source, "r1", 3)
    later = []

    def slow(rows):
        if not later:  # a second run begins, and ends, while the first one works
            later.append(None)
            later.append(runs.run(spark, source, root, SCHEMA, lambda r: counted(r).withColumn("n", F.col("n") + 100)))
        return counted(rows)

    assert runs.run(spark, source, root, SCHEMA, slow) == 1
    assert later[1] == 2 and shown(spark, root) == {"r1": (103, 2)}
    assert {x["generation"]: x["status"] for x in runs.progress(spark, root).collect()} == {1: "discarded", 2: "done"}


def test_each_run_has_a_generation_of_its_own(spark, monkeypatch):
    root = folder()
    first = runs.begin(spark, root)
    kept = runs.newest
    seen = iter([first - 1])  # a racing process looked before the first one began
    monkeypatch.setattr(runs, "newest", lambda *a: next(seen, None) if (x := None) is None and seen.__length_hint__() else kept(*a))
    assert runs.begin(spark, root) == first + 1


def test_results_before_any_run_are_empty(spark):
    root = folder()
    assert runs.results(spark, root, OUT).count() == runs.quarantined(spark, root).count() == runs.progress(spark, root).count() == 0


# Scans


@pytest.fixture(scope="module")
def recordings():
    source = folder()
    put(f"{source}/a/aoi_results/raw/analysis.csv", "﻿timestamp_ns,time_s,frame_idx,gaze_x_px,is_fixation,primary_aoi,Board_hit\n100,0.1,0,5.5,True,Board,True\n200,0.2,1,nan,False,,False\n")
    put(f"{source}/b/aoi_results/raw/analysis.csv", "frame_idx,primary_aoi,time_s,timestamp_ns\n7,Screen,0.7,700\n8, Board ,0.8,800\n")
    put(f"{source}/b/aoi_results/analysis.csv", "")  # blank: the raw file counts
    put(f"{source}/d/aoi_results/analysis.csv", "frame_idx,primary_aoi,time_s,timestamp_ns\n")  # a header alone counts, and has no rows
    put(f"{source}/d/aoi_results/raw/analysis.csv", "frame_idx,primary_aoi,time_s,timestamp_ns\n1,Board,0.1,100\n")
    put(f"{source}/c/aoi_results/analysis.csv", "timestamp_ns,time_s,frame_idx,gaze_x_px,is_fixation,primary_aoi,Board_hit\n300,0.3,3,1.25,False,Board,False\n")
    return source


def test_scans_of_differing_headers_meet_by_name(spark, recordings):
    groups = scans.header_groups(spark, recordings)
    assert sorted(len(files) for _, files in groups) == [2, 2]
    got = sorted(map(tuple, scans.frame_scan(spark, recordings, ["frame_idx", "time_s", "primary_aoi", "gaze_x_px", "is_fixation", "Board_hit"]).collect()))
    assert got == [("a", 0, 0.1, "Board", 5.5, True, True), ("a", 1, 0.2, None, None, False, False), ("b", 7, 0.7, "Screen", None, None, None), ("b", 8, 0.8, "Board", None, None, None), ("c", 3, 0.3, "Board", 1.25, False, False)]


def test_only_asked_columns_reach_the_reader(spark, recordings):
    plan = scans.frame_scan(spark, recordings, ["frame_idx", "primary_aoi"]).where("frame_idx > 1")._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1].strip() for line in plan.splitlines() if "ReadSchema: " in line]
    assert len(schemas) == 2 and all("time_s" not in s and "frame_idx" in s and "primary_aoi" in s for s in schemas)
    assert plan.count("PushedFilters: [IsNotNull(frame_idx), GreaterThan(frame_idx,1)]") == 2


def test_the_scan_agrees_with_the_reader_by_lines(spark, recordings):
    names = ["recording", "timestamp_ns", "frame_idx", "time_s", "primary_aoi", "gaze_x_px"]
    a, b = scans.frame_scan(spark, recordings).select(names), readers.frame_table(spark, recordings).select(names)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_no_matching_file_gives_an_empty_table(spark):
    source = folder()
    for read in (scans.frame_scan, readers.frame_table, readers.fixation_table, readers.task_table, readers.error_table, readers.quality_table, readers.trim_table):
        out = read(spark, source)
        assert out.count() == 0 and "recording" in out.columns
