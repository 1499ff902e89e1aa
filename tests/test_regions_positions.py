"""Regions by priority and rows by place, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from gazeframe.operators import positions, regions

REGION = "idx int, name string, surface string, kind string, priority int, u1 double, u2 double, v1 double, v2 double, points array<struct<x:double,y:double>>, rows array<string>"


def region(idx, kind, priority, box=None, points=None, rows=None, surface="Screen"):
    return (idx, f"n{idx}", surface, kind, priority, *(map(float, (box[0], box[2], box[1], box[3])) if box else (None,) * 4), [{"x": float(x), "y": float(y)} for x, y in points] if points else None, rows)


def test_highest_priority_wins_and_ties_go_to_the_first(spark):
    listed = [
        region(0, "bbox", 1, (0.0, 0.0, 1.0, 1.0)), region(1, "bbox", 5, (0.4, 0.4, 0.6, 0.6)), region(2, "bbox", 5, (0.5, 0.5, 0.9, 0.9)), region(3, "polygon", 9, points=[(0.8, 0.0), (1.0, 0.0), (1.0, 0.2)]),
        region(4, "mask", 7, rows=["1000", "0000"]), region(5, "polygon", 99, points=[(0, 0), (1, 1)]), region(6, "bbox", 99), region(7, "bbox", 99, (0, 0, 1, 1), surface="Board"), region(8, "bbox", 2, (1.2, -9.0, 7.0, 9.0)), region(9, "odd", 99, (0, 0, 1, 1)),
    ]
    points = [(0, "Screen", 0.55, 0.55), (1, "Screen", 0.6, 0.6), (2, "Screen", 0.95, 0.05), (3, "Screen", 0.05, 0.1), (4, "Screen", 0.3, 0.9), (5, "Board", 1.0, 1.0), (6, "Screen", float("nan"), 0.5), (7, "Screen", None, 0.5), (8, "Screen", 3.0, 4.0), (9, None, 0.5, 0.5), (10, "Screen", 1.05, 0.5), (11, "Screen", 0.9, 0.1)]
    got = regions.resolved(spark.createDataFrame(points, "i int, surface string, u double, v double"), spark.createDataFrame(listed, REGION), ["i"])
    assert {x["i"]: x["region"] for x in got.collect()} == {0: "n1", 1: "n1", 2: "n3", 3: "n4", 4: "n0", 5: "n7", 6: None, 7: None, 8: "n8", 9: None, 10: None, 11: "n3"}
    assert [x["name"] for x in regions.names_in_order(spark.createDataFrame(listed, REGION)).orderBy(F.desc("priority"), "idx").collect()][:2] == ["n5", "n6"]


@pytest.mark.parametrize("cells", [1, 7, 32])
def test_the_grid_finds_what_brute_force_finds(spark, cells):
    r = random.Random(cells)
    boxes = [(x := r.uniform(-0.2, 1), y := r.uniform(-0.2, 1), x + r.uniform(0, 0.5), y + r.uniform(0, 0.5)) for _ in range(300)]
    listed = [region(i, "bbox", r.randrange(6), b) for i, b in enumerate(boxes)]
    points = [(i, "Screen", r.uniform(-0.3, 1.5), r.uniform(-0.3, 1.5)) for i in range(300)] + [(300 + i, "Screen", boxes[i][0], boxes[i][3]) for i in range(20)]
    want = {}
    for i, _, u, v in points:
        inside = [(-t[4], t[0]) for t, b in zip(listed, boxes, strict=True) if b[0] <= u <= b[2] and b[1] <= v <= b[3]]
        want[i] = f"n{min(inside)[1]}" if inside else None
    got = regions.resolved(spark.createDataFrame(points, "i int, surface string, u double, v double"), spark.createDataFrame(listed, REGION), ["i"], cells)
    assert {x["i"]: x["region"] for x in got.collect()} == want
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("size", [3, 1000])
def test_zip_ends_with_the_shorter_side(spark, size):
    a = spark.createDataFrame([("x", i * 2, f"a{i}") for i in range(9)] + [("y", 5, "a")], "recording string, t int, name string")
    b = spark.createDataFrame([("x", 100 + i * 7, f"b{i}") for i in range(7)] + [("z", 5, "b")], "recording string, t int, name string")
    got = positions.zipped(a, b, ["recording"], "t", "t", size, size).orderBy("position").collect()
    assert [(x["position"], x["t"], x["name"], x["t_right"], x["name_right"]) for x in got] == [(i, i * 2, f"a{i}", 100 + i * 7, f"b{i}") for i in range(7)]


FRAMES = "recording string, ts_us int, frame_idx int, time_s double"


def slices(spark, frames, start, end):
    ranges = spark.createDataFrame([("r", start, end)], "recording string, start_frame int, end_frame int")
    df = spark.createDataFrame([("r", t, i, s) for t, (i, s) in enumerate(frames)], FRAMES)
    cut = [x["ts_us"] for x in positions.sliced(df, ranges, "ts_us", 3).orderBy("ts_us").collect()]
    return cut, positions.durations(df, ranges, F.lit(2.0), "ts_us", 3).collect()[0]["duration_s"]


def test_slices_and_durations_by_index(spark):
    frames = [(i + 10, i * 0.5) for i in range(20)]
    assert slices(spark, frames, 12, 15) == ([2, 3, 4, 5], 1.5)
    assert slices(spark, frames, 25, 99) == ([15, 16, 17, 18, 19], 2.0)
    assert slices(spark, frames, 15, 12)[0] == [] and slices(spark, frames, 12, 12) == ([], 0.5)
    assert slices(spark, frames, 90, 99) == ([], 5.0)


def test_slices_and_durations_by_place_where_an_index_is_missing(spark):
    frames = [(None if i == 13 else i + 10, None if i == 9 else i * 0.5) for i in range(20)]
    assert slices(spark, frames, 2, 5) == ([2, 3, 4, 5], 1.5)
    assert slices(spark, frames, -5, 2)[0] == [0, 1, 2]  # held inside the recording
    assert slices(spark, frames, 17, 99) == ([17, 18, 19], 41.5)  # no row at the end's place: frames over the rate
    assert slices(spark, frames, 2, 9) == ([2, 3, 4, 5, 6, 7, 8, 9], 4.0)  # no time there
    assert slices(spark, frames, 19, 30)[0] == []
    assert slices(spark, frames, 9, 2)[1] == 0.0


def test_points_meet_no_region_behind_a_box_around_the_whole_cell(spark):
    r = random.Random(5)
    box = lambda: (x := r.uniform(-0.1, 0.9), y := r.uniform(-0.1, 0.9), x + r.uniform(0.1, 0.3), y + r.uniform(0.1, 0.3))
    listed = [region(0, "bbox", 9, (-0.1, -0.1, 1.1, 1.1)), region(1, "polygon", 99, points=[(0, 0), (0.2, 0), (0, 0.2)])] + [region(i, "bbox", r.randrange(9), box()) for i in range(2, 400)]
    each = regions.covering(spark.createDataFrame(listed, REGION))
    inside = each.where(F.col("cu").between(0, regions.CELLS - 1) & F.col("cv").between(0, regions.CELLS - 1))
    assert {x["idx"]: x["count"] for x in inside.groupBy("idx").count().collect()} == {0: regions.CELLS**2, 1: 49}
    # However small the table looks, its cells are not broadcast from the driver.
    points = spark.createDataFrame([(0, "Screen", 1.0, 1.0), (1, "Screen", 0.05, 0.05), (2, "Screen", 1.1, 1.1)], "i int, surface string, u double, v double")
    got = regions.resolved(points, spark.createDataFrame(listed, REGION), ["i"])
    assert {x["i"]: x["region"] for x in got.collect()} == {0: "n0", 1: "n1", 2: "n0"}
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
