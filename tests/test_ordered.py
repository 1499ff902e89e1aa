"""Values carried over chunks against plain lists, and what the plans of heavy queries read."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gazeframe.operators import align, ordered
from gazeframe.plans import adapter, queries

TINY = "/root/testdata/sf0.001"


def rows_of(seed, n=120):
    r = random.Random(seed)
    return [(key, t, r.choice([None, r.randrange(9)])) for key in "ab" for t in r.sample(range(400), n)]


def by_key(rows):
    return {k: sorted((x for x in rows if x[0] == k), key=lambda x: x[1]) for k in {x[0] for x in rows}}


@pytest.mark.parametrize("size", [3, 40, 1000])
def test_places_and_trailing_values(spark, size):
    rows = rows_of(size)
    df = spark.createDataFrame(rows, "key string, t int, v int")
    out = ordered.placed(df, ["key"], "t", "place", "first", size)
    out = ordered.trailing(out, ["key"], "t", F.col("v"), "before", 4, size)
    got = {(x["key"], x["t"]): (x["place"], x["first"], x["before"]) for x in out.collect()}
    want = {(k, x[1]): (i, xs[0][1], [y[2] for y in xs[max(0, i - 4) : i]]) for k, xs in by_key(rows).items() for i, x in enumerate(xs)}
    assert got == want


@pytest.mark.parametrize("size", [3, 1000])
def test_nearest_takes_the_closer_side_over_any_chunks(spark, size):
    r = random.Random(size)
    left = [("a", t, i) for i, t in enumerate(r.sample(range(300), 60))] + [("c", 5, 99)]
    right = [("a", t, r.randrange(100)) for t in r.sample(range(300), 25)] + [("a", 250, 7), ("a", 250, 3), ("b", 5, 1)]
    got = align.asof_join(spark.createDataFrame(left, "key string, t int, i int"), spark.createDataFrame(right, "key string, t int, v int"), ["key"], "t", ["v"], chunk=size)
    want = {}
    for key, t, i in left:
        near = sorted((abs(s - t), s) for k, s, _ in right if k == key)
        want[i] = (None, None)
        if near:
            at = near[0][1]
            vs = [v for k, s, v in right if k == key and s == at]
            want[i] = (max(vs) if at <= t else min(vs), at)
    assert {x["i"]: (x["v"], x["t_right"]) for x in got.collect()} == want


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no tables")
@pytest.mark.parametrize("name", ["scanpath_window", "task_metrics", "asof_nearest", "reviewed_export", "time_in_aoi", "overall_stats"])
def test_heavy_queries_read_the_events_no_more_than_twice(spark, name, monkeypatch):
    plans = []
    kept = adapter.settled
    monkeypatch.setattr(adapter, "settled", lambda df: plans.append(df) or kept(df))
    plans.append(queries.QUERIES[name](spark, TINY))
    scans = sum(p._jdf.queryExecution().optimizedPlan().toString().count("Relation [event_id") for p in plans)
    assert 1 <= scans <= 2


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no tables")
def test_no_window_over_a_whole_recording_numbers_the_frames(spark):
    plan = adapter.frames(spark, TINY).select("recording", "frame_idx", "time_s")._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.splitlines() if "row_number" in line and "Window" in line]
    assert rows and all("__chunk" in line for line in rows)
