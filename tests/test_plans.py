import os

import pytest
from pyspark.sql import functions as F

from gazeframe.operators import sequence
from gazeframe.plans import adapter, analysis, queries, reports
from gazeframe.streaming import frames as stream

TINY = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(TINY), reason="no test tables")


def test_stream_equals_batch(spark, tmp_path):
    import random

    random.seed(7)
    rows = [(rec, i, random.choice(["Board", "Screen", "NoAOI"])) for rec in (1, 2) for i in range(60)]
    for part in range(3):
        own = [x for x in rows if part * 20 <= x[1] < part * 20 + 20]
        random.shuffle(own)
        spark.createDataFrame(own, "recording bigint, frame_idx int, label string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("recording bigint, frame_idx int, label string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.sequence_stream(src, 10.0).writeStream.format("memory").queryName("seq_out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["recording"], r["frame_idx"]): (r["aoi_transition"], r["visits"], r["time_in_current_aoi_ms"]) for r in spark.table("seq_out").collect()}
    batch = spark.createDataFrame(rows, "recording bigint, frame_idx int, label string")
    v = sequence.cumulative_visits(batch).select("recording", "frame_idx", "visits")
    t = sequence.time_in_area(batch, 10.0).select("recording", "frame_idx", "time_in_current_aoi_ms")
    want = sequence.transitions(batch).join(v, ["recording", "frame_idx"]).join(t, ["recording", "frame_idx"]).collect()
    assert len(got) == 120
    for r in want:
        assert got[r["recording"], r["frame_idx"]] == (r["aoi_transition"], r["visits"], r["time_in_current_aoi_ms"])


def test_new_files_are_taken_once(spark, tmp_path):
    schema = "recording bigint, frame_idx int"
    for n in (1, 2):
        spark.range(n * 10).selectExpr("id AS recording", "CAST(id AS INT) AS frame_idx").write.mode("append").parquet(f"{tmp_path}/src")
        for _ in range(2):
            stream.new_recordings(spark, f"{tmp_path}/src", schema, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == (10, 30)[n - 1]


def test_disorder_is_seen(spark):
    g = spark.createDataFrame([("a", 0, 1), ("a", 1, 5), ("a", 2, 4), ("b", 0, 1), ("b", 1, 2)], "recording string, pos int, ts_us long")
    assert {r["recording"]: r["disordered"] for r in stream.out_of_order(g).collect()} == {"a": True, "b": False}


def test_raw_streams_to_frames(spark):
    fr = spark.createDataFrame([("r", i, i * 100) for i in range(6)], "recording string, frame_idx int, ts_us long")
    gz = spark.createDataFrame([("r", i * 100 + 3, 50.0 if i < 3 else 500.0, 50.0) for i in range(6)] + [("r", 90, float("nan"), 1.0)], "recording string, ts_us long, x double, y double")
    fx = spark.createDataFrame([("r", 0, 90, 210, 1.0, 2.0)], "recording string, fixation_id int, start long, stop long, mean_x double, mean_y double")
    quad = [("Board", 2, 0.0, 0.0, 100.0, 0.0, 100.0, 100.0, 0.0, 100.0), ("Screen", 0, 0.0, 0.0, 60.0, 0.0, 60.0, 60.0, 0.0, 60.0)]
    q = spark.createDataFrame([("r", i, *x) for i in range(0, 6, 2) for x in quad], "recording string, frame_idx int, surface string, own_tags int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    out = analysis.build_gaze_frames(gz, fr, fx, q, frame_ms=10.0, stride=2).orderBy("frame_idx").collect()
    assert [r["label"] for r in out] == ["Screen"] * 3 + ["NoAOI"] * 3
    assert out[0]["surfaces_hit"] == "Board;Screen" and out[0]["aoi_hit_source"] == "projected"
    assert [r["fixation_id"] for r in out] == [None, 0, 0, None, None, None]
    assert [r["aoi_transition"] for r in out] == ["NoAOI->Screen", None, None, "Screen->NoAOI", None, None]
    assert [r["time_in_current_aoi_ms"] for r in out] == [0, 10, 20, 0, 10, 20] and [r["visits"] for r in out] == [1, 1, 1, 0, 0, 0]
    trim = spark.createDataFrame([("r", 2, 4)], "recording string, start_frame int, end_frame int")
    assert analysis.build_gaze_frames(gz, fr, fx, q, trim).count() == 3


def test_detection_passes(spark):
    d = lambda rows: spark.createDataFrame(rows, "recording string, frame_idx int, tag_id int, corners string")
    both = analysis.merged_detections(d([("r", 0, 12, "a"), ("r", 0, 14, "a")]), d([("r", 0, 12, "b"), ("r", 1, 13, "b")]))
    assert {(r["frame_idx"], r["tag_id"]): r["corners"] for r in both.collect()} == {(0, 12): "b", (0, 14): "a", (1, 13): "b"}
    f = spark.createDataFrame([("r", i) for i in range(100)], "recording string, frame_idx int")
    assert analysis.sparse_detection(both, f, [12, 14]).collect()[0]["sparse"]


@needs_data
def test_reports(spark):
    f = adapter.frames(spark, TINY).cache()
    t = adapter.tasks(f)
    sheets = reports.master_tables(f, t)
    assert sheets["Recording_Summary"].count() == 15 and sheets["Task_Metrics"].count() == t.count() and sheets["README"].count() == 5
    c = reports.compare_conditions(f, t)
    assert c.aoi_stats.count() == 12 and c.overall_stats.count() == 2 and c.screen_tests.count() == 16 and c.screen_position.count() == 2
    tables = reports.dashboard(f, t, adapter.errors(f))
    top = tables["all_heatmap"].groupBy("label").agg(F.max("level").alias("m"), F.count("*").alias("n")).collect()
    assert all(r["m"] == 1 and r["n"] == 625 for r in top)
    assert tables["errors"].count() == tables["learning_curve"].count() and tables["timeline"].count() > 0


@needs_data
@pytest.mark.parametrize("name", ["dwell_pct", "asof_nearest", "fixation_interval_join", "gap_fill", "label_runs", "mannwhitney_u", "homography_uv"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, TINY).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    norm = lambda rows: [x.replace(".0,", ",").replace(".0)", ")") for x in rows]
    assert norm(key(got)) == norm(key(want))


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL) and len(queries.QUERIES) >= 60


def test_gaze_stands_beside_its_quads(spark, tmp_path):
    """Quads made of a frame meet its gaze without a join; frames of no recording hit nothing."""
    from datetime import datetime

    from gazeframe.operators import spatial
    from gazeframe.plans import adapter as ad
    from gazeframe.plans import queries as plans

    rows = [(i, None if i % 5 == 0 else i % 3, datetime(2024, 1, 1 + i % 28, i // 28), "click", 5.0 + i * 0.37, f'{{"k": {i * 7 % 100}}}') for i in range(120)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    f = ad.stored_frames(spark, str(tmp_path))
    joined = spatial.surface_hits(f.select("recording", "frame_idx", "x_px", "y_px"), ad.quads(f))
    beside = spatial.hits_beside(plans._quads_and_gaze(f)).select(*joined.columns)
    assert sorted(map(tuple, beside.collect())) == sorted(map(tuple, joined.collect())) and beside.count() > 0
    assert "Join" not in plans.QUERIES["homography_uv"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
