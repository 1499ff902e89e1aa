"""Tags of areas, frames put onto their new surface, the look at fixed frames."""

import pytest
from pyspark.sql import functions as F

from gazeframe.operators import surfaces
from gazeframe.operators.spatial import QUAD

SQUARE = [100.0, 100.0, 200.0, 100.0, 200.0, 200.0, 100.0, 200.0]


def test_own_tags(spark):
    seen = spark.createDataFrame([("r", 0, 1), ("r", 0, 1), ("r", 0, 7), ("r", 1, 7), ("r", 2, 99), ("r", 3, None)], "recording string, frame_idx int, tag_id int")
    areas = spark.createDataFrame([("Board", [1, 7, 7]), ("Box", [7]), ("Empty", []), ("None", None)], "surface string, tag_ids array<int>")
    out = {(r["frame_idx"], r["surface"]): (r["own_tags"], r["source"]) for r in surfaces.own_tags(seen, areas).collect()}
    assert out == {(0, "Board"): (3, "direct"), (0, "Box"): (1, "projected"), (1, "Board"): (1, "projected"), (1, "Box"): (1, "projected")}
    assert surfaces.own_tags(seen.limit(0), areas).count() == surfaces.own_tags(seen, areas.limit(0)).count() == 0


@pytest.fixture
def moved(spark):
    def run(frames, edited, quads, done=None):
        f = spark.createDataFrame(frames, "recording string, frame_idx int, x_px double, y_px double, u double, v double, label string")
        e = spark.createDataFrame(edited, "recording string, frame_idx int, final_label string, edit_source string")
        q = spark.createDataFrame(quads, f"recording string, frame_idx int, surface string, {', '.join(f'{c} double' for c in QUAD)}")
        d = done and spark.createDataFrame(done, "recording string, frame_idx int, label string")
        return {r["frame_idx"]: (r["u"], r["v"], r["u_source"]) for r in surfaces.reprojected(f, surfaces.corrected_frames(e, d), q).collect()}

    return run


FRAMES = [("r", i, 125.0, 150.0, 0.9, 0.8, "x") for i in range(6)] + [("r", 6, None, 150.0, 0.9, 0.8, "x"), ("r", 7, float("nan"), 1.0, None, None, "x"), ("r", 8, 500.0, -20.0, 0.1, 0.1, "x")]


def test_corrected_frames_move_to_their_surface(moved):
    edited = [("r", 0, "Screen", "manual"), ("r", 1, "NoAOI", "manual"), ("r", 2, "Screen", "auto"), ("r", 3, "Board", "manual"), ("r", 4, "Screen", "auto_gap_fill"), ("r", 5, "Screen", "manual"), ("r", 6, "Screen", "manual"), ("r", 7, "Screen", "manual"), ("r", 8, "Screen", "manual"), ("r", 99, "Screen", "manual")]
    quads = [("r", i, "Screen", *SQUARE) for i in (0, 1, 2, 3, 4, 6, 7, 8)] + [("r", 5, "Screen", *[1.0] * 8), ("s", 0, "Screen", *[3.0 * x for x in SQUARE])]
    kept = (0.9, 0.8, "kept")
    assert moved(FRAMES, edited, quads) == {
        0: (0.25, 0.5, "reprojected"), 1: (None, None, "blank"), 2: kept, 3: kept, 4: kept, 5: kept, 6: kept, 7: (None, None, "kept"), 8: (1.0, 0.0, "reprojected"),
    }
    assert moved(FRAMES, [], quads)[0] == moved(FRAMES, edited, [])[0] == kept and moved([], edited, quads) == {}


def test_frames_done_with_the_same_label_are_not_moved_again(moved):
    edited, quads = [("r", 0, "Screen", "manual"), ("r", 1, "Board", "manual")], [("r", i, n, *SQUARE) for i in (0, 1) for n in ("Screen", "Board")]
    out = moved(FRAMES, edited, quads, [("r", 0, "Screen"), ("r", 1, "Screen")])
    assert out[0][2] == "kept" and out[1] == (0.25, 0.5, "reprojected")


def test_frame_diagnostic(spark):
    frames = spark.range(0, 150).select(F.lit("r").alias("recording"), F.col("id").cast("int").alias("frame_idx")).unionByName(spark.range(0, 50).select(F.lit("short").alias("recording"), F.col("id").cast("int").alias("frame_idx")))
    seen = spark.createDataFrame([("r", 100, 14), ("r", 100, 3), ("r", 100, 12), ("r", 100, 12), ("r", 99, 12), ("r", 1000, 12)], "recording string, frame_idx int, tag_id int")
    assert [tuple(r) for r in surfaces.frame_diagnostic(frames, seen).collect()] == [("r", 100, 3 + 1, [12, 12, 14])]
    assert sorted(tuple(r) for r in surfaces.frame_diagnostic(frames, seen, (10, 100)).collect()) == [("r", 10, 0, []), ("r", 100, 4, [12, 12, 14]), ("short", 10, 0, [])]
