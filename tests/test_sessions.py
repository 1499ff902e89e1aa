"""The edit log against a stack, marks against the panels' steps, saves against a recomputed store."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from gazeframe.operators import editlog
from gazeframe.sources import corrections

LOG = "recording string, seq long, kind string"


def by_stack(rows):
    stack, out = [], {}
    for _, seq, kind in rows:
        if kind == "undo":
            back = stack.pop() if stack else None
            if back is not None:
                out[back][2] = False
            out[seq] = [len(stack), back, False]
        else:
            stack.append(seq)
            out[seq] = [len(stack), None, True]
    return out


@pytest.mark.parametrize("size", [3, 1000])
def test_undo_takes_back_the_latest_edit_that_stands(spark, size):
    r = random.Random(size)
    rows = [(rec, seq, r.choice(["edit", "undo", kind])) for rec, kind in (("a", "edit"), ("b", "undo"), ("c", "edit")) for seq in r.sample(range(200), 90)]
    rows += [("idle", 1, "undo"), ("idle", 2, "undo"), ("idle", 7, "edit")]
    got = {(x["recording"], x["seq"]): [x["height"], x["takes_back"], x["stands"]] for x in editlog.replayed(spark.createDataFrame(rows, LOG), size).collect()}
    want = {(rec, seq): v for rec in {x[0] for x in rows} for seq, v in by_stack(sorted(x for x in rows if x[0] == rec)).items()}
    assert got == want
    left = editlog.standing(spark.createDataFrame(rows, LOG), size)
    assert left.columns == ["recording", "seq", "kind"] and left.count() == sum(v[2] for v in want.values())


def test_an_undo_does_not_reach_into_another_recording(spark):
    rows = [("a", 1, "edit"), ("b", 2, "undo"), ("b", 3, "edit")]
    assert editlog.standing(spark.createDataFrame(rows, LOG), 3).count() == 2
    assert editlog.standing(spark.createDataFrame([], LOG), 3).count() == 0


def step(state, kind, frame, crossing):
    start, end = state
    if kind == "clear":
        return None, None
    if kind == "in":
        return frame, (None if end is not None and end < frame else end)
    if start is not None and frame < start:
        return (None, frame) if crossing == "clear" else (frame, start)
    return start, frame


@pytest.mark.parametrize("crossing", ["clear", "swap"])
def test_marks_leave_the_range_that_the_panel_shows(spark, crossing):
    r, rows, want = random.Random(4), [], {}
    for rec in range(120):
        state = (None, None)
        for seq in range(r.randrange(1, 9)):
            kind, frame = r.choice(["in", "out", "in", "out", "in", "out", "clear"]), r.randrange(6)
            rows.append((str(rec), seq, kind, frame))
            state = step(state, kind, frame, crossing)
        want[str(rec)] = state
    got = editlog.marked_range(spark.createDataFrame(rows, LOG + ", frame int"), crossing).collect()
    assert {x["recording"]: (x["start"], x["end"]) for x in got} == want


def test_unknown_crossings_are_refused(spark):
    with pytest.raises(ValueError):
        editlog.marked_range(spark.createDataFrame([], LOG + ", frame int"), "jump")


def test_crop_pads_with_whole_frames_and_open_ends_are_the_recordings_own(spark):
    frames = spark.createDataFrame([(rec, i) for rec in "abcd" for i in range(100)], "recording string, frame_idx int")
    ranges = spark.createDataFrame([("a", 10, 20, 0.99, 2.0), ("b", 1, None, 1.0, 3.0), ("c", None, 5, 0.5, 0.0)], "recording string, start int, end int, padding_s double, fps double")
    bounds = editlog.crop_bounds(ranges, frames)
    assert sorted(tuple(x) for x in bounds.collect()) == [("a", 9, 21), ("b", -2, 99), ("c", 0, 20)]
    kept = editlog.cropped(frames, bounds).groupBy("recording").count().collect()
    assert {x["recording"]: x["count"] for x in kept} == {"a": 13, "b": 100, "c": 21, "d": 100}
    spans = spark.createDataFrame([("a", 1, 8), ("a", 8, 9), ("a", 21, 30), ("a", 22, 30)], "recording string, start_frame int, end_frame int")
    assert editlog.cropped(spans, bounds, "start_frame", "end_frame").count() == 2


# Saves

FRAME = "recording int, frame_idx int, ts_us long, time_s double, label string, u double, v double, x_px double, y_px double, is_fixation boolean, fixation_id int, fixation_dur_ms double, aoi_hit_source string, edit_source string"


def frames_of(spark):
    r = random.Random(2)
    rows = [(rec, i, i * 33_000, i * 0.033, r.choice(["Board", "Screen", "NoAOI"]), 0.5, 0.5, None if i == 7 else 50.0, 50.0, i % 3 > 0, i // 5, 165.0, "direct", "auto") for rec in (1, 2, 3) for i in range(40)]
    return spark.createDataFrame(rows, FRAME)


def edits_of(spark, rows):
    return spark.createDataFrame(rows, "recording int, start_frame int, end_frame int, label string, seq int")


@pytest.fixture
def store(spark):
    root = tempfile.mkdtemp(prefix="spark-") + "/store"
    corrections.create(root, frames_of(spark))
    return root


def listing(root):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet"))


def rows_of(spark, root, name):
    df = spark.read.parquet(f"{root}/{name}")
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_a_save_rewrites_touched_recordings_alone(spark, store):
    before = listing(store)
    edits = edits_of(spark, [(2, 9, 5, " Screen ", 1), (2, 6, 6, "nan", 2)])
    corrections.save(spark, store, edits)
    after = listing(store)
    kept = lambda files: [f for f in files if "recording=2" not in f]
    assert kept(before) == kept(after) and not set(before) & {f for f in after if "recording=2" in f}
    got = {x["frame_idx"]: x for x in spark.read.parquet(f"{store}/frames").where("recording = 2").collect()}
    was = {x["frame_idx"]: x for x in frames_of(spark).where("recording = 2").collect()}
    assert [got[i]["label"] for i in range(5, 10)] == ["Screen", "NoAOI", "Screen", "Screen", "Screen"]
    assert all((got[i]["aoi_hit_source"] == "manual") == (5 <= i <= 9) for i in got)
    assert all(got[i]["label"] == was[i]["label"] for i in got if not 5 <= i <= 9)
    assert all(got[i]["aoi_transition"] == (i == 0 or got[i]["label"] != got[i - 1]["label"]) for i in got)
    assert "final_label" not in got[0].asDict()


def test_touched_summaries_equal_a_full_recompute(spark, store):
    corrections.save(spark, store, edits_of(spark, [(1, 0, 20, "Left_Box", 1), (3, 2, 2, "Board", 1)]))
    fresh = tempfile.mkdtemp(prefix="spark-") + "/fresh"
    corrections.create(fresh, spark.read.parquet(f"{store}/frames"))
    for name in corrections.SUMMARIES:
        assert rows_of(spark, store, name) == rows_of(spark, fresh, name), name


def test_a_light_save_leaves_the_summaries(spark, store):
    before = {n: rows_of(spark, store, n) for n in corrections.SUMMARIES}
    corrections.save(spark, store, edits_of(spark, [(1, 0, 39, "Left_Box", 1)]), summaries=False)
    assert {n: rows_of(spark, store, n) for n in corrections.SUMMARIES} == before
    assert spark.read.parquet(f"{store}/frames").where("recording = 1 AND label = 'Left_Box'").count() == 40


def test_a_save_that_breaks_before_it_is_ready_leaves_the_old_state(spark, store, monkeypatch):
    before = listing(store)

    def broken(frames):
        raise RuntimeError("no summary")

    monkeypatch.setitem(corrections.SUMMARIES, "data_quality", broken)
    with pytest.raises(RuntimeError, match="no summary"):
        corrections.save(spark, store, edits_of(spark, [(1, 0, 5, "Board", 1)]))
    assert listing(store) == before and not [n for n in os.listdir(store) if n.startswith("_saving")]


def test_a_save_that_breaks_while_it_is_published_is_completed(spark, store, monkeypatch):
    before = rows_of(spark, store, "frames")
    kept = corrections.publish
    monkeypatch.setattr(corrections, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        corrections.save(spark, store, edits_of(spark, [(1, 0, 5, "Stream_Deck", 1)]))
    assert rows_of(spark, store, "frames") == before
    monkeypatch.setattr(corrections, "publish", kept)
    half = f"{store}/_saving-half"
    frames_of(spark).write.parquet(f"{half}/frames")  # without its mark
    assert len(corrections.recovered(spark, store)) == 1
    assert spark.read.parquet(f"{store}/frames").where("recording = 1 AND label = 'Stream_Deck'").count() == 6
    assert spark.read.parquet(f"{store}/preprocessing_report").where("recording = 1").collect()[0]["aoi_dwell_frames"]["Stream_Deck"] == 6
    assert not [n for n in os.listdir(store) if n.startswith("_saving")] and corrections.recovered(spark, store) == []


def test_edited_gaze_moves_to_its_new_surface(spark):
    quads = spark.createDataFrame([(1, i, "Screen", 0.0, 0.0, 200.0, 0.0, 200.0, 100.0, 0.0, 100.0) for i in range(40)], "recording int, frame_idx int, surface string, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    edits = edits_of(spark, [(1, 3, 8, "Screen", 1), (1, 5, 5, "NoAOI", 2), (1, 6, 6, "Board", 3)])
    out = {x["frame_idx"]: (x["u"], x["v"]) for x in corrections.corrected(frames_of(spark).where("recording = 1"), edits, quads).collect()}
    assert out[3] == out[4] == out[8] == (0.25, 0.5)
    assert out[5] == (None, None)  # outside all areas
    assert out[6] == out[7] == out[9] == (0.5, 0.5)  # no quad, no gaze, not edited


def test_a_crop_rewrites_frames_fixations_and_summaries(spark, store):
    before = listing(store)
    bounds = spark.createDataFrame([(1, 12, 21), (2, 900, 999)], "recording int, from_frame long, to_frame long")
    corrections.crop(spark, store, bounds)
    frames = spark.read.parquet(f"{store}/frames")
    assert sorted(x["frame_idx"] for x in frames.where("recording = 1").collect()) == list(range(12, 22))
    assert sorted({x["recording"] for x in frames.select("recording").collect()}) == [1, 3]  # nothing of 2 lies inside
    spans = spark.read.parquet(f"{store}/fixation_summary").where("recording = 1").orderBy("start_frame").collect()
    assert [(x["start_frame"], x["end_frame"]) for x in spans] == [(10, 14), (15, 19), (20, 24)]  # as they were
    report = {x["recording"]: x["total_frames"] for x in spark.read.parquet(f"{store}/preprocessing_report").collect()}
    assert report == {1: 10, 3: 40}
    kept = lambda files: [f for f in files if "recording=3" in f]
    assert kept(before) == kept(listing(store)) and not [n for n in os.listdir(store) if n.startswith("_saving")]
