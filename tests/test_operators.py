import random

import pytest
from pyspark.sql import functions as F

from gazeframe.operators import align, compare, metrics, ordered, review, sequence, spatial

NAMES = {"B": "Board", "S": "Screen", "L": "Left_Box", "-": "NoAOI"}


def frames(spark, text, recording="r"):
    rows = [(recording, i, NAMES[c]) for i, c in enumerate(text.split())]
    return spark.createDataFrame(rows, "recording string, frame_idx int, label string")


def column(df, name, order="frame_idx"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_sequence_basic(spark):
    f = frames(spark, "- B B S - S")
    assert column(sequence.transitions(f), "aoi_transition") == [None, "NoAOI->Board", None, "Board->Screen", "Screen->NoAOI", "NoAOI->Screen"]
    assert column(sequence.cumulative_visits(f), "visits") == [0, 1, 1, 1, 0, 2]
    assert sequence.transition_count(f).collect()[0]["n_transitions"] == 4


def test_first_row_is_a_transition_but_not_counted(spark):
    f = frames(spark, "B B")
    assert column(sequence.transitions(f), "aoi_transition") == ["NoAOI->Board", None]
    assert sequence.transition_count(f).collect()[0]["n_transitions"] == 0


def test_matrix_breaks_at_gaps_and_normalises(spark):
    assert sequence.transition_edges(frames(spark, "B - S")).count() == 0
    e = spark.createDataFrame([("r", "Board", "Screen", 2), ("r", "Board", "Left_Box", 1), ("r", "Screen", "Board", 0)], "recording string, src string, dst string, n long")
    assert {r["dst"]: r["pct"] for r in sequence.transition_percent(e).collect()} == {"Screen": 66.7, "Left_Box": 33.3, "Board": 0.0}


@pytest.mark.parametrize(("text", "bits"), [("B B S S", 1.0), ("B B B B", 0.0), ("B S - -", 1.5)])
def test_entropy(spark, text, bits):
    assert metrics.entropy(frames(spark, text), ["recording"]).collect()[0]["entropy_bits"] == bits


def test_runs_cover_all_frames_and_chunks_do_not_matter(spark):
    random.seed(1)
    f = frames(spark, " ".join(random.choice("BSL-") for _ in range(300)))
    lab = column(f, "label")
    want, run = [], 0
    for i, x in enumerate(lab):
        run += i == 0 or x != lab[i - 1]
        want.append(run)
    for size in (7, 1000):
        prev = ordered.lagged(f, ["recording"], "frame_idx", F.col("label"), "p", size=size)
        assert column(prev, "p") == [None, *lab[:-1]]
        nxt = ordered.lagged(f, ["recording"], "frame_idx", F.col("label"), "p", size=size, ahead=True)
        assert column(nxt, "p") == [*lab[1:], None]
        runs = ordered.running(prev, ["recording"], "frame_idx", (F.col("p").isNull() | (F.col("p") != F.col("label"))).cast("long"), "run", size=size)
        assert column(runs, "run") == want
        top = ordered.running(f.withColumn("x", (F.col("frame_idx") * 7919) % 301), ["recording"], "frame_idx", F.col("x"), "m", "max", size=size)
        xs = [(i * 7919) % 301 for i in range(300)]
        assert column(top, "m") == [max(xs[: i + 1]) for i in range(300)]
    assert sum(r["n_frames"] for r in sequence.label_runs(f).collect()) == 300


def test_time_in_area(spark):
    assert column(sequence.time_in_area(frames(spark, "B B B S S"), 10.0), "time_in_current_aoi_ms") == [0.0, 10.0, 20.0, 0.0, 10.0]


def asof(spark, left, right, direction, chunk):
    lf = spark.createDataFrame([("r", i, t) for i, t in enumerate(left)], "recording string, frame_idx int, ts long")
    rt = spark.createDataFrame([("r", t, float(t)) for t in right], "recording string, ts long, x double")
    return column(align.asof_join(lf, rt, ["recording"], "ts", ["x"], direction, chunk), "ts_right")


@pytest.mark.parametrize("chunk", [3, 10**9])
def test_asof_against_brute_force(spark, chunk):
    random.seed(2)
    left, right = sorted(random.sample(range(200), 40)), sorted(random.sample(range(20, 180), 25))
    back = [max((r for r in right if r <= t), default=None) for t in left]
    ahead = [min((r for r in right if r >= t), default=None) for t in left]
    near = [min(right, key=lambda r: (abs(r - t), r)) for t in left]
    assert asof(spark, left, right, "backward", chunk) == back
    assert asof(spark, left, right, "forward", chunk) == ahead
    assert asof(spark, left, right, "nearest", chunk) == near


def test_nearest_tie_goes_to_the_earlier(spark):
    assert asof(spark, [5], [0, 10], "nearest", 100) == [0]


def pointer(points, spans):
    out, i = [], 0
    for t in points:
        while i < len(spans) and spans[i][1] < t:
            i += 1
        out.append(i if i < len(spans) and spans[i][0] <= t else None)
    return out


def test_interval_join_is_the_pointer_loop(spark):
    random.seed(3)
    for n in range(3):
        spans, t = [], 0
        for _ in range(12):
            t += random.randrange(1, 12)
            spans.append((t, t + random.randrange(0, 25)))
        points = sorted(random.sample(range(150), 60))
        p = spark.createDataFrame([("r", i, x) for i, x in enumerate(points)], "recording string, frame_idx int, ts long")
        s = spark.createDataFrame([("r", i, a, b) for i, (a, b) in enumerate(spans)], "recording string, fixation_id int, start long, stop long")
        got = column(align.interval_join(p, s, ["recording"], "ts", "fixation_id", "start", "stop", chunk=(5, 40, 10**9)[n]), "fixation_id")
        assert got == pointer(points, spans)


def test_fixation_bounds_are_closed(spark):
    p = spark.createDataFrame([("r", i, t) for i, t in enumerate((99, 100, 200, 201))], "recording string, frame_idx int, ts long")
    s = spark.createDataFrame([("r", 0, 100, 200)], "recording string, fixation_id int, start long, stop long")
    assert column(align.interval_join(p, s, ["recording"], "ts", "fixation_id", "start", "stop"), "fixation_id") == [None, 0, 0, None]


def test_dominant_label_tie(spark):
    rows = [("r", 0, "Screen", 0.0), ("r", 1, "Board", 0.1)]
    f = spark.createDataFrame(rows, "recording string, frame_idx int, label string, time_s double").selectExpr("*", "0 AS fixation_id", "CAST(NULL AS DOUBLE) AS fixation_dur_ms", "1.0D AS x_px", "2.0D AS y_px")
    r = metrics.fixation_summary(f).collect()[0]
    assert (r["dominant_aoi"], r["duration_s"]) == ("Board", 0.1)


@pytest.mark.parametrize(("n", "kept"), [(9, 14), (10, 10)])
def test_preferred_points(spark, n, kept):
    f = spark.createDataFrame([("r", i < n) for i in range(n + 5)], "recording string, is_fixation boolean")
    assert spatial.preferred_points(f, ["recording"]).count() == kept


def test_bins_and_grid(spark):
    p = spark.createDataFrame([("r", 0.0, 1.0), ("r", 0.28, 0.25), ("r", 1.0, 0.25)], "recording string, u double, v double")
    assert {(r["xbin"], r["ybin"]) for r in spatial.histogram_2d(p, ["recording"]).collect()} == {(0, 24), (7, 6), (24, 6)}
    grid = {r["cell"]: r["share"] for r in spatial.grid_occupancy(p, ["recording"]).collect()}
    assert len(grid) == 16 and grid[13] == pytest.approx(1 / 3) and sum(grid.values()) == pytest.approx(1)


def test_smoothing_weights_sum_to_one():
    w = spatial.smoothing_weights()
    for to in range(25):
        assert sum(x for a, b, x in w if b == to) == pytest.approx(1)


def test_zones_overlap(spark):
    p = spark.createDataFrame([(0.84, 0.78)], "u double, v double")
    assert {r["zone"] for r in spatial.zone_hits(p).collect()} == {"Points", "Buddy_Speech", "Buddy_Avatar"}


def test_homography_takes_corners_to_the_unit_square(spark):
    quad = [100.0, 120.0, 410.0, 90.0, 450.0, 380.0, 80.0, 350.0]
    f = spark.createDataFrame([("r", i, quad[2 * i], quad[2 * i + 1]) for i in range(4)], "recording string, frame_idx int, x_px double, y_px double")
    q = spark.createDataFrame([("r", i, "Board", 2, *quad) for i in range(4)], "recording string, frame_idx int, surface string, own_tags int, " + ", ".join(f"{c} double" for c in spatial.QUAD))
    got = [(r["u"], r["v"]) for r in spatial.surface_hits(f, q).orderBy("frame_idx").collect()]
    assert got == [pytest.approx(x, abs=1e-9) for x in ((0, 0), (1, 0), (1, 1), (0, 1))]


def test_the_homography_is_worked_out_in_steps(spark):
    f = spark.createDataFrame([("r", 0, 200.0, 200.0), ("r", 1, None, 200.0)], "recording string, frame_idx int, x_px double, y_px double")
    q = spark.createDataFrame([("r", i, "Board", 2, 100.0, 120.0, 410.0, 90.0, 450.0, 380.0, 80.0, 350.0) for i in range(2)], "recording string, frame_idx int, surface string, own_tags int, " + ", ".join(f"{c} double" for c in spatial.QUAD))
    hits = spatial.surface_hits(f, q)
    assert [x["frame_idx"] for x in hits.collect()] == [0]
    # Written out in one expression, the plan has each corner hundreds of times.
    assert max(map(len, hits._jdf.queryExecution().optimizedPlan().toString().split("\n"))) < 6_000


def edits(spark, rows):
    return spark.createDataFrame([("r", a, b, label, i) for i, (a, b, label) in enumerate(rows)], "recording string, start_frame int, end_frame int, label string, seq long")


@pytest.mark.parametrize(("rows", "filled"), [([(10, 10, "Screen"), (14, 14, "Screen")], 3), ([(0, 0, "Screen"), (16, 16, "Screen")], 15), ([(0, 0, "Screen"), (17, 17, "Screen")], 0), ([(0, 0, "Screen"), (3, 3, "Board")], 0)])
def test_gap_fill(spark, rows, filled):
    f = frames(spark, " ".join("B" * 20))
    out = review.reviewed(f, edits(spark, rows))
    assert out.where("edit_source = 'auto_gap_fill'").count() == filled
    again = review.fill_gaps(out.withColumnRenamed("final_primary_aoi", "final_label"))
    assert again.where("edit_source = 'auto_gap_fill'").count() == filled


def test_last_edit_wins_and_undo(spark):
    f = frames(spark, "B B B B")
    e = edits(spark, [(2, 0, "Screen"), (1, 1, "nan")])
    assert column(review.apply_edits(f, e), "final_label") == ["Screen", "NoAOI", "Screen", "Board"]
    assert column(review.apply_edits(f, review.undo_last(e)), "final_label") == ["Screen", "Screen", "Screen", "Board"]


def values(spark, a, b):
    return spark.createDataFrame([("x", "A", float(v)) for v in a] + [("x", "B", float(v)) for v in b], "m string, condition string, value double")


def test_rank_test_exact(spark):
    r = compare.rank_test(values(spark, [1, 2], [3, 4]), ["m"]).collect()[0]
    assert (r["u1"], r["effect"]) == (0.0, 1.0) and r["p"] == pytest.approx(1 / 3)


def test_rank_test_against_enumeration(spark):
    from itertools import combinations

    a, b = [1.5, 9, 3, 12, 7], [2, 4, 6, 8, 10, 11, 13]
    pool = sorted(a + b)
    u = lambda s: sum(pool.index(x) + 1 for x in s) - len(s) * (len(s) + 1) / 2
    every = [u(c) for c in combinations(pool, len(a))]
    own = max(u(a), len(a) * len(b) - u(a))
    p = min(1, 2 * sum(x >= own for x in every) / len(every))
    assert compare.rank_test(values(spark, a, b), ["m"]).collect()[0]["p"] == pytest.approx(p)


def test_rank_sums_with_ties_add_up(spark):
    r = compare.rank_sums(values(spark, [1, 1, 2, 5], [1, 2, 2, 9, 9]), ["m"]).collect()[0]
    s = compare.rank_sums(values(spark, [1, 2, 2, 9, 9], [1, 1, 2, 5]), ["m"]).collect()[0]
    assert r["u1"] + s["u1"] == 20 and r["tie_sum"] == 24 + 24 + 6


def test_rank_test_normal_branch(spark):
    a, b = list(range(0, 40, 2)), list(range(5, 45, 2))
    r = compare.rank_test(values(spark, a, b), ["m"]).collect()[0]
    import math

    n1, n2 = len(a), len(b)
    z = (max(r["u1"], n1 * n2 - r["u1"]) - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - r["tie_sum"] / ((n1 + n2) * (n1 + n2 - 1))))
    assert r["p"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-9)


def test_single_member_deviation(spark):
    r = compare.stat_rows(values(spark, [2.0], [3.0]), ["m"]).collect()[0]
    assert (r["a_std"], r["p_value"], r["significant"]) == (0.0, None, False)


def test_false_discovery(spark):
    rows = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p_value double")
    got = {r["p_raw"]: r["p_value"] for r in compare.false_discovery(rows, []).collect()}
    assert got == {0.01: 0.04, 0.04: 0.0533, 0.03: 0.0533, 0.5: 0.5}


def test_errors(spark):
    e = spark.createDataFrame([("r", "Task 1", 1, 2, 3, 4, 5)], "recording string, task_name string, comp_number int, comp_type int, comp_orientation int, cable_colour int, cable_position int")
    r = metrics.error_rollup(e).collect()[0]
    assert (r["comp_type"], r["comp_pos"], r["cable_type"], r["cable_pos"], r["comp_tot"], r["cable_tot"]) == (2, 4, 4, 5, 6, 9)
