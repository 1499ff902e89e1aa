from pyspark.sql import functions as F

from gazeframe.functions import labels as lab


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_null_spellings(spark):
    rows = [(x,) for x in (None, "", " Board ", "nan", "None", "NONE", "null", "NoAOI", "none")]
    got = [r[0] for r in one(spark, rows, "x string", lab.normal_label(F.col("x")))]
    assert got == ["NoAOI", "NoAOI", "Board", "NoAOI", "NoAOI", "NoAOI", "NoAOI", "NoAOI", "none"]


def test_final_label_column_decides_for_the_table(spark):
    df = spark.createDataFrame([("a", None), ("b", "c")], "primary_aoi string, final_primary_aoi string")
    assert [r[0] for r in df.select(lab.chosen_label(df)).collect()] == ["NoAOI", "c"]


def test_task_index(spark):
    assert [r[0] for r in one(spark, [("Task 10",), ("T1b2",), ("Intro",)], "x string", lab.task_index(F.col("x")))] == [10, 12, 0]


def test_numbers_and_ratios(spark):
    got = one(spark, [("7.9", 5.0, 0.0), ("x", 1.0, 4.0), (None, None, 2.0)], "t string, a double, b double", lab.whole(F.col("t")), lab.number(F.col("t")), lab.safe_div(F.col("a"), F.col("b")))
    assert got == [(7, 7.9, 0.0), (None, None, 0.25), (None, None, 0.0)]


def test_difficulty(spark):
    rows = [("/d/EASY/r1", "/d"), ("/x/r1", "/s/hard/medium"), ("/x/r1", "/s/Gamified")]
    assert [r[0] for r in one(spark, rows, "p string, s string", lab.difficulty_of(F.col("p"), F.col("s")))] == ["Easy", "Medium", "Gamified"]


def test_snap_band_stars_and_texts(spark):
    fps = [r[0] for r in one(spark, [(29.2,), (27.4,), (40.0,), (24.5,)], "x double", lab.snapped_fps(F.col("x")))]
    assert fps == [30.0, 25.0, 40.0, 24.0]
    bands = [r[0] for r in one(spark, [(80.0,), (60.0,), (59.9,)], "x double", lab.quality_band(F.col("x")))]
    assert bands == ["Good", "Acceptable", "Poor"]
    shown = one(spark, [(0.0004,), (0.03,), (None,)], "p double", lab.stars(F.col("p")), lab.shown_p(F.col("p")))
    assert shown == [("***", "<0.001"), ("*", "0.030"), ("", "—")]
    assert [r[0] for r in one(spark, [(65.0,), (3661.9,)], "s double", lab.minutes_seconds(F.col("s")))] == ["1:05", "1:01:01"]


def test_clamp_keeps_nan_missing(spark):
    got = [r[0] for r in one(spark, [(float("nan"),), (1.7,), (-0.2,), (0.1234567,)], "x double", lab.clamped(F.col("x")))]
    assert got == [None, 1.0, 0.0, 0.12346]


def test_lists_and_names(spark):
    got = one(spark, [([3, 1, 2], "Left_Box", "A b! c")], "x array<int>, l string, n string", lab.joined_ints(F.col("x")), lab.shown_label(F.col("l")), lab.safe_name(F.col("n")), lab.aoi_rank(F.col("l")), lab.split_ints(F.lit("")))
    assert got == [("1;2;3", "Left Box", "a_b_c", 3, [])]
