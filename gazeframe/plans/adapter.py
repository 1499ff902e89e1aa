"""The event tables seen as recordings: frames, gaze, fixations, tasks, edits and quads, in Spark and as SQL.

Each user is a recording, each of their events a frame in time order. The SQL twin of every view is in ``VIEWS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import NULL_LABELS, normal_label
from ..operators.ordered import placed, settled

DAY_US = 86_400_000_000
#: Time chunk of this data: events of a user are hours apart.
CHUNK_US = 7 * DAY_US


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.col("user_id").alias("recording"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_type", "value", k.alias("k"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each frame, with label, gaze on the surface (u, v) and in pixels, fixations in blocks of five."""
    e = events(spark, sf_dir)
    raw = (
        F.when(F.col("event_type") == "click", "Board").when(F.col("event_type") == "view", " Screen ").when(F.col("event_type") == "purchase", "Left_Box").when(F.col("event_type") == "signup", "Right_Box")
        .when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "nan")
    )
    seen = F.col("value") >= 5
    # A recording of any length is numbered in chunks of time.
    e = placed(e, ["recording"], "ts_us", "frame_idx", "first_us", CHUNK_US)
    f = e.withColumn("frame_idx", F.col("frame_idx").cast("int")).withColumn("raw_label", raw)
    f = f.withColumn("block", F.floor(F.col("frame_idx") / 5).cast("int")).withColumn("is_fixation", F.col("k") >= 30)
    f = f.withColumn("u", F.col("k") / 99.0).withColumn("v", F.col("value") - F.floor("value"))
    block = Window.partitionBy("recording", "block")
    return f.select(
        "recording",
        F.when(F.col("recording") % 2 == 0, "A").otherwise("B").alias("condition"),
        F.when(F.col("recording") % 3 == 0, "Easy").when(F.col("recording") % 3 == 1, "Medium").otherwise("Hard").alias("difficulty"),
        "event_id", "frame_idx", "ts_us", ((F.col("ts_us") - F.col("first_us")) / 1e6).alias("time_s"), "k", "value", "raw_label", normal_label(F.col("raw_label")).alias("label"), "u", "v",
        F.when(seen, F.col("u") * 1600.0).alias("x_px"), F.when(seen, F.col("v") * 1200.0).alias("y_px"), "is_fixation",
        F.when(F.col("is_fixation"), F.col("block")).alias("fixation_id"),
        F.when(F.col("is_fixation"), (F.max("ts_us").over(block) - F.min("ts_us").over(block)) / 1000.0).alias("fixation_dur_ms"),
        F.when(F.col("k") % 2 == 0, "direct").otherwise("projected").alias("aoi_hit_source"),
        F.when(F.col("k") % 17 == 0, "manual").when(F.col("k") % 19 == 0, "auto_gap_fill").otherwise("auto").alias("edit_source"),
    )


def stored_frames(spark: SparkSession, sf_dir: str, durations: bool = False) -> DataFrame:
    """``frames``, written once for queries that read them in several branches; fixation_dur_ms, which takes one more shuffle, only with ``durations``."""
    f = frames(spark, sf_dir)
    return settled(f if durations else f.drop("fixation_dur_ms"))


def recordings(f: DataFrame) -> DataFrame:
    return f.groupBy("recording", "condition", "difficulty").agg(F.count("*").alias("n_frames"))


def labels(f: DataFrame) -> DataFrame:
    return f.select("label").distinct()


def gaze(f: DataFrame) -> DataFrame:
    return f.where(F.col("event_id") % 3 != 0).select("recording", "ts_us", "u", "v")


def scene(f: DataFrame) -> DataFrame:
    return f.where(F.col("event_id") % 3 == 0).select("recording", "frame_idx", "ts_us")


def fixation_spans(f: DataFrame) -> DataFrame:
    """Blocks of five frames; every third one lasts into the next, so that intervals overlap."""
    blocks = f.groupBy("recording", F.floor(F.col("frame_idx") / 5).cast("int").alias("fixation_id"))
    spans = blocks.agg(F.min("ts_us").alias("start"), F.max("ts_us").alias("end_us"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"))
    return spans.select("recording", "fixation_id", "start", (F.col("end_us") + F.when(F.col("fixation_id") % 3 == 0, F.lit(DAY_US)).otherwise(F.lit(0))).alias("stop"), "start_frame", "end_frame")


def tasks(f: DataFrame, overlap: int = -1) -> DataFrame:
    """Tasks of ten frames; with ``overlap`` 2 each lasts into the next one."""
    return f.groupBy("recording", F.floor(F.col("frame_idx") / 10).cast("int").alias("t")).agg(F.count("*").alias("n")).select(
        "recording", F.concat(F.lit("Task "), F.col("t") + 1).alias("task_name"), (F.col("t") * 10).cast("int").alias("start_frame"), (F.col("t") * 10 + 10 + overlap).cast("int").alias("end_frame")
    )


def edits(f: DataFrame) -> DataFrame:
    """Some frames relabelled by hand, in ranges of up to three frames given from either end."""
    label = F.when(F.col("k") % 4 == 0, "Screen").when(F.col("k") % 4 == 1, "Board").when(F.col("k") % 4 == 2, " Screen ").otherwise("nan")
    other = F.col("frame_idx") + F.col("k") % 3 - 1
    return f.where(F.col("k") % 17 == 0).select("recording", F.col("frame_idx").alias("start_frame"), other.cast("int").alias("end_frame"), label.alias("label"), F.col("event_id").alias("seq"))


def quads(f: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Three surfaces for each frame, as quads around the gaze; some are degenerate. ``keep``: columns of the frame that stand beside them."""
    surface = F.explode(F.array(*[F.struct(F.lit(n).alias("surface"), F.lit(i).alias("i")) for i, n in enumerate(("Board", "Screen", "Left_Box"))]))
    q = f.select("recording", "frame_idx", "k", *keep, surface.alias("s")).select("recording", "frame_idx", "k", *keep, F.col("s.surface").alias("surface"), F.col("s.i").alias("i"))
    x = lambda a, b: (F.lit(float(a)) + F.col("i") * 150.0 + F.col("k") * float(b)).cast("double")
    corner = [x(100, 1), x(120, 2), x(900, 1), x(90, 1), x(1000, 1), x(800, 2), x(80, 2), x(900, 1)]
    corner[4] = F.when(F.col("k") % 11 == 0, F.lit(120.0)).otherwise(corner[4])
    return q.select("recording", "frame_idx", *keep, "surface", ((F.col("k") + F.col("i")) % 4).alias("own_tags"), *[c.alias(n) for c, n in zip(corner, ("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3"), strict=True)])


def errors(f: DataFrame) -> DataFrame:
    return f.where(F.col("k") % 10 == 0).select("recording", F.concat(F.lit("Task "), F.floor(F.col("frame_idx") / 10) + 1).alias("task_name"), (F.col("k") % 3).alias("comp_number"), (F.col("k") % 4).alias("comp_type"), (F.col("k") % 5).alias("comp_orientation"), (F.col("k") % 6).alias("cable_colour"), (F.col("k") % 7).alias("cable_position"))


_SPELLINGS = ", ".join(f"'{s}'" for s in NULL_LABELS)
_XS = [("100", 1), ("120", 2), ("900", 1), ("90", 1), ("1000", 1), ("800", 2), ("80", 2), ("900", 1)]
_CORNERS = ", ".join(
    (f"CASE WHEN k % 11 = 0 THEN 120.0::DOUBLE ELSE {c} END" if n == "x2" else c) + f" AS {n}"
    for n, c in ((n, f"CAST({a} + i * 150 + k * {b} AS DOUBLE)") for n, (a, b) in zip(("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3"), _XS, strict=True))
)
#: SQL text of the views above, in order of use.
VIEWS = f"""
e AS (
  SELECT event_id, user_id AS recording, epoch_us(CAST(ts AS TIMESTAMP)) AS ts_us, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), e1 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY recording ORDER BY ts_us) - 1 AS INTEGER) AS frame_idx,
    CASE event_type WHEN 'click' THEN 'Board' WHEN 'view' THEN ' Screen ' WHEN 'purchase' THEN 'Left_Box' WHEN 'signup' THEN 'Right_Box' ELSE CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'nan' END END AS raw_label,
    k / CAST(99 AS DOUBLE) AS u, value - floor(value) AS v FROM e
), f AS (
  SELECT recording, CASE WHEN recording % 2 = 0 THEN 'A' ELSE 'B' END AS condition, CASE recording % 3 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Medium' ELSE 'Hard' END AS difficulty,
    event_id, frame_idx, ts_us, (ts_us - min(ts_us) OVER (PARTITION BY recording)) / CAST(1000000 AS DOUBLE) AS time_s, k, value, raw_label,
    CASE WHEN raw_label IS NULL OR trim(raw_label) IN ({_SPELLINGS}) THEN 'NoAOI' ELSE trim(raw_label) END AS label, u, v,
    CASE WHEN value >= 5 THEN u * 1600 END AS x_px, CASE WHEN value >= 5 THEN v * 1200 END AS y_px, k >= 30 AS is_fixation,
    CASE WHEN k >= 30 THEN frame_idx // 5 END AS fixation_id,
    CASE WHEN k >= 30 THEN (max(ts_us) OVER b - min(ts_us) OVER b) / CAST(1000 AS DOUBLE) END AS fixation_dur_ms,
    CASE WHEN k % 2 = 0 THEN 'direct' ELSE 'projected' END AS aoi_hit_source,
    CASE WHEN k % 17 = 0 THEN 'manual' WHEN k % 19 = 0 THEN 'auto_gap_fill' ELSE 'auto' END AS edit_source
  FROM e1 WINDOW b AS (PARTITION BY recording, frame_idx // 5)
), recs AS (
  SELECT recording, condition, difficulty, count(*) AS n_frames FROM f GROUP BY ALL
), gaze AS (
  SELECT recording, ts_us, u, v FROM f WHERE event_id % 3 <> 0
), scene AS (
  SELECT recording, frame_idx, ts_us FROM f WHERE event_id % 3 = 0
), spans AS (
  SELECT recording, frame_idx // 5 AS fixation_id, min(ts_us) AS start, max(ts_us) + CASE WHEN (frame_idx // 5) % 3 = 0 THEN {DAY_US} ELSE 0 END AS stop, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame FROM f GROUP BY recording, frame_idx // 5
), tasks AS (
  SELECT DISTINCT recording, 'Task ' || (frame_idx // 10 + 1) AS task_name, frame_idx // 10 * 10 AS start_frame, frame_idx // 10 * 10 + 9 AS end_frame FROM f
), tasks2 AS (
  SELECT recording, task_name, start_frame, end_frame + 3 AS end_frame FROM tasks
), edits AS (
  SELECT recording, frame_idx AS start_frame, frame_idx + k % 3 - 1 AS end_frame, CASE k % 4 WHEN 0 THEN 'Screen' WHEN 1 THEN 'Board' WHEN 2 THEN ' Screen ' ELSE 'nan' END AS label, event_id AS seq FROM f WHERE k % 17 = 0
), quads AS (
  SELECT recording, frame_idx, surface, (k + i) % 4 AS own_tags, {_CORNERS}
  FROM f, (VALUES ('Board', 0), ('Screen', 1), ('Left_Box', 2)) AS s(surface, i)
), errs AS (
  SELECT recording, frame_idx // 10 + 1 AS task_index, k % 4 AS t, k % 3 + k % 5 AS p, k % 6 AS c, k % 7 AS q FROM f WHERE k % 10 = 0
)"""
