"""Registered queries over whole reports, and over the functions that no other query shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lab
from . import adapter as ad
from . import analysis, reports
from . import shared_sql as sh
from .queries import _BH, _STAT, ORACLE_SQL, QUERIES, query, r

# Functions over text and numbers


@query(
    """SELECT recording, frame_idx, t, TRY_CAST(t AS DOUBLE) AS number, CAST(trunc(TRY_CAST(t AS DOUBLE)) AS INTEGER) AS whole
       FROM (SELECT recording, frame_idx, CASE k % 5 WHEN 0 THEN k || '.75' WHEN 1 THEN 'x' || k WHEN 2 THEN '' WHEN 3 THEN '-' || k || '.5' ELSE CAST(k AS VARCHAR) END AS t FROM f)"""
)
def text_numbers(s, d):
    k = F.col("k")
    t = F.when(k % 5 == 0, F.concat(k, F.lit(".75"))).when(k % 5 == 1, F.concat(F.lit("x"), k)).when(k % 5 == 2, "").when(k % 5 == 3, F.concat(F.lit("-"), k, F.lit(".5"))).otherwise(k.cast("string"))
    return ad.frames(s, d).select("recording", "frame_idx", t.alias("t")).select("*", lab.number(F.col("t")).alias("number"), lab.whole(F.col("t")).alias("whole"))


@query(
    """SELECT recording, path, source, coalesce(upper(known[1:1]) || lower(known[2:]), parts[1]) AS difficulty FROM (
      SELECT *, list_filter(list_concat(parts, list_reverse(list_filter(string_split(path, '/'), lambda x: x <> ''))), lambda x: lower(x) IN ('easy', 'medium', 'hard'))[1] AS known FROM (
        SELECT *, list_reverse(list_filter(string_split(source, '/'), lambda x: x <> '')) AS parts, source || CASE recording % 2 WHEN 0 THEN '/HARD/rec' ELSE '/rec' END || recording AS path FROM (
          SELECT DISTINCT recording, '/data/' || CASE recording % 3 WHEN 0 THEN 'Easy/A' WHEN 1 THEN 'hard/medium' ELSE 'study' END AS source FROM f)))"""
)
def difficulty_infer(s, d):
    rec = F.col("recording")
    source = F.concat(F.lit("/data/"), F.when(rec % 3 == 0, "Easy/A").when(rec % 3 == 1, "hard/medium").otherwise("study"))
    rows = ad.recordings(ad.frames(s, d)).select("recording", source.alias("source"))
    rows = rows.withColumn("path", F.concat("source", F.when(rec % 2 == 0, "/HARD/rec").otherwise("/rec"), rec.cast("string")))
    return rows.select("recording", "path", "source", lab.difficulty_of(F.col("path"), F.col("source")).alias("difficulty"))


@query(
    """SELECT recording, frame_idx, CASE WHEN k % 7 = 0 THEN '—' WHEN k < 1 THEN '<0.001' ELSE printf('%.3f', k / 1000::DOUBLE) END AS p, CASE WHEN k % 7 = 0 THEN '—' ELSE printf('%.3f', k / 1000::DOUBLE) END AS effect,
       array_to_string(list_sort([k, k % 7, k % 3]), ';') AS ids, trim(regexp_replace(lower(label || ' #' || k || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS name,
       round(round_even(least(greatest(k * 100 / 60::DOUBLE, 0), 100), 1), 3) AS pct, round(greatest(sqrt(value) * 1.8, 12), 6) AS radius, round(least(greatest(value * 10 / 100, 10), 80), 6) AS ring FROM f"""
)
def shown_values(s, d):
    k, value = F.col("k"), F.col("value")
    p = F.when(k % 7 != 0, k / 1000.0)
    return ad.frames(s, d).select(
        "recording", "frame_idx", lab.shown_p(p).alias("p"), lab.shown_effect(p).alias("effect"), lab.joined_ints(F.array(k, k % 7, k % 3)).alias("ids"), lab.safe_name(F.concat("label", F.lit(" #"), k, F.lit("!"))).alias("name"),
        r(lab.percent(k, F.lit(60.0)), 3).alias("pct"), r(lab.fixation_radius(value)).alias("radius"), r(lab.ring_radius(value)).alias("ring"),
    )


@query(f"SELECT recording, frame_idx, CASE WHEN final IS NULL OR trim(final) IN ({', '.join(repr(x) for x in lab.NULL_LABELS)}) THEN 'NoAOI' ELSE trim(final) END AS reviewed, label AS unreviewed FROM (SELECT *, CASE k % 4 WHEN 0 THEN ' Screen ' WHEN 1 THEN 'nan' WHEN 2 THEN label END AS final FROM f)")
def label_choice(s, d):
    """A table with a final label uses it alone, nulls included; one without it uses the primary label."""
    f = ad.frames(s, d).withColumn("primary_aoi", F.col("label"))
    final = f.withColumn("final_primary_aoi", F.when(F.col("k") % 4 == 0, " Screen ").when(F.col("k") % 4 == 1, "nan").when(F.col("k") % 4 == 2, F.col("label")))
    return final.select("recording", "frame_idx", lab.chosen_label(final).alias("reviewed"), lab.chosen_label(f).alias("unreviewed"))


# Detections


@query(
    """SELECT recording, frame_idx, tag_id, arg_max(corner, p) AS corner FROM (
      SELECT recording, frame_idx, k % 5 AS tag_id, u AS corner, 1 AS p FROM f WHERE k % 3 < 2 UNION ALL SELECT recording, frame_idx, k % 5, v, 2 FROM f WHERE k % 3 > 0) GROUP BY ALL"""
)
def detection_union(s, d):
    f = ad.frames(s, d)
    seen = lambda rows, c: f.where(rows).select("recording", "frame_idx", (F.col("k") % 5).alias("tag_id"), F.array(c).alias("corners"))
    first, second = seen(F.col("k") % 3 < 2, "u"), seen(F.col("k") % 3 > 0, "v")
    return analysis.merged_detections(first, second).select("recording", "frame_idx", "tag_id", F.get("corners", F.lit(0)).alias("corner"))


@query(
    """SELECT recording, round(avg(CASE WHEN k % 40 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, avg(CASE WHEN k % 40 = 0 THEN 1.0::DOUBLE ELSE 0 END) < 0.03 AS sparse FROM (
      SELECT *, min(frame_idx) OVER w AS lo, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY recording)) WHERE (frame_idx - lo) % greatest(1, n // 20) = 0 GROUP BY 1"""
)
def detection_rate_gate(s, d):
    f = ad.frames(s, d)
    seen = f.select("recording", "frame_idx", F.explode(F.when(F.col("k") % 40 == 0, F.array(F.lit(1), F.lit(2), F.lit(9))).otherwise(F.array(F.lit(1), F.lit(9)))).alias("tag_id"))
    out = analysis.sparse_detection(seen, f.select("recording", "frame_idx"), [1, 2], every=20)
    return out.select("recording", r("share").alias("share"), "sparse")


# Reports


def _same(name: str, of: str, sheet) -> None:
    """A table of a report, with the columns, the rounding and the SQL of the query that shows its operator alone."""

    def run(spark, sf_dir) -> DataFrame:
        f = ad.stored_frames(spark, sf_dir, durations=True)
        return sheet(f, ad.tasks(f))

    run.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = run, ORACLE_SQL[of]


def _cut(df: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    return df.select(*[F.col(c) if digits is None else r(c, digits).alias(c) for c, digits in columns.items()])


_plain = dict.fromkeys
_same("master_recording_dwell", "recording_dwell", lambda f, t: _cut(reports.master_tables(f, t)["Recording_Dwell"], {"recording": None, "label": None, "dwell_s": 6, "dwell_ratio": 6}))
_same("master_area_by_difficulty", "aoi_by_difficulty", lambda f, t: _cut(reports.master_tables(f, t)["AOI_By_Difficulty"], {"difficulty": None, "label": None, "mean_ratio": 6, "median_ratio": 6, "n": None}))
_same(
    "master_recording_summary",
    "recording_summary",
    lambda f, t: _cut(
        reports.master_tables(f, t)["Recording_Summary"].withColumnRenamed("entropy_bits", "aoi_entropy_bits"),
        _plain(("recording", "condition", "difficulty", "frame_count", "n_transitions")) | dict.fromkeys(("none_ratio", "manual_edit_ratio", "auto_gap_fill_ratio", "duration_s", "estimated_fps", "aoi_entropy_bits"), 6),
    ),
)
_same("master_data_quality", "quality_summary", lambda f, t: _cut(reports.master_tables(f, t)["Data_Quality"], {"difficulty": None, "recordings": None, "mean_none_ratio": 6, "mean_duration_s": 4, "tasks": None, "mean_task_none_ratio": 6}))
_same("comparison_learning", "learning_by_condition", lambda f, t: _cut(reports.compare_conditions(f, t).learning, {"task_index": None, "condition": None, "metric": None, "mean": 5, "std": 4, "n": None}))
_same("dashboard_dwell_spread", "dwell_stats", lambda f, t: _cut(reports.dashboard(f, t)["all_dwell"], {"label": None, "mean": 6, "median": 6, "std": 6, "min": 6, "max": 6, "n": None}))
_same("dashboard_timeline", "label_runs", lambda f, t: reports.dashboard(f, t)["timeline"])
_same("dashboard_quality", "data_quality", lambda f, t: _cut(reports.dashboard(f, t)["quality"].drop("band"), _plain(("recording", "total_frames", "valid_gaze_frames", "fixation_count")) | {"recording_duration_s": 6, "fps": 6, "missing_gaze_pct": 6}))


@query("SELECT task_index, round(avg(d), 6) AS mean, round(coalesce(stddev_samp(d), 0), 4) AS std, round(median(d), 6) AS median, count(*) AS n FROM (SELECT CAST(replace(task_name, 'Task ', '') AS INTEGER) AS task_index, (end_frame - start_frame) / fps AS d FROM tasks JOIN times USING (recording)) GROUP BY 1", sh.TIMES)
def dashboard_learning(s, d):
    f = ad.stored_frames(s, d, durations=True)
    return _cut(reports.dashboard(f, ad.tasks(f))["all_learning"], {"task_index": None, "mean": 6, "std": 4, "median": 6, "n": None})


_ON_SCREEN = """sp0 AS (
  SELECT * FROM (SELECT *, count(*) FILTER (is_fixation) OVER (PARTITION BY recording) AS nf FROM f WHERE label = 'Screen') WHERE nf < 10 OR is_fixation
), sp AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY recording) AS n FROM sp0 WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1) WHERE n >= 10
), ax AS (
  SELECT 'Vertical position' AS metric, condition, round(avg(u), 9) AS value FROM sp GROUP BY recording, condition UNION ALL SELECT 'Horizontal position', condition, round(avg(v), 9) FROM sp GROUP BY recording, condition
), so AS (
  SELECT r.recording, r.condition, c.cell, coalesce(n, 0) / total::DOUBLE AS value FROM (SELECT recording, condition, count(*) AS total FROM sp GROUP BY ALL) r CROSS JOIN (SELECT unnest(range(0, 16))::INTEGER AS cell) c
  LEFT JOIN (SELECT recording, least(floor(u * 4), 3)::INTEGER * 4 + least(floor(v * 4), 3)::INTEGER AS cell, count(*) AS n FROM sp GROUP BY ALL) p ON p.recording = r.recording AND p.cell = c.cell)"""


def _compared(s, d):
    f = ad.stored_frames(s, d, durations=True)
    return reports.compare_conditions(f, ad.tasks(f))


@query("SELECT metric, " + _STAT + " FROM mwu", _ON_SCREEN, sh.rank_test_sql("ax", "metric"))
def comparison_screen_position(s, d):
    return _compared(s, d).screen_position


@query("SELECT cell, p0 AS p_raw, round_even(q, 4) AS p_value, q < 0.05 AS significant FROM bh2", _ON_SCREEN, sh.rank_test_sql("so", "cell"), _BH)
def comparison_screen_tests(s, d):
    return _compared(s, d).screen_tests.select("cell", "p_raw", "p_value", "significant")
