"""SQL pieces that several checks share; each builds on ``adapter.VIEWS``."""

RUNS = """
chg AS (
  SELECT *, lag(label) OVER w AS prev FROM f WINDOW w AS (PARTITION BY recording ORDER BY frame_idx)
), runs AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR prev <> label THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run_id FROM chg
)"""
EDGES = """
edges AS (
  SELECT recording, prev AS src, label AS dst, count(*) AS n FROM chg
  WHERE prev IS NOT NULL AND prev <> 'NoAOI' AND label <> 'NoAOI' AND prev <> label GROUP BY ALL
)"""
DWELL = """
dw AS (
  SELECT *, sum(n_label) OVER (PARTITION BY recording) AS n_all FROM (SELECT recording, label, count(*) AS n_label FROM f GROUP BY ALL)
)"""
TIMES = """
times AS (
  SELECT recording, count(*) AS n_frames, (max(ts_us) - min(ts_us)) / 1e6::DOUBLE AS duration_s,
    CASE WHEN count(*) > 1 AND max(ts_us) > min(ts_us) THEN greatest(1.0::DOUBLE, (count(*) - 1) / ((max(ts_us) - min(ts_us)) / 1e6::DOUBLE)) ELSE 30.0::DOUBLE END AS fps FROM f GROUP BY recording
)"""
TASK_METRICS = """
inside AS (
  SELECT f.*, t.task_name, t.start_frame, t.end_frame FROM f JOIN tasks t ON f.recording = t.recording AND f.frame_idx BETWEEN t.start_frame AND t.end_frame
), tshare AS (
  SELECT recording, task_name, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY recording, task_name) AS a FROM inside GROUP BY recording, task_name, label
), tent AS (
  SELECT recording, task_name, round(-sum(n / a * log2(n / a)), 9) + 0.0 AS bits FROM (SELECT recording, task_name, CAST(n AS DOUBLE) AS n, CAST(a AS DOUBLE) AS a FROM tshare) GROUP BY ALL
), tlag AS (
  SELECT *, lag(label) OVER (PARTITION BY recording, task_name ORDER BY frame_idx) AS p FROM inside
), tm AS (
  SELECT i.recording, i.task_name, any_value(i.start_frame) AS start_frame, any_value(i.end_frame) AS end_frame, CAST(replace(i.task_name, 'Task ', '') AS INTEGER) AS task_index, any_value(i.difficulty) AS difficulty, any_value(i.condition) AS condition,
    count(*) AS frame_count, CASE WHEN count(*) > 1 THEN (max(ts_us) - min(ts_us)) / 1e6::DOUBLE ELSE 10 / any_value(times.fps) END AS duration_s,
    avg(CASE WHEN i.label = 'NoAOI' THEN 1.0 ELSE 0.0 END) AS none_ratio, sum(CASE WHEN p <> label THEN 1 ELSE 0 END)::BIGINT AS aoi_transition_count, any_value(bits) AS aoi_entropy_bits,
    coalesce(sum(CASE WHEN label = 'Screen' THEN 1.0::DOUBLE ELSE 0 END) / nullif(sum(CASE WHEN label = 'Board' THEN 1.0::DOUBLE ELSE 0 END), 0), 0) AS screen_to_board_ratio,
    sum(CASE WHEN label IN ('Screen', 'Board') THEN 1.0::DOUBLE ELSE 0 END) / any_value(times.fps) AS focus_s
  FROM tlag i JOIN times USING (recording) JOIN tent USING (recording, task_name) GROUP BY i.recording, i.task_name
), tmetrics AS (
  SELECT * EXCLUDE (focus_s), coalesce(focus_s / nullif(duration_s, 0), 0) AS task_focus_ratio FROM tm
)"""
FIXSUM = """
fixsum AS (
  SELECT recording, fixation_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, min(time_s) AS start_time_s, max(time_s) AS end_time_s, min(fixation_dur_ms) / 1000 AS duration_s, avg(x_px) AS centroid_x, avg(y_px) AS centroid_y
  FROM f WHERE fixation_id IS NOT NULL GROUP BY ALL
), fixmode AS (
  SELECT recording, fixation_id, label AS dominant_aoi FROM (
    SELECT recording, fixation_id, label, row_number() OVER (PARTITION BY recording, fixation_id ORDER BY count(*) DESC, label) AS r FROM f WHERE fixation_id IS NOT NULL GROUP BY recording, fixation_id, label) WHERE r = 1
), fixall AS (SELECT * FROM fixsum JOIN fixmode USING (recording, fixation_id)
), grid AS (
  SELECT recording, condition, difficulty, label FROM recs, (SELECT DISTINCT label FROM f WHERE label <> 'NoAOI')
), fixgrid AS (
  SELECT g.recording, g.condition, g.label, count(x.fixation_id) AS n_fixations, coalesce(avg(x.duration_s), 0) AS mean_dur_s, coalesce(sum(x.duration_s), 0) AS total_dur_s
  FROM grid g LEFT JOIN fixall x ON g.recording = x.recording AND g.label = x.dominant_aoi GROUP BY ALL
)"""
DGRID = """
dgrid AS (
  SELECT g.recording, g.condition, g.difficulty, g.label, coalesce(d.n_label * 100.0::DOUBLE / d.n_all, 0) AS value, d.n_label IS NOT NULL AS seen FROM grid g LEFT JOIN dw d USING (recording, label)
)"""


def rank_test_sql(source: str, by: str) -> str:
    """CTEs that end in ``mwu``: n1, n2, u1, tie_sum, p, effect of ``source`` (columns by, condition, value)."""
    return f"""
ranked AS (
  SELECT *, rank() OVER (PARTITION BY {by} ORDER BY value) + (count(*) OVER (PARTITION BY {by}, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY {by}, value) AS same FROM {source}
), sums AS (
  SELECT {by}, sum(CASE WHEN condition = 'A' THEN 1 ELSE 0 END)::BIGINT AS n1, sum(CASE WHEN condition = 'B' THEN 1 ELSE 0 END)::BIGINT AS n2,
    sum(CASE WHEN condition = 'A' THEN rk ELSE 0 END) AS r1, sum(CAST(same AS DOUBLE) * same - 1) AS tie_sum,
    avg(CASE WHEN condition = 'A' THEN value END) AS a_mean, stddev_samp(CASE WHEN condition = 'A' THEN value END) AS a_std, avg(CASE WHEN condition = 'B' THEN value END) AS b_mean, stddev_samp(CASE WHEN condition = 'B' THEN value END) AS b_std FROM ranked GROUP BY {by}
), us AS (
  SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1, CAST(n1 AS DOUBLE) * n2 AS nn, CAST(n1 + n2 AS DOUBLE) AS n FROM sums
), zs AS (
  SELECT *, least(9.0::DOUBLE, greatest(0.0::DOUBLE, (greatest(u1, nn - u1) - nn / 2 - 0.5) / sqrt(nn / 12 * ((n + 1) - tie_sum / (n * (n - 1)))))) AS z FROM us
), mwu AS (
  SELECT *, 1 - 2 * u1 / nn AS effect,
    greatest(0.0::DOUBLE, 1 - 2 * 0.3989422804014327 * z / 400 / 3 * list_sum(list_transform(range(0, 401), lambda i: CASE WHEN i = 0 OR i = 400 THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END * exp(-(i * z / 400) * (i * z / 400) / 2)))) AS p FROM zs
)"""
