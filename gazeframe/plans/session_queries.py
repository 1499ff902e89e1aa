"""Registered queries over review sessions (edit log, marked ranges, crops, saved corrections), regions and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import editlog, positions, regions
from ..sources import corrections
from . import adapter as ad
from .queries import _H, query, r

# The edit log


def _log(s, d):
    f = ad.stored_frames(s, d)
    return f.select("recording", F.col("event_id").alias("seq"), F.when(F.col("k") % 5 < 2, "undo").otherwise("edit").alias("kind"))


@query(
    """SELECT a.recording, a.seq, a.kind, len(a.stack) AS height, a.popped AS takes_back, a.kind = 'edit' AND b.seq IS NULL AS stands
       FROM walk a LEFT JOIN walk b ON b.recording = a.recording AND b.popped = a.seq WHERE a.n > 0""",
    """lg AS (SELECT recording, event_id AS seq, CASE WHEN k % 5 < 2 THEN 'undo' ELSE 'edit' END AS kind, row_number() OVER (PARTITION BY recording ORDER BY event_id) AS n FROM f
    ), walk AS (
      SELECT recording, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, []::BIGINT[] AS stack, NULL::BIGINT AS popped FROM recs
      UNION ALL SELECT l.recording, l.n, l.seq, l.kind, CASE WHEN l.kind = 'undo' THEN w.stack[1:len(w.stack) - 1] ELSE list_append(w.stack, l.seq) END, CASE WHEN l.kind = 'undo' THEN w.stack[len(w.stack)] END
      FROM walk w JOIN lg l ON l.recording = w.recording AND l.n = w.n + 1)""",
    recursive=True,
)
def edit_log_replay(s, d):
    return editlog.replayed(_log(s, d), size=64).select("recording", "seq", "kind", "height", "takes_back", "stands")


_MARKS = """mk AS (
  SELECT recording, n, kind, frame FROM (SELECT recording, event_id, CASE WHEN k % 11 = 0 THEN 'undo' WHEN k % 7 < 3 THEN 'in' WHEN k % 7 < 6 THEN 'out' ELSE 'clear' END AS kind, k * 13 % 60 AS frame, row_number() OVER (PARTITION BY recording ORDER BY event_id) AS n FROM f WHERE k < 60)
), mk2 AS (
  SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY n) AS n, kind, frame FROM mk WHERE kind IN ('in', 'out')
), trims AS (
  SELECT DISTINCT recording, 0::BIGINT AS n, NULL::INTEGER AS s, NULL::INTEGER AS e, []::STRUCT(s INTEGER, e INTEGER)[] AS stack FROM mk
  UNION ALL SELECT m.recording, m.n,
    CASE m.kind WHEN 'in' THEN m.frame WHEN 'out' THEN CASE WHEN t.s <= m.frame THEN t.s END WHEN 'undo' THEN CASE WHEN len(t.stack) > 0 THEN t.stack[len(t.stack)].s ELSE t.s END END,
    CASE m.kind WHEN 'out' THEN m.frame WHEN 'in' THEN CASE WHEN t.e >= m.frame THEN t.e END WHEN 'undo' THEN CASE WHEN len(t.stack) > 0 THEN t.stack[len(t.stack)].e ELSE t.e END END,
    CASE WHEN m.kind = 'undo' THEN t.stack[1:len(t.stack) - 1] ELSE list_append(t.stack, {'s': t.s, 'e': t.e}) END
  FROM trims t JOIN mk m ON m.recording = t.recording AND m.n = t.n + 1
), spans2 AS (
  SELECT DISTINCT recording, 0::BIGINT AS n, NULL::INTEGER AS s, NULL::INTEGER AS e FROM mk2
  UNION ALL SELECT m.recording, m.n, CASE WHEN m.kind = 'in' THEN m.frame ELSE CASE WHEN t.s IS NOT NULL THEN least(t.s, m.frame) END END, CASE WHEN m.kind = 'in' THEN CASE WHEN t.e >= m.frame THEN t.e END ELSE greatest(coalesce(t.s, m.frame), m.frame) END
  FROM spans2 t JOIN mk2 m ON m.recording = t.recording AND m.n = t.n + 1
), panels AS (
  SELECT recording, 'trim' AS panel, arg_max({'s': s, 'e': e}, n) AS x FROM trims GROUP BY recording
  UNION ALL SELECT recording, 'range', arg_max({'s': s, 'e': e}, n) FROM spans2 GROUP BY recording)"""


def _panels(s, d):
    k = F.col("k")
    kind = F.when(k % 11 == 0, "undo").when(k % 7 < 3, "in").when(k % 7 < 6, "out").otherwise("clear")
    marks = ad.stored_frames(s, d).where("k < 60").select("recording", F.col("event_id").alias("seq"), kind.alias("kind"), (k * 13 % 60).alias("frame"))
    # A recording whose marks are all taken back has an open range.
    trim = editlog.marked_range(editlog.standing(marks, size=64))
    trim = marks.select("recording").distinct().join(trim, "recording", "left")
    return trim, editlog.marked_range(marks.where(F.col("kind").isin("in", "out")), crossing="swap")


@query("SELECT recording, panel, x.s AS start_frame, x.e AS end_frame FROM panels", _MARKS, recursive=True)
def marked_ranges(s, d):
    trim, span = _panels(s, d)
    shown = lambda df, name: df.select("recording", F.lit(name).alias("panel"), F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))
    return shown(trim, "trim").unionByName(shown(span, "range"))


@query(
    """SELECT f.recording, f.frame_idx FROM f LEFT JOIN (SELECT recording, x.s - pad AS a, CASE WHEN x.e IS NULL THEN n_frames - 1 ELSE x.e + pad END AS b, x.s IS NULL AS open
         FROM panels JOIN (SELECT recording, n_frames, CAST(trunc(recording % 4 * 0.3::DOUBLE * (2.5::DOUBLE + recording % 3)) AS BIGINT) AS pad FROM recs) USING (recording) WHERE panel = 'trim') c USING (recording)
       WHERE c.b IS NULL OR f.frame_idx BETWEEN CASE WHEN open THEN 0 ELSE a END AND b""",
    _MARKS,
    recursive=True,
)
def crop_frames(s, d):
    f = ad.stored_frames(s, d)
    ranges = _panels(s, d)[0].withColumn("padding_s", F.col("recording") % 4 * F.lit(0.3)).withColumn("fps", F.lit(2.5) + F.col("recording") % 3)
    return editlog.cropped(f, editlog.crop_bounds(ranges, f)).select("recording", "frame_idx")


# Saved corrections

_SAVED = f"""ed AS (
  SELECT f.recording, frame_idx, arg_max(e.label, seq) AS raw FROM f JOIN edits e ON f.recording = e.recording AND frame_idx BETWEEN least(start_frame, end_frame) AND greatest(start_frame, end_frame) WHERE f.recording % 3 = 0 GROUP BY ALL
), lb AS (
  SELECT f.* EXCLUDE (label, aoi_hit_source, u, v), raw IS NOT NULL AS edited, u AS u0, v AS v0, CASE WHEN raw IS NOT NULL THEN 'manual' ELSE aoi_hit_source END AS aoi_hit_source,
    CASE WHEN raw IS NULL THEN label WHEN trim(raw) IN ({ad._SPELLINGS}) THEN 'NoAOI' ELSE trim(raw) END AS label
  FROM f LEFT JOIN ed USING (recording, frame_idx) WHERE f.recording % 3 = 0
), saved AS (
  SELECT lb.*, lb.label IS DISTINCT FROM lag(lb.label) OVER (PARTITION BY lb.recording ORDER BY lb.frame_idx) AS aoi_transition,
    CASE WHEN edited AND lb.label = 'NoAOI' THEN NULL WHEN edited AND uv.u IS NOT NULL THEN round_even(least(greatest(uv.u, 0), 1), 5) ELSE u0 END AS u,
    CASE WHEN edited AND lb.label = 'NoAOI' THEN NULL WHEN edited AND uv.v IS NOT NULL THEN round_even(least(greatest(uv.v, 0), 1), 5) ELSE v0 END AS v
  FROM lb LEFT JOIN uv ON uv.recording = lb.recording AND uv.frame_idx = lb.frame_idx AND uv.surface = lb.label)"""


def _saved(s, d):
    f = ad.stored_frames(s, d)
    edits = ad.edits(f).where(F.col("recording") % 3 == 0)
    return corrections.corrected(f.join(edits.select("recording").distinct(), "recording", "left_semi"), edits, ad.quads(f))


@query("SELECT recording, frame_idx, label, aoi_hit_source, aoi_transition, round(u, 4) AS u, round(v, 4) AS v FROM saved WHERE recording IN (SELECT recording FROM edits)", _H, _SAVED)
def saved_corrections(s, d):
    return _saved(s, d).select("recording", "frame_idx", "label", "aoi_hit_source", "aoi_transition", r("u", 4).alias("u"), r("v", 4).alias("v"))


@query(
    """SELECT recording, count(*) AS total_frames, count(*) FILTER (label = 'NoAOI') AS no_aoi_frames, count(*) FILTER (aoi_hit_source = 'direct') AS surface_3d_frames, count(*) FILTER (aoi_hit_source = 'manual') AS manual_frames,
         count(*) FILTER (label = 'Board') AS board_frames FROM saved WHERE recording IN (SELECT recording FROM edits) GROUP BY recording""",
    _H,
    _SAVED,
)
def saved_summaries(s, d):
    saved = _saved(s, d)
    report = corrections.SUMMARIES["preprocessing_report"](saved)
    manual = saved.groupBy("recording").agg(F.count_if(F.col("aoi_hit_source") == "manual").alias("manual_frames"))
    board = F.coalesce(F.try_element_at("aoi_dwell_frames", F.lit("Board")), F.lit(0)).cast("long").alias("board_frames")
    return report.join(manual, "recording").select("recording", "total_frames", "no_aoi_frames", "surface_3d_frames", "manual_frames", board)


# Regions by priority

_REGIONS = """rg AS (
  SELECT p_partkey AS idx, 'R' || p_partkey % 300 AS name, ['Board', 'Screen', 'Left_Box', 'NoAOI'][p_partkey % 4 + 1] AS surface, CAST(p_size % 7 AS INTEGER) AS priority, p_partkey % 3 = 0 AS triangle,
    (p_partkey * 37 % 101) / 101.0::DOUBLE - 0.02 AS u1, (p_partkey * 53 % 103) / 103.0::DOUBLE - 0.02 AS v1, 0.02::DOUBLE + p_size / 400.0::DOUBLE AS w, 0.03::DOUBLE + p_size / 350.0::DOUBLE AS h FROM part
), hit AS (
  SELECT f.recording, f.frame_idx, rg.name, rg.priority, rg.idx FROM f JOIN rg ON rg.surface = f.label AND f.u BETWEEN u1 AND u1 + w AND f.v BETWEEN v1 AND v1 + h AND (NOT triangle OR (f.u - u1) / w + (f.v - v1) / h <= 1)
), won AS (
  SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY recording, frame_idx ORDER BY priority DESC, idx) = 1)"""


def _regions(s, d):
    """A region for each part: boxes and right-angled triangles of several priorities on four surfaces."""
    p, key = s.read.parquet(f"{d}/part.parquet"), F.col("p_partkey")
    u, v = (key * 37 % 101) / 101.0 - 0.02, (key * 53 % 103) / 103.0 - 0.02
    w, h = 0.02 + F.col("p_size") / 400.0, 0.03 + F.col("p_size") / 350.0
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return p.select(
        key.alias("idx"), F.concat(F.lit("R"), key % 300).alias("name"), F.get(F.array(*[F.lit(x) for x in ("Board", "Screen", "Left_Box", "NoAOI")]), (key % 4).cast("int")).alias("surface"), (F.col("p_size") % 7).alias("priority"),
        F.when(key % 3 == 0, "polygon").otherwise("bbox").alias("kind"), u.alias("u1"), (u + w).alias("u2"), v.alias("v1"), (v + h).alias("v2"),
        F.array(corner(u, v), corner(u + w, v), corner(u, v + h)).alias("points"), F.lit(None).cast("array<string>").alias("rows"),
    )


@query("SELECT f.recording, f.frame_idx, won.name AS region, won.priority FROM f LEFT JOIN won USING (recording, frame_idx)", _REGIONS)
def region_resolution(s, d):
    points = ad.frames(s, d).select("recording", "frame_idx", F.col("label").alias("surface"), "u", "v")
    return regions.resolved(points, _regions(s, d), ["recording", "frame_idx"]).select("recording", "frame_idx", "region", F.col("priority").cast("int").alias("priority"))


@query("SELECT name, CAST(-min(s).p AS INTEGER) AS priority, min(s).i AS idx FROM (SELECT name, {'p': -priority, 'i': idx} AS s FROM rg) GROUP BY name", _REGIONS)
def region_order(s, d):
    out = regions.names_in_order(_regions(s, d))
    return out.select("name", F.col("priority").cast("int").alias("priority"), "idx")


# Places


@query(
    """SELECT a.recording, a.n AS position, a.frame_idx, b.u, b.v FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY frame_idx) - 1 AS n FROM scene) a
       JOIN (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY ts_us) - 1 AS n FROM gaze) b ON a.recording = b.recording AND a.n = b.n"""
)
def zip_frames(s, d):
    f = ad.stored_frames(s, d)
    out = positions.zipped(ad.scene(f).drop("ts_us"), ad.gaze(f), ["recording"], "frame_idx", "ts_us", 32, ad.CHUNK_US)
    return out.select("recording", "position", "frame_idx", "u", "v")


_GAPPED = """gp AS (
  SELECT recording, ts_us, CASE WHEN recording % 3 = 0 AND k % 29 = 5 THEN NULL ELSE frame_idx + 4 END AS frame_idx, CASE WHEN k % 7 <> 1 THEN time_s END AS time_s, frame_idx AS place FROM f
), gr AS (
  SELECT recording, bool_or(frame_idx IS NULL) AS gap, count(*) AS n, recording % 5 * 6 - 6 AS s, recording % 5 * 6 - 6 + recording % 4 * 30 AS e FROM gp GROUP BY recording)"""


def _gapped(s, d):
    f, k, rec = ad.stored_frames(s, d), F.col("k"), F.col("recording")
    frames = f.select("recording", "ts_us", F.when((rec % 3 != 0) | (k % 29 != 5), F.col("frame_idx") + 4).alias("frame_idx"), F.when(k % 7 != 1, F.col("time_s")).alias("time_s"))
    start = rec % 5 * 6 - 6
    return frames, ad.recordings(f).select("recording", start.alias("start_frame"), (start + rec % 4 * 30).alias("end_frame"))


@query("SELECT gp.recording, gp.ts_us, gp.frame_idx FROM gp JOIN gr USING (recording) WHERE e > s AND CASE WHEN gap THEN least(e, n - 1) > greatest(0, s) AND place BETWEEN greatest(0, s) AND least(e, n - 1) ELSE gp.frame_idx BETWEEN s AND e END", _GAPPED)
def positional_slice(s, d):
    frames, ranges = _gapped(s, d)
    return positions.sliced(frames, ranges, "ts_us", ad.CHUNK_US).select("recording", "ts_us", "frame_idx")


@query(
    """SELECT recording, round(greatest(0, coalesce(CASE WHEN NOT gap AND count(time_s) FILTER (gp.frame_idx BETWEEN s AND e) > 1 THEN arg_max(time_s, place) FILTER (gp.frame_idx BETWEEN s AND e AND time_s IS NOT NULL) - arg_min(time_s, place) FILTER (gp.frame_idx BETWEEN s AND e AND time_s IS NOT NULL) END,
         CASE WHEN gap THEN max(time_s) FILTER (place = e) - max(time_s) FILTER (place = s) END, (e - s + 1) / 2.5::DOUBLE)), 6) AS duration_s FROM gp JOIN gr USING (recording) GROUP BY recording, gap, s, e""",
    _GAPPED,
)
def positional_duration(s, d):
    frames, ranges = _gapped(s, d)
    return positions.durations(frames, ranges, F.lit(2.5), "ts_us", ad.CHUNK_US).select("recording", r("duration_s").alias("duration_s"))
