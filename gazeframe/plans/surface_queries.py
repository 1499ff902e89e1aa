"""Registered queries over tags and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review, surfaces
from . import adapter as ad
from .queries import _EDITED, _H, query, rounded

#: Areas of this data and their tags; tag 7 is on two of them.
AREAS = {"Board": [0, 1, 2, 3, 7], "Left_Box": [4, 5, 6, 7], "Right_Box": [8, 9], "Screen": [12, 13, 14, 15]}
#: Three tags of each frame, as (factor, offset); frames of k below 20 show the first alone.
_TAGS = ((1, 0), (3, 1), (7, 2))
_PICKED = (0, 10, 20, 50, 100, 200)
_VALUES = ", ".join(f"('{name}', {tag})" for name, tags in AREAS.items() for tag in tags)
_DETECTED = f"""det AS (
  SELECT recording, frame_idx, (k * a + b) % 18 AS tag_id FROM f, (VALUES {", ".join(f"({a}, {b})" for a, b in _TAGS)}) AS t(a, b) WHERE k >= 20 OR a = 1
), areas AS (
  SELECT * FROM (VALUES {_VALUES}) AS t(surface, tag_id))"""


def _detections(f):
    tags = F.explode(F.array(*[F.when((F.col("k") >= 20) | F.lit(a == 1), (F.col("k") * a + b) % 18) for a, b in _TAGS])).alias("tag_id")
    return f.select("recording", "frame_idx", tags).where(F.col("tag_id").isNotNull())


@query("SELECT recording, frame_idx, surface, count(*) AS own_tags, CASE WHEN count(*) >= 2 THEN 'direct' ELSE 'projected' END AS source FROM det JOIN areas USING (tag_id) GROUP BY ALL", _DETECTED)
def area_own_tags(s, d):
    rows = [(name, tags) for name, tags in AREAS.items()]
    return surfaces.own_tags(_detections(ad.frames(s, d)), s.createDataFrame(rows, "surface string, tag_ids array<int>"))


@query(
    f"""SELECT f.recording, f.frame_idx, count(tag_id) AS n_tags, coalesce(string_agg(tag_id::VARCHAR, ',' ORDER BY tag_id) FILTER (tag_id IN {surfaces.SCREEN_TAGS}), '') AS screen_tags
    FROM f LEFT JOIN det ON det.recording = f.recording AND det.frame_idx = f.frame_idx WHERE f.frame_idx IN {_PICKED} GROUP BY ALL""",
    _DETECTED,
)
def frame_diagnostic(s, d):
    f = ad.stored_frames(s, d)
    out = surfaces.frame_diagnostic(f, _detections(f), _PICKED)
    return out.withColumn("screen_tags", F.array_join(F.transform("screen_tags", lambda t: t.cast("string")), ","))


@query(
    """SELECT recording, frame_idx, src AS u_source, CASE src WHEN 'reprojected' THEN round(round_even(least(greatest(nu, 0), 1), 5), 2) WHEN 'kept' THEN round(u, 2) END AS u,
      CASE src WHEN 'reprojected' THEN round(round_even(least(greatest(nv, 0), 1), 5), 2) WHEN 'kept' THEN round(v, 2) END AS v
    FROM (SELECT f.recording, f.frame_idx, f.u, f.v, uv.u AS nu, uv.v AS nv, CASE WHEN app.edit_source = 'manual' AND final_label = 'NoAOI' THEN 'blank' WHEN app.edit_source = 'manual' AND uv.u IS NOT NULL THEN 'reprojected' ELSE 'kept' END AS src
      FROM f JOIN app ON app.recording = f.recording AND app.frame_idx = f.frame_idx LEFT JOIN uv ON uv.recording = f.recording AND uv.frame_idx = f.frame_idx AND uv.surface = final_label)""",
    _EDITED.split("), anc AS")[0] + ")",
    _H,
)
def reprojected_corrections(s, d):
    f = ad.stored_frames(s, d)
    edited = review.apply_edits(f.select("recording", "frame_idx", "label"), ad.edits(f))
    out = surfaces.reprojected(f.select("recording", "frame_idx", "x_px", "y_px", "u", "v"), surfaces.corrected_frames(edited), ad.quads(f))
    return rounded(out.select("recording", "frame_idx", "u_source", "u", "v"), "u", "v", digits=2)
