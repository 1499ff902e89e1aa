"""Registered queries over surfaces in space: means of transforms, poses from the anchor, projected quads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rig
from . import adapter as ad
from .queries import query, r

SURFACES = ["Board", "Left_Box", "Right_Box", "Screen", "Stream_Deck"]
_LIST = "[" + ", ".join(f"'{s}'" for s in SURFACES) + "]"
#: Rounded numbers without a negative zero.
_SHOWN = ", ".join(f"round({a}, 6) + 0.0 AS {b}" for a, b in (("c", "cos"), ("s", "sin"), ("x", "tx"), ("y", "ty"), ("z", "tz")))


def _shown():
    return [(r(a) + F.lit(0.0)).alias(b) for a, b in (("r0", "cos"), ("r3", "sin"), ("tx", "tx"), ("ty", "ty"), ("tz", "tz"))]


def _samples(s, d):
    """Of each frame the transform between two surfaces, turned about the vertical axis, and its inverse; some are far off."""
    f = ad.stored_frames(s, d)
    k, value = F.col("k"), F.col("value")
    names = F.array(*[F.lit(x) for x in SURFACES])
    a, b = k % 5, F.floor(k / 5).cast("int") % 4
    t = (b * 5 + a) / F.lit(40.0) + (value - F.floor("value")) / 100.0
    cos, sin = (1 - t * t) / (1 + t * t), 2 * t / (1 + t * t)
    off = F.when(k % 13 == 0, 1.5).otherwise(0.0) + (value - F.floor("value")) / 50.0
    turn = [cos, -sin, F.lit(0.0), sin, cos, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    rows = f.select("recording", F.get(names, a).alias("a"), F.get(names, F.when(b >= a, b + 1).otherwise(b)).alias("b"), *rig.named([*turn, a * 0.5 + off, b * 0.25 - off, F.lit(0.1) + off]))
    back = rows.select("recording", F.col("b").alias("a"), F.col("a").alias("b"), *rig.named(rig.inverted(rig.columns())))
    return rows.unionByName(back)


_EDGES = f"""smp0 AS (
  SELECT recording, k % 5 AS ai, k // 5 % 4 AS bi, CASE WHEN k % 13 = 0 THEN 1.5::DOUBLE ELSE 0 END + (value - floor(value)) / 50 AS o, (k // 5 % 4 * 5 + k % 5) / 40.0::DOUBLE + (value - floor(value)) / 100 AS t FROM f
), smp1 AS (
  SELECT recording, {_LIST}[ai + 1] AS a, {_LIST}[CASE WHEN bi >= ai THEN bi + 2 ELSE bi + 1 END] AS b, (1 - t * t) / (1 + t * t) AS c, 2 * t / (1 + t * t) AS s, ai * 0.5::DOUBLE + o AS x, bi * 0.25::DOUBLE - o AS y, 0.1::DOUBLE + o AS z FROM smp0
), smp AS (
  SELECT * FROM smp1 UNION ALL SELECT recording, b, a, c, -s, -(c * x + s * y), -(c * y - s * x), -z FROM smp1
), mid AS (
  SELECT recording, a, b, count(*) AS n, median(x) AS mx, median(y) AS my, median(z) AS mz FROM smp GROUP BY ALL
), far AS (
  SELECT smp.*, n, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS away FROM smp JOIN mid USING (recording, a, b)
), edges3 AS (
  SELECT recording, a, b, n, count(*) AS inliers, avg(c) / sqrt(avg(c) * avg(c) + avg(s) * avg(s)) AS c, avg(s) / sqrt(avg(c) * avg(c) + avg(s) * avg(s)) AS s, avg(x) AS x, avg(y) AS y, avg(z) AS z
  FROM (SELECT *, greatest(0.02::DOUBLE, 2.5 * median(away) OVER (PARTITION BY recording, a, b)) AS gate FROM far) WHERE n <= 2 OR away <= gate + 1e-12 GROUP BY ALL)"""


@query("SELECT recording, a, b, n, inliers, " + _SHOWN + " FROM edges3", _EDGES)
def robust_edges(s, d):
    mean = rig.robust_mean(_samples(s, d), ["recording", "a", "b"])
    return mean.select("recording", "a", "b", "n", "inliers", *_shown())


def _rounds() -> str:
    """One table for each round of the walk from the anchor; five surfaces are reached in four rounds."""
    out = [
        """hop0 AS (SELECT recording, CASE WHEN bool_or(a = 'Board' OR b = 'Board') THEN 'Board' ELSE min(least(a, b)) END AS surface, 0 AS hops, 1.0::DOUBLE AS c, 0.0::DOUBLE AS s, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM edges3 GROUP BY recording)"""
    ]
    for i in range(1, len(SURFACES)):
        seen = " UNION ALL ".join(f"SELECT recording, surface FROM hop{j}" for j in range(i))
        out.append(
            f"""hop{i} AS (SELECT e.recording, e.b AS surface, {i} AS hops, p.c * e.c - p.s * e.s AS c, p.s * e.c + p.c * e.s AS s, p.c * e.x - p.s * e.y + p.x AS x, p.s * e.x + p.c * e.y + p.y AS y, e.z + p.z AS z
            FROM hop{i - 1} p JOIN edges3 e ON e.recording = p.recording AND e.a = p.surface AND e.n >= 3 ANTI JOIN ({seen}) q ON q.recording = e.recording AND q.surface = e.b
            QUALIFY row_number() OVER (PARTITION BY e.recording, e.b ORDER BY e.a) = 1)"""
        )
    return ", ".join(out)


@query(" UNION ALL ".join(f"SELECT recording, surface, hops, {_SHOWN} FROM hop{i}" for i in range(len(SURFACES))), _EDGES, _rounds())
def anchor_poses(s, d):
    poses = rig.anchor_poses(rig.robust_mean(_samples(s, d), ["recording", "a", "b"]))
    return poses.select("recording", "surface", "hops", *_shown())


#: surface, centre and half size of the projected boxes; all face the camera.
_BOXES = [("Board", 0.0, 0.0, 0.0, 0.42, 0.3), ("Screen", 0.6, -0.3, 0.4, 0.27, 0.17), ("Left_Box", -0.7, 0.2, -0.6, 0.15, 0.1)]
_CORNER_SIGNS = [(-1, -1), (1, -1), (1, 1), (-1, 1)]


def _views(s, d):
    f = ad.stored_frames(s, d)
    k, v = F.col("k"), F.col("v")
    t = (k - 50) / 80.0
    cos, sin = (1 - t * t) / (1 + t * t), 2 * t / (1 + t * t)
    turn = [cos, F.lit(0.0), sin, F.lit(0.0), F.lit(1.0), F.lit(0.0), -sin, F.lit(0.0), cos]
    cameras = f.select("recording", "frame_idx", (v * 24).alias("reprojection_px"), *rig.named([*turn, v - 0.5, F.lit(0.05) * (k % 7), k % 9 * 0.25 - 0.2]))
    boxes = f.sparkSession.createDataFrame([(n, *[c for a, b in _CORNER_SIGNS for c in (x + a * w, y + b * h, z)]) for n, x, y, z, w, h in _BOXES], "surface string, " + ", ".join(f"{c} double" for c in rig.CORNERS))
    quads = ad.recordings(f).select("recording").join(F.broadcast(boxes))  # three rows
    rec = F.col("recording") % 5
    lenses = ad.recordings(f).select("recording", (800.0 + rec * 10).alias("fx"), (790.0 + rec * 10).alias("fy"), F.lit(800.0).alias("cx"), F.lit(600.0).alias("cy"), *[F.lit(c).alias(n) for c, n in ((-0.12, "k1"), (0.02, "k2"), (0.001, "p1"), (-0.0005, "p2"), (0.003, "k3"))])
    return cameras, quads, lenses


def _projection_sql() -> str:
    boxes = ", ".join("(" + ", ".join([f"'{n}'", *[f"{float(c)!r}::DOUBLE" for a, b in _CORNER_SIGNS for c in (x + a * w, y + b * h, z)]]) + ")" for n, x, y, z, w, h in _BOXES)
    names = ", ".join(f"{c}_{i}" for i in range(4) for c in "xyz")
    deep = ", ".join(f"c * x_{i} + s * z_{i} + tx AS cx{i}, y_{i} + ty AS cy{i}, -s * x_{i} + c * z_{i} + tz AS cz{i}" for i in range(4))
    norm = ", ".join(f"cx{i} / nullif(cz{i}, 0) AS nx{i}, cy{i} / nullif(cz{i}, 0) AS ny{i}" for i in range(4))
    r2 = ", ".join(f"nx{i} * nx{i} + ny{i} * ny{i} AS q{i}" for i in range(4))
    radial = ", ".join(f"1 + q{i} * (-0.12::DOUBLE + q{i} * (0.02::DOUBLE + q{i} * 0.003::DOUBLE)) AS w{i}" for i in range(4))
    pix = ", ".join(
        f"(800.0::DOUBLE + recording % 5 * 10) * (nx{i} * w{i} + 0.002::DOUBLE * nx{i} * ny{i} - 0.0005::DOUBLE * (q{i} + 2 * nx{i} * nx{i})) + 800 AS px{i}, (790.0::DOUBLE + recording % 5 * 10) * (ny{i} * w{i} + 0.001::DOUBLE * (q{i} + 2 * ny{i} * ny{i}) - 0.001::DOUBLE * nx{i} * ny{i}) + 600 AS py{i}"
        for i in range(4)
    )
    turns = ", ".join(f"(px{(i + 1) % 4} - px{i}) * (py{(i + 2) % 4} - py{(i + 1) % 4}) - (py{(i + 1) % 4} - py{i}) * (px{(i + 2) % 4} - px{(i + 1) % 4})" for i in range(4))
    area = " + ".join(f"px{i} * py{(i + 1) % 4} - px{(i + 1) % 4} * py{i}" for i in range(4))
    return f"""cam AS (SELECT recording, frame_idx, v * 24 AS err, (1 - t * t) / (1 + t * t) AS c, 2 * t / (1 + t * t) AS s, v - 0.5 AS tx, 0.05::DOUBLE * (k % 7) AS ty, k % 9 * 0.25::DOUBLE - 0.2 AS tz FROM (SELECT *, (k - 50) / 80.0::DOUBLE AS t FROM f)
    ), box AS (SELECT * FROM (VALUES {boxes}) b(surface, {names})
    ), dp AS (SELECT recording, frame_idx, err, surface, {deep} FROM cam, box
    ), nm AS (SELECT *, (cz0 + cz1 + cz2 + cz3) / 4 AS centre, {norm} FROM dp
    ), rr AS (SELECT *, {r2} FROM nm
    ), rd AS (SELECT *, {radial} FROM rr
    ), px AS (SELECT *, {pix} FROM rd
    ), st AS (SELECT *, [{turns}] AS turns, abs({area}) / 2 AS area FROM px
    ), shown AS (SELECT *, CASE WHEN err > 18 THEN 'pose' WHEN NOT coalesce(centre > 0.05, false) THEN 'behind' WHEN coalesce((list_min(turns) > 0 OR list_max(turns) < 0) AND area > 60 AND px0 + px1 + px2 + px3 + py0 + py1 + py2 + py3 IS NOT NULL, false) THEN 'ok' ELSE 'quad' END AS status FROM st)"""


@query("SELECT recording, frame_idx, surface, status, " + ", ".join(f"round(CASE WHEN status = 'ok' THEN greatest(least(p{'xy'[i % 2]}{i // 2}, 1e6), -1e6) END, 3) AS q{i}" for i in range(8)) + " FROM shown", _projection_sql())
def projected_quads(s, d):
    out = rig.projected_quads(*_views(s, d))
    # A corner beside the camera is projected far away; beyond a million pixels the engines' last digits differ.
    shown = [F.when(F.col("status") == "ok", F.greatest(F.least(F.col(f"q{i}"), F.lit(1e6)), F.lit(-1e6))) for i in range(8)]
    return out.select("recording", "frame_idx", "surface", "status", *[r(c, 3).alias(f"q{i}") for i, c in enumerate(shown)])
