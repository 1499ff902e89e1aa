"""Where gaze falls: preferred fixation points, 2-D histograms, smoothing, grid occupancy, zones and surface hits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import HIT_MARGIN, in_box, inside_unit, on_unit_square, quad_area, valid_quad

LEAST_POINTS = 10
BINS, SIGMA, RADIUS = 25, 1.5, 6
GRID = 4
#: Fixed zones of the screen in its normalised frame: group, zone, x0, y0, x1, y1.
ZONES = [
    ("gamification", "Progress_Bar", 0.12, 0.00, 0.80, 0.14),
    ("gamification", "Buddy_Speech", 0.67, 0.55, 0.84, 0.81),
    ("gamification", "Points", 0.83, 0.69, 0.93, 0.79),
    ("gamification", "Buddy_Avatar", 0.84, 0.77, 0.99, 0.96),
    ("task", "Work_Card", 0.16, 0.18, 0.80, 0.88),
    ("task", "Order_Label", 0.57, 0.19, 0.73, 0.34),
]


def preferred_points(frames: DataFrame, by: list[str], least: int = LEAST_POINTS) -> DataFrame:
    """Fixation frames only, in groups that have at least ``least`` of them; all frames in the others."""
    enough = frames.groupBy(*by).agg((F.count_if(F.col("is_fixation")) >= least).alias("__enough"))
    return frames.join(enough, by).where(~F.col("__enough") | F.col("is_fixation")).drop("__enough")


def unit_points(frames: DataFrame, by: list[str], least: int = LEAST_POINTS) -> DataFrame:
    """Points inside the unit square, both coordinates known, of groups with at least ``least`` such points."""
    inside = frames.where(F.col("u").between(0, 1) & F.col("v").between(0, 1))
    enough = inside.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*by)
    return inside.join(enough, by, "left_semi")


def histogram_2d(points: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """n of each bin with points; the upper edge belongs to the last bin."""
    cell = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    return points.groupBy(*by, cell("u").alias("xbin"), cell("v").alias("ybin")).agg(F.count("*").alias("n"))


def smoothing_weights(bins: int = BINS, sigma: float = SIGMA, radius: int = RADIUS) -> list[tuple[int, int, float]]:
    """(from, to, weight) of a Gaussian of 2 radius + 1 taps along one axis, reflected at the ends."""
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total, out = sum(taps), {}
    for to in range(bins):
        for k, t in zip(range(-radius, radius + 1), taps, strict=True):
            at = (to + k) % (2 * bins)
            at = at if at < bins else 2 * bins - 1 - at
            out[at, to] = out.get((at, to), 0.0) + t / total
    return [(a, b, w) for (a, b), w in sorted(out.items())]


def smoothed(histogram: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """The histogram smoothed along both axes and divided by its largest cell; the weights are a fixed 25 x 25 table."""
    spark = histogram.sparkSession
    k = F.broadcast(spark.createDataFrame(smoothing_weights(bins), "f int, t int, w double"))
    x = histogram.join(k, histogram["xbin"] == k["f"]).groupBy(*by, F.col("t").alias("xbin"), "ybin").agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    y = x.join(k, x["ybin"] == k["f"]).groupBy(*by, "xbin", F.col("t").alias("ybin")).agg(F.sum(F.col("s") * F.col("w")).alias("density"))
    top = y.groupBy(*by).agg(F.max("density").alias("__top"))
    out = y.join(top, by).withColumn("level", F.when(F.col("__top") > 0, F.col("density") / F.col("__top")).otherwise(F.lit(0.0)))
    return out.select(*by, "xbin", "ybin", "density", "level", ((F.col("xbin") + 0.5) / bins).alias("x_center"), ((F.col("ybin") + 0.5) / bins).alias("y_center"))


def grid_occupancy(points: DataFrame, by: list[str], size: int = GRID) -> DataFrame:
    """share of points in each of size x size cells, cell = column * size + row; all cells, zeros included."""
    place = lambda c: F.least(F.floor(F.col(c) * size), F.lit(size - 1)).cast("int")
    counts = points.groupBy(*by, (place("u") * size + place("v")).alias("cell")).agg(F.count("*").alias("n"))
    totals = points.groupBy(*by).agg(F.count("*").alias("total"))
    grid = totals.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
    return grid.join(counts, [*by, "cell"], "left").select(*by, "cell", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def mean_position(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(F.avg("u").alias("mean_x"), F.avg("v").alias("mean_y"), F.count("*").alias("n"))


def zone_hits(points: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Points with every zone that holds them, bounds included; zones may overlap. Zones are a short configured list."""
    zones = points.sparkSession.createDataFrame(ZONES, "zone_group string, zone string, x0 double, y0 double, x1 double, y1 double") if zones is None else zones
    listed = zones.select(F.collect_list(F.struct("zone_group", "zone", "x0", "y0", "x1", "y1")).alias("__z"))
    held = lambda z: in_box(F.col("u"), F.col("v"), z["x0"], z["y0"], z["x1"], z["y1"])
    hit = points.join(F.broadcast(listed)).withColumn("__z", F.explode(F.filter("__z", held)))
    return hit.select(*points.columns, "__z.zone_group", "__z.zone")


QUAD = ["x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3"]


def surface_hits(frames: DataFrame, quads: DataFrame, margin: float = HIT_MARGIN) -> DataFrame:
    """Every frame's surfaces that its gaze hits, with (u, v) on them.

    ``quads``: recording, frame_idx, surface, own_tags and the eight corner numbers. Invalid quads hit nothing.
    """
    return hits_beside(frames.join(quads.where(valid_quad([F.col(c) for c in QUAD])), ["recording", "frame_idx"]), margin)


def hits_beside(quads: DataFrame, margin: float = HIT_MARGIN) -> DataFrame:
    """``surface_hits`` of quads beside which their frame's gaze (x_px, y_px) stands already; nothing is shuffled."""
    q = [F.col(c) for c in QUAD]
    met = quads.where(valid_quad(q))
    out = on_unit_square(met, q, F.col("x_px"), F.col("y_px"), "__uv").where(inside_unit(F.col("__uv.u"), F.col("__uv.v"), margin))
    out = out.withColumn("u", F.col("__uv.u")).withColumn("v", F.col("__uv.v")).drop("__uv")
    return out.withColumn("aoi_hit_source", F.when(F.col("own_tags") >= 2, "direct").otherwise("projected"))


def area_ranks(quads: DataFrame) -> DataFrame:
    """rank of each surface of a recording by mean quad area: the smallest is 1 and wins overlaps."""
    from pyspark.sql import Window

    mean = quads.groupBy("recording", "surface").agg(F.avg(quad_area([F.col(c) for c in QUAD])).alias("area"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy("recording").orderBy("area", "surface")))


def primary_hits(hits: DataFrame, ranks: DataFrame) -> DataFrame:
    """The hit with the best rank (99 where the surface has none) of each frame, and all surfaces hit."""
    ranked = hits.join(ranks.select("recording", "surface", "rank"), ["recording", "surface"], "left").withColumn("rank", F.coalesce("rank", F.lit(99)))
    best = F.min_by(F.struct("surface", "u", "v", "aoi_hit_source", "own_tags"), F.struct("rank", "surface"))
    out = ranked.groupBy("recording", "frame_idx").agg(best.alias("b"), F.array_join(F.array_sort(F.collect_set("surface")), ";").alias("surfaces_hit"))
    return out.select("recording", "frame_idx", F.col("b.surface").alias("primary_aoi"), F.bround(F.least(F.greatest("b.u", F.lit(0.0)), F.lit(1.0)), 5).alias("u"), F.bround(F.least(F.greatest("b.v", F.lit(0.0)), F.lit(1.0)), 5).alias("v"), "b.aoi_hit_source", F.col("b.own_tags").alias("primary_marker_count"), "surfaces_hit")
