"""Plane geometry as columns: quads, homographies, polygons, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed limits of hit tests: margin around the unit square, least quad area, greatest reprojection error in pixels.
HIT_MARGIN, LEAST_AREA, MAX_REPROJECTION = 0.05, 60.0, 18.0


def quad_area(q: list[Column]) -> Column:
    """Area of x0, y0, ... x3, y3 by the shoelace sum."""
    x, y = q[0::2], q[1::2]
    return F.abs(sum((x[i] * y[(i + 1) % 4] - x[(i + 1) % 4] * y[i] for i in range(4)), F.lit(0.0))) / 2


def valid_quad(q: list[Column], least_area: float = LEAST_AREA) -> Column:
    """Finite, convex (all turns to one side, none straight) and larger than ``least_area``."""
    x, y = q[0::2], q[1::2]
    turns = [(x[(i + 1) % 4] - x[i]) * (y[(i + 2) % 4] - y[(i + 1) % 4]) - (y[(i + 1) % 4] - y[i]) * (x[(i + 2) % 4] - x[(i + 1) % 4]) for i in range(4)]
    finite = F.lit(True)
    for c in q:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    convex = (F.least(*turns) > 0) | (F.greatest(*turns) < 0)
    return F.coalesce(finite & convex & (quad_area(q) > least_area), F.lit(False))


def on_unit_square(df: DataFrame, q: list[Column], x: Column, y: Column, name: str) -> DataFrame:
    """``df`` with ``name``: struct(u, v) of the point under the homography that takes the quad's corners to (0,0), (1,0), (1,1), (0,1).

    The square-to-quad map has a closed form; its adjugate is the inverse up to scale. Null where the scale vanishes.
    As one expression, with each part written out wherever it is used, this is more than the JVM compiles. So it is
    worked out in steps; exploding the one value of a step keeps Spark from putting them together again.
    """

    def step(df: DataFrame, at: str, **parts: Column) -> DataFrame:
        return df.withColumn(at, F.explode(F.array(F.struct(*[c.alias(n) for n, c in parts.items()]))))

    x0, y0, x1, y1, x2, y2, x3, y3 = q
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    dx1, dy1, dx2, dy2 = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    det = dx1 * dy2 - dx2 * dy1
    df = step(df, "__p", g=F.try_divide(sx * dy2 - dx2 * sy, det), h=F.try_divide(dx1 * sy - sx * dy1, det))
    g, h = F.col("__p.g"), F.col("__p.h")
    df = step(df, "__m", a=x1 - x0 + g * x1, b=x3 - x0 + h * x3, d=y1 - y0 + g * y1, e=y3 - y0 + h * y3)
    a, b, c, d, e, f = F.col("__m.a"), F.col("__m.b"), x0, F.col("__m.d"), F.col("__m.e"), y0
    u = (e - f * h) * x + (c * h - b) * y + (b * f - c * e)
    v = (f * g - d) * x + (a - c * g) * y + (c * d - a * f)
    w = (d * h - e * g) * x + (b * g - a * h) * y + (a * e - b * d)
    df = step(df, "__w", u=u, v=v, w=w)
    w = F.col("__w.w")
    uv = F.when(F.abs(w) >= 1e-9, F.struct((F.col("__w.u") / w).alias("u"), (F.col("__w.v") / w).alias("v")))
    return df.withColumn(name, uv).drop("__p", "__m", "__w")


def inside_unit(u: Column, v: Column, margin: float = HIT_MARGIN) -> Column:
    return F.coalesce(u.between(-margin, 1 + margin) & v.between(-margin, 1 + margin), F.lit(False))


def in_box(u: Column, v: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Bounds count as inside."""
    return u.between(x0, x1) & v.between(y0, y1)


def in_polygon(u: Column, v: Column, points: Column) -> Column:
    """Ray casting over ARRAY<STRUCT<x, y>>; a point on an edge is inside."""
    n = F.size(points)
    edges = F.transform(points, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get(points, (i + 1) % n)["x"].alias("bx"), F.get(points, (i + 1) % n)["y"].alias("by")))
    crossing = F.filter(edges, lambda e: ((e["ay"] > v) != (e["by"] > v)) & (u < (e["bx"] - e["ax"]) * (v - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))
    on_edge = F.exists(
        edges,
        lambda e: (((e["bx"] - e["ax"]) * (v - e["ay"]) - (e["by"] - e["ay"]) * (u - e["ax"])) == 0)
        & u.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        & v.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )
    return F.coalesce((n >= 3) & (on_edge | (F.size(crossing) % 2 == 1)), F.lit(False))


def in_mask(u: Column, v: Column, rows: Column) -> Column:
    """Look-up in a raster given as an array of 0/1 strings; the pixel is round(u (w - 1)), round(v (h - 1))."""
    h, w = F.size(rows), F.length(F.get(rows, F.lit(0)))
    row = F.get(rows, F.bround(v * (h - 1)).cast("int"))
    inside = u.between(0, 1) & v.between(0, 1)
    return F.coalesce(inside & (F.substring(row, F.bround(u * (w - 1)).cast("int") + 1, F.lit(1)) == "1"), F.lit(False))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
