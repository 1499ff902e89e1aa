"""Regions by priority: every point's region of its surface, found through a uniform grid.

A region covers cells of a grid over its surface, a point lies in one cell, and the two meet by surface and cell; an exact
test decides, and of the regions that hold a point the one with the highest priority wins, of equal ones the first in
the configuration. No point meets a region that its cell doesn't touch, nor one that stands behind a box around the whole
cell: that box holds every point of the cell, so nothing behind it can win. Where boxes cover cells, the regions that
points meet don't grow with their number. Cells that many points share are dealt over ``SALTS`` tasks, each with its copy
of the cell's regions; regions and points meet by shuffle, as the size of a region's cells can't be told beforehand.

``regions``: idx (place in the configuration), name, surface, kind, priority and, by kind: ``bbox`` u1, u2, v1, v2;
``polygon`` points (array of x, y); ``mask`` rows (array of 0/1 strings over the unit square). Bounds and edges count as
inside. Points without finite coordinates and regions without their shape hold nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import finite, in_box, in_mask, in_polygon
from .ordered import settled

#: Cells of the grid along an axis of the unit square; one more row and column on each side take all that lies beyond.
CELLS = 32
#: Tasks over which the points of a cell are dealt.
SALTS = 8
SHAPE = ["kind", "u1", "u2", "v1", "v2", "points", "rows"]


def _cell(x: Column, cells: int) -> Column:
    """Never smaller for a larger ``x``; 1 is in the last cell of the unit square."""
    at = F.floor(F.least(F.greatest(x * cells, F.lit(-1.0)), F.lit(float(cells)))).cast("int")
    return F.when(x <= 1, F.least(at, F.lit(cells - 1))).otherwise(at)


def bounded(regions: DataFrame) -> DataFrame:
    """``regions`` that have a shape, with lo_u, hi_u, lo_v and hi_v around it."""
    points = F.col("points")
    lowest = lambda c: F.array_min(F.transform(points, lambda p: p[c]))
    highest = lambda c: F.array_max(F.transform(points, lambda p: p[c]))

    def pick(box: str, poly: Column, mask: float) -> Column:
        return F.when(F.col("kind") == "bbox", F.col(box)).when((F.col("kind") == "polygon") & (F.size("points") >= 3), poly).when((F.col("kind") == "mask") & (F.size("rows") > 0), mask)

    out = regions.withColumn("lo_u", pick("u1", lowest("x"), 0.0)).withColumn("hi_u", pick("u2", highest("x"), 1.0))
    out = out.withColumn("lo_v", pick("v1", lowest("y"), 0.0)).withColumn("hi_v", pick("v2", highest("y"), 1.0))
    return out.where((F.col("lo_u") <= F.col("hi_u")) & (F.col("lo_v") <= F.col("hi_v")))


def covering(regions: DataFrame, cells: int = CELLS) -> DataFrame:
    """``regions`` once for each cell (cu, cv) that their bounds touch, without those behind the first box around the whole cell.

    A cell strictly between the cells of a box's bounds lies in the box. There is one such box at most for each cell.
    """
    rank = F.struct(-F.col("priority"), F.col("idx"))
    ends = bounded(regions).withColumns({f"__{c}": _cell(F.col(c), cells) for c in ("lo_u", "hi_u", "lo_v", "hi_v")}).drop("lo_u", "hi_u", "lo_v", "hi_v")

    def exploded(rows: DataFrame, inset: int) -> DataFrame:
        span = lambda a, b: F.explode(F.sequence(F.col(a) + inset, F.col(b) - inset))
        return rows.select("*", span("__lo_u", "__hi_u").alias("cu")).select("*", span("__lo_v", "__hi_v").alias("cv")).drop("__lo_u", "__hi_u", "__lo_v", "__hi_v")

    wide = (F.col("__hi_u") - F.col("__lo_u") >= 2) & (F.col("__hi_v") - F.col("__lo_v") >= 2)
    boxes = ends.where((F.col("kind") == "bbox") & wide).select("surface", rank.alias("__rank"), "__lo_u", "__hi_u", "__lo_v", "__hi_v")
    first = settled(exploded(boxes, 1).groupBy("surface", "cu", "cv").agg(F.min("__rank").alias("__first")))
    each = exploded(ends, 0).join(first, ["surface", "cu", "cv"], "left")
    return each.where(F.col("__first").isNull() | (rank <= F.col("__first"))).select(*regions.columns, "cu", "cv")


def holds(u: Column, v: Column) -> Column:
    """Whether a region's shape (its columns) holds the point."""
    kind = F.col("kind")
    return F.when(kind == "bbox", in_box(u, v, F.col("u1"), F.col("v1"), F.col("u2"), F.col("v2"))).when(kind == "polygon", in_polygon(u, v, F.col("points"))).when(kind == "mask", in_mask(u, v, F.col("rows"))).otherwise(False)


def resolved(points: DataFrame, regions: DataFrame, keys: list[str], cells: int = CELLS, salts: int = SALTS) -> DataFrame:
    """``points`` (keys that name a row, surface, u, v) with ``region`` and ``priority`` of the winning region, null for none."""
    u, v = F.col("u"), F.col("v")
    here = finite(u) & finite(v)
    salt = F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")
    placed = points.withColumns({"__cu": F.when(here, _cell(u, cells)), "__cv": F.when(here, _cell(v, cells)), "__salt": salt})
    each = covering(regions, cells).select(F.col("surface").alias("__surface"), F.col("cu").alias("__at_u"), F.col("cv").alias("__at_v"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__of"), "idx", "name", "priority", *SHAPE)
    meet = (F.col("surface") == F.col("__surface")) & (F.col("__cu") == F.col("__at_u")) & (F.col("__cv") == F.col("__at_v")) & (F.col("__salt") == F.col("__of"))
    held = placed.join(each.hint("merge"), meet & F.coalesce(holds(u, v), F.lit(False)), "left")
    won = F.min_by(F.struct("name", "priority"), F.when(F.col("idx").isNotNull(), F.struct(-F.col("priority"), F.col("idx")))).alias("__won")
    best = held.groupBy(*keys).agg(*[F.first(c).alias(c) for c in points.columns if c not in keys], won)
    return best.select(*points.columns, F.col("__won.name").alias("region"), F.col("__won.priority").alias("priority"))


def names_in_order(regions: DataFrame) -> DataFrame:
    """Each name once with its place in the order of priority: the highest first, of equal ones the first configured."""
    first = regions.groupBy("name").agg(F.min(F.struct(-F.col("priority"), F.col("idx"))).alias("__at"))
    return first.select("name", (-F.col("__at.col1")).alias("priority"), F.col("__at.idx").alias("idx"))
