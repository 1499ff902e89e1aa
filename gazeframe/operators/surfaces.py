"""Tags and surfaces: tags counted by area, corrected frames put onto their new surface, a look at fixed frames.

``detections``: recording, frame_idx, tag_id, one row for each tag seen. ``areas``: surface, tag_ids. ``quads`` as in
``spatial.surface_hits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import finite, on_unit_square, valid_quad
from ..functions.labels import NO_AOI
from .spatial import QUAD

#: A surface is formed from its own tags where that many of them are seen.
OWN_TAGS = 2
#: The frames and tags of the diagnostic. Fixed values.
DIAGNOSED_FRAMES, SCREEN_TAGS = (100, 1000, 5000, 10000, 20000, 30000), (12, 13, 14, 15)


def own_tags(detections: DataFrame, areas: DataFrame) -> DataFrame:
    """recording, frame_idx, surface, own_tags (detections of the surface's tags; a tag seen twice counts twice) and source.

    A tag may belong to several surfaces; tags of none and surfaces of which nothing is seen have no row. The join is on
    the tag; Spark broadcasts the configuration where its size allows.
    """
    tags = areas.select("surface", F.explode(F.array_distinct("tag_ids")).alias("tag_id")).distinct()
    out = detections.select("recording", "frame_idx", "tag_id").join(tags, "tag_id").groupBy("recording", "frame_idx", "surface").agg(F.count("*").alias("own_tags"))
    return out.withColumn("source", F.when(F.col("own_tags") >= OWN_TAGS, "direct").otherwise("projected"))


def corrected_frames(edited: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """recording, frame_idx, label of the frames corrected by hand; not those that ``done`` has with the same label."""
    out = edited.where(F.col("edit_source") == "manual").select("recording", "frame_idx", F.col("final_label").alias("label"))
    return out if done is None else out.join(done.select("recording", "frame_idx", "label"), ["recording", "frame_idx", "label"], "left_anti")


def reprojected(frames: DataFrame, corrected: DataFrame, quads: DataFrame) -> DataFrame:
    """``frames`` (recording, frame_idx, x_px, y_px, u, v and others) with the gaze of corrected frames put onto the new surface.

    A frame corrected to no area loses its (u, v). A frame corrected to a surface takes the gaze under the homography of
    that surface's quad in that frame, drawn into the unit square and rounded to five digits. Where there is no valid
    quad or no finite gaze, and in all other frames, (u, v) stay. ``u_source`` is reprojected, blank or kept. Only quads
    of corrected frames reach the arithmetic; each frame has at most one correction and one quad of a surface.
    """
    q = [F.col(f"__{c}") for c in QUAD]
    of_label = quads.select("recording", "frame_idx", F.col("surface").alias("__label"), *[F.col(c).alias(f"__{c}") for c in QUAD])
    put = corrected.withColumnRenamed("label", "__label").join(of_label.where(valid_quad(q)), ["recording", "frame_idx", "__label"], "left")
    out = frames.join(put, ["recording", "frame_idx"], "left")
    known = finite(F.col("x_px")) & finite(F.col("y_px"))
    out = on_unit_square(out, q, F.when(known, F.col("x_px")), F.when(known, F.col("y_px")), "__uv")
    blank, new = F.coalesce(F.col("__label") == NO_AOI, F.lit(False)), F.col("__uv").isNotNull()

    def moved(name: str) -> Column:
        unit = F.bround(F.least(F.greatest(F.col(f"__uv.{name}"), F.lit(0.0)), F.lit(1.0)), 5)
        return F.when(blank, F.lit(None).cast("double")).when(new, unit).otherwise(F.col(name))

    source = F.when(blank, "blank").when(new, "reprojected").otherwise("kept")
    return out.withColumns({"u": moved("u"), "v": moved("v"), "u_source": source}).drop("__label", "__uv", *[f"__{c}" for c in QUAD])


def frame_diagnostic(frames: DataFrame, detections: DataFrame, picked: tuple[int, ...] = DIAGNOSED_FRAMES, tags: tuple[int, ...] = SCREEN_TAGS) -> DataFrame:
    """recording, frame_idx, n_tags and screen_tags (ascending, with repeats) of the picked frames that a recording has.

    The picked places reach both scans as a filter; a frame in which nothing is seen has zero tags.
    """
    here = frames.where(F.col("frame_idx").isin(*picked)).select("recording", "frame_idx")
    seen = detections.where(F.col("frame_idx").isin(*picked)).groupBy("recording", "frame_idx")
    counts = seen.agg(F.count("tag_id").alias("n_tags"), F.array_sort(F.collect_list(F.when(F.col("tag_id").isin(*tags), F.col("tag_id")))).alias("screen_tags"))
    out = here.join(counts, ["recording", "frame_idx"], "left")
    return out.select("recording", "frame_idx", F.coalesce("n_tags", F.lit(0)).alias("n_tags"), F.coalesce("screen_tags", F.array().cast("array<int>")).alias("screen_tags"))
