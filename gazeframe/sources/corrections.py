"""Saving manual corrections to stored frames: stage, publish, and recompute the summaries of touched recordings alone.

The store is a folder with one Parquet table for the frames and one for each summary, all partitioned by recording. A
save writes the new partitions beside the tables first. Only when all of them are complete are they marked as ready and
then replace the old ones, partition by partition; other recordings keep their files. A save that breaks before the mark
leaves the store as it was; one that breaks after it is completed by the next save or by ``recovered``. One process saves
to a store at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import on_unit_square, valid_quad
from ..functions.labels import NO_AOI
from ..operators import editlog, metrics, review
from ..operators.spatial import QUAD

KEY = "recording"
#: What is recomputed from the frames of a touched recording.
SUMMARIES = {"fixation_summary": metrics.fixation_summary, "data_quality": metrics.data_quality, "preprocessing_report": metrics.preprocessing_report}
STAGED, READY, GONE = "_saving-", "_READY", "_gone"


def corrected(frames: DataFrame, edits: DataFrame, quads: DataFrame | None = None) -> DataFrame:
    """``frames`` with the edits written into ``label``: edited frames have the hit source manual, aoi_transition says
    whether the label differs from the frame before, a final label column goes.

    With ``quads`` (recording, frame_idx, surface and corners) the gaze of edited frames is placed on their new surface:
    (u, v) inside the unit square, null outside all areas, as before where there is no valid quad or no gaze.
    """
    edited = review.apply_edits(frames.drop("final_primary_aoi"), edits)
    manual = F.col("edit_source") == "manual"
    out = review.changed_after_edits(edited).withColumn("label", F.col("final_label")).withColumn("aoi_hit_source", F.when(manual, "manual").otherwise(F.col("aoi_hit_source")))
    out = out.withColumn("aoi_transition", F.col("is_transition")).drop("is_transition", "final_label")
    if quads is None:
        return out
    corners = [F.col(c) for c in QUAD]
    places = quads.where(valid_quad(corners)).select("recording", "frame_idx", F.col("surface").alias("label"), *QUAD)
    # Only edited frames meet their quad.
    met = out.where(manual & F.col("x_px").isNotNull() & F.col("y_px").isNotNull()).join(places, ["recording", "frame_idx", "label"])
    placed = on_unit_square(met, corners, F.col("x_px"), F.col("y_px"), "__uv").select("recording", "frame_idx", "__uv")
    both = out.join(placed, ["recording", "frame_idx"], "left")
    for c in ("u", "v"):
        inside = F.bround(F.least(F.greatest(F.col(f"__uv.{c}"), F.lit(0.0)), F.lit(1.0)), 5)
        both = both.withColumn(c, F.when(manual & (F.col("label") == NO_AOI), F.lit(None)).when(F.col(f"__uv.{c}").isNotNull(), inside).otherwise(F.col(c)))
    return both.drop("__uv")


def create(root: str, frames: DataFrame) -> None:
    """A new store of ``frames`` with their summaries; aoi_transition is a boolean in all partitions, edited or not."""
    marked = review.changed_after_edits(frames.drop("aoi_transition", "final_primary_aoi").withColumn("final_label", F.col("label")))
    frames = marked.withColumnRenamed("is_transition", "aoi_transition").drop("final_label")
    if "edit_source" not in frames.columns:
        frames = frames.withColumn("edit_source", F.lit("auto"))
    frames.write.partitionBy(KEY).parquet(f"{root}/frames")
    for name, summary in SUMMARIES.items():
        summary(frames).write.partitionBy(KEY).parquet(f"{root}/{name}")


def save(spark: SparkSession, root: str, edits: DataFrame, quads: DataFrame | None = None, summaries: bool = True) -> None:
    """Write ``edits`` (recording, start_frame, end_frame, label, seq) into the store's frames and, if asked, its summaries."""
    recovered(spark, root)
    folder = staged(spark, root, edits, quads, summaries)
    publish(spark, root, folder)


def staged(spark: SparkSession, root: str, edits: DataFrame, quads: DataFrame | None = None, summaries: bool = True) -> str:
    """Write the new partitions of the touched recordings beside the store; what is incomplete goes, and the error shows."""
    folder = f"{root}/{STAGED}{uuid.uuid4().hex}"
    try:
        touched = edits.select(KEY).distinct()
        before = spark.read.parquet(f"{root}/frames").join(touched, KEY, "left_semi")
        corrected(before, edits, quads).select(before.columns).write.partitionBy(KEY).parquet(f"{folder}/frames")
        if summaries:
            after = spark.read.parquet(f"{folder}/frames")
            for name, summary in SUMMARIES.items():
                summary(after).write.partitionBy(KEY).parquet(f"{folder}/{name}")
        _files(spark, folder)[0].create(_path(spark, f"{folder}/{READY}")).close()
    except BaseException:
        _remove(spark, folder)
        raise
    return folder


def crop(spark: SparkSession, root: str, bounds: DataFrame) -> None:
    """Cut the stored recordings down to their bounds (recording, from_frame, to_frame), for good.

    Frames outside go, so do fixations that touch no frame inside; those that reach beyond stay as they are. The other
    summaries are recomputed. A recording that has nothing left in a table has no partition there any more.
    """
    recovered(spark, root)
    folder = f"{root}/{STAGED}{uuid.uuid4().hex}"
    touched = bounds.select(KEY).distinct()
    stored = lambda name: spark.read.parquet(f"{root}/{name}").join(touched, KEY, "left_semi")
    try:
        before = stored("frames")
        editlog.cropped(before, bounds).select(before.columns).write.partitionBy(KEY).parquet(f"{folder}/frames")
        left = spark.read.schema(before.schema).parquet(f"{folder}/frames")
        for name, summary in SUMMARIES.items():
            spans = name == "fixation_summary"
            new = editlog.cropped(stored(name), bounds, "start_frame", "end_frame") if spans else summary(left)
            new.write.partitionBy(KEY).parquet(f"{folder}/{name}")
        for name in ["frames", *SUMMARIES]:
            rest = spark.read.schema(stored(name).schema).parquet(f"{folder}/{name}").select(KEY).distinct()
            touched.join(rest, KEY, "left_anti").select(F.lit(name).alias("table"), F.col(KEY).cast("string").alias(KEY)).write.mode("append").parquet(f"{folder}/{GONE}")
        _files(spark, folder)[0].create(_path(spark, f"{folder}/{READY}")).close()
    except BaseException:
        _remove(spark, folder)
        raise
    publish(spark, root, folder)


def publish(spark: SparkSession, root: str, folder: str) -> None:
    """Replace the store's partitions by the staged ones and delete those that are gone; may be repeated."""
    listed = _files(spark, folder)[1]
    if GONE in listed:
        escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for row in spark.read.parquet(f"{folder}/{GONE}").collect():  # recordings that a crop emptied
            _remove(spark, f"{root}/{row['table']}/{KEY}={escape(row[KEY])}")
    for name in sorted(x for x in listed if not x.startswith("_")):
        if not any(x.startswith(f"{KEY}=") for x in _files(spark, f"{folder}/{name}")[1]):
            continue
        spark.read.parquet(f"{folder}/{name}").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY).parquet(f"{root}/{name}")
    _remove(spark, folder)


def recovered(spark: SparkSession, root: str) -> list[str]:
    """Complete the saves that were ready, undo the others; the names of the completed ones."""
    done = []
    for name in sorted(x for x in _files(spark, root)[1] if x.startswith(STAGED)):
        folder = f"{root}/{name}"
        if READY in _files(spark, folder)[1]:
            publish(spark, root, folder)
            done.append(name)
        else:
            _remove(spark, folder)
    return done


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, folder: str):
    """The folder's file system and the names in it (few: tables and staged saves)."""
    path = _path(spark, folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []


def _remove(spark: SparkSession, folder: str) -> None:
    path = _path(spark, folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
