"""Recordings and their side files as DataFrames.

A source folder holds one folder for each recording, marked by an ``info.json``. All files of one kind are read by one
scan with a path pattern, and the recording's name comes from the path, so a folder of any size is one Spark job and
may lie in any store that Spark reads. Of a recording's candidate files the one that stands first in ``order`` counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import difficulty_of
from ..schema import ANALYSIS, ERROR_JSON, QUALITY_JSON, TASK_JSON, TRIM_JSON, no_nans

#: Fixed folder names that hold results, never recordings.
OUTPUT_PARTS = ["aoi_results", "raw", "aoi_master", "aoi_comparison"]
#: Places of a recording's files below its folder.
FINAL, RAW = "aoi_results", "aoi_results/raw"
FINAL_FIRST, RAW_FIRST, FINAL_ONLY = (FINAL, RAW), (RAW, FINAL), (FINAL,)
RECORDING_NAME = r"^\d{4}-(\d{2}-){4}\d{2}$"


def _path(uri: str = "_metadata.file_path") -> Column:
    return F.regexp_replace(F.url_decode(F.col(uri)), r"^[a-z]+:/+", "/")


def _any(spark: SparkSession, pattern: str) -> bool:
    """Whether a file matches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _text(spark: SparkSession, pattern: str, path: Column | None = None, **how) -> DataFrame:
    """value and __path of the lines (or whole texts) of the files that match, none of which need be there."""
    if not _any(spark, pattern):
        return spark.createDataFrame([], "value string, __path string")
    return spark.read.text(pattern, **how).select("value", (_path() if path is None else path).alias("__path"))


def recording_dirs(spark: SparkSession, source: str, named: bool = False) -> DataFrame:
    """recording, path, difficulty, source of the folders below ``source`` with an info.json, output and hidden folders left out.

    ``named``: only folders named by date and time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "info.json").load(source)
    parts = F.split(F.regexp_replace(_path(), "/info.json$", ""), "/")
    out = files.select(F.array_join(parts, "/").alias("path"), F.element_at(parts, -1).alias("recording"), F.lit(source.rstrip("/")).alias("source"))
    below = F.split(F.expr("substring(path, length(source) + 1)"), "/")
    out = out.where(~F.exists(below, lambda p: p.isin(OUTPUT_PARTS) | p.startswith(".")))
    out = out.where(F.regexp_like("recording", F.lit(RECORDING_NAME))) if named else out
    return out.select("recording", "path", difficulty_of(F.col("path"), F.col("source")).alias("difficulty"), "source").orderBy("path")


def distinct_sources(folders: DataFrame) -> DataFrame:
    """Folders (path, pos) once for each path, in order of first sight."""
    first = Window.partitionBy("path").orderBy("pos")
    return folders.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").orderBy("pos")


def _candidates(df: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """recording and place (its rank in ``order``) from the file's path; files elsewhere are left out."""
    place = F.coalesce(*[F.when(F.endswith(F.col("__path"), F.lit(f"/{p}/{name}")), F.lit(i)) for i, p in enumerate(order)])
    rec = F.coalesce(*[F.when(F.endswith(F.col("__path"), F.lit(f"/{p}/{name}")), F.element_at(F.split(F.regexp_replace("__path", f"/{p}/{name}$", ""), "/"), -1)) for p in order])
    return df.withColumn("place", place).withColumn("recording", rec).where(F.col("place").isNotNull())


def _first_place(df: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """The rows of each recording's best candidate file that has rows."""
    placed = _candidates(df, order, name)
    best = placed.groupBy("recording").agg(F.min("place").alias("__best"))
    return placed.join(best, "recording").where(F.col("place") == F.col("__best")).drop("place", "__best", "__path")


def frame_table(spark: SparkSession, source: str, order: tuple[str, ...] = FINAL_FIRST, name: str = "analysis.csv") -> DataFrame:
    """Frame rows of every recording from its first non-empty candidate, NaN as null, with ``final_primary_aoi`` where reviewed.

    Files differ in their columns, so values are read by name: a file's header decides what its columns mean.
    """
    raw = _text(spark, f"{source}/*/{{{','.join(order)}}}/{name}")
    lines = _first_place(raw.where(F.length(F.trim("value")) > 0), order, name)
    lines = lines.withColumn("value", F.regexp_replace("value", "^\\uFEFF", ""))
    is_header = F.regexp_like("value", F.lit("(^|,)frame_idx(,|$)"))
    heads = lines.where(is_header).select("recording", F.split("value", ",").alias("__names"))
    cells = lines.where(~is_header).join(heads, "recording")
    pairs = cells.withColumn("__cells", F.map_from_arrays("__names", F.transform(F.split("value", ",", -1), lambda x: F.trim(x))))
    get = lambda c, t: F.nullif(F.try_element_at("__cells", F.lit(c)), F.lit("")).try_cast(t).alias(c)
    fields = [f.strip().split(" ") for f in ANALYSIS.split(",")]
    extra = [get(c, "string") for c in ("final_primary_aoi", "edit_source", "markers_detected", "aoi_transition")]
    reviewed = F.array_contains("__names", "final_primary_aoi").alias("has_final")
    other = F.map_filter("__cells", lambda k, v: F.endswith(k, F.lit("_hit")) & (k != "any_aoi_hit"))
    areas = F.transform_keys(other, lambda k, v: F.regexp_replace(k, "_hit$", ""))
    hits = F.transform_values(areas, lambda k, v: F.lower(v) == "true").alias("hits")
    return no_nans(pairs.select("recording", *[get(c, t) for c, t in fields], *extra, reviewed, hits))


def fixation_table(spark: SparkSession, source: str, order: tuple[str, ...] = RAW_FIRST) -> DataFrame:
    """Fixation summaries, the raw file first."""
    schema = "fixation_id int, start_frame int, end_frame int, start_time_s double, end_time_s double, duration_s double, dominant_aoi string, centroid_x double, centroid_y double"
    pattern = f"{source}/*/{{{','.join(order)}}}/fixation_summary.csv"
    if not _any(spark, pattern):
        return spark.createDataFrame([], f"{schema}, recording string")
    df = spark.read.schema(schema).option("header", True).option("nanValue", "nan").csv(pattern)
    return no_nans(_first_place(df.withColumn("__path", _path()), order, "fixation_summary.csv"))


def _whole_json(spark: SparkSession, source: str, name: str, order: tuple[str, ...], schema: str) -> DataFrame:
    text = _text(spark, f"{source}/*/{{{','.join(order)}}}/{name}", wholetext=True)
    first = _first_place(text.withColumn("value", F.regexp_replace("value", "^\\uFEFF", "")), order, name)
    return first.select("recording", F.from_json("value", schema).alias("j"))


def task_table(spark: SparkSession, source: str, order: tuple[str, ...] = RAW_FIRST) -> DataFrame:
    """Task bounds; the order is raw first for reports and final first for dashboards. A broken file has no tasks."""
    j = _whole_json(spark, source, "tasks.json", order, TASK_JSON)
    return j.select("recording", F.explode("j").alias("task_name", "b")).where(F.col("b").isNotNull()).select("recording", "task_name", F.col("b.start").alias("start_frame"), F.col("b.end").alias("end_frame"))


def error_table(spark: SparkSession, source: str, order: tuple[str, ...] = RAW_FIRST) -> DataFrame:
    j = _whole_json(spark, source, "errors.json", order, ERROR_JSON)
    e = j.select("recording", F.explode("j").alias("task_name", "e")).select("recording", "task_name", "e.*")
    return e.na.fill(0)


def quality_table(spark: SparkSession, source: str, order: tuple[str, ...] = RAW_FIRST) -> DataFrame:
    return _whole_json(spark, source, "data_quality.json", order, QUALITY_JSON).select("recording", *[F.col(f"j.{c.split()[0]}") for c in QUALITY_JSON.split(", ")[1:]])


def trim_table(spark: SparkSession, source: str, order: tuple[str, ...] = RAW_FIRST) -> DataFrame:
    return _whole_json(spark, source, "trim.json", order, TRIM_JSON).select("recording", "j.*")


def aoi_tags(spark: SparkSession, path: str) -> DataFrame:
    """aoi, tag_id, pos of an area configuration file."""
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", "aois map<string,array<int>>").alias("j"))
    return j.select(F.explode("j.aois").alias("aoi", "tags")).select("aoi", F.posexplode("tags").alias("pos", "tag_id"))


def zones(spark: SparkSession, path: str) -> DataFrame:
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", "zones map<string,map<string,struct<x0:double,y0:double,x1:double,y1:double>>>").alias("j"))
    return j.select(F.explode("j.zones").alias("zone_group", "z")).select("zone_group", F.explode("z").alias("zone", "b")).select("zone_group", "zone", "b.*")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a mask configuration in any of its three layouts: ``surfaces``, ``regions`` or a bare list.

    Bounds count before points, points before a mask file; the default priority is 100 less the place in the list.
    """
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), F.regexp_replace(_path(), "/[^/]*$", "").alias("folder"))
    item = "struct<name:string,label:string,surface:string,priority:int,bounds:variant,points:array<array<double>>,path:string,file:string,mask:string>"
    by_surface = text.select("folder", F.explode(F.try_variant_get("v", "$.surfaces", "map<string,variant>")).alias("surface0", "s")).select("folder", "surface0", F.try_variant_get("s", "$.masks", f"array<{item}>").alias("items"))
    listed = text.select("folder", F.lit(None).cast("string").alias("surface0"), F.coalesce(F.try_variant_get("v", "$.regions", f"array<{item}>"), F.when(F.startswith(F.to_json("v"), F.lit("[")), F.try_variant_get("v", "$", f"array<{item}>"))).alias("items"))
    i = by_surface.unionByName(listed).select("folder", "surface0", F.posexplode("items").alias("idx", "i")).where(F.col("i").isNotNull())
    num = lambda p: F.try_variant_get("i.bounds", p, "double")
    bound = lambda k, n: F.coalesce(num(f"$.{k}"), num(f"$[{n}]"))
    bounds = F.struct(bound("u_min", 0).alias("u1"), bound("u_max", 1).alias("u2"), bound("v_min", 2).alias("v1"), bound("v_max", 3).alias("v2"))
    points = F.transform("i.points", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    file = F.coalesce(F.nullif("i.path", F.lit("")), F.nullif("i.file", F.lit("")), F.nullif("i.mask", F.lit("")))
    has_bounds, has_points = F.col("i.bounds").isNotNull(), F.col("i.points").isNotNull()
    kind = F.when(has_bounds, "bbox").when(has_points, "polygon").when(file.isNotNull(), "mask")
    out = i.select(
        F.trim(F.coalesce(F.nullif("i.name", F.lit("")), F.col("i.label"), F.lit(""))).alias("name"),
        F.trim(F.coalesce(F.nullif("i.surface", F.lit("")), F.col("surface0"), F.lit(""))).alias("surface"),
        kind.alias("kind"),
        F.coalesce("i.priority", 100 - F.col("idx")).cast("int").alias("priority"),
        F.when(has_bounds, bounds).alias("bounds"),
        F.when(~has_bounds & has_points, points).alias("points"),
        F.when(~has_bounds & ~has_points, F.when(F.startswith(file, F.lit("/")), file).otherwise(F.concat_ws("/", "folder", file))).alias("mask_path"),
    )
    fine = F.when(F.col("kind") == "bbox", F.forall(F.array("bounds.u1", "bounds.u2", "bounds.v1", "bounds.v2"), lambda x: x.isNotNull())).when(F.col("kind") == "polygon", F.size("points") >= 3).otherwise(F.col("kind").isNotNull())
    return out.where((F.col("name") != "") & (F.col("surface") != "") & fine)


def mask_rasters(spark: SparkSession, regions_df: DataFrame, base: str) -> DataFrame:
    """name, rows (strings of 0 and 1) of plain-text PBM masks below ``base``; other picture formats need an image reader."""
    files = spark.read.text(f"{base}/*.pbm", wholetext=True).select(F.element_at(F.split(_path(), "/"), -1).alias("file"), F.split(F.regexp_replace("value", r"(?m)^P1\s+\d+\s+\d+\s+", ""), r"\s*\n\s*").alias("rows"))
    named = regions_df.where("kind = 'mask'").select("name", F.element_at(F.split("mask_path", "/"), -1).alias("file"))
    return named.join(files, "file").select("name", F.filter("rows", lambda x: x != "").alias("rows"))
