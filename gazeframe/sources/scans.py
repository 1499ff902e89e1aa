"""Typed scans of recordings' frame files whose headers differ: one for each header, with the asked columns alone.

The headers are found by one scan of plain lines, without taking the lines apart. Files with one header then are one CSV
scan with its schema in the header's order, so the reader parses only the columns that a query asks for and takes the
filters along. The scans meet by column name; what a header lacks is null. The driver holds the list of the files,
as Spark's own reader does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ANALYSIS, no_nans
from .readers import FINAL_FIRST, _candidates, _path, _text

TYPES = dict(f.strip().split(" ", 1) for f in ANALYSIS.split(","))


def _type(name: str) -> str:
    return TYPES.get(name) or ("boolean" if name.endswith("_hit") else "int" if name.endswith("_visits") else "string")


def header_groups(spark: SparkSession, source: str, order: tuple[str, ...] = FINAL_FIRST, name: str = "analysis.csv") -> list[tuple[str, list[str]]]:
    """Header lines with the files that have them: of each recording its first candidate that isn't blank."""
    lines = _text(spark, f"{source}/*/{{{','.join(order)}}}/{name}", path=F.col("_metadata.file_path")).where(F.length(F.trim("value")) > 0)
    header = F.regexp_like(F.regexp_replace("value", "^\\uFEFF", ""), F.lit("(^|,)frame_idx(,|$)"))
    files = lines.groupBy(F.col("__path").alias("file")).agg(F.max(F.when(header, F.regexp_replace("value", "^\\uFEFF", ""))).alias("header"))
    placed = _candidates(files.withColumn("__path", _path("file")), order, name)
    best = placed.groupBy("recording").agg(F.min_by(F.struct("header", "file"), "place").alias("x"))
    grouped = best.where("x.header IS NOT NULL").groupBy(F.trim("x.header").alias("header")).agg(F.array_sort(F.collect_list("x.file")).alias("files")).orderBy("header")
    return [(r["header"], r["files"]) for r in grouped.collect()]


def frame_scan(spark: SparkSession, source: str, columns: list[str] | None = None, order: tuple[str, ...] = FINAL_FIRST, name: str = "analysis.csv") -> DataFrame:
    """recording and ``columns`` (all known ones by default) of every recording's frames; no file gives an empty table."""
    asked = columns or list(TYPES)
    parts = []
    for header, files in header_groups(spark, source, order, name):
        names = [c.strip() for c in header.split(",")]
        schema = ", ".join(f"`{c}` {_type(c)}" for c in names)
        read = spark.read.schema(schema).option("header", True).option("nanValue", "nan").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(files)
        shown = _candidates(read.withColumn("__path", _path()), order, name)
        parts.append(shown.select("recording", *[F.col(f"`{c}`") if c in names else F.lit(None).cast(_type(c)).alias(c) for c in asked]))
    if not parts:
        return spark.createDataFrame([], "recording string, " + ", ".join(f"`{c}` {_type(c)}" for c in asked))
    return no_nans(reduce(DataFrame.unionByName, parts))
