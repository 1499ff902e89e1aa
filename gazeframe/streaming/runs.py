"""Runs over new recordings: broken files apart, progress, and only the newest run's results shown.

A run takes up the recordings that no earlier run has finished, all in one job. A file with a line that doesn't fit the
schema is set aside whole, with its first such line and the reason; the others go on. What the run read is observed while
it is written and becomes its progress row.

Every run has a generation, a number that no other run has. Results are staged and then published under it; readers take
the newest published generation of each recording, and a run that finds a newer one begun discards what it has made.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BAD = "__bad"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    system, at = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def _claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file that wasn't there; false if another process was first."""
    system, at = _fs(spark, path)
    return system.createNewFile(at)


# Generations


def begin(spark: SparkSession, root: str) -> int:
    """A generation later than all begun before; of processes that race, each has its own."""
    while True:
        number = newest(spark, root) + 1
        if _claim(spark, f"{root}/begun/{number:09d}"):
            return number


def newest(spark: SparkSession, root: str) -> int:
    """The latest generation that was begun, 0 for none."""
    return max((int(n) for n in _names(spark, f"{root}/begun") if n.isdigit()), default=0)


def publish(spark: SparkSession, root: str, generation: int, staged: str) -> bool:
    """Show the staged results under their generation; false, and they go, if a later generation has begun meanwhile."""
    system, at = _fs(spark, staged)
    if newest(spark, root) != generation:
        system.delete(at, True)
        return False
    target = _fs(spark, f"{root}/results/generation={generation}")[1]
    system.mkdirs(target.getParent())
    return system.rename(at, target)


def results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Of each recording the rows of its newest published generation; an empty table before the first run."""
    full = f"{schema}, recording string, generation int"
    if not _names(spark, f"{root}/results"):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(f"{root}/results")
    last = rows.groupBy("recording").agg(F.max("generation").alias("generation"))
    return rows.join(last, ["recording", "generation"], "left_semi")


# A run


def pending(spark: SparkSession, source: str, root: str) -> list[str]:
    """Recordings (folders of ``source``) that neither a published run has finished nor is set aside."""
    done = {n.partition("=")[2] for g in _names(spark, f"{root}/results") for n in _names(spark, f"{root}/results/{g}") if n.startswith("recording=")}
    aside = {r["recording"] for r in quarantined(spark, root).select("recording").distinct().collect()}
    return [n for n in _names(spark, source) if n not in done | aside]


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    """recording, path, line, reason and generation of the files that were set aside."""
    schema = "recording string, path string, line string, reason string, generation int"
    return spark.read.schema(schema).parquet(f"{root}/quarantine") if _names(spark, f"{root}/quarantine") else spark.createDataFrame([], schema)


def progress(spark: SparkSession, root: str) -> DataFrame:
    """generation, status, recordings, rows and bad_rows of every run."""
    schema = "generation int, status string, recordings long, rows long, bad_rows long"
    return spark.read.schema(schema).parquet(f"{root}/progress") if _names(spark, f"{root}/progress") else spark.createDataFrame([], schema)


def run(spark: SparkSession, source: str, root: str, schema: str, analyse, name: str = "frames.csv") -> int:
    """Take up what is pending in ``source``/<recording>/``name`` and publish ``analyse(rows)``, which keeps recording; the run's generation.

    ``schema`` is that of the files; ``analyse`` turns their rows (with recording) into the results.
    """
    generation = begin(spark, root)
    todo = [f"{source}/{n}/{name}" for n in pending(spark, source, root)]
    found = [p for p in todo if _fs(spark, p)[0].exists(_fs(spark, p)[1])]
    if not found:
        _note(spark, root, generation, "nothing to do", 0, 0, 0)
        return generation
    read = spark.read.schema(f"{schema}, {BAD} string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).csv(found)
    path = F.col("_metadata.file_path")
    rows = read.select("*", path.alias("path"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("recording"))
    # The parsed rows are written once; whole files are then taken or set aside.
    parsed = f"{root}/work/{uuid.uuid4().hex}"
    seen = Observation(f"run {generation}")
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(BAD).isNotNull(), 1)).alias("bad_rows"))
    counted.write.parquet(f"{parsed}/rows")
    kept = spark.read.schema(counted.schema).parquet(f"{parsed}/rows")
    broken = kept.where(F.col(BAD).isNotNull()).groupBy("recording", "path").agg(F.min(BAD).alias("line"))
    broken.select("recording", "path", "line", F.lit("line does not fit the schema").alias("reason"), F.lit(generation).alias("generation")).write.mode("append").parquet(f"{root}/quarantine")
    good = kept.join(broken.select("path"), "path", "left_anti").drop("path", BAD)
    analyse(good).write.partitionBy("recording").parquet(f"{parsed}/out")
    shown = publish(spark, root, generation, f"{parsed}/out")
    system, at = _fs(spark, parsed)
    system.delete(at, True)
    _note(spark, root, generation, "done" if shown else "discarded", len(found), seen.get["rows"], seen.get["bad_rows"])
    return generation


def _note(spark: SparkSession, root: str, generation: int, status: str, recordings: int, rows: int, bad: int) -> None:
    row = [(generation, status, recordings, rows, bad)]
    spark.createDataFrame(row, "generation int, status string, recordings long, rows long, bad_rows long").coalesce(1).write.mode("append").parquet(f"{root}/progress")
