"""What the corpus operators share: table access, bounded Arrow batches, shared checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch that a Python worker holds; whole texts pass, so the count bounds its memory.
BATCH_ROWS = 512
_CLEANUP, _WHOLE_STAGE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.codegen.wholeStage"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where none is set and Spark runs in one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[\d*, ]+\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for the actions within."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, long_condition: bool = False) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; smaller than a checkpoint. What was shuffled for it goes.

    ``long_condition``: the plan's time goes into a join condition too long for the JVM to compile as part of one
    method for the whole stage; Spark then makes a method of each part.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"), setting(spark, _WHOLE_STAGE, "false" if long_condition else spark.conf.get(_WHOLE_STAGE)):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing lazy reads any more."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            remove_folder(table.sparkSession, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, with all in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row, stored: file splits, and with them numbers made anew, depend on the cores alive."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """A stored table with a broadcast hint if it has at most ``rows`` rows; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def identity(doc: Column, text: Column, names: tuple[str, str] = ("t1", "t2")) -> list[Column]:
    """Two 64-bit hashes of id and text, by which a row is known in whatever way the input is split into tasks."""
    return [F.xxhash64(F.lit(seed), F.isnull(doc), doc, F.isnull(text), text).alias(name) for seed, name in enumerate(names)]


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and their hashes t1, t2."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc.alias("doc_id"), text.alias("text"), *identity(doc, text))


#: A key that this many rows of a sample of one in SAMPLE have is dealt to SALTS tasks.
SAMPLE, COMMON, SALTS = 64, 20, 64


def beside(rows: DataFrame, sampled: DataFrame, key: str, name: str, order: str, many: int | None = None) -> DataFrame:
    """``rows`` with those next to each in the ``order`` of its key: below, above (their order), near (the name of the one below), common, only (just one other row has the key).
    With ``many`` also whether as many rows stand on one side of a row, or its key is common.

    ``sampled`` are the rows of one in SAMPLE names. Keys that it shows to be very common are dealt to several tasks,
    and their rows see the neighbours in their task only; the sample decides nothing else.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = sampled.groupBy(key).count().where(F.col("count") >= COMMON)
    # The limit bounds the broadcast; a common key beyond it is only not dealt to several tasks.
    common = stored(counted.orderBy(F.desc("count")).limit(4 * parts).select(key, F.lit(True).alias("common")))
    dealt = rows.join(F.broadcast(common), key, "left").withColumn("common", F.coalesce("common", F.lit(False)))
    dealt = dealt.withColumn("salt", F.when(F.col("common"), F.pmod(F.xxhash64(name), F.lit(SALTS))).otherwise(0))
    by = Window.partitionBy(key, "salt").orderBy(order)
    below, above = F.lag(order).over(by), F.lead(order).over(by)
    alone = F.lag(order, 2).over(by).isNull() & F.lead(order, 2).over(by).isNull() & (below.isNull() | above.isNull())
    large = [] if many is None else [(F.col("common") | F.lag(name, many).over(by).isNotNull() | F.lead(name, many).over(by).isNotNull()).alias("many")]
    return dealt.select(*rows.columns, "common", *large, below.alias("below"), above.alias("above"), F.lag(name).over(by).alias("near"), (alone & ~F.col("common")).alias("only"))


def one_in_sample(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(name), F.lit(SAMPLE)) == 0)


def id_remainder(column, modulus: int):
    """crc32 of an id's decimal text modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(column.cast("string")), F.lit(modulus))


def hashed_words(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, stable between processes."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(w) for w in words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing of each value (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        v = values.astype(np.uint64, copy=True)
        for factor in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)):
            v ^= v >> np.uint64(32)
            v *= factor
        return v ^ (v >> np.uint64(29))
