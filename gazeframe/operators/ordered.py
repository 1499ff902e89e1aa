"""Running values over ordered rows of a key, safe for keys of any length.

A window over a whole recording puts all its rows into one task. Here the rows of a key are cut into chunks of the
order column; a window runs inside each chunk, and one summary row for each chunk carries the value over. The rows are
shuffled once, by key and chunk; only the summaries meet by key alone.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order units (frames) of a chunk.
CHUNK = 50_000


def _chunk(order: str, size: int) -> Column:
    return F.floor(F.col(order) / size).cast("long")


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the folder of ``spark.checkpoint.dir``; a temporary one only where none is set and Spark runs in one process.

    Each running value joins a table with a summary of itself, so a long chain of them doubles its plan at each step,
    and what several branches read is worked out by each. Later steps read only the columns that they need.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, keys: list[str], order: str, position: str, first: str, size: int = CHUNK) -> DataFrame:
    """``position``: the row's place in its key, from 0; ``first``: the key's least ``order``. One join gives both."""
    cut = df.withColumn("__chunk", _chunk(order, size))
    over_chunks = Window.partitionBy(*keys)
    before = over_chunks.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*keys, "__chunk").agg(F.count("*").alias("__n"), F.min(order).alias("__least"))
    parts = parts.select(*keys, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.min("__least").over(over_chunks).alias(first))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order)
    return cut.join(parts, [*keys, "__chunk"]).withColumn(position, F.col("__start") + F.row_number().over(inside) - 1).drop("__chunk", "__start")


def trailing(df: DataFrame, keys: list[str], order: str, value: Column, name: str, count: int, size: int = CHUNK) -> DataFrame:
    """``name``: an array of ``value`` of up to ``count`` rows before, in order. A chunk hands its last ``count`` values on."""
    cut = df.withColumn("__chunk", _chunk(order, size)).withColumn("__v", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "__chunk")
    last = cut.withColumn("__r", F.row_number().over(inside.orderBy(F.desc(order)))).where(F.col("__r") <= count)
    tails = last.groupBy(*keys, "__chunk").agg(F.sort_array(F.collect_list(F.struct(-F.col("__r"), "__v"))).alias("__tail"))
    # Each chunk has a row at least, so as many chunks as values are enough.
    chunks = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(-count, -1)
    tails = tails.select(*keys, "__chunk", F.flatten(F.collect_list("__tail.__v").over(chunks)).alias("__carried"))
    here = F.collect_list("__v").over(inside.orderBy(order).rowsBetween(-count, -1))
    out = cut.join(tails, [*keys, "__chunk"]).withColumn("__all", F.concat("__carried", here))
    return out.withColumn(name, F.transform(F.slice("__all", F.greatest(F.size("__all") - count + 1, F.lit(1)), F.lit(count)), lambda x: x["v"])).drop("__chunk", "__v", "__carried", "__all")


def around(df: DataFrame, keys: list[str], order: str, before: Column, after: Column, names: tuple[str, str], tie: Column, size: int = CHUNK) -> DataFrame:
    """The last non-null ``before`` up to the row and the first non-null ``after`` from it on; one join gives both.

    Of rows at one place those without ``tie`` count as before and as after those with it.
    """
    cut = df.withColumn("__chunk", _chunk(order, size)).withColumn("__b", before).withColumn("__a", after)
    parts = cut.groupBy(*keys, "__chunk").agg(F.max_by("__b", F.when(F.col("__b").isNotNull(), F.col(order))).alias("__last"), F.min_by("__a", F.when(F.col("__a").isNotNull(), F.col(order))).alias("__next"))
    chunks = Window.partitionBy(*keys).orderBy("__chunk")
    earlier = F.last("__last", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("__next", ignorenulls=True).over(chunks.rowsBetween(1, Window.unboundedFollowing))
    parts = parts.select(*keys, "__chunk", earlier.alias("__earlier"), later.alias("__later"))
    inside = Window.partitionBy(*keys, "__chunk")
    upto = F.last("__b", ignorenulls=True).over(inside.orderBy(F.col(order), tie.asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    since = F.last("__a", ignorenulls=True).over(inside.orderBy(F.col(order).desc(), tie.asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = cut.join(parts, [*keys, "__chunk"]).withColumn(names[0], F.coalesce(upto, "__earlier")).withColumn(names[1], F.coalesce(since, "__later"))
    return out.drop("__chunk", "__b", "__a", "__earlier", "__later")


def lagged(df: DataFrame, keys: list[str], order: str, value: Column, name: str, default: Column | None = None, size: int = CHUNK, ahead: bool = False) -> DataFrame:
    """``name``: ``value`` of the row before (after, with ``ahead``) in its key; ``default`` for the first (last)."""
    default = F.lit(None) if default is None else default
    cut = df.withColumn("__chunk", _chunk(order, size)).withColumn("__v", F.struct(value.alias("v")))
    edge = F.min_by if ahead else F.max_by
    over_chunks = Window.partitionBy(*keys).orderBy(F.desc("__chunk") if ahead else F.asc("__chunk"))
    edges = cut.groupBy(*keys, "__chunk").agg(edge("__v", order).alias("__edge")).withColumn("__carried", F.lag("__edge").over(over_chunks)).drop("__edge")
    inside = Window.partitionBy(*keys, "__chunk").orderBy(F.desc(order) if ahead else F.asc(order))
    out = cut.join(edges, [*keys, "__chunk"]).withColumn("__p", F.coalesce(F.lag("__v").over(inside), F.col("__carried")))
    return out.withColumn(name, F.when(F.col("__p").isNotNull(), F.col("__p.v")).otherwise(default)).drop("__chunk", "__v", "__p", "__carried")


def running(df: DataFrame, keys: list[str], order: str, value: Column, name: str, how: str = "sum", size: int = CHUNK, tie: list[Column] | None = None, ahead: bool = False) -> DataFrame:
    """``name``: running ``sum``, ``max`` or ``last`` (last non-null) of ``value`` up to and with the row; ``ahead`` runs from the end.

    ``tie`` orders rows of one place; of equal places of ``last`` values, any is carried on to later chunks, so make them unique.
    """
    total = {"sum": F.sum, "max": F.max}.get(how)
    turn = (lambda c: c.desc()) if ahead else (lambda c: c.asc())
    cut = df.withColumn("__chunk", _chunk(order, size)).withColumn("__v", value)
    inside = Window.partitionBy(*keys, "__chunk").orderBy(turn(F.col(order)), *(tie or [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(turn(F.col("__chunk"))).rowsBetween(Window.unboundedPreceding, -1)
    if how == "last":
        edge = (F.min_by if ahead else F.max_by)("__v", F.when(F.col("__v").isNotNull(), F.col(order)))
        parts = cut.groupBy(*keys, "__chunk").agg(edge.alias("__edge")).withColumn("__carried", F.last("__edge", ignorenulls=True).over(before)).drop("__edge")
        out = cut.join(parts, [*keys, "__chunk"]).withColumn(name, F.coalesce(F.last("__v", ignorenulls=True).over(inside), F.col("__carried")))
        return out.drop("__chunk", "__v", "__carried")
    parts = cut.groupBy(*keys, "__chunk").agg(total("__v").alias("__edge")).withColumn("__carried", total("__edge").over(before)).drop("__edge")
    out = cut.join(parts, [*keys, "__chunk"])
    here, carried = total("__v").over(inside), F.col("__carried")
    merged = F.greatest(here, carried) if how == "max" else F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return out.withColumn(name, merged).drop("__chunk", "__v", "__carried")
