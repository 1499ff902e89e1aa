"""Time alignment: as-of joins, point-in-interval joins and recent-fixation windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import around, running

#: Microseconds of a chunk of one recording's time line.
TIME_CHUNK = 600_000_000


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], direction: str = "nearest", chunk: int = TIME_CHUNK) -> DataFrame:
    """``left`` with the matching row's ``values`` and its time as ``{on}_right``; nulls where nothing matches.

    backward: the latest right row at or before; forward: the earliest at or after; nearest: the closer of both, the
    earlier one of two equally close. Rows of both sides are ordered once by key and time; no range join is made.
    """
    if direction == "nearest":
        return _nearest(left, right, keys, on, values, chunk)
    out = _asof(left, right, keys, on, values, "__m_", ahead=direction == "forward", chunk=chunk)
    return out.select(*left.columns, *[F.col(f"__m_{v}").alias(v) for v in values], F.col(f"__m_{on}").alias(f"{on}_right"))


def _nearest(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], chunk: int) -> DataFrame:
    """Both sides put together and ordered once; each left row takes the closer of the matches before and after it."""
    rest = [c for c in left.columns if c not in keys and c != on]
    sides = [F.struct(F.col(on), *[F.col(f"__{side}.{v}").alias(v) for v in values]).alias(f"__{side}") for side in ("b", "f")]
    one = right.where(F.col(on).isNotNull()).groupBy(*keys, on).agg(F.max(F.struct(*values)).alias("__b"), F.min(F.struct(*values)).alias("__f"))
    u = left.select(*keys, on, F.struct(*rest, F.lit(True).alias("__left")).alias("__l")).unionByName(one.select(*keys, on, *sides), allowMissingColumns=True)
    u = around(u, keys, on, F.col("__b"), F.col("__f"), ("__before", "__after"), F.col("__l").isNotNull(), chunk).where(F.col("__l").isNotNull())
    back, fore = F.col(f"__before.{on}"), F.col(f"__after.{on}")
    earlier = back.isNotNull() & (fore.isNull() | (F.col(on) - back <= fore - F.col(on)))
    hit = F.when(earlier, F.col("__before")).otherwise(F.col("__after"))
    own = [F.col(c) if c in keys or c == on else F.col(f"__l.{c}").alias(c) for c in left.columns]
    return u.withColumn("__hit", hit).select(*own, *[F.col(f"__hit.{v}").alias(v) for v in values], F.col(f"__hit.{on}").alias(f"{on}_right"))


def _asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], prefix: str, ahead: bool, chunk: int) -> DataFrame:
    rest = [c for c in left.columns if c not in keys and c != on]
    match = F.struct(F.col(on), *map(F.col, values)).alias("__m")
    # Of right rows at one time the last values in order win backward, the first forward.
    one = right.where(F.col(on).isNotNull()).groupBy(*keys, on).agg((F.min if ahead else F.max)(F.struct(*values)).alias("__r"))
    one = one.select(*keys, on, *[F.col(f"__r.{v}").alias(v) for v in values])
    u = left.select(*keys, on, F.struct(*rest, F.lit(True).alias("__left")).alias("__l")).unionByName(one.select(*keys, on, match), allowMissingColumns=True)
    u = running(u, keys, on, F.col("__m"), "__hit", "last", size=chunk, tie=[F.col("__l").isNotNull().asc()], ahead=ahead)
    hit = [F.col(f"__hit.{c}").alias(f"{prefix}{c}") for c in [on, *values]]
    return u.where(F.col("__l").isNotNull()).select(*[F.col(c) if c in keys or c == on else F.col(f"__l.{c}").alias(c) for c in left.columns], *hit)


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], on: str, id_col: str, start: str, stop: str, values: list[str] | None = None, chunk: int = TIME_CHUNK) -> DataFrame:
    """``points`` with the interval [start, stop] that holds each, at most one, as a pointer over the intervals in order finds it.

    The pointer moves on while an interval has stopped, so a point meets the first interval whose running maximum of
    stop reaches it, and is inside if that interval has begun. This is a forward as-of join on the running maximum.
    """
    carried = [id_col, start, stop, *(values or [])]
    topped = running(intervals, keys, id_col, F.col(stop), on, "max")
    first = topped.groupBy(*keys, on).agg(F.min_by(F.struct(*carried), id_col).alias("__i")).select(*keys, on, *[F.col(f"__i.{c}").alias(c) for c in carried])
    out = asof_join(points, first, keys, on, carried, "forward", chunk)
    inside = F.col(start) <= F.col(on)
    return out.select(*points.columns, *[F.when(inside, F.col(c)).alias(c) for c in carried])


def recent_fixations(points: DataFrame, fixations: DataFrame, keys: list[str], on: str, horizon: int, most: int = 7) -> DataFrame:
    """For each point its last ``most`` fixations that stopped within ``horizon``, and the active one (start <= t < stop).

    Points and fixations meet by time bucket of ``horizon``, two buckets for each fixation's stop, so no bucket pairs a
    whole recording; active fixations are taken from the buckets that they touch.
    """
    bucket = lambda c: F.floor(c / horizon).cast("long")
    p = points.withColumn("__b", bucket(F.col(on)))
    spans = fixations.withColumn("__b", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("stop")) + 1)))
    t = F.col(on)
    ended = (F.col("stop") <= t) & (F.col("stop") >= t - horizon)
    active = (F.col("start") <= t) & (t < F.col("stop"))
    met = p.join(spans, [*keys, "__b"]).where(ended | active).withColumn("is_active", active)
    order = Window.partitionBy(*keys, on).orderBy(F.col("is_active").asc(), F.desc("stop"), F.desc("fixation_id"))
    ranked = met.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("is_active") | (F.col("rank") <= most)).drop("__b")


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], on: str, start: str, stop: str, width: int) -> DataFrame:
    """Points with every range start <= point <= stop of their key, met by buckets of ``width``; ranges may overlap."""
    bucket = lambda c: F.floor(c / width).cast("long")
    spans = ranges.where(F.col(start) <= F.col(stop)).withColumn("__b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(stop)))))
    met = points.withColumn("__b", bucket(F.col(on))).join(spans, [*keys, "__b"])
    return met.where(F.col(on).between(F.col(start), F.col(stop))).drop("__b")
