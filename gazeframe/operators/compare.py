"""Comparing two conditions: rank tests, effect sizes, false-discovery correction, learning curves, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rank_test_p

SIGNIFICANT = 0.05


def rank_sums(values: DataFrame, by: list[str], group: str = "condition", a: str = "A") -> DataFrame:
    """n1, n2, u1 (U of sample ``a``) and tie_sum of each cell; ``values`` has one ``value`` for each member.

    Ranks are taken over distinct values: each value's count in either sample and the count below it are enough, so
    a cell's members never meet in one window, only its distinct values do.
    """
    clean = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = clean.groupBy(*by, "value").agg(F.count("*").alias("n"), F.count_if(F.col(group) == a).alias("na"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("rank", below + (F.col("n") + 1) / 2)
    n = F.col("n").cast("double")
    ties = n * n * n - n
    out = ranked.groupBy(*by).agg(F.sum("na").alias("n1"), F.sum(F.col("n") - F.col("na")).alias("n2"), F.sum(F.col("rank") * F.col("na")).alias("r1"), F.sum(ties).alias("tie_sum"))
    return out.withColumn("u1", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).drop("r1")


def rank_test(values: DataFrame, by: list[str], group: str = "condition", a: str = "A") -> DataFrame:
    """u1, p and effect = 1 - 2 U / (n1 n2); null where a sample has fewer than two members."""
    out = rank_sums(values, by, group, a)
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    effect = F.when(enough, 1 - 2 * F.col("u1") / (F.col("n1") * F.col("n2")))
    return out.withColumn("p", rank_test_p(F.col("u1"), F.col("n1"), F.col("n2"), F.col("tie_sum"))).withColumn("effect", effect)


def stat_rows(values: DataFrame, by: list[str], group: str = "condition", a: str = "A", b: str = "B") -> DataFrame:
    """Mean and deviation of both conditions (4 decimals, half to even; deviation 0 for one member), p (4), effect (3), significance of the unrounded p."""
    moments = values.groupBy(*by).agg(
        *[f for name, g in (("a", a), ("b", b)) for f in (
            F.bround(F.avg(F.when(F.col(group) == g, F.col("value"))), 4).alias(f"{name}_mean"),
            F.bround(F.coalesce(F.stddev_samp(F.when(F.col(group) == g, F.col("value"))), F.lit(0.0)), 4).alias(f"{name}_std"),
        )]
    )
    tests = rank_test(values, by, group, a)
    return moments.join(tests, by, "left").select(
        *by, "a_mean", "a_std", "b_mean", "b_std", F.bround("p", 4).alias("p_value"), F.bround("effect", 3).alias("effect_size"), F.coalesce(F.col("p") < SIGNIFICANT, F.lit(False)).alias("significant")
    )


def false_discovery(rows: DataFrame, within: list[str], p: str = "p_value") -> DataFrame:
    """Benjamini-Hochberg step-up over the rows of a family: p_raw kept, missing p counts as 1, corrected p in 4 decimals.

    A family is a fixed grid of tests, so its window stays small.
    """
    raw = F.coalesce(F.nanvl(F.col(p), F.lit(1.0)), F.lit(1.0))
    out = rows.withColumn("p_raw", F.col(p)).withColumn("__p", raw)
    family = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    out = out.withColumn("__rank", F.row_number().over(family.orderBy("__p"))).withColumn("__m", F.count("*").over(family))
    up = family.orderBy("__rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = out.withColumn("__q", F.least(F.lit(1.0), F.min(F.col("__p") * F.col("__m") / F.col("__rank")).over(up)))
    return out.withColumn(p, F.bround("__q", 4)).withColumn("significant", F.col("__q") < SIGNIFICANT).drop("__p", "__rank", "__m", "__q")


def zero_filled(values: DataFrame, recordings: DataFrame, labels: DataFrame, value: str) -> DataFrame:
    """recording, condition, label, value for every area of every recording; 0 where the recording never met it."""
    names = labels.select(F.collect_set("label").alias("names"))
    grid = recordings.select("recording", "condition").distinct().join(F.broadcast(names)).select("recording", "condition", F.explode("names").alias("label"))
    return grid.join(values.select("recording", "label", F.col(value).alias("value")), ["recording", "label"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


LEARNING_METRICS = ["duration_s", "aoi_transition_count", "aoi_entropy_bits", "task_focus_ratio"]


def learning_by_condition(metrics: DataFrame) -> DataFrame:
    """Mean, deviation (0 for one) and n of four metrics by task and condition; tasks without a number are left out."""
    long = metrics.where(F.col("task_index") != 0).select("task_index", "condition", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in LEARNING_METRICS])).alias("m"))
    return long.groupBy("task_index", "condition", F.col("m.metric").alias("metric")).agg(F.avg("m.value").alias("mean"), F.coalesce(F.stddev_samp("m.value"), F.lit(0.0)).alias("std"), F.count("m.value").alias("n"))


def linear_trend(points: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """slope and intercept of the least-squares line of groups with at least ``least`` points."""
    out = points.groupBy(*by).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"), F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    return out.where(F.col("n") >= least)


def trend_grid(trend: DataFrame, by: list[str], points: int = 50) -> DataFrame:
    """The trend line at evenly spaced places."""
    step = (F.col("x_max") - F.col("x_min")) / F.lit(points - 1.0)
    out = trend.select(*by, "slope", "intercept", "x_min", "x_max", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    return out.select(*by, "i", (F.col("x_min") + F.col("i") * step).alias("x"), (F.col("intercept") + F.col("slope") * (F.col("x_min") + F.col("i") * step)).alias("y"))
