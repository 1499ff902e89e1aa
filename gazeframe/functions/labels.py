"""Columns over labels, numbers read from text, and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_AOI = "NoAOI"
#: Fixed spellings of "no area of interest"; case counts.
NULL_LABELS = ["", "NoAOI", "nan", "None", "NONE", "null"]
#: Fixed order in which areas are listed before all others.
AOI_ORDER = ["Board", "Screen", "Left_Box", "Middle_Box", "Right_Box", "Stream_Deck"]
DIFFICULTIES = ["easy", "medium", "hard"]
#: Frame rates that recorders use.
FRAME_RATES = [24, 25, 30, 50, 60]


def normal_label(c: Column) -> Column:
    """The label without outer white space; every null spelling becomes NoAOI."""
    t = F.trim(c)
    return F.when(c.isNull() | t.isin(NULL_LABELS), F.lit(NO_AOI)).otherwise(t)


def filled_label(c: Column) -> Column:
    """Null and empty become NoAOI; nothing else changes."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(NO_AOI))


def chosen_label(df, final: str = "final_primary_aoi", primary: str = "primary_aoi") -> Column:
    """The reviewed label if the table has that column (its nulls are NoAOI), else the primary one."""
    return normal_label(F.col(final if final in df.columns else primary))


def number(c: Column) -> Column:
    """A double, null where the text is none."""
    return c.try_cast("double")


def whole(c: Column) -> Column:
    """An int from text or a number, fractions cut off; null where it can't be read."""
    return F.when(F.abs(c.try_cast("double")) < 2**31, c.try_cast("double")).cast("int")


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 for a zero or missing denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clamped(c: Column, digits: int = 5) -> Column:
    """Into [0, 1] and rounded; null and NaN stay null."""
    x = F.when(~F.isnan(c), c)
    return F.when(x.isNotNull(), F.bround(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), digits))


def task_index(name: Column) -> Column:
    """All digits of a task's name as one number, 0 without digits."""
    return F.coalesce(F.regexp_replace(name, "[^0-9]", "").try_cast("int"), F.lit(0))


def difficulty_of(recording_path: Column, source_path: Column) -> Column:
    """The first part named easy, medium or hard, of the source's parts from the deepest up, then the recording's; else the source's own name."""
    parts = lambda p: F.reverse(F.filter(F.split(p, "/"), lambda x: x != ""))
    known = F.filter(F.concat(parts(source_path), parts(recording_path)), lambda x: F.lower(x).isin(DIFFICULTIES))
    return F.coalesce(F.initcap(F.get(known, F.lit(0))), F.get(parts(source_path), F.lit(0)))


def snapped_fps(fps: Column, within: float = 4.0) -> Column:
    """The nearest usual frame rate at most ``within`` away (the lower one of two), else the rate itself."""
    near = F.filter(F.transform(F.array(*map(F.lit, FRAME_RATES)), lambda r: F.struct(F.abs(fps - r).alias("d"), r.cast("double").alias("r"))), lambda s: s["d"] <= within)
    return F.coalesce(F.array_min(near)["r"], fps)


def quality_band(valid_pct: Column) -> Column:
    return F.when(valid_pct >= 80, "Good").when(valid_pct >= 60, "Acceptable").otherwise("Poor")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def shown_p(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "—").when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def shown_effect(e: Column) -> Column:
    return F.when(e.isNull() | F.isnan(e), "—").otherwise(F.format_string("%.3f", e))


def minutes_seconds(s: Column) -> Column:
    whole_s = F.floor(s).cast("long")
    return F.when(whole_s >= 3600, F.format_string("%d:%02d:%02d", F.floor(whole_s / 3600), F.floor(whole_s / 60) % 60, whole_s % 60)).otherwise(F.format_string("%d:%02d", F.floor(whole_s / 60), whole_s % 60))


def percent(part: Column, total: Column, digits: int = 1) -> Column:
    return F.bround(F.least(F.greatest(safe_div(part * 100.0, total), F.lit(0.0)), F.lit(100.0)), digits)


def aoi_rank(c: Column) -> Column:
    """Sort key: place in the fixed order, others after it (then sort by name)."""
    place = F.array_position(F.array(*map(F.lit, AOI_ORDER)), c)
    return F.when(place > 0, place).otherwise(F.lit(len(AOI_ORDER) + 1))


def joined_ints(c: Column) -> Column:
    return F.array_join(F.array_sort(c).cast("array<string>"), ";")


def split_ints(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ";"), lambda x: x != ""), lambda x: x.try_cast("int"))


def pair_label(src: Column, dst: Column) -> Column:
    return F.concat_ws("->", src, dst)


def shown_label(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def safe_name(c: Column) -> Column:
    """Lower-case letters and digits, other runs as one underscore."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def fixation_radius(duration_ms: Column) -> Column:
    return F.greatest(F.sqrt(duration_ms) * 1.8, F.lit(12.0))


def ring_radius(duration_ms: Column) -> Column:
    return F.least(F.greatest(duration_ms * 10.0 / 100.0, F.lit(10.0)), F.lit(80.0))


def seconds_from(ts_us: Column, base_us: Column) -> Column:
    return (ts_us - base_us) / 1e6
