"""The log of a review session: edits taken back by undo, and the range that In and Out marks leave.

``log``: recording, seq (unique in its recording) and kind; ``undo`` takes back the latest edit that still stands, any
other kind is an edit. An undo with nothing left to take back does nothing. Recordings don't reach into each other.

Whether an edit stands is stack matching. The stack's height after a row is the running sum of +1 and -1 less the lowest
sum so far (0 at most); both are carried over chunks as one pair, so a log of any length is worked on in pieces. Edits
that push to a height and undos that pop from it alternate, so the row before or after at the same height is the partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import lagged

KEY = ["recording"]
#: Log entries of a chunk.
LOG_CHUNK = 50_000


def heights(log: DataFrame, undo: Column, size: int = LOG_CHUNK) -> DataFrame:
    """``height`` of the stack after each row and ``took``: an undo that found an edit."""
    chunk = Window.partitionBy(*KEY, "__chunk").orderBy("seq")
    upto, earlier = chunk.rowsBetween(Window.unboundedPreceding, 0), chunk.rowsBetween(Window.unboundedPreceding, -1)
    local = log.withColumn("__chunk", F.floor(F.col("seq") / size).cast("long")).withColumn("__undo", F.coalesce(undo, F.lit(False)))
    local = local.withColumn("__sum", F.sum(F.when(F.col("__undo"), -1).otherwise(1)).over(upto)).withColumn("__low", F.min("__sum").over(earlier))
    # A chunk's pair is its sum and its lowest sum; the pairs of all earlier chunks give where it begins.
    pairs = local.groupBy(*KEY, "__chunk").agg(F.max_by("__sum", "seq").alias("__total"), F.min("__sum").alias("__least"))
    chunks = Window.partitionBy(*KEY).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    begun = pairs.withColumn("__from", F.coalesce(F.sum("__total").over(chunks), F.lit(0))).withColumn("__floor", F.min(F.col("__from") + F.col("__least")).over(chunks))
    out = local.join(begun.drop("__total", "__least"), [*KEY, "__chunk"])
    now, before = F.col("__from") + F.col("__sum"), F.least(F.lit(0), F.col("__floor"), F.col("__from") + F.col("__low"))
    return out.withColumn("took", F.col("__undo") & (now >= before)).withColumn("height", (now - F.least(before, now)).cast("long")).drop("__chunk", "__undo", "__sum", "__low", "__from", "__floor")


def replayed(log: DataFrame, size: int = LOG_CHUNK) -> DataFrame:
    """``log`` with height, stands (an edit that no undo took back) and takes_back (the seq of an undo's edit)."""
    undo = F.col("kind") == "undo"
    high = heights(log, undo, size)
    level = F.when(~F.coalesce(undo, F.lit(False)), F.col("height")).when(F.col("took"), F.col("height") + 1)
    high = high.withColumn("__level", level)
    paired = high.where(F.col("__level").isNotNull())
    paired = lagged(paired, [*KEY, "__level"], "seq", F.col("seq"), "__before", size=size)
    paired = lagged(paired, [*KEY, "__level"], "seq", F.col("took"), "__undone", size=size, ahead=True)
    out = paired.withColumn("stands", ~F.col("took") & ~F.coalesce("__undone", F.lit(False))).withColumn("takes_back", F.when(F.col("took"), F.col("__before")))
    idle = high.where(F.col("__level").isNull()).withColumn("stands", F.lit(False)).withColumn("takes_back", F.lit(None).cast("long"))
    return out.unionByName(idle, allowMissingColumns=True).drop("__level", "__before", "__undone", "took")


def standing(log: DataFrame, size: int = LOG_CHUNK) -> DataFrame:
    """The edits that no undo took back, in the columns of ``log``."""
    return replayed(log, size).where("stands").select(*log.columns)


# In and Out marks


def marked_range(marks: DataFrame, crossing: str = "clear") -> DataFrame:
    """start and end of each recording after its marks (recording, seq, kind ``in``, ``out`` or ``clear``, frame); null where open.

    An In beyond the end opens the end. An Out before the start opens the start (``clear``, the trim panel) or becomes
    the start, the old start the end (``swap``, the range panel). Of each recording only the last marks matter, so a few
    aggregates find the range without going through the marks one by one.
    """
    if crossing not in ("clear", "swap"):
        raise ValueError("crossing marks clear or swap")
    cleared = marks.groupBy(*KEY).agg(F.max(F.when(F.col("kind") == "clear", F.col("seq"))).alias("__cleared"))
    rows = marks.join(cleared, KEY).withColumn("__live", F.col("__cleared").isNull() | (F.col("seq") > F.col("__cleared"))).drop("__cleared")
    is_in, is_out = F.col("__live") & (F.col("kind") == "in"), F.col("__live") & (F.col("kind") == "out")
    frame, seq = F.col("frame"), F.col("seq")
    last = rows.groupBy(*KEY).agg(F.max(F.when(is_in, seq)).alias("__in"), F.max(F.when(is_out, seq)).alias("__out"))
    rows = rows.join(last, KEY)
    after_out = is_in & (F.col("__out").isNull() | (seq > F.col("__out")))
    tops = F.max(F.when(after_out, frame)).alias("__ins_top")
    if crossing == "clear":
        after_in = is_out & (F.col("__in").isNull() | (seq > F.col("__in")))
        got = rows.groupBy(*KEY).agg(F.max_by("frame", F.when(is_in, seq)).alias("__s"), F.max_by("frame", F.when(is_out, seq)).alias("__e"), tops, F.min(F.when(after_in, frame)).alias("__outs_least"), F.max("__in").alias("__in"), F.max("__out").alias("__out"))
        start = F.when(F.col("__in").isNotNull() & (F.col("__outs_least").isNull() | (F.col("__outs_least") >= F.col("__s"))), F.col("__s"))
        end = F.when(F.col("__out").isNotNull() & (F.col("__ins_top").isNull() | (F.col("__ins_top") <= F.col("__e"))), F.col("__e"))
        return got.select(*KEY, start.alias("start"), end.alias("end"))
    # The last In before the last Out; the Outs between them each leave the lower frame as the start.
    first = rows.groupBy(*KEY).agg(F.max(F.when(is_in & (seq < F.col("__out")), seq)).alias("__begun"))
    rows = rows.join(first, KEY)
    earlier_outs = is_out & (seq > F.col("__begun")) & (seq < F.col("__out"))
    got = rows.groupBy(*KEY).agg(
        F.max_by("frame", F.when(after_out, seq)).alias("__s"), tops, F.max(F.when(is_out & (seq == F.col("__out")), frame)).alias("__e"),
        F.max(F.when(is_in & (seq == F.col("__begun")), frame)).alias("__b"), F.min(F.when(earlier_outs, frame)).alias("__outs_least"), F.count_if(after_out).alias("__n"),
    )
    held = F.when(F.col("__b").isNotNull(), F.least("__b", "__outs_least"))  # the start before the last Out
    end = F.when(F.col("__e").isNotNull(), F.greatest("__e", held))
    start = F.when(F.col("__n") > 0, F.col("__s")).when(held.isNotNull(), F.least(held, F.col("__e")))
    return got.select(*KEY, start.alias("start"), F.when((F.col("__n") == 0) | (F.col("__ins_top") <= end), end).alias("end"))


def crop_bounds(ranges: DataFrame, frames: DataFrame) -> DataFrame:
    """from_frame and to_frame of each recording's crop: start and end (null: open) widened by whole frames of padding.

    ``ranges``: recording, start, end, padding_s, fps. The padding is cut to whole frames towards zero, the lower bound
    may lie below zero, an open end is the last frame that the recording has.
    """
    pad = (F.col("padding_s") * F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)).cast("long")
    last = frames.groupBy(*KEY).agg(F.max("frame_idx").alias("__last"))
    both = ranges.join(last, KEY)
    return both.select(*KEY, F.when(F.col("start").isNotNull(), F.col("start") - pad).otherwise(0).cast("long").alias("from_frame"), F.when(F.col("end").isNotNull(), F.col("end") + pad).otherwise(F.col("__last")).cast("long").alias("to_frame"))


def cropped(rows: DataFrame, bounds: DataFrame, first: str = "frame_idx", last: str | None = None) -> DataFrame:
    """Rows (frames, or spans from ``first`` to ``last``) that touch their recording's bounds; recordings without bounds are whole."""
    met = rows.join(bounds, KEY, "left")
    inside = (F.col(last or first) >= F.col("from_frame")) & (F.col(first) <= F.col("to_frame"))
    return met.where(F.col("from_frame").isNull() | inside).select(*rows.columns)
