"""Merkle manifest of a dataset by concatenated-level strings, in DataFrame operations alone.

Every row is a leaf. The leaves of a source are numbered in the order of doc_id and dealt to aligned blocks of
``BLOCK`` = 16 x 16. A block keeps each of its levels as one string of hex digests, all of the same width: the parents
are the digests of fixed-width substrings, and the siblings of a node are the substrings to its left and right inside
its run. The top digests of a source's blocks are the leaves of the next tree, and so on until one is left; the
subroots of the sources are the leaves of one more such tree.

Numbers come from a range partitioning by (source, doc_id) and prefix sums of the counts of each range, so a source of
any size is dealt over many tasks; a task of the later steps holds single blocks.

Defined cases: nulls of any column are ``-`` in the leaf; a null source is a source of its own and comes first; null ids
come first in their source; rows of one id are ordered by their leaf, and equal rows are interchangeable; empty and very
long texts count whole; an empty table gives no rows; columns other than the five, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_remainder, stored

#: Nodes of a run, hex digits of a digest, nodes of an aligned block.
ARITY, WIDTH = 16, 64
BLOCK = ARITY * ARITY
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(text: Column) -> Column:
    """The digest of a row: each field as its byte count, a colon and its value, or a dash; ``text`` stands for the text."""
    values = [text if name == "text" else F.col(name).cast("string") for name in FIELDS]
    return digest(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values])


def indexed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows``, a stored table, with ``i``, the place in its group from 0, and ``n``, the group's rows.

    The last key of the range partitioning splits rows that are equal in all of ``order``; which of them comes first
    doesn't matter.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = stored(numbered.repartitionByRange(parts, *group, *order, "__tie").withColumn("__part", F.spark_partition_id()))
    by_group = Window.partitionBy(*group)
    before = by_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__part", *group).agg(F.count("*").alias("__n"))
    starts = totals.select("__part", *group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(by_group).alias("n"))
    inside = Window.partitionBy("__part", *group).orderBy(*order, "__tie")
    placed = dealt.withColumn("__k", F.row_number().over(inside)).join(starts, ["__part", *group])
    return placed.withColumn("i", F.col("__start") + F.col("__k") - 1).drop("__tie", "__part", "__k", "__start")


def _cut(level: Column, start: Column, nodes: Column) -> Column:
    """``nodes`` digests of a level's string from the node ``start`` (from 0)."""
    return F.substring(level, start * WIDTH + 1, nodes * WIDTH)


def _beside(level: Column, at: Column) -> Column:
    """What stands left and right of the node ``at`` in its run."""
    place = at % ARITY
    first = at - place
    return F.struct(_cut(level, first, place).alias("l"), _cut(level, at + 1, F.lit(ARITY - 1) - place).alias("r"))


def forest(rows: DataFrame, group: list[str], payload: list[str], deep: bool | None = None) -> DataFrame:
    """The tree of each group: ``rows`` (group, i, n, digest, payload) give group, i, payload, digest, root and path.

    ``path`` has one (l, r) for each level from the node to the root: the siblings' digests left and right of it.
    ``deep`` says whether a group has more than a block; None looks it up.
    """
    entry = F.struct((F.col("i") % BLOCK).cast("int").alias("p"), "digest", *payload)
    blocks = rows.groupBy(*group, "n", F.floor(F.col("i") / BLOCK).alias("b")).agg(F.sort_array(F.collect_list(entry)).alias("nodes"))
    # Binary strings: their substrings are found by place, without a walk from the start.
    blocks = blocks.withColumn("level0", F.array_join("nodes.digest", "").cast("binary"))
    runs = F.sequence(F.lit(0), F.floor((F.size("nodes") - 1) / ARITY).cast("int"))
    parents = F.array_join(F.transform(runs, lambda k: F.sha2(_cut(F.col("level0"), k * ARITY, F.lit(ARITY)), 256)), "")
    blocks = stored(blocks.withColumn("level1", parents.cast("binary")))
    top = F.when(F.col("n") == 1, F.col("level0").cast("string")).when(F.col("n") <= ARITY, F.col("level1").cast("string")).otherwise(F.sha2("level1", 256))
    blocks = blocks.withColumn("top", top)
    nothing = F.array().cast("array<struct<l:binary,r:binary>>")
    if blocks.where(F.col("n") > BLOCK).isEmpty() if deep is None else not deep:
        above = blocks.withColumn("root", F.col("top")).withColumn("higher", nothing)
    else:
        tops = blocks.where(F.col("n") > BLOCK).select(*group, F.col("b").alias("i"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
        higher = forest(tops, group, []).select(*group, F.col("i").alias("b"), F.col("root").alias("__root"), F.col("path").alias("__path"))
        above = blocks.join(higher, [*group, "b"], "left").withColumn("root", F.coalesce("__root", "top")).withColumn("higher", F.coalesce("__path", nothing))
    each = above.select(*group, "n", "b", "level0", "level1", "root", "higher", F.explode("nodes").alias("x"))
    p = F.col("x.p")
    own = F.when(F.col("n") == 1, nothing).when(F.col("n") <= ARITY, F.array(_beside(F.col("level0"), p))).otherwise(F.array(_beside(F.col("level0"), p), _beside(F.col("level1"), F.floor(p / ARITY).cast("int"))))
    return each.select(*group, (F.col("b") * BLOCK + p).alias("i"), *[F.col(f"x.{c}").alias(c) for c in [*payload, "digest"]], "root", F.concat(own, "higher").alias("path"))


def folded(path: Column, start: Column) -> Column:
    """The root that a node's digest and its siblings give."""
    return F.aggregate(path, start, lambda now, s: F.sha2(F.concat(s["l"], now.cast("binary"), s["r"]), 256))


def joined(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"]).cast("string")), "")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    ``tampered`` (over the columns of ``docs``) marks rows whose text has its A-Z lower-cased before the proof is
    folded: they show that a changed text doesn't verify. All other columns are those of the rows as they are.
    """
    text = F.col("text").cast("string")
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = docs.withColumn("__shown", F.when(changed, leaf(F.translate(text, UPPER, LOWER)))).select(
        F.col("source").isNotNull().cast("int").alias("g0"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("g1"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf(text).alias("digest"), F.col("__shown").alias("shown"),
    )
    group = ["g0", "g1"]
    trees = forest(indexed(stored(rows), group, ["doc_id", "digest"]), group, ["doc_id", "shown"])
    trees = trees.withColumnRenamed("root", "subroot")
    subroots = stored(trees.where(F.col("i") == 0).select(*group, F.col("subroot").alias("digest")))
    top = indexed(subroots.withColumn("all", F.lit(0)), ["all"], group)
    tops = forest(top, ["all"], group).select(*group, "root", F.col("path").alias("higher"))
    out = trees.join(tops, group).withColumn("path", F.concat("path", "higher"))
    out = out.withColumn("folded_root", folded(F.col("path"), F.coalesce("shown", "digest")))
    return out.select(
        "doc_id", F.when(F.col("g0") == 1, F.col("g1")).alias("source"), F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(joined(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def every_fifth(doc_id: Column) -> Column:
    """Rows whose id's checksum is divisible by 5."""
    return id_remainder(doc_id, 5) == 0
