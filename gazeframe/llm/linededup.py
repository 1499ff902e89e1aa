"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations alone.

A line is the set of its lower-case words. A later line is removed if its set equals an earlier line's, or if an
earlier line that stands first for its set has a Jaccard similarity of at least ``THRESHOLD`` with it. The join:

* words are counted over all lines (in 65,536 hashed kinds, so the counts have a fixed size) and each line's words
  are ordered by rarity;
* the prefix of a line is its first pairs of neighbours in that order. A word that only one of two lines has breaks at
  most two pairs of that line and one of the other, so two similar lines of n and m words that share a words have
  ``SHARED`` pairs in common among the first ``2 (n - a) + (m - a) + SHARED`` of each. Pairs of words are rare where
  single words are not: the lines that meet on one grow with the text that is alike, not with the corpus;
* lines that meet must leave room for the overlap by their sizes (length filter) and by the places of the pair
  (positional filter), and by 64 or 128 bits, each the parity of the words in one of as many slots: a word that only one of
  two lines has turns one bit, so similar lines differ in no more bits than words. The bits stand beside the pairs of
  words, so lines that meet by chance are told apart inside the joins, before any word is read;
* what is left is verified on the words of the lines themselves.

All texts are split into words once for the counts and once for the prefixes; after that only the lines that the bits
leave are read again.

A group of near copies would pair all its lines. A line needs one earlier match only, so each line is compared with one
line that it meets; those without an earlier match with the earliest of hashed subsets of the lines of each pair that
many lines have (sums that Spark combines before it shuffles), first with one and then with up to eight; what still has
no match meets all lines before it, so no pair of undecided lines is left out. Pairs that a sample shows to be very common are dealt to several
tasks; the sample only decides that.

Rows are told apart by two 64-bit hashes of id and text, so nothing depends on how the input is split into tasks, and
no copy of the texts is written.

Defined cases: lines without words are always kept and match nothing; short lines are lines like any other (below
four different words, only equal sets are similar enough); null and empty texts have no lines to remove and stay as
they are; "earlier" is by doc_id (nulls first), then a hash of the text, then place; of rows that repeat both id and
text one keeps its lines and the others keep those without words; columns with other names pass through. ``docs``
must give the same rows whenever it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, broadcast_up_to, dropped, identified, identity, numbered, one_in_sample, stored

#: Similar lines: 5 |A and B| >= 4 |A or B|; kept as whole numbers, so that no rounding decides.
THRESHOLD = (4, 5)
KINDS = 1 << 16
#: Pairs of the prefixes that similar lines have in common.
SHARED = 2
#: Lines of fewer different words are similar to equal sets only.
LEAST_UNEQUAL = 4
#: Hashed subsets of a pair's lines whose earliest lines are tried, round by round, and whether a line tries only one of them.
SUBSETS = ((4, True), (8, False))
#: Lines with more words than this have parities in 128 slots, compared where both lines have them; the others in 64.
MORE_MARKS = 64
_MARKS = ["m0", "m1"]
#: Lines on one side of a line in the order of a pair's lines from which on the pair counts as one of many lines.
MANY = 16
#: Rows of numbers that a table may have to be broadcast (32 bytes each at most); larger ones are joined by shuffle.
BROADCAST_ROWS = 600_000
PLACE = ("doc_id", "t1", "t2", "pos")


def _words(line: Column) -> Column:
    """Words between white space; the common case of spaces alone needs no pattern."""
    low = F.lower(line)
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r"))
    return F.when(other, F.split(low, r"[ \t\r]+")).otherwise(F.split(low, " "))


def _hashes(line: Column) -> Column:
    """Hashes of a line's different words; the empty word between two spaces is none."""
    return F.array_remove(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def word_classes(docs: DataFrame) -> list[int]:
    """For each hashed kind of word, a class from 0 (rare) to 63, by the logarithm of its count over all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(KINDS - 1)).alias("kind")).count()
    out = [0] * KINDS  # at most KINDS rows reach the driver
    for kind, c in counts.select("kind", F.least(F.lit(63), F.floor(F.log2("count") * 2)).cast("int")).collect():
        out[kind] = c
    return out


def _ordered(hashes: Column, classes: list[int]) -> Column:
    """A line's words, rare ones first: the class stands above the upper bits of the hash."""
    table = F.expr(f"cast(split('{','.join(str(c << 56) for c in classes)}', ',') as array<bigint>)")
    return F.sort_array(F.transform(hashes, lambda h: F.get(table, h.bitwiseAND(F.lit(KINDS - 1)).cast("int")).bitwiseXOR(F.shiftrightunsigned(h, 8))))


def _overlap_needed(a: Column, b: Column) -> Column:
    """ceil(t / (1 + t) (|A| + |B|)) for t = 4 / 5."""
    up, down = THRESHOLD
    return F.floor((up * (a + b) + (up + down - 1)) / (up + down)).cast("int")


def _least_size(n: Column) -> Column:
    """The smallest set that can be similar to one of n words."""
    up, down = THRESHOLD
    return F.floor((up * n + (down - 1)) / down).cast("int")


def _prefix_words(n: Column) -> Column:
    """Words of a prefix: with a >= 4 (n + m) / 9 shared words, 2 (n - a) + (m - a) is (2n - m) / 3 at most."""
    return F.floor((2 * n - _least_size(n)) / 3).cast("int") + SHARED + 1


def _parities(w: Column) -> list[Column]:
    """m0: in each of 64 bits whether an odd number of words falls into its slot; m1: of every other word alone."""
    turned = lambda what: lambda b, h: b.bitwiseXOR(F.call_function("shiftleft", what(h), h.bitwiseAND(F.lit(63)).cast("int")))
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    m1 = F.aggregate(w, none, turned(lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(one)))
    return [F.aggregate(w, none, turned(lambda h: one)).alias("m0"), F.when(F.size(w) > MORE_MARKS, m1).otherwise(none).alias("m1")]


def line_keys(base: DataFrame, classes: list[int]) -> DataFrame:
    """id, the line's place, n (different words), key and key2 (of the set), prefix (32-bit hashes of words) and marks (parities) of every line."""
    lines = base.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = lines.select(*PLACE, _ordered(_hashes(F.col("line")), classes).alias("w"))
    n = F.size("w")
    prefix = F.transform(F.slice("w", F.lit(1), _prefix_words(n)), lambda h: F.hash(h))  # lines only meet on it; sets are verified
    return words.select(F.monotonically_increasing_id().alias("id"), *PLACE, n.alias("n"), F.xxhash64("w").alias("key"), F.xxhash64(F.lit(1), F.col("w")).alias("key2"), prefix.alias("prefix"), *_parities(F.col("w")))


def _repeated_sets(lines: DataFrame) -> DataFrame:
    """id, at, kept: every line but the first of its set, its place and the first one's."""
    keys = ["key", "key2"]
    more = stored(lines.where(F.col("n") > 0).groupBy(*keys).count().where(F.col("count") > 1).select(*keys))
    of = stored(lines.select("id", F.struct(*PLACE, "id").alias("at"), *keys).join(broadcast_up_to(more, BROADCAST_ROWS), keys))
    firsts = stored(of.groupBy(*keys).agg(F.min("at").alias("first")))
    out = stored(of.join(firsts, keys).where(F.col("at.id") != F.col("first.id")).select("id", *(F.struct(*(F.col(f"{c}.{x}").alias(x) for x in PLACE)).alias(name) for c, name in (("at", "at"), ("first", "kept")))))
    dropped(more, of, firsts)
    return out


def _pairs_of_words(lines: DataFrame) -> DataFrame:
    """key, id, np for each pair of neighbours in a line's prefix; np holds the line's size above the pair's place."""
    spots = lines.where(F.col("n") >= LEAST_UNEQUAL).select("id", "n", "prefix", F.posexplode("prefix").alias("p", "h"))
    np = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("p").cast("long"))
    return spots.where(F.col("p") < F.size("prefix") - 1).select(F.xxhash64("h", F.get("prefix", F.col("p") + 1)).alias("key"), "id", np.alias("np"))


def _size(np: Column) -> Column:
    return F.shiftright(np, 32).cast("int")


def _place(np: Column) -> Column:
    return np.bitwiseAND(F.lit(2**31 - 1)).cast("int")


def _meeting(lines: DataFrame) -> DataFrame:
    """key, id, np, near, many: the pairs of words that another line of fitting size has as well, with such a line where the order by size shows one."""
    # Of the lines with a pair, those next by size fit if any does.
    fits = lambda small, large: F.coalesce(5 * _size(F.col(small)) >= 4 * _size(F.col(large)), F.lit(False))
    rows = beside(_pairs_of_words(lines), _pairs_of_words(one_in_sample(lines, "id")), "key", "id", "np", MANY)
    # If just one other line has the pair, the positional filter decides at once.
    alone = ~F.col("only") | _may_match(F.col("np"), F.coalesce("below", "above"))
    met = rows.where((F.col("common") | fits("below", "np") | fits("np", "above")) & alone)
    return stored(met.select("key", "id", "np", F.when(fits("below", "np"), F.col("near")).alias("near"), "many"))


def _read_once(base: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``base`` with one of the rows that repeat id and text; their hashes, a stored table."""
    copies = stored(lines.where(F.col("pos") == 0).groupBy("t1", "t2").count().where(F.col("count") > 1).select("t1", "t2"))
    if not copies.isEmpty():
        few = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
        once = base.join(few, ["t1", "t2"], "left_semi").groupBy("doc_id", "t1", "t2").agg(F.any_value("text").alias("text"))
        base = base.join(few, ["t1", "t2"], "left_anti").unionByName(once)
    return base, copies


def _words_of(base: DataFrame, lines: DataFrame, ids: DataFrame) -> DataFrame:
    """id, place and w (64-bit hashes of the words) of the given lines, read again from their texts."""
    at = lines.select("id", "t1", "t2", "pos").join(broadcast_up_to(ids, BROADCAST_ROWS), "id", "left_semi")
    wanted = stored(at.groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "id")).alias("wanted")))  # lines of one text
    small = wanted.agg(F.coalesce(F.sum(F.size("wanted") + 1), F.lit(0))).first()[0] <= BROADCAST_ROWS
    texts = base.join(F.broadcast(wanted) if small else wanted, ["t1", "t2"]).select("doc_id", "t1", "t2", "wanted", F.split("text", "\n").alias("all"))
    picked = texts.select("doc_id", "t1", "t2", "all", F.explode("wanted").alias("e"))
    words = picked.select(F.col("e.id").alias("id"), "doc_id", "t1", "t2", F.col("e.pos").alias("pos"), _hashes(F.get("all", F.col("e.pos"))).alias("w"))
    out = stored(words.select("id", *PLACE, "w"))
    dropped(wanted)
    return out


def _may_match(np: Column, np_a: Column) -> Column:
    """Length and positional filter of two lines that meet on a pair; none drops a similar pair of lines."""
    n, m, p, q = _size(np), _size(np_a), _place(np), _place(np_a)
    return (F.least(n, m) >= _least_size(F.greatest(n, m))) & (F.least(p, q) + F.least(n - p, m - q) >= _overlap_needed(n, m))


def _marks_allow(n: Column, m: Column) -> Column:
    """Parities (m0, ...) differ from the other line's (a0, ...) in no more bits than there are words that only one of the two has."""
    first, second = F.col("m0").bitwiseXOR(F.col("a0")), F.col("m1").bitwiseXOR(F.col("a1"))
    both = F.bit_count(first.bitwiseXOR(second)) + F.bit_count(second)
    differ = F.when((n > MORE_MARKS) & (m > MORE_MARKS), both).otherwise(F.bit_count(first))
    return differ <= n + m - 2 * _overlap_needed(n, m)


def _verified(pairs: DataFrame, base: DataFrame, lines: DataFrame, long_condition: bool = False) -> DataFrame:
    """later_id, at, kept (places) of the pairs (a, b) whose lines are similar."""
    pairs = stored(pairs, long_condition=long_condition)
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    words = _words_of(base, lines, ids)
    of = lambda e: words.select(F.col("id").alias(e), F.struct(*PLACE).alias(f"at_{e}"), F.col("w").alias(f"w_{e}"))
    both = broadcast_up_to(pairs, BROADCAST_ROWS).join(of("b"), "b").join(of("a"), "a")
    similar = both.where((F.col("at_a") != F.col("at_b")) & (F.size(F.array_intersect("w_a", "w_b")) >= _overlap_needed(F.size("w_a"), F.size("w_b"))))
    x, y = F.col("at_a"), F.col("at_b")
    out = stored(similar.select(F.when(x < y, F.col("b")).otherwise(F.col("a")).alias("later_id"), F.greatest(x, y).alias("at"), F.least(x, y).alias("kept")))
    dropped(pairs, ids, words)
    return out


def similar_lines(base: DataFrame) -> DataFrame:
    """at, kept (doc_id, t1, t2, pos): the places of each line to remove and of an earlier line that it matches."""
    lines = stored(line_keys(base, word_classes(base)))
    base, copies = _read_once(base, lines)
    repeated = _repeated_sets(lines)
    firsts = lines.join(broadcast_up_to(repeated.select("id"), BROADCAST_ROWS), "id", "left_anti")
    meeting = _meeting(firsts)
    tried = stored(meeting.groupBy("id").agg(F.count("*").alias("n_pairs"), F.min("near").alias("near")).where(F.col("n_pairs") >= SHARED).select("id", "near"))
    # From here on ids ascend by place, so the smallest id of a set of lines is that of the earliest one.
    kept = lines.select(F.col("id").alias("line"), *PLACE, "n", *_MARKS).join(broadcast_up_to(tried.withColumnRenamed("id", "line"), BROADCAST_ROWS), "line")
    marked = numbered(kept.orderBy(*PLACE), "id")
    # prev is the line's pair of words at the place before, if it is here too: where two lines have it in common, they meet there as well.
    before = Window.partitionBy("id").orderBy("np")
    prev = F.when(F.lag("np").over(before) == F.col("np") - 1, F.lag("key").over(before)).alias("prev")
    met = meeting.withColumnRenamed("id", "line").select("key", "line", "np", "many").join(marked.select("line", "id", *_MARKS), "line")
    met = stored(met.select("key", "id", "np", "many", *_MARKS, prev))
    dropped(meeting, tried)

    others = [F.col("m0").alias("a0"), F.col("m1").alias("a1")]
    near = marked.where(F.col("near").isNotNull()).join(marked.select(F.col("id").alias("a"), F.col("line").alias("near"), F.col("n").alias("n_a"), *others), "near")
    found = [_verified(near.where(_marks_allow(F.col("n"), F.col("n_a"))).select("a", F.col("id").alias("b")), base, marked)]
    undecided = lambda ids: stored(ids.select("id").join(broadcast_up_to(found[-1].select(F.col("later_id").alias("id")).distinct(), BROADCAST_ROWS), "id", "left_anti"))
    rest = undecided(marked)
    # Neighbours in common have the same filters; of a run of them the first one makes the pair of lines.
    begins = F.coalesce(F.col("prev") != F.col("prev_a"), F.lit(True))
    may = begins & _may_match(F.col("np"), F.col("np_a")) & _marks_allow(_size(F.col("np")), _size(F.col("np_a")))
    # Pairs of few lines are cheaper compared in full at once.
    large = met.where("many")
    for n, one in SUBSETS:
        subset = F.pmod(F.xxhash64(F.lit(n), F.col("id")), F.lit(n)).alias("subset")
        earliest = large.groupBy("key", subset).agg(F.min("id").alias("a"), *(F.min_by(c, "id").alias(to) for c, to in (("np", "np_a"), ("prev", "prev_a"), ("m0", "a0"), ("m1", "a1"))))
        of_rest = large.join(broadcast_up_to(rest, BROADCAST_ROWS), "id", "left_semi")
        meet = of_rest.join(earliest, "key").where((F.col("a") < F.col("id")) & may)
        pairs = meet.groupBy(F.col("id").alias("b"), *([] if one else ["subset"])).agg(F.min("a").alias("a")).select("a", "b").distinct()
        found.append(_verified(pairs, base, marked))
        before, rest = rest, undecided(rest)
        dropped(before)
    # What is left meets all earlier lines of its pairs of words.
    of_rest = met.join(broadcast_up_to(rest, BROADCAST_ROWS), "id", "left_semi")
    of_keys = met.select("key", F.col("id").alias("a"), F.col("np").alias("np_a"), F.col("prev").alias("prev_a"), *others)
    meet = of_rest.join(of_keys, "key").where((F.col("a") < F.col("id")) & may)
    found.append(_verified(meet.select("a", F.col("id").alias("b")).distinct(), base, marked, long_condition=True))

    every = repeated.select("at", "kept").where(F.col("at") != F.col("kept"))
    for f in found:
        every = every.unionByName(f.select("at", "kept"))
    out = stored(every.groupBy("at").agg(F.min("kept").alias("kept")))
    dropped(lines, copies, marked, met, rest, repeated, *found)
    return out


def remove_similar_lines(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with its later similar lines taken out of ``text``, and the columns n_lines, n_removed and removed (their places).

    ``prefix`` stands before the three new names, for tables that have columns of these names.
    """
    names = docs.columns
    base = identified(docs)
    t = ("__t1", "__t2")
    gone = stored(similar_lines(base).groupBy(F.col("at.t1").alias(t[0]), F.col("at.t2").alias(t[1])).agg(F.sort_array(F.collect_list("at.pos")).alias("__gone")))
    few = gone.agg(F.coalesce(F.sum(F.size("__gone") + 1), F.lit(0))).first()[0] <= BROADCAST_ROWS
    rows = docs.select("*", *identity(F.col("doc_id").cast("long"), F.col("text").cast("string"), t))
    out = rows.join(F.broadcast(gone) if few else gone, list(t), "left")
    text, all_lines = F.col("text").cast("string"), F.split("text", "\n")
    copies = stored(rows.groupBy(*t).count().where((F.col("count") > 1)).select(*t))
    copy = F.lit(False)
    if not copies.isEmpty():
        # Only the repeated rows are numbered and stored; the first number of each keeps its lines.
        of = broadcast_up_to(copies, BROADCAST_ROWS)
        again = numbered(out.join(of, list(t), "left_semi"), "__number")
        first = again.groupBy(*t).agg(F.min("__number").alias("__first"))
        marked = again.join(first, list(t)).withColumn("__copy", F.col("__number") != F.col("__first")).drop("__number", "__first")
        out, copy = out.join(of, list(t), "left_anti").withColumn("__copy", F.lit(False)).unionByName(marked), F.col("__copy")
    wordless = lambda line: ~line.rlike(r"[^ \t\r]")
    of_copy = F.array_compact(F.transform(all_lines, lambda x, i: F.when(~wordless(x), i)))
    removed = F.coalesce(F.when(copy & text.isNotNull(), of_copy).otherwise(F.col("__gone")), F.array().cast("array<int>"))
    kept = F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    left = F.array_join(F.filter(all_lines, wordless), "\n")
    new = F.when(copy & text.isNotNull(), left).when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    return out.select(
        *[new.alias("text") if c == "text" else F.col(c) for c in names],
        F.when(F.length("text") > 0, F.size(all_lines)).otherwise(F.lit(0)).alias(f"{prefix}n_lines"),
        F.size(removed).alias(f"{prefix}n_removed"),
        removed.alias(f"{prefix}removed"),
    )
