"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's words (lower case, without punctuation) give five-word k-mers; each k-mer with its number of occurrence
so far is distinct. Each of ``SKETCHES`` sketches takes the ``TUPLE`` k-mers with the smallest keyed hashes and keeps
their text order, so two documents meet in a sketch the more likely, the more similar they are in edit distance. Texts
of at most ``SHORT_TEXT`` words have a second family of sketches, of two-word k-mers, in which few edits spoil little. A
pair that meets is verified by a bit-parallel alignment in a band: documents are near copies if the word edit
distance is at most ``1 - SIMILARITY`` of the longer one. Groups are the connected components of the links.

Documents with the same words form one class at once. The classes of a bucket (sketch and value) are candidates of each
other; a link between two that are in one group already changes nothing, so

* each class is first aligned with one class that it meets; then, twice, with one of the classes that stand first in a
  quarter of the buckets, the one that it meets most often; after that the buckets whose classes are all in one group
  are done;
* what is left is compared in full: each two classes of a bucket that are in different groups and whose lengths, words
  and pairs of neighbouring words leave room for the budget are aligned. Texts that merely share a passage or a few common
  words meet here, the more of them the larger the corpus, so their pairs are not rows of a join: the classes of a bucket
  come in the order of length, and numpy tests each with the longer ones that fit, on bits of their words. Only pairs
  that these leave become rows, those of classes that meet in many buckets in the first of them, as far as the
  ``BEFORE`` earlier ones tell.

There is no bound on a bucket's classes. Buckets that a sample shows to be very common are dealt to several tasks for
the first round; those of more than ``BLOCK_ROWS`` classes are dealt out in blocks, each two of which meet in one task, for the
full comparison.

Defined cases: null texts and texts without words share one class; texts of fewer than five words have one k-mer, the
whole text; very long texts are aligned in memory that grows with their length; an empty table gives an empty result;
other columns, whatever their names, are not read; repeated rows get the same class; class_id is the smallest known doc_id of the group, null only if none of
its ids is known. Rows are told apart by hashes of id and text, so ``docs`` must give the same rows whenever it is read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, bounded_batches, broadcast_up_to, dropped, hashed_words, identified, mixed, one_in_sample, stored

WORDS_PER_SHINGLE = 5
#: So many that two texts at SIMILARITY with their edits spread by chance meet in 99 of 100 cases.
SKETCHES = 128
TUPLE = 2
#: Texts of at most this many words have as many sketches again of pairs of words: few of their five-word k-mers, or none,
#: outlast the edits that the rule allows.
SHORT_TEXT, SHORT_MER = 128, 2
SIMILARITY = 0.8
#: Rounds in which a class is tried with one class that it meets, each in one of PARTS parts of the buckets.
ROUNDS, PARTS = 2, 4
#: Earlier open buckets of a class that tell whether two classes have met already.
BEFORE = 32
#: Classes of a bucket that are compared in one task, and rows that a task gathers before it compares their buckets.
BLOCK_ROWS, CHUNK_ROWS = 8192, 8192
#: 64-bit numbers whose bits are turned by a text's words, and others by its pairs of neighbouring words, each with its
#: number of occurrence; by them unlike classes are told before they are aligned. Only what two texts don't share
#: turns a bit between them, so the rest of a text, however long, hides nothing; where two of these share a bit, they hide
#: each other, so a text of hundreds of words needs thousands of bits.
WORD_MARKS, PAIR_MARKS = 64, 16
_WORD_MARKS, _PAIR_MARKS = [f"w{i}" for i in range(WORD_MARKS)], [f"p{i}" for i in range(PAIR_MARKS)]
_MARKS = _WORD_MARKS + _PAIR_MARKS
#: k-mers that are keyed at a time, so that a text of any length takes bounded memory.
KEYED = 1 << 14
#: Rows of a few numbers that a table may have to be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 300_000
_WORD = re.compile(r"\w+")
_FACTORS = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _two_smallest(labels: np.ndarray, factors: np.ndarray, size: int) -> np.ndarray:
    """For each factor the places of the ``size`` labels whose product with it, modulo 2^32, is smallest."""
    each, values, places = np.arange(len(factors)), [], []
    for start in range(0, len(labels), KEYED):
        keyed = labels[None, start : start + KEYED] * factors[:, None]
        for _ in range(min(size, keyed.shape[1])):
            at = keyed.argmin(axis=1)
            values.append(keyed[each, at].astype(np.uint64))
            places.append(at + start)
            keyed[each, at] = np.uint32(2**32 - 1)
    if len(places) == size:
        return np.stack(places, axis=1)
    best = np.argsort(np.stack(values, axis=1), axis=1, kind="stable")[:, :size]
    return np.take_along_axis(np.stack(places, axis=1), best, axis=1)


def with_occurrence(values: np.ndarray) -> np.ndarray:
    """Each value mixed with the number of its occurrence so far, so that repeated ones are distinct."""
    order = np.argsort(values, kind="stable")
    ranked, at = values[order], np.arange(len(values))
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    occurrence = np.empty(len(values), np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mixed(values + mixed(occurrence))


def order_minhash(words: list[str], sketches: int = SKETCHES, size: int = TUPLE, k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """A signed 64-bit value for each sketch."""
    h = hashed_words(words)
    n = max(1, len(h) - k + 1)
    mers = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(h))):
            mers = mixed(mers) + h[i : i + n]
        labels = (with_occurrence(mers) >> np.uint64(32)).astype(np.uint32)
        if n > size:
            take = np.sort(_two_smallest(labels, _FACTORS[:sketches], size), axis=1)
        else:
            take = np.broadcast_to(np.arange(n), (sketches, n))
        value = np.zeros(sketches, np.uint64)
        for at in take.T:
            value = mixed(value) + mers[at]
    return value.view(np.int64)


def sketches_of(words: list[str]) -> np.ndarray:
    """All sketches of a text: of five-word k-mers, for short texts of pairs of words as well; none without words."""
    if not words:
        return np.empty(0, np.int64)
    sk = order_minhash(words)
    return sk if len(words) > SHORT_TEXT else np.concatenate([sk, order_minhash(words, k=SHORT_MER)])


def places_of(a, width: int, small: int = 4096) -> dict:
    """Where each value of a sequence stands: one integer of bits, or for the rarer values of a long sequence a list.

    A value is rare up to 64 or width / 512 places. So there are at most 512 m / width integers of m bits beside m
    places in lists: memory grows with the length m, not with its square.
    """
    lists: dict = {}
    for i, x in enumerate(a):
        lists.setdefault(x, []).append(i)
    rare = 0 if len(a) <= small else max(64, width // 512)
    for x, at in lists.items():
        if len(at) > rare:
            bits = bytearray((at[-1] >> 3) + 1)
            for i in at:
                bits[i >> 3] |= 1 << (i & 7)
            lists[x] = int.from_bytes(bits, "little")
    return lists


def banded_distance(a, b, budget: int, small: int = 4096) -> int | None:
    """Edit distance of two sequences if it is at most ``budget``, else None.

    Bit-parallel columns over a band of 2 budget + 1 rows that moves down with the diagonal; once its lower rim has
    reached the last row, the score follows that row. Memory grows with the longer sequence (``places_of``).
    """
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > budget:
        return None
    first = 0
    while first < n and a[first] == b[first]:
        first += 1
    while n > first and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[first:m], b[first:n]
    m, n = len(a), len(b)
    if not n:
        return m
    t = min(budget, m)
    width = 2 * t + 1
    full, top = (1 << width) - 1, 1 << 2 * t
    where = places_of(a, width, small)
    up, down, score = full ^ ((1 << t) - 1), 0, t
    for j in range(1, n + 1):
        at = where.get(b[j - 1], 0)
        shift = j - t - 1
        if at.__class__ is int:
            eq = (at >> shift if shift >= 0 else at << -shift) & full
        else:
            eq = 0
            for i in at[bisect_left(at, shift) : bisect_left(at, shift + width)]:
                eq |= 1 << (i - shift)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        right, left = (down | ~(diagonal | up)) & full, diagonal & up
        last = m - j + t  # the bit of the last row
        if last >= 2 * t:
            score += not diagonal & top
            if score > 2 * t + n - m + t:
                return None
        else:
            bit = 1 << last
            score += bool(right & bit) - bool(left & bit)
        step = diagonal >> 1
        up, down = (left | ~(step | right)) & full, step & right
    return score if score <= budget else None


def budget_of(a: int, b: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * max(a, b) + 1e-9)


def _room(n, m, similarity: float):
    """The budget as a column."""
    return F.floor((1 - similarity) * F.greatest(n, m) + 1e-9)


def sketched(rows: DataFrame) -> DataFrame:
    """doc_id, t1, t2, k1, k2 (128-bit key of the words), nw (their number), sk (sketches; empty for texts without words)."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            k1, k2, nw, sk = [], [], [], []
            for text in batch.column(3).to_pylist():
                words = words_of(text)
                digest = hashlib.md5(" ".join(words).encode("utf-8", "replace")).digest()
                k1.append(int.from_bytes(digest[:8], "big", signed=True))
                k2.append(int.from_bytes(digest[8:], "big", signed=True))
                nw.append(len(words))
                sk.append(sketches_of(words))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sk]))).astype(np.int32)
            sketches = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sk) if sk else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(nw, pa.int32()), sketches], names=["doc_id", "t1", "t2", "k1", "k2", "nw", "sk"])

    return rows.select("doc_id", "t1", "t2", "text").mapInArrow(run, "doc_id long, t1 long, t2 long, k1 long, k2 long, nw int, sk array<long>")


def parities(values: np.ndarray, slots: int) -> np.ndarray:
    """For each slot whether an odd number of values falls into it."""
    return (np.bincount((values % np.uint64(slots)).astype(np.intp), minlength=slots) & 1).astype(np.uint8)


def _fold_size(n: int) -> int:
    """64-bit numbers to which the marks of n words are folded: four bits or more a word, as far as there are marks."""
    return next((s for s in (4, 8, 16, 32) if n <= 16 * s), WORD_MARKS)


def folded(marks: np.ndarray, size: int) -> np.ndarray:
    """The parities in fewer slots, of rows of marks: slots that are the same modulo the new number are one."""
    return np.bitwise_xor.reduce(marks.reshape(len(marks), -1, size), axis=1)


def class_words(texts: DataFrame) -> DataFrame:
    """c, words (joined by spaces), nw (their number), marks and folded marks of the words of c, text."""

    def run(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            bits = np.zeros((len(words), 64 * len(_MARKS)), np.uint8)
            for i, w in enumerate(words):
                h = hashed_words(w)
                with np.errstate(over="ignore"):
                    bits[i, : 64 * WORD_MARKS] = parities(with_occurrence(h), 64 * WORD_MARKS)
                    if len(h) > 1:
                        bits[i, 64 * WORD_MARKS :] = parities(with_occurrence(mixed(h[:-1]) + h[1:]), 64 * PAIR_MARKS)
            marks = np.packbits(bits, axis=1).view(np.int64).reshape(len(words), len(_MARKS))
            fold = pa.array([folded(marks[i : i + 1, :WORD_MARKS], _fold_size(len(w)))[0] for i, w in enumerate(words)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(w) for w in words], pa.string()), pa.array([len(w) for w in words], pa.int32()), *(pa.array(np.ascontiguousarray(m)) for m in marks.T), fold], names=["c", "words", "nw", *_MARKS, "fold"])

    return texts.select("c", "text").mapInArrow(run, f"c long, words string, nw int, {', '.join(f'{m} long' for m in _MARKS)}, fold array<long>")


def _as_other(table: DataFrame, *columns) -> DataFrame:
    """A table's marks under the names of the other class."""
    return table.select(*columns, *(F.col(m).alias(f"o{m}") for m in _MARKS))


def _may_link(n, m, similarity: float):
    """Whether lengths and marks leave room.

    A replaced word turns two bits of words and four of pairs of neighbours at most, an added or deleted one turns one
    and three and changes the length.
    """
    turned = lambda names: sum((F.bit_count(F.col(k).bitwiseXOR(F.col(f"o{k}"))) for k in names), F.lit(0))
    room, longer = _room(n, m, similarity), F.abs(n - m)
    return (longer <= room) & (turned(_WORD_MARKS) <= 2 * room - longer) & (turned(_PAIR_MARKS) <= 4 * room - longer)


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float, tested: bool = False) -> DataFrame:
    """The pairs (a, b) of classes that are near copies; unless they are ``tested`` on folded marks, the marks rule out most others before words are read."""
    pairs = stored(pairs)
    if not tested:
        met = pairs.join(texts.select(F.col("c").alias("b"), F.col("nw").alias("nb"), *_MARKS), "b").join(_as_other(texts, F.col("c").alias("a"), F.col("nw").alias("na")), "a")
        pairs = stored(met.where(_may_link(F.col("na"), F.col("nb"), similarity)).select("a", "b"), long_condition=True)
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    words = stored(texts.select("c", "words").join(broadcast_up_to(ids, BROADCAST_ROWS), "c", "left_semi"))
    a = words.select(F.col("c").alias("a"), F.col("words").alias("wa"))
    b = words.select(F.col("c").alias("b"), F.col("words").alias("wb"))

    def run(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = x.split(" "), y.split(" ")
                near.append(banded_distance(x, y, budget_of(len(x), len(y), similarity)) is not None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    both = pairs.join(b, "b").join(a, "a").select("a", "b", "wa", "wb")
    out = stored(both.mapInArrow(run, "a long, b long, near boolean").where("near").select("a", "b"))
    dropped(pairs, ids, words)
    return out


def _meeting(classes: DataFrame, similarity: float) -> DataFrame:
    """bucket, c, nw, near: the buckets in which a class meets another one of fitting length, with such a class where the order by length shows one."""
    rows = lambda of: of.select("c", "nw", F.posexplode("sk").alias("j", "v")).select(F.xxhash64("j", "v").alias("bucket"), "c", "nw")
    fits = lambda x, y: F.coalesce(F.abs(F.col(x) - F.col(y)) <= _room(F.col(x), F.col(y), similarity), F.lit(False))
    met = beside(rows(classes), rows(one_in_sample(classes, "c")), "bucket", "c", "nw")
    met = met.where(F.col("common") | fits("below", "nw") | fits("nw", "above"))
    return stored(met.select("bucket", "c", "nw", F.when(fits("below", "nw"), F.col("near")).alias("near")))


def _rooted(met: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, c, nw, root."""
    return met.select("bucket", "c", "nw").join(broadcast_up_to(roots, BROADCAST_ROWS), "c", "left").withColumn("root", F.coalesce("root", "c"))


def _open(met: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """bucket, c, nw, root of the classes that meet one of another group and of fitting length."""
    by = Window.partitionBy("bucket").orderBy("nw", "root", "c")
    back = Window.partitionBy("bucket").orderBy(F.desc("nw"), F.desc("root"), F.desc("c"))
    rooted = _rooted(met, roots)
    other = lambda at: F.when(at("root").over(by) != F.col("root"), at("nw").over(by))
    turns = rooted.select("*", other(F.lag).alias("below"), other(F.lead).alias("above"))
    # The nearest class of another group stands beside the run of a class's own group in the order of length.
    so_far = lambda c, of: F.last(c, ignorenulls=True).over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(c)
    near = turns.select("bucket", "c", "nw", "root", so_far("below", by), so_far("above", back))
    fits = lambda n, m: F.coalesce(m - n <= _room(n, m, similarity), F.lit(False))
    return stored(near.where(fits(F.col("below"), F.col("nw")) | fits(F.col("nw"), F.col("above"))).select("bucket", "c", "nw", "root"))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow column of lists, and where each row's begin."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)))).astype(np.int64)


def _pairs_of_rows(rows: pa.RecordBatch, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """a, b of the rows of whole blocks, ordered by block and nw: classes of one block that fit by their lengths and folded marks."""
    bucket, lo, hi, side, c, nw, root = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(7))
    (fold, begins), (before, earlier) = _lists(rows.column(7)), _lists(rows.column(8))
    n, room = len(c), np.floor((1 - similarity) * nw + 1e-9).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    sizes, marks = np.diff(begins), {}
    for size in np.unique(sizes):
        marks[size] = np.zeros((size, n), np.uint64)
        for larger in np.unique(sizes[sizes >= size]):
            at = np.flatnonzero(sizes == larger)
            marks[size][:, at] = folded(fold[begins[at][:, None] + np.arange(larger)].view(np.uint64), size).T
    found, x, step = [], np.arange(n), 0
    while len(x):
        # Each row with the one so many places further; beyond the first that is too long, all are.
        step += 1
        x = x[x + step < ends[x]]
        x = x[nw[x + step] - nw[x] <= room[x + step]]
        apart = x[(root[x] != root[x + step]) & ((lo[x] == hi[x]) | (side[x] != side[x + step]))]
        for size in marks:
            i = apart[sizes[apart] == size]
            most, turned = 2 * room[i + step] - (nw[i + step] - nw[i]), np.zeros(len(i), np.int64)
            for k in range(size):
                if not len(i):
                    break
                turned += np.bitwise_count(marks[size][k, i] ^ marks[size][k, i + step])
                if k % 4 == 3:
                    may = turned <= most
                    i, most, turned = i[may], most[may], turned[may]
            met = lambda r: before[earlier[r] : earlier[r + 1]].tolist()
            found += [(r, r + step) for r in i.tolist() if set(met(r)).isdisjoint(met(r + step))]
    at = np.array(found, np.int64).reshape(-1, 2)
    return np.minimum(c[at[:, 0]], c[at[:, 1]]), np.maximum(c[at[:, 0]], c[at[:, 1]])


def _apart_in_full(met: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b: each two classes of a bucket in different groups that may be near copies by their lengths and folded marks."""
    # A class and its open buckets (no more than sketches) are one row until its marks are there.
    of = met.groupBy("c").agg(F.any_value("nw").alias("nw"), F.any_value("root").alias("root"), F.sort_array(F.collect_list("bucket")).alias("open"))
    # Classes of different groups that fit and have an earlier bucket in common both have it here, and are in its rows as well.
    before = lambda i: F.slice("open", F.greatest(i - BEFORE + 1, F.lit(1)), F.least(i, F.lit(BEFORE)))
    spots = F.transform("open", lambda b, i: F.struct(b.alias("bucket"), before(i).alias("before")))
    rows = of.join(texts.select("c", "fold"), "c").select("c", "nw", "root", "fold", F.explode(spots).alias("s")).select("c", "nw", "root", "fold", "s.*")
    # No more than one in BLOCK_ROWS rows are such buckets.
    large = stored(met.groupBy("bucket").count().where(F.col("count") > BLOCK_ROWS).select("bucket", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("parts")))
    dealt = rows.join(F.broadcast(large), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("side", k).alias("lo"), F.greatest("side", k).alias("hi")))
    blocks = dealt.select("*", F.explode(others).alias("block")).select("bucket", "block.lo", "block.hi", "side", "c", "nw", "root", "fold", "before")

    def run(batches):
        held, limit = [], CHUNK_ROWS
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < limit:
                continue
            rows = pa.concat_batches(held)
            keys = [rows.column(k).to_numpy() for k in range(3)]
            last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held, limit = [rows.slice(cut)], max(CHUNK_ROWS, 2 * (len(rows) - cut))
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs_of_rows(rows.slice(0, cut), similarity)], names=["a", "b"])
        if held and len(rows := pa.concat_batches(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs_of_rows(rows, similarity)], names=["a", "b"])

    ordered = blocks.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "nw", "c")
    pairs = stored(ordered.mapInArrow(run, "a long, b long").distinct())
    dropped(large)
    return pairs


def class_groups(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """c, root of every class (c, nw, sk) that has a verified link: root is the smallest class it is connected with.

    ``texts_of`` gives c and text of the classes asked for (c).
    """
    met = _meeting(classes, similarity)
    first = stored(met.groupBy("c").agg(F.min("near").alias("a")))
    texts = stored(class_words(texts_of(first.select("c"))))
    links = _linked(first.where(F.col("a").isNotNull()).select("a", F.col("c").alias("b")), texts, similarity)
    roots = components(links)
    for n in range(ROUNDS):
        part = _rooted(met.where(F.pmod("bucket", F.lit(PARTS)) == n), roots)
        one = part.groupBy("bucket").agg(F.min(F.struct(F.xxhash64(F.lit(n), "c"), F.col("c").alias("a"), F.col("root").alias("root_a"), F.col("nw").alias("na"))).alias("one")).select("bucket", "one.a", "one.root_a", "one.na")
        meet = part.join(one, "bucket").where((F.col("root") != F.col("root_a")) & (F.abs(F.col("nw") - F.col("na")) <= _room(F.col("nw"), F.col("na"), similarity)))
        often = meet.groupBy(F.col("c").alias("b")).agg(F.mode("a").alias("a"))
        roots = merged(roots, _linked(often.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, similarity))
    left = _open(met, roots, similarity)
    pairs = _apart_in_full(left, texts, similarity)
    roots = merged(roots, _linked(pairs, texts, similarity, tested=True))
    dropped(met, first, texts, left, pairs)
    return roots


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The groups after some more links: only the groups that the links join are looked at again."""
    if roots is None:
        return components(links)
    of = broadcast_up_to(roots, BROADCAST_ROWS)
    end = lambda df, c: df.join(of.select(F.col("c").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
    joined = stored(end(end(links, "a"), "b").where(F.col("a") != F.col("b")).distinct())
    if joined.isEmpty():
        return roots
    new = components(joined)
    moved = roots.join(broadcast_up_to(new.select(F.col("c").alias("root"), F.col("root").alias("to")), BROADCAST_ROWS), "root", "left")
    kept = moved.select("c", F.coalesce("to", "root").alias("root"))
    return stored(kept.unionByName(new.join(roots, "c", "left_anti")))


def components(links: DataFrame) -> DataFrame:
    """c, root: the smallest class that each linked class is connected with (classes without links are left out)."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = stored(edges.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        # The smallest label among the neighbours, then the label of that label.
        near = edges.join(label, edges["b"] == label["c"]).groupBy("a").agg(F.min("root").alias("near"))
        moved = label.join(near, label["c"] == near["a"]).select("c", F.least("root", "near").alias("new"), F.col("root").alias("old"))
        jump = label.select(F.col("c").alias("new"), F.col("root").alias("far"))
        after = stored(moved.join(jump, "new", "left").select("c", F.least("new", F.coalesce("far", "new")).alias("root"), "old"))
        label = after.select("c", "root")
        if after.where(F.col("root") != F.col("old")).isEmpty():
            return label


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id of every row of ``docs``: equal for documents in one group of near copies."""
    base = identified(docs)
    sketches = stored(sketched(base))
    classes = sketches.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.min(F.struct("t1", "t2")).alias("at"), F.any_value("nw").alias("nw"), F.any_value("sk").alias("sk"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("c"), "*"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """The text of the row that stands for each class; of repeated rows, of one."""
        at = stored(classes.select("c", "at.t1", "at.t2").join(broadcast_up_to(wanted, BROADCAST_ROWS), "c", "left_semi"))
        return base.join(broadcast_up_to(at, BROADCAST_ROWS), ["t1", "t2"]).groupBy("c").agg(F.any_value("text").alias("text"))

    roots = class_groups(classes.where(F.size("sk") > 0).select("c", "nw", "sk"), texts_of, similarity)
    rooted = classes.select("c", "k1", "k2", "least").join(broadcast_up_to(roots, BROADCAST_ROWS), "c", "left").select("k1", "k2", "least", F.coalesce("root", "c").alias("root"))
    leaders = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    of = stored(rooted.join(leaders, "root").select("k1", "k2", "class_id"))
    out = stored(sketches.select("doc_id", "k1", "k2").join(broadcast_up_to(of, BROADCAST_ROWS), ["k1", "k2"]).select("doc_id", "class_id"))
    dropped(sketches, classes, of, roots)
    return out
