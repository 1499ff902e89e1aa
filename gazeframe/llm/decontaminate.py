"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to k edits. Split into k + 1 pieces, at least one piece of it then
occurs unchanged, so exact piece hits (one automaton for all pieces) find every place worth checking; Myers'
bit-parallel search measures the edit distance there. Both sides are compared as lower-case words joined by
single spaces.

The test items are broadcast in blocks of bounded size, one pass over the documents for each block; the documents
are never shuffled and their whole texts are searched. With more than one block, each pass is stored and its block
let go before the next one is gathered, so that driver and executors hold one block whatever their number is.

Defined cases: null and empty documents match nothing, and so do null items and items without words; items of fewer
than ``MIN_WORDS`` words must occur word for word; repeated items of different ids each match; an item without an id is
reported with a null id; repeated documents each match; an item found in several places of a document counts once,
with its least distance; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: Edits allowed for each character of an item, and words from which on any are allowed.
ERROR_RATE = 0.06
MIN_WORDS = 5
#: Bounds of a broadcast block of test items.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
_NO_WORD = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    return _NO_WORD.sub(" ", text.lower()).strip() if text else ""


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """Bounds of errors + 1 pieces of near-equal length."""
    n = errors + 1
    return [(length * i // n, length * (i + 1) // n) for i in range(n)]


class Pattern:
    """One test item prepared for the bit-parallel search."""

    def __init__(self, item_id: int | None, text: str, error_rate: float, min_words: int = 0):
        if short := len(text.split()) < min_words:
            text = f" {text} "  # whole words
        self.id, self.text, self.size = item_id, text, len(text)
        self.errors = 0 if short else int(error_rate * len(text))
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def least_distance(self, window: str) -> int:
        """The least edit distance of the item to any substring of the window."""
        full, top, masks = (1 << self.size) - 1, self.size - 1, self.masks
        up, down, score = full, 0, self.size
        best = score
        for c in window:
            eq = masks.get(c, 0)
            diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
            right, left = (down | ~(diagonal | up)) & full, diagonal & up
            score += (right >> top & 1) - (left >> top & 1)
            right, left = right << 1 & full, left << 1 & full
            up, down = (left | ~(diagonal | right)) & full, right & diagonal
            if score < best:
                best = score
        return best


def _runs(starts: list[int], gap: int) -> list[tuple[int, int]]:
    """First and last of the runs of sorted places that are at most ``gap`` apart; each run is searched once."""
    out = [[starts[0], starts[0]]]
    for s in starts[1:]:
        if s - out[-1][1] <= gap:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [(a, b) for a, b in out]


class Matcher:
    """All items of a block: an automaton of their pieces, and their patterns."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, min_words: int = 0):
        import ahocorasick

        self.patterns = [Pattern(i, t, error_rate, min_words) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.patterns):
            for first, last in pieces(p.size, p.errors):
                where.setdefault(p.text[first:last], []).append((n, last))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, at)
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def matches(self, text: str) -> list[tuple[int | None, int]]:
        """(item id, distance) of the items that occur within their error budget."""
        if self.empty or not text:
            return []
        text = f" {text} "
        starts: dict[int, list[int]] = {}
        for end, at in self.automaton.iter(text):
            for n, offset in at:
                starts.setdefault(n, []).append(end + 1 - offset)
        found = []
        for n, where in starts.items():
            p = self.patterns[n]
            best = min(p.least_distance(text[max(0, first - p.errors) : last + p.size + p.errors]) for first, last in _runs(sorted(where), p.errors))
            if best <= p.errors:
                found.append((p.id, best))
        return sorted(found, key=str)


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The usable items in blocks that hold BLOCK_ITEMS items and BLOCK_CHARS characters on average, by hash."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, distance for each document and each test item that occurs in it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    bounded_batches(spark)

    def searched(shared) -> DataFrame:
        def run(batches):
            matcher = Matcher(shared.value, error_rate, min_words)
            for batch in batches:
                ids, items, distances = [], [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for item, distance in matcher.matches(normalised(text)):
                        ids.append(doc)
                        items.append(item)
                        distances.append(distance)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(distances, pa.int32())], names=["doc_id", "item_id", "distance"])

        return docs.mapInArrow(run, "doc_id long, item_id long, distance int")

    out, blocks = None, item_blocks(benchmark)
    for block in blocks:
        rows = {(r["item_id"], t) for r in block.toLocalIterator() if (t := normalised(r["text"]))}
        shared = spark.sparkContext.broadcast(sorted(rows, key=str))
        hits = searched(shared)
        if len(blocks) > 1:
            hits = stored(hits)
            shared.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out
