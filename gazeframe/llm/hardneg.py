"""Hard negatives by a best-first search of STR-packed R-trees.

Vectors become integers, floor(256 x) of each component. The rows are dealt into blocks of bounded size, and each task
packs the block's rows of a label into an R-tree: sort by the coordinate that varies most, cut into slabs, and so on
with the next coordinates inside the slabs (sort-tile-recursive), then boxes of boxes. The minimum bounding box of a
node bounds each term of an inner product from both sides, and the sums bound the scores of all rows below it. A queue
opens the box with the highest upper bound first; a box is passed over when it lies outside all score windows or is
strictly below the k-th score found. Each task returns its k best rows for an anchor, a window over each anchor merges
those of all blocks. First the positives of all anchors are found, then the negatives inside the windows they give.

Defined cases: rows without an id, a label or a vector, or with a null or non-finite component, take no part; vectors may
differ in length (missing terms count as zero); rows with the anchor's own id are its own and neither positives nor
negatives; repeated rows each count; equal anchor rows are one anchor, those of one id with another vector or label are
anchors of their own; equal scores go to the smaller id; a positive score below zero leaves no window; an empty table or
an anchor without positives gives no rows. Sums are exact at any size; a score beyond 64 bits is given as the nearest
64-bit number. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Components of a block of candidates and of a block of anchors, and the most rows of either.
CELLS, CANDIDATE_BLOCK, ANCHOR_BLOCK = 4_000_000, 8192, 1024
#: Rows of a leaf box, boxes of a node.
LEAF, FANOUT = 128, 16
LONG = 2**63 - 1


@dataclass
class Wanted:
    """Scores from ``low`` to ``high`` are wanted, the ``k`` best of them: what was found so far, best first."""

    low: float
    high: float
    k: int
    scores: list = field(default_factory=list)
    ids: list = field(default_factory=list)

    @property
    def need(self):
        """A score below this can't be among the k best."""
        return self.scores[-1] if len(self.scores) == self.k else self.low

    def wants(self, upper, lower, least_id: int) -> bool:
        """Whether a box with these bounds and ids from ``least_id`` may hold a row to be found."""
        if upper < self.need or lower > self.high:
            return False
        return len(self.scores) < self.k or upper > self.scores[-1] or least_id < self.ids[-1]

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero((scores >= self.need) & (scores <= self.high))
        if at.size:
            new = zip(scores[at].tolist(), ids[at].tolist(), strict=True)
            both = sorted([*zip(self.scores, self.ids, strict=True), *new], key=lambda x: (-x[0], x[1]))[: self.k]
            self.scores, self.ids = [s for s, _ in both], [i for _, i in both]


def tiles(vectors: np.ndarray, rows: np.ndarray, by: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """``rows`` in tiles of at most ``leaf``: slabs by the first coordinate of ``by``, cut again by the next ones."""
    if len(rows) <= leaf:
        return [rows]
    pages = -(-len(rows) // leaf)
    slabs = max(2, int(np.ceil(pages ** (1 / len(by))))) if len(by) > 1 else pages
    size = leaf * -(-pages // slabs)
    ordered = rows[np.argsort(vectors[rows, by[0]], kind="stable")] if len(by) else rows
    return [t for first in range(0, len(rows), size) for t in tiles(vectors, ordered[first : first + size], by[1:] if len(by) > 1 else by, leaf)]


class Tree:
    """The packed boxes of a block, which has rows: one tree for each label, level by level from the leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        packs, kinds = [], []
        spread = np.argsort(-vectors.astype(float).var(axis=0), kind="stable") if vectors.size else np.arange(vectors.shape[1])
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            deep = max(1, int(np.ceil(np.log2(max(2, -(-len(mine) // leaf))))))
            packed = tiles(vectors, mine, spread[:deep], leaf) if vectors.shape[1] else [mine[i : i + leaf] for i in range(0, len(mine), leaf)]
            packs += packed
            kinds += [label] * len(packed)
        order, ends = np.concatenate(packs), np.cumsum([0, *map(len, packs)])
        self.ids, self.vectors, self.ends = ids[order], vectors[order], ends
        low = np.minimum.reduceat(self.vectors, ends[:-1])
        high = np.maximum.reduceat(self.vectors, ends[:-1])
        least = np.minimum.reduceat(self.ids, ends[:-1])
        #: (low, high, least id, label, first child of each box and the end of the last) of each level.
        self.levels = [(low, high, least, np.array(kinds), None)]
        while True:
            low, high, least, kinds, _ = self.levels[-1]
            begins = np.unique(kinds, return_index=True)[1]
            if len(begins) == len(kinds):
                break
            spans = zip(begins.tolist(), [*begins[1:].tolist(), len(kinds)], strict=True)
            first = [i for a, b in spans for i in range(a, b, fanout)]
            self.levels.append((np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.minimum.reduceat(least, first), kinds[first], np.array([*first, len(kinds)])))

    def search(self, anchor: np.ndarray, own_id: int, wanted_label, windows: list[Wanted]) -> int:
        """Fill ``windows`` with the rows of the labels that ``wanted_label`` accepts; returns how many leaves were opened."""
        plus, minus = np.maximum(anchor, 0), np.minimum(anchor, 0)
        opened, queue = 0, []

        def push(level: int, first: int, end: int) -> None:
            low, high, least, _, _ = self.levels[level]
            upper = high[first:end] @ plus + low[first:end] @ minus
            lower = low[first:end] @ plus + high[first:end] @ minus
            for i, (up, lo, at_least) in enumerate(zip(upper.tolist(), lower.tolist(), least[first:end].tolist(), strict=True), first):
                if any(w.wants(up, lo, at_least) for w in windows):
                    heapq.heappush(queue, (-up, level, i, lo, at_least))

        top = len(self.levels) - 1
        for i in np.flatnonzero(wanted_label(self.levels[top][3])).tolist():
            push(top, i, i + 1)
        while queue:
            up, level, i, lo, at_least = heapq.heappop(queue)
            if not any(w.wants(-up, lo, at_least) for w in windows):
                if -up < min(w.need for w in windows):
                    break  # all that is left lies lower still
                continue
            if level:
                push(level - 1, int(self.levels[level][4][i]), int(self.levels[level][4][i + 1]))
                continue
            opened += 1
            a, b = self.ends[i], self.ends[i + 1]
            scores, ids = self.vectors[a:b] @ anchor, self.ids[a:b]
            if (own := ids == own_id).any():
                scores, ids = scores[~own], ids[~own]
            best = max(scores.tolist(), default=None)
            for w in windows:
                if best is not None and best >= w.need:
                    w.take(scores, ids)
        return opened


def whole(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(256 x) of the lists in ``column``, as doubles; short ones end in zeros. Beyond 64 bits: the nearest number."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(flat * 256), -float(2**63), float(2**63))
    sizes = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), width))
    at = np.repeat(np.arange(len(rows)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact_kind(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where every sum of products is exact in them; else as Python's own whole numbers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**52:
        return a, b
    return tuple(np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object) for x in (a, b))


def score_window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * positive <= 100 s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _search(asked: DataFrame, rows: DataFrame, n_q: int, n_c: int, width: int, k: int, same: bool, share: tuple[int, int]) -> DataFrame:
    """k best rows of each block for each row of ``asked`` (id, key, label, v, positives): id, key, positive_id, positive_score, vec_id, score."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Columns of their own: both sides come from the same rows.
    c = rows.select(*[F.col(n).alias(f"c_{n}") for n in ("id", "label", "v")], F.pmod(F.xxhash64("id", "v"), F.lit(n_c)).cast("int").alias("cb"), every(n_q).alias("qb"))
    q = asked.select("id", "key", "label", "v", "positives", F.pmod(F.xxhash64("id", "key"), F.lit(n_q)).cast("int").alias("qb"), every(n_c).alias("cb"))
    schema = pa.schema([(n, pa.int64()) for n in ("id", "key", "positive_id", "positive_score", "vec_id", "score")])

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            anchors, vectors = exact_kind(whole(left.column("v"), width), whole(right.column("c_v"), width))
            tree = Tree(right.column("c_id").to_numpy(), right.column("c_label").to_numpy(), vectors)
            for i, row in enumerate(left.drop_columns(["v"]).to_pylist()):
                if same:
                    spans = [(None, Wanted(float("-inf"), float("inf"), k))]
                    fits = lambda kinds, mine=row["label"]: kinds == mine
                else:
                    spans = [(p, Wanted(*score_window(p["positive_score"], *share), k)) for p in row["positives"]]
                    fits = lambda kinds, mine=row["label"]: kinds != mine
                if live := [w for _, w in spans if w.low <= w.high]:
                    tree.search(anchors[i], row["id"], fits, live)
                for p, w in spans:
                    out += [(row["id"], row["key"], p and p["positive_id"], p and p["positive_score"], v, max(-LONG - 1, min(LONG, int(s)))) for v, s in zip(w.ids, w.scores, strict=True)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 6)], schema=schema)

    fields = ", ".join(f"{n} long" for n in schema.names)
    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(both, fields)


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor and each of its positives.

    ``vectors``: vec_id, embedding, label; ``anchors`` marks its anchors, ``label`` replaces the label (over vec_id and
    label). Negatives score from share[0] to share[1] per cent of the positive.
    """
    spark = vectors.sparkSession
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col("embedding").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    asked = rows.where("anchor").select("id", F.xxhash64("v", "label").alias("key"), "label", "v").dropDuplicates(["id", "key", "label", "v"])
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_asked = asked.count()
    per = lambda most: max(1, min(most, CELLS // max(1, width)))
    n_c, n_q = max(1, -(-n // per(CANDIDATE_BLOCK))), max(1, -(-n_asked // per(ANCHOR_BLOCK)))

    none = F.lit(None).cast("array<struct<positive_id:long,positive_score:long>>").alias("positives")
    found = _search(asked.withColumn("positives", none), rows, n_q, n_c, width, positives, True, share)
    best = Window.partitionBy("id", "key").orderBy(F.desc("score"), "vec_id")
    kept = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives)
    # A handful of rows for each anchor; stored, as the next search reads them. Equal positives are searched for once.
    given = stored(kept.groupBy("id", "key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).agg(F.count("*").cast("int").alias("times")))
    pairs = given.groupBy("id", "key").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    hard = _search(asked.join(pairs, ["id", "key"]), rows, n_q, n_c, width, negatives, False, share)
    by = ["id", "key", "positive_id", "positive_score"]
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= negatives)
    out = ranked.join(given, by).withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
