"""Quality scores from histogram gradient-boosted trees over document statistics.

One pass over a whole text gives some thirty statistics of its characters, words and lines. Trees are grown on
binned statistics by second-order boosting of the logistic loss, then flattened into parallel arrays, so that a
batch of documents walks all levels of a tree with one numpy gather for each level.

Defined cases: null and empty texts have all-zero statistics and get a score like any other; repeated rows are
scored each by itself; ids, language and source never enter a score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_remainder

#: Bound of the labelled rows that a model is fitted on.
MAX_TRAINING_ROWS = 20_000

_UPPER, _LOWER, _DIGIT, _SPACE, _POINT, _MARK, _HIGH = range(7)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _MARK, np.uint8)
    for chars, kind in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("abcdefghijklmnopqrstuvwxyz", _LOWER), ("0123456789", _DIGIT), (" \t\n\r\x0b\x0c", _SPACE), (".,;:!?'\"()-", _POINT)):
        out[[ord(c) for c in chars]] = kind
    out[128:] = _HIGH
    return out


CLASSES = _byte_classes()
FEATURES = (
    "log_bytes log_words log_lines upper lower digit point mark high mean_word sd_word long_words unique_words top_word repeated_pairs repeated_triples "
    "shouted marked_words lone_marks ended_words title_words repeated_lines mean_line sd_line ended_lines short_lines longest_run exclamations bars hashes symbols_per_word digits_per_word"
).split()


def statistics(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for one whole text."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(CLASSES[data], minlength=7) / data.size
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    triples = len(set(zip(words, words[1:], words[2:])))
    shouted = sum(map(str.isupper, words))
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?)'\"" for w in words)
    lone = sum(len(w) == 1 and not w.isalnum() for w in words)
    ended = sum(w[-1] in ".,;:!?" for w in words)
    title = sum(w[0].isupper() for w in words)
    lines = [x for x in text.split("\n") if x.strip()]
    line_sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ended_lines = sum(x.rstrip()[-1] in ".!?" for x in lines)
    runs = np.flatnonzero(np.fromiter((a != b for a, b in zip(words, words[1:])), bool, n - 1)) if n > 1 else np.empty(0)
    longest = int(np.diff(np.concatenate(([-1], runs, [n - 1]))).max())
    return [
        np.log1p(data.size), np.log1p(n), np.log1p(len(lines)),
        kinds[_UPPER], kinds[_LOWER], kinds[_DIGIT], kinds[_POINT], kinds[_MARK], kinds[_HIGH],
        sizes.mean(), sizes.std(), float((sizes > 15).mean()),
        len(counts) / n, max(counts.values()) / n, 1 - pairs / max(1, n - 1), 1 - triples / max(1, n - 2),
        shouted / n, marked / n, lone / n, ended / n, title / n,
        1 - len(set(lines)) / len(lines), line_sizes.mean(), line_sizes.std(), ended_lines / len(lines), float((line_sizes < 20).mean()),
        longest / n, text.count("!") / n, text.count("|") / n, text.count("#") / n, kinds[_MARK] * data.size / n, kinds[_DIGIT] * data.size / n,
    ]


@dataclass
class Forest:
    """All trees in flat arrays: node i of tree t tests ``feature[t, i] <= cut[t, i]``; children are 2i + 1 and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 3.0) -> Forest:
    """Second-order boosting over histograms of ``bins`` quantile bins; leaves of less hessian weight than ``least`` aren't split off."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1).astype(np.int64)
    rate_1 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate_1 / (1 - rate_1)))
    margin = np.full(n, start)
    inner = 2**depth - 1
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), depth, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within its level
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-6)
            sg, sh = np.bincount(node, g, width), np.bincount(node, h, width)
            base = sg**2 / (sh + ridge)
            split = np.full(width, bins)
            for j in range(k):
                at = node * bins + binned[:, j]
                gl = np.bincount(at, g, width * bins).reshape(width, bins).cumsum(1)
                hl = np.bincount(at, h, width * bins).reshape(width, bins).cumsum(1)
                gr, hr = sg[:, None] - gl, sh[:, None] - hl
                gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - base[:, None], 0)
                b = gain.argmax(1)
                better = gain[np.arange(width), b] > best
                best[better] = gain[np.arange(width), b][better]
                split[better] = b[better]
                forest.feature[t, first : first + width][better] = j
                forest.cut[t, first : first + width][better] = [cuts[j][min(i, len(cuts[j]) - 1)] if len(cuts[j]) else np.inf for i in b[better]]
            feature = forest.feature[t, first + node]
            node = 2 * node + (binned[np.arange(n), feature] > split[node])
        leaf = -rate * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + ridge)
        forest.value[t] = leaf
        margin += leaf[node]
    return forest


def _stats_frame(docs: DataFrame, extra: str, extra_type: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [statistics(s) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=[extra, "stats"])

    return docs.mapInArrow(run, f"{extra} {extra_type}, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS, **options) -> Forest:
    """A forest for ``labels.<label>``, from at most ``max_rows`` labelled documents outside the held-out fold.

    The rows are those with the smallest hashes of doc_id and label, so a rerun picks the same ones. Only they are sent to
    the driver, as statistics. Without both labels the forest has no splits and gives the share of label 1.
    """
    bounded_batches(docs.sparkSession)
    id_remainder_ = id_remainder(F.col("doc_id"), 5)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = known.where(F.col("y").isNotNull() & (id_remainder_ != 0)).orderBy(F.xxhash64("doc_id", "y"), "doc_id").limit(max_rows)
    # At most max_rows pairs of numbers: small enough to broadcast whatever the corpus is.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    chosen = chosen.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one text for each, however often an id is repeated
    rows = _stats_frame(chosen.select("y", "text"), "y", "double").toPandas()
    if not len(rows):
        return Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 1, 0.0)
    x, y = np.array(rows["stats"].tolist(), float), rows["y"].to_numpy(float)
    return fit(x, (y > 0).astype(float), **options)


def score_documents(docs: DataFrame, forest: Forest, keep: list[str] | None = None, threshold: float = 0.3, prefix: str = "") -> DataFrame:
    """``docs`` columns in ``keep`` (doc_id by default), then held_out, score and predicted. One pass, no shuffle.

    ``prefix`` stands before the three new names, for tables that have columns of these names.
    """
    bounded_batches(docs.sparkSession)
    keep = keep or ["doc_id"]
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    at = source.columns.index("text")
    kept = [source.schema[c] for c in keep]

    def run(batches):
        for batch in batches:
            rows = np.array([statistics(s) for s in batch.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(forest.score(rows))], names=[*keep, f"{prefix}score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    scored = source.mapInArrow(run, StructType([*kept, StructField(f"{prefix}score", DoubleType())]))
    held = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    score = F.col(f"{prefix}score")
    return scored.select(*keep, held.alias(f"{prefix}held_out"), score, (score >= threshold).cast("int").alias(f"{prefix}predicted"))
