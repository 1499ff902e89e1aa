"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Components are turned into integers, so that all engines agree. Candidates and queries are dealt into blocks of
bounded size; for each pair of blocks one task walks the terms (dimensions), scatters the query rows' weights
times the term's postings into a dense score array, and selects the k best of each query by partition. The
selections of all candidate blocks are merged with a window over each query.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do rows without an
id; vectors may differ in length (missing terms count as zero); rows with the query's own id are its own and are
no candidates; equal scores go to the smaller id, repeated candidate rows of one id each count, a repeated query row
is one query, and query rows of one id with different vectors are queries of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block; a task holds one block of candidates, one of queries and a tile of scores.
CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 2048
#: Query rows whose dense score arrays are held at once.
TILE = 64


def whole_components(column):
    """floor(256 x) of each component as bigint; null for a vector that takes no part."""
    x = F.transform(column, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(column.isNotNull() & fine, F.transform(x, lambda v: F.floor(v * 256).cast("bigint")))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = rows.flatten().to_numpy(zero_copy_only=False), np.diff(rows.offsets.to_numpy())
    width = int(ends.max(initial=0))
    if (ends == width).all():
        return flat.reshape(len(rows), width).astype(np.int64)
    out = np.zeros((len(rows), width), np.int64)
    at = np.repeat(np.arange(len(rows)), ends)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def block_top(query_ids, queries: np.ndarray, ids, vectors: np.ndarray, k: int):
    """The k best candidates of a block for each query: (query index, candidate id, score)."""
    width = min(queries.shape[1], vectors.shape[1])
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, width)
    kind = np.int32 if bound < 2**31 else np.int64
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    # Postings of each term: where it isn't zero, and with what weight.
    postings = []
    for d in range(width):
        column = vectors[:, d].astype(kind)
        at = np.flatnonzero(column)
        postings.append((slice(None), column) if at.size > 0.3 * len(ids) else (at, column[at]))
    out_q, out_id, out_s = [], [], []
    for first in range(0, len(queries), TILE):
        tile = queries[first : first + TILE].astype(kind)
        scores = np.zeros((len(tile), len(ids)), kind)
        for d, (at, weights) in enumerate(postings):
            for i in np.flatnonzero(tile[:, d]):
                scores[i, at] += tile[i, d] * weights
        for i, row in enumerate(scores):
            others = np.flatnonzero(ids != query_ids[first + i])
            s = row[others]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                above = np.flatnonzero(s > least)
                # Ids ascend, so the first of the equal scores are those with the smallest ids.
                at = np.concatenate((above, np.flatnonzero(s == least)[: k - len(above)]))
            else:
                at = np.arange(len(s))
            out_q += [first + i] * len(at)
            out_id.append(ids[others[at]])
            out_s.append(s[at].astype(np.int64))
    return np.array(out_q, np.int64), np.concatenate(out_id) if out_id else np.empty(0, np.int64), np.concatenate(out_s) if out_s else np.empty(0, np.int64)


def top_matches(vectors: DataFrame, queries: DataFrame, k: int = 5, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of ``vectors`` for each row of ``queries`` (both: vec_id, embedding)."""
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        out = df.select(F.col("vec_id").cast("long").alias("id"), whole_components(F.col("embedding")).alias("v"))
        return out.where(F.col("id").isNotNull() & F.col("v").isNotNull())

    candidates, asked = usable(vectors), usable(queries).dropDuplicates(["id", "v"])
    n_c = max(1, -(-vectors.count() // candidate_block))
    n_q = max(1, -(-asked.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Each candidate block meets each query block once; ids with few distinct values still spread by content.
    c = candidates.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(n_c)).cast("int").alias("cb"), every(n_q).alias("qb"))
    q = asked.select("id", "v", F.xxhash64("v").alias("of"), F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int").alias("qb"), every(n_c).alias("cb"))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            ids = left.column("id").to_numpy()
            at, found, score = block_top(ids, _matrix(left.column("v")), right.column("id").to_numpy(), _matrix(right.column("v")), k)
        else:
            ids = at = found = score = np.empty(0, np.int64)
        of = left.column("of").to_numpy()[at] if len(at) else at
        return pa.table({"query_id": pa.array(ids[at], pa.int64()), "of": pa.array(of, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})

    parts = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(both, "query_id long, of long, vec_id long, score long")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
