"""The corpus operators applied to their whole tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunkbpe, decontaminate, hardneg, html, langid, linededup, merkle, neardup, pii, quality, shards, topk
from .common import read



def _tokenizer_path(name: str, setting: str) -> str:
    """The file of a token query: what the environment variable ``setting`` names, or where the public tokenizers' own list has ``name``."""
    if named := os.environ.get(setting):
        return named
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"/opt/tokenizers/{name}"
    return str(public_tokenizers.path(name))


def _pattern() -> str:
    """The pattern that cuts texts before the merges of the rank files: the public tokenizers' own, or the same as the usual one."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return bpe.PIECES
    return public_tokenizers.PATTERN


TOKENIZER_PATH = _tokenizer_path("byte_bpe_50k.json", "GAZEFRAME_TOKENIZER")
RANKS_PATH, RANKS_PATTERN = _tokenizer_path("byte_bpe_multi_50k.tiktoken", "GAZEFRAME_RANKS"), _pattern()


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_documents(read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(read(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), TOKENIZER_PATH)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predict_documents(docs, langid.train(docs))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_shards(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.remove_similar_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed_lines"), "text")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_matches(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"), tampered=merkle.every_fifth(F.col("doc_id")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkbpe.encode_documents(read(spark, sf_dir, "documents"), RANKS_PATH, RANKS_PATTERN)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_minhash_near_dedup, op3_pii, op4_html_extraction, op5_bpe, op6_language_id, op7_sharding, op8_line_dedup, op9_exact_topk, op10_decontamination, op11_merkle_manifest, op12_hard_negatives, op13_chunked_bpe)}

ORACLE_SQL = {
    # The checksum by its table of 256 steps, byte for byte.
    "op7_sharding": """
        WITH RECURSIVE step AS (
            SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS n FROM range(256) t(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8
        ), crcs AS (
            SELECT list(c ORDER BY i) AS t FROM step WHERE n = 8
        ), b AS (
            SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents
        ), o AS (
            SELECT doc_id, CAST(len(bytes) + 16 AS BIGINT) AS size, ('0x' || md5(text)[1:15])::BIGINT AS digest,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, crcs
        ), s AS (
            SELECT *, CAST(sum(size) OVER w AS BIGINT) - size AS start, CAST(sum(size) OVER () AS BIGINT) AS total, row_number() OVER w AS n FROM o
            WINDOW w AS (ORDER BY digest, size, text_crc32, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)
        ), p AS (
            SELECT *, CAST(least(39, (2 * start + size)::HUGEINT * 40 // (2 * total)) AS INTEGER) AS shard FROM s
        )
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
    """,
    # Prefixes by exact counts; the result doesn't depend on the order of words that the join uses.
    "op8_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, text, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
        ), k AS (
            SELECT doc_id, pos, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[ \t\r]+'), lambda x: x <> ''))) AS s FROM l
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS n FROM k WHERE len(s) > 0
        ), sets AS (
            SELECT row_number() OVER (ORDER BY doc_id, pos) AS id, doc_id, pos, s FROM r WHERE n = 1
        ), words AS (
            SELECT id, len(s) AS size, unnest(s) AS w FROM sets
        ), ranked AS (
            SELECT id, w, size, row_number() OVER (PARTITION BY id ORDER BY f, w) AS p FROM words JOIN (SELECT w, count(*) AS f FROM words GROUP BY w) USING (w)
        ), prefix AS (
            SELECT id, w, size FROM ranked WHERE p <= size - ceil(size * 4 / 5.0) + 1
        ), pairs AS (
            SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.w = b.w AND a.id < b.id AND 5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size)
        ), removed AS (
            SELECT doc_id, pos FROM r WHERE n > 1
            UNION
            SELECT y.doc_id, y.pos FROM pairs JOIN sets x ON x.id = a JOIN sets y ON y.id = b
            WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (len(x.s) + len(y.s))
        ), marked AS (
            SELECT l.*, removed.pos IS NOT NULL AS gone FROM l LEFT JOIN removed ON l.doc_id = removed.doc_id AND l.pos = removed.pos
        )
        SELECT doc_id, CAST(CASE WHEN length(any_value(text)) > 0 THEN count(*) ELSE 0 END AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
               coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (gone), '') AS removed_lines,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
        FROM marked GROUP BY doc_id
    """,
    "op9_exact_topk": """
        WITH fine AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
            FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    # A level of a source, and of all subroots, is a list; rows climb the levels by their place. Checksums as in op7.
    "op11_merkle_manifest": """
        WITH RECURSIVE step AS (
            SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS n FROM range(256) t(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8
        ), crcs AS (
            SELECT list(c ORDER BY i) AS t FROM step WHERE n = 8
        ), d AS (
            SELECT *, doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(CAST(coalesce(doc_id, 0) AS VARCHAR), '.'), lambda x: ascii(x)::BIGINT)),
                      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0 AS tampered FROM documents, crcs
        ), v AS (
            SELECT *, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS head,
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM d
        ), l AS (
            SELECT doc_id, source, sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN tampered THEN sha256(array_to_string(head, '') || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS shown FROM v
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER () AS row FROM l
        ), low AS (
            SELECT g, 0 AS lvl, list(leaf ORDER BY i) AS x FROM r GROUP BY g
            UNION ALL SELECT g, lvl + 1, list_transform(range(0, len(x), 16), lambda k: sha256(array_to_string(x[k + 1:k + 16], ''))) FROM low WHERE len(x) > 1
        ), subs AS (
            SELECT g, x[1] AS subroot FROM low WHERE len(x) = 1
        ), high AS (
            SELECT 0 AS lvl, list(subroot ORDER BY g) AS x FROM subs
            UNION ALL SELECT lvl + 1, list_transform(range(0, len(x), 16), lambda k: sha256(array_to_string(x[k + 1:k + 16], ''))) FROM high WHERE len(x) > 1
        ), climb AS (
            SELECT row, lvl AS k, x, i // (16 ** lvl)::BIGINT AS place FROM r JOIN low USING (g) WHERE len(x) > 1
            UNION ALL SELECT row, 100 + lvl, x, g // (16 ** lvl)::BIGINT FROM r, high WHERE len(x) > 1
        ), beside AS (
            SELECT row, row_number() OVER (PARTITION BY row ORDER BY k) AS j, array_to_string(x[place // 16 * 16 + 1:place], '') AS before, array_to_string(x[place + 2:place // 16 * 16 + 16], '') AS after FROM climb
        ), fold AS (
            SELECT row, 0::BIGINT AS j, coalesce(shown, leaf) AS now FROM r
            UNION ALL SELECT fold.row, beside.j, sha256(before || now || after) FROM fold JOIN beside ON beside.row = fold.row AND beside.j = fold.j + 1
        ), proofs AS (
            SELECT row, sha256(string_agg(before || after, '' ORDER BY j)) AS proof_sha256 FROM beside GROUP BY row
        ), ends AS (
            SELECT row, arg_max(now, j) AS folded_root FROM fold GROUP BY row
        )
        SELECT doc_id, source, leaf, subroot, x[1] AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = x[1] AS verified
        FROM r JOIN subs USING (g) JOIN ends USING (row) LEFT JOIN proofs USING (row), high WHERE len(x) = 1
    """,
    "op12_hard_negatives": """
        WITH fine AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
                   CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(c.v)) + 1), lambda i: a.v[i] * c.v[i])), 0) AS BIGINT) AS score
            FROM fine a JOIN fine c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
        ), positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        ), ranked AS (
            SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
            FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        )
        SELECT * FROM ranked WHERE rank <= 10
    """,
}
