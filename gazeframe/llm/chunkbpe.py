"""Byte-level BPE by a rank file over overlapping chunks of the texts.

A text of up to ``CHUNK`` characters is one chunk. A longer one is cut into chunks that overlap, and the chunks are dealt
over all tasks, where each is pre-tokenised from its own start. The pattern looks only ahead, so two pre-tokenisations of
one text that share a boundary agree from there on: a chunk takes over from the one before at the first boundary that
both have in their overlap. Then each chunk's part between its two such boundaries is encoded, again on any task, and the
parts of a text are put together. A text in which some overlap has no common boundary (a word longer than the overlap)
is cut again with chunks eight times as long, until all overlaps agree or the text is one chunk.

Pieces become tokens as a rank file says: the pair of neighbours whose bytes together have the lowest rank merges first,
the leftmost of equal ones; a piece that is itself a token stays one. Decoding joins the tokens' raw bytes.

Defined cases: null texts encode as empty ones: no tokens; texts of any length are taken whole; every row counts, repeated
rows and ids as well, also null ids; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CACHE_CHARS, CACHE_WORDS, CHUNKS
from .common import bounded_batches, stored

#: Characters of a chunk and of what it shares with the next one; how much longer chunks become where overlaps disagree.
CHUNK, OVERLAP, LONGER = 32_768, 256, 8
#: Characters before a cut end that the pattern must have seen to know that a piece ends where it does.
SEEN = 2
#: Bytes up to which looking through all neighbours is quicker than a heap; a rank that no pair has.
SHORT, NEVER = 64, 1 << 62


class Ranks:
    """The tokens of a rank file by their bytes, and the pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = (line.split() for line in f if line.strip())
            self.of = {base64.b64decode(token): int(rank) for token, rank in lines}
        if any(bytes([b]) not in self.of for b in range(256)):
            raise ValueError("a byte-level rank file has all 256 bytes")
        self.pattern = pattern


class Codec:
    """Encodes and decodes stretches of text; one lives in each Python worker."""

    def __init__(self, ranks: Ranks):
        import regex

        self.of = ranks.of
        self.pieces = regex.compile(ranks.pattern)
        self.bytes_of = np.full(1 + max(self.of.values()), b"", object)
        for token, rank in self.of.items():
            self.bytes_of[rank] = token
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.held = 0

    def boundaries(self, text: str) -> np.ndarray:
        """Where pieces end, from the start of ``text``."""
        return np.fromiter((m.end() for m in self.pieces.finditer(text)), np.int32)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: neighbours merge by rank, leftmost first, over a linked list with a heap."""
        of, n = self.of, len(piece)
        if (whole := of.get(piece)) is not None:
            return [whole]
        if n <= SHORT:
            return self._merge_short(piece)
        after, before, heap = [*range(1, n + 1), n], [*range(-1, n)], []
        for i in range(n - 1):
            if (rank := of.get(piece[i : i + 2])) is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            # The entry is a pair still: a part that begins at i and one that ends at end, side by side.
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue
            alive[j], after[i], before[end] = False, end, i
            if end < n and (rank := of.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (rank, i, after[end]))
            if i and (rank := of.get(piece[before[i] : end])) is not None:
                heapq.heappush(heap, (rank, before[i], end))
        return [of[piece[i : after[i]]] for i in range(n) if alive[i]]

    def _merge_short(self, piece: bytes) -> list[int]:
        """The same for a short piece: the least rank of all neighbours, over and over."""
        get, ends = self.of.get, [*range(len(piece) + 1)]
        ranks = [get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            del ends[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(piece[ends[i] : ends[i + 2]], NEVER)
            if i:
                ranks[i - 1] = get(piece[ends[i - 1] : ends[i + 1]], NEVER)
        return [self.of[piece[a:b]] for a, b in pairwise(ends)]

    def learn(self, stretches: set[str]) -> None:
        """Encode new stretches between white space and remember their ids, as numbers and as decimal text."""
        words = self.words
        for stretch in stretches:
            if stretch not in self.known:
                ids: list[int] = []
                for piece in self.pieces.findall(stretch):
                    if (got := words.get(piece)) is None:
                        got = words[piece] = self.merge(piece.encode("utf-8", "replace"))
                    ids += got
                self.known[stretch] = array("i", ids).tobytes(), ",".join(map(str, ids))
                self.held += len(stretch)

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """For each text, which begins and ends at boundaries of pieces, its ids and their decimals joined by commas."""
        # Separators that are white space to one pattern alone: such texts are cut by the pieces' own pattern.
        cut = [(self.pieces if any(c in t for c in "\x1c\x1d\x1e\x1f") else CHUNKS).findall(t) for t in texts]
        if len(self.known) > CACHE_WORDS or self.held > CACHE_CHARS:
            self._forget()
        self.learn(set().union(*cut))
        found = [[self.known[s] for s in stretches] for stretches in cut]
        return [(np.frombuffer(b"".join([raw for raw, _ in x]), np.int32), ",".join([s for _, s in x])) for x in found]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[ids].tolist())


def cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row, doc_id, chunk (from 0), last, ends and piece of each text's chunks, each with what follows it up to ``overlap``.

    ``ends``: the piece reaches the text's end.
    """
    split = texts.select("row", "doc_id", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("parts"))

    def one(part, i):
        after = F.coalesce(F.get("parts", i + 1), F.lit(""))
        left = F.size("parts") - i - 1
        ends = (left == 0) | ((left == 1) & (F.length(after) <= overlap))
        return F.struct(i.alias("chunk"), (left == 0).alias("last"), ends.alias("ends"), F.concat(part, F.left(after, F.lit(overlap))).alias("piece"))

    # Whole pieces are made before the explode, so that its rows don't each hold the text.
    return split.select("row", "doc_id", F.transform("parts", one).alias("pieces")).select("row", "doc_id", F.inline("pieces"))


def _pretokenised(chunks: DataFrame, ranks, chunk: int, overlap: int) -> DataFrame:
    """``chunks`` with the boundaries in the overlap with the one before (``head``) and the next one (``tail``), by their place in either."""

    def run(batches):
        codec = Codec(ranks.value)
        for batch in batches:
            head, tail = [], []
            for piece, ends in zip(batch.column("piece").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                at = codec.boundaries(piece)
                # The next chunk's start is this one's place ``chunk``; its own start is a place, too.
                known = at if ends else at[at <= len(piece) - SEEN]
                head.append([0, *known[known <= overlap].tolist()])
                tail.append((known[known >= chunk] - chunk).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=[*batch.schema.names, "head", "tail"])

    return chunks.mapInArrow(run, "row long, doc_id long, chunk int, last boolean, ends boolean, piece string, head array<int>, tail array<int>")


def _encoded(parts: DataFrame, ranks, digests: bool) -> DataFrame:
    """id columns of ``parts`` (all but text) with n_tokens and either the digests or the ids and the decoded bytes."""
    names = [c for c in parts.columns if c != "text"]

    def run(batches):
        codec = Codec(ranks.value)
        for batch in batches:
            found = codec.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            count = pa.array([len(ids) for ids, _ in found], pa.int64())
            raw = [codec.decode(ids) for ids, _ in found]
            if digests:
                made = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in ([s.encode() for _, s in found], raw)]
            else:
                made = [pa.array([s for _, s in found], pa.string()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), count, *made], names=[*names, "n_tokens", "ids", "decoded"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name in names)
    return parts.select(*names, "text").mapInArrow(run, f"{kept}, n_tokens long, ids string, decoded {'string' if digests else 'binary'}")


def _long(texts: DataFrame, ranks, chunk: int, overlap: int) -> DataFrame | None:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the texts (row, doc_id, text) that have several chunks; None for none."""
    done = None
    while True:
        dealt = cut(texts, chunk, overlap).repartition("row", "chunk")
        spans = stored(_pretokenised(dealt, ranks, chunk, overlap))
        of_text = Window.partitionBy("row").orderBy("chunk")
        borders = spans.select("row", "chunk", "last", "head", F.lag("tail").over(of_text).alias("before"))
        begins = F.when(F.col("chunk") == 0, 0).otherwise(F.array_min(F.array_intersect("head", "before")))
        borders = borders.select("row", "chunk", begins.alias("first")).withColumn("next", F.lead("first").over(of_text))
        joins = stored(borders.withColumn("apart", F.max(F.col("first").isNull().cast("int")).over(Window.partitionBy("row"))))
        agreed = spans.join(joins.where("apart = 0"), ["row", "chunk"])
        until = F.when(F.col("last"), F.length("piece")).otherwise(F.col("next") + chunk)
        parts = agreed.select("row", "doc_id", "chunk", F.substring("piece", F.col("first") + 1, until - F.col("first")).alias("text"))
        whole = _encoded(parts, ranks, digests=False).groupBy("row", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("chunk", "ids", F.col("decoded").cast("string").alias("decoded")))).alias("x"))
        # A part is empty where a chunk's whole range lies inside one piece.
        ids = F.array_join(F.filter(F.col("x.ids"), lambda s: s != ""), ",")
        out = whole.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.array_join("x.decoded", ""), 256).alias("decoded_sha256"))
        done = out if done is None else done.unionByName(out)
        rest = spans.join(joins.where("apart = 1").select("row", "chunk"), ["row", "chunk"])
        if joins.where("apart = 1").isEmpty():
            return done
        part = F.when(F.col("last"), F.col("piece")).otherwise(F.left("piece", F.lit(chunk)))
        again = rest.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", part.alias("part")))).alias("x"))
        texts, chunk, overlap = again.select("row", "doc_id", F.array_join("x.part", "").alias("text")), chunk * LONGER, overlap * LONGER


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``. The ranks have a fixed size and are broadcast."""
    if not 2 * SEEN < overlap < chunk:
        raise ValueError("an overlap is longer than four characters and shorter than a chunk")
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(Ranks(ranks_path, pattern))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = _encoded(texts.where(F.length("text") <= chunk), ranks, digests=True)
    short = short.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
    # The number of a row is made once, in the job that stores the chunks.
    long = _long(texts.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), ranks, chunk, overlap)
    return short.unionByName(long)
