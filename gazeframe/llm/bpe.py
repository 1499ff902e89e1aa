"""Byte-level BPE by speculation: greedy longest tokens, checked pair by pair, merged exactly only where a check fails.

A token sequence is what BPE makes of a word exactly if each adjacent pair of tokens is what BPE makes of the
pair's own bytes. Greedy longest-match proposes a sequence for each new word; one vectorised pass checks all
adjacent pairs of all new words against the merge ranks; the words with a bad pair go through the merges.

Null texts encode as empty ones: no tokens. Texts of any length are taken whole; the words of a text are found
by one linear scan, and a single long word is merged in O(n log n). Repeated words are encoded once and cached
(bounded, see ``CACHE_WORDS``).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

#: Distinct chunks, and characters of them, that a worker remembers; beyond that the memory starts anew (results stay the same).
CACHE_WORDS, CACHE_CHARS = 500_000, 16_000_000
#: A run without white space, with one leading space, or the white space between such runs.
CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Fixed pattern of the byte-level pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = int(np.iinfo(np.int64).max)
NO_MERGE = (NEVER, -1)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: printable Latin-1 is itself, the rest follows U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def numbers(joined: str) -> np.ndarray:
    """Decimal ids joined by commas, as an array."""
    return np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32)


class Vocabulary:
    """Tokens, merge ranks and special strings of a tokenizer file, as arrays that travel to the workers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        if (cut.get("type"), cut.get("add_prefix_space", False), cut.get("use_regex", True)) != ("ByteLevel", False, True) or spec.get("normalizer"):
            raise ValueError("only byte-level files without a normalizer or a prefix space, cut by the usual pattern, are read")
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.tokens: dict[bytes, int] = {raw(s): i for s, i in model["vocab"].items()}
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = 1 + max([*self.tokens.values(), *self.specials.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.tokens.items():
            self.bytes_of[i] = b
        for s, i in self.specials.items():
            self.bytes_of[i] = s.encode()
        self.size = size
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        #: The rank of the merge that makes a token; -1 for single bytes.
        self.born = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (self.tokens[raw(s)] for s in (pair if isinstance(pair, list) else pair.split(" ")))
            made = self.tokens[self.bytes_of[a] + self.bytes_of[b]]
            self.merges[a, b] = (rank, made)
            if self.born[made] < 0:
                self.left[made], self.right[made], self.born[made] = a, b, rank
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        #: The longest token that begins with three given bytes.
        self.reach: dict[bytes, int] = {}
        for b in self.tokens:
            if len(b) > 2:
                self.reach[b[:3]] = max(len(b), self.reach.get(b[:3], 0))


class Codec:
    """Encodes and decodes whole texts; one lives in each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v = vocabulary
        self.pieces = regex.compile(PIECES)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.v.specials, key=len, reverse=True))) + ")") if self.v.specials else None
        self.flat = np.frombuffer(b"".join(self.v.bytes_of), np.uint8)
        self.lengths = np.array([len(b) for b in self.v.bytes_of], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.speculated = self.merged = 0
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, str] = {}
        self.chunks: dict[str, str] = {}
        self.held = 0

    # Speculation

    def propose(self, word: bytes) -> list[int]:
        """The longest vocabulary token at each place, left to right."""
        tokens, reach, out, at, end = self.v.tokens, self.v.reach, [], 0, len(word)
        while at < end:
            n = min(reach.get(word[at : at + 3], 2), end - at)
            while (token := tokens.get(word[at : at + n])) is None:
                n -= 1
            out.append(token)
            at += n
        return out

    # Verification

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves token a before token b as they are; element by element.

        Undoes the two tokens' merges from the last to the first. While the parts that touch at the border
        stand side by side, a merge of the two that ranks before the next merge of either would have come first.
        """
        v, n = self.v, len(a)
        x, y = a.astype(np.int64), b.astype(np.int64)
        until = np.full(n, NEVER)  # the pair at the border must not merge before this rank
        ok, live = np.ones(n, bool), np.arange(n)
        while live.size:
            p, q = x[live], y[live]
            key = p * v.size + q
            at = np.minimum(np.searchsorted(v.pair_keys, key), v.pair_keys.size - 1)
            rank = np.where(v.pair_keys[at] == key, v.pair_ranks[at], NEVER)
            bad = rank < until[live]
            ok[live[bad]] = False
            live, p, q = live[~bad], p[~bad], q[~bad]
            bp, bq = v.born[p], v.born[q]
            more = (bp >= 0) | (bq >= 0)
            live, p, q, bp, bq = live[more], p[more], q[more], bp[more], bq[more]
            # Of equal ranks the left merge comes first, so the right one is undone first.
            first = bp > bq
            until[live] = np.where(first, bp, bq + 1)
            x[live] = np.where(first, v.right[p], p)
            y[live] = np.where(first, q, v.left[q])
        return ok

    # Exact merging

    def merge(self, word: bytes) -> list[int]:
        """The merges themselves, lowest rank first and leftmost first, over a linked list with a heap."""
        part: list[int | None] = [self.v.tokens[word[i : i + 1]] for i in range(len(word))]
        n, merges = len(part), self.v.merges
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m[0], i, part[i], part[i + 1]) for i in range(n - 1) if (m := merges.get((part[i], part[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = merges[a, b][1], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((part[i], part[k])):
                    heapq.heappush(heap, (m[0], i, part[i], part[k]))
            if (h := before[i]) >= 0 and (m := merges.get((part[h], part[i]))):
                heapq.heappush(heap, (m[0], h, part[h], part[i]))
        return [x for x in part if x is not None]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokenized words: proposals, one check of all their pairs, merges for those that fail."""
        proposed = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        keys, back = np.unique(flat[inside] * self.v.size + flat[inside + 1], return_inverse=True)
        fine = self.compatible(keys // self.v.size, keys % self.v.size)
        failed = np.unique(owner[inside[~fine[back]]])
        # A proposed token stands only if the merges make it of its own bytes; multi-byte ones without a merge do not.
        failed = np.union1d(failed, np.unique(owner[(self.v.born[flat] < 0) & (self.lengths[flat] > 1)])).astype(int)
        for i in failed:
            proposed[i] = self.merge(words[i])
        self.speculated += len(words)
        self.merged += len(failed)
        return proposed

    # Texts

    def _chunks(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python's patterns alone
            return self.pieces.findall(text)
        return CHUNKS.findall(text)

    def parts(self, text: str) -> list[str]:
        """The chunks of a text in order; special strings stand alone."""
        if self.special is None or not any(s in text for s in self.v.specials):
            return self._chunks(text)
        out = []
        for piece in self.special.split(text):
            out += [piece] if piece in self.v.specials else self._chunks(piece)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that are new and remember their ids as decimal text."""
        known, words, specials = self.chunks, self.words, self.v.specials
        new = [c for c in chunks if c not in known]
        split = [() if c in specials else self.pieces.findall(c) for c in new]
        if fresh := list({w for parts in split for w in parts if w not in words}):
            ids = self.encode_words([w.encode("utf-8", "replace") for w in fresh])
            words.update(zip(fresh, (",".join(map(str, x)) for x in ids), strict=True))
        self.held += sum(map(len, new))
        for c, parts in zip(new, split, strict=True):
            known[c] = words[parts[0]] if len(parts) == 1 else ",".join([words[w] for w in parts]) if parts else str(specials[c])

    def encode_batch(self, texts: list[str | None]) -> list[str]:
        """For each text its decimal ids joined by commas."""
        split = [self.parts(t) if t else [] for t in texts]
        if len(self.chunks) > CACHE_WORDS or self.held > CACHE_CHARS:
            self._forget()
        self.learn(set().union(*split))
        known = self.chunks
        return [",".join([known[c] for c in parts]) for parts in split]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        return numbers(self.encode_batch([text])[0])

    def decode(self, ids) -> bytes:
        """The bytes of a token sequence."""
        ids = np.asarray(ids, np.int64)
        if not ids.size:
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)].tobytes()


def encode_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, input_ids of every row of ``docs``.

    The vocabulary has a fixed size and is broadcast; each partition is encoded in bounded Arrow batches, without
    a shuffle. Other columns of ``docs`` are left out. Every row counts, repeated ids as well.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(tokenizer_path))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("input_ids", pa.list_(pa.int32()))] * with_ids

    def encode(batches):
        codec = Codec(shared.value)
        for batch in batches:
            joined = codec.encode_batch(batch.column(1).to_pylist())
            ids = [numbers(s) for s in joined]
            columns = [batch.column(0), [len(x) for x in ids], [hashlib.sha256(s.encode()).hexdigest() for s in joined], [hashlib.sha256(codec.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in ids]]
            columns += [ids] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c.cast(t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", input_ids array<int>" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(encode, schema)
