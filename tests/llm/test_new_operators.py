"""Merkle manifest, hard negatives and chunked BPE against brute force and the library."""

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeframe.llm import chunkbpe, hardneg, merkle
from gazeframe.llm.queries import RANKS_PATH, RANKS_PATTERN

# Merkle manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def climb(tree, at, now):
    """Siblings of a leaf, and the root that ``now`` in its place gives."""
    beside = ""
    for level in tree[:-1]:
        first = at // 16 * 16
        left, right = "".join(level[first:at]), "".join(level[at + 1 : first + 16])
        beside, now, at = beside + left + right, sha(left + now + right), at // 16
    return beside, now


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if bad else r[4]
            one, sub = climb(trees[s], i, leaf((*r[:4], text)))
            two, root = climb(top, g, sub)
            out.append((r[0], r[1], leaf(r), trees[s][-1][0], top[-1][0], sha(one + two), root, root == top[-1][0]))
    return sorted(out, key=repr)


def manifest(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, i int, digest string, n int")
    got = merkle.manifest(df, tampered=merkle.every_fifth(F.col("doc_id"))).select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted([tuple(r) for r in got.collect()], key=repr)


def test_manifest_equals_one_made_by_hand(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["hot", "hot", "hot", None, "b", "ä"]), r.choice(["en", None]), r.choice([i, None]), r.choice(["Text With Capitals", "", None, "ÄÖ only", "lower"])) for i in range(700)]
    rows += [(5, "hot", None, 3, "Same Row")] * 30 + [(None, "b", "en", 1, "No Id"), (None, "b", "en", 1, "no id"), (999, "lone", "en", 1, "One Leaf")]
    got = manifest(spark, rows)
    assert got == by_hand(rows)
    assert {True, False} == {t[-1] for t in got}


@pytest.mark.parametrize("n", [0, 1, 16, 17, 256, 257])
def test_manifest_of_single_sources(spark, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert manifest(spark, rows) == by_hand(rows)


def test_more_sources_than_a_block(spark):
    rows = [(i, f"s{i % 300}", "en", i, "Long " * (i % 3)) for i in range(320)]
    assert manifest(spark, rows) == by_hand(rows)


def test_native_manifest(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    plan = merkle.manifest(df)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# Hard negatives


def mined_by_hand(rows, every=10, positives=3, negatives=4, share=(30, 90)):
    fine = [(i, y, [int(np.floor(float(np.float32(x)) * 256)) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, y, v in dict.fromkeys((i, y, tuple(v)) for i, y, v in fine if i % every == 0):
        found = sorted((-score(v, w), j) for j, z, w in fine if z == y and j != i)[:positives]
        for s, p in found:
            inside = sorted((-score(v, w), j) for j, z, w in fine if z != y and j != i and share[0] * -s <= 100 * score(v, w) <= share[1] * -s)[:negatives]
            out += [(i, p, k, j, -s, -t) for k, (t, j) in enumerate(inside, 1)]
    return sorted(out)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 1, 2) for i, v, y in rows], "vec_id long, embedding array<float>, label int, id int, score int")


def mined(spark, rows, **how):
    out = hardneg.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0, positives=3, negatives=4, **how)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CANDIDATE_BLOCK", 90)
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", 7)
    r = np.random.default_rng(2)
    rows = [(i, np.round(r.normal(size=6), 1), int(r.integers(0, 4))) for i in range(250)]
    rows += [(i, rows[3][1], int(i % 4)) for i in range(250, 330)]  # one vector in many rows: ties
    rows += [rows[20], rows[20], rows[31], (20, rows[5][1], 1), (None, rows[1][1], 1), (340, None, 1), (350, [1.0, None], 1), (360, [float("nan")] * 6, 1), (370, [float("inf")] * 6, 0), (380, rows[2][1], None), (390, rows[2][1][:3], 2), (400, [], 2), (410, rows[9][1], 77)]
    got = mined(spark, rows)
    assert got == mined_by_hand(rows)
    assert len(got) > 100


def test_no_rows_and_large_numbers(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    big = [(0, [3e18, 1.0], 1), (1, [3e18, 0.0], 1), (2, [1.5e18, 0.0], 2), (3, [1.0, 0.5], 2)]
    out = mined(spark, big)
    assert all(abs(x) < 2**63 for t in out for x in t)
    exact = [(0, [2.0**22, 1.0], 1), (1, [2.0**22, 0.25], 1), (2, [2.0**21, 0.5], 2), (3, [1.0, 0.5], 2)]
    assert mined(spark, exact) == mined_by_hand(exact) == [(0, 1, 1, 2, 2**60 + 2**14, 2**59 + 2**15)]


def tree_of(seed=4, n=900, d=8):
    r = np.random.default_rng(seed)
    vectors = np.floor(r.normal(size=(n, d)) * 20)
    return r, np.arange(n), r.integers(0, 3, n), vectors, hardneg.Tree(np.arange(n), np.sort(r.integers(0, 3, n)), vectors, leaf=16, fanout=4)


def test_boxes_hold_their_rows_and_bound_their_scores():
    r, ids, _, _, tree = tree_of()
    low, high = tree.levels[0][:2]
    assert len(np.unique(tree.ids)) == len(ids) and max(np.diff(tree.ends)) <= 16
    for q in np.floor(r.normal(size=(20, 8)) * 20):
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        for i, (a, b) in enumerate(zip(tree.ends, tree.ends[1:])):
            s = tree.vectors[a:b] @ q
            assert low[i] @ plus + high[i] @ minus <= s.min() and s.max() <= high[i] @ plus + low[i] @ minus


def test_the_queue_leaves_boxes_closed():
    r = np.random.default_rng(6)
    centres = np.floor(r.normal(size=(40, 4)) * 200)
    vectors = np.repeat(centres, 50, axis=0) + np.floor(r.normal(size=(2000, 4)) * 3)
    tree = hardneg.Tree(np.arange(2000), np.zeros(2000, int), vectors, leaf=20, fanout=8)
    for i in range(0, 2000, 171):
        w = hardneg.Wanted(float("-inf"), float("inf"), 5)
        opened = tree.search(vectors[i], -1, lambda kinds: kinds == 0, [w])
        scores = vectors @ vectors[i]
        assert list(zip(w.scores, w.ids, strict=True)) == sorted(zip(scores.tolist(), range(2000), strict=True), key=lambda x: (-x[0], x[1]))[:5]
        assert opened < len(tree.ends) / 3


def test_exact_numbers_where_doubles_are_too_small():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 3.0]])
    x, y = hardneg.exact_kind(a, b)
    assert int((x @ y.T)[0, 0]) == 2**80 + 3
    tree = hardneg.Tree(np.array([1]), np.array([0]), y)
    w = hardneg.Wanted(float("-inf"), float("inf"), 1)
    tree.search(x[0], -1, lambda kinds: kinds == 0, [w])
    assert w.scores == [2**80 + 3]


# Chunked BPE

TEXTS = ["", None, "  a  b\n\n c\t\td  ", "<|endoftext|>x", "a\x1cb\xa0c d　e", "don't we're I'LL 's 't ''s", "a" * 700, "日本語 🙂🙂 é " * 20, "x y " * 400, "\n", " " * 300, "same", "same", "''''ll'll're" * 30, "aß1２³ " * 60, "word " * 30 + "z" * 500 + " end"]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS_PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=RANKS_PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return chunkbpe.Codec(chunkbpe.Ranks(RANKS_PATH, RANKS_PATTERN))


def test_ids_equal_the_library(codec, library):
    r = random.Random(1)
    texts = [t for t in TEXTS if t is not None] + ["".join(r.choice("abcdeE Th'1290 \n\tñé#$% \x85\x1d日ж") for _ in range(r.randrange(120))) for _ in range(500)]
    found = codec.encode_batch(texts)
    assert [ids.tolist() for ids, _ in found] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(ids).decode() for ids, _ in found] == texts
    assert [s for _, s in found] == [",".join(map(str, ids)) for ids, _ in found]


def test_heap_and_list_merge_alike(codec, monkeypatch):
    r = random.Random(7)
    pieces = ["".join(r.choices("abcdefst日", k=r.randrange(1, 30))).encode() for _ in range(1000)]
    want = [codec.merge(p) for p in pieces]
    monkeypatch.setattr(chunkbpe, "SHORT", 0)
    assert [codec.merge(p) for p in pieces] == want


def test_a_long_piece_takes_little_longer_than_its_length(codec):
    piece = ("qwertyuiop" * 20_000).encode()
    began = time.time()
    ids = codec.merge(piece)
    assert b"".join(codec.bytes_of[ids].tolist()) == piece and time.time() - began < 20


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 12), (65, 64), (7, 5), (100_000, 50)])
def test_documents_equal_the_library_however_they_are_cut(spark, docs_of, library, chunk, overlap):
    out = chunkbpe.encode_documents(docs_of(TEXTS), RANKS_PATH, RANKS_PATTERN, chunk, overlap).orderBy("doc_id").collect()
    assert len(out) == len(TEXTS)
    for r, t in zip(out, TEXTS, strict=True):
        ids = library.encode_ordinary(t or "")
        assert r["n_tokens"] == len(ids), (t, chunk)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_repeated_rows_and_empty_tables(spark, docs_of, library):
    text = "some words " * 40
    out = chunkbpe.encode_documents(docs_of([text] * 3, ids=[4, 4, None]), RANKS_PATH, RANKS_PATTERN, 50, 20)
    want = hashlib.sha256(",".join(map(str, library.encode_ordinary(text))).encode()).hexdigest()
    assert [(r["doc_id"], r["ids_sha256"]) for r in out.orderBy(F.col("doc_id").asc_nulls_first()).collect()] == [(None, want), (4, want), (4, want)]
    assert chunkbpe.encode_documents(docs_of([]), RANKS_PATH, RANKS_PATTERN).count() == 0


def test_overlaps_that_disagree_are_cut_again(spark, monkeypatch):
    rounds = []
    kept = chunkbpe.cut
    monkeypatch.setattr(chunkbpe, "cut", lambda texts, chunk, overlap: rounds.append(chunk) or kept(texts, chunk, overlap))
    df = spark.createDataFrame([(1, "y " * 40 + "z" * 500 + " y" * 40), (2, "ab " * 100)], "doc_id long, text string")
    assert chunkbpe.encode_documents(df, RANKS_PATH, RANKS_PATTERN, 40, 10).count() == 2
    assert rounds == [40, 320, 2560]


def test_files_without_all_bytes_are_refused(tmp_path):
    (tmp_path / "r.tiktoken").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        chunkbpe.Ranks(str(tmp_path / "r.tiktoken"), RANKS_PATTERN)
