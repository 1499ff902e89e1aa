import hashlib
import random

import numpy as np
import pytest

from gazeframe.llm import bpe
from gazeframe.llm.queries import TOKENIZER_PATH

tokenizers = pytest.importorskip("tokenizers")
TEXTS = ["", None, "  a  b\n\n c\t\td  ", "<|endoftext|>x<|endoftext|>", "a\x1cb\xa0c d　e", "don't we're I'LL 's 't ''s", "a" * 3000, "日本語 🙂🙂 é", "x y " * 5000, "\n", "same", "same"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Vocabulary(TOKENIZER_PATH))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(TOKENIZER_PATH)


def test_ids_equal_the_library(codec, library):
    r = random.Random(1)
    texts = [t for t in TEXTS if t is not None] + ["".join(r.choice("abcdeE Th'1290 \n\tñé#$% \x85\x1d日") for _ in range(r.randrange(120))) for _ in range(500)]
    got = [bpe.numbers(s).tolist() for s in codec.encode_batch(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [codec.decode(i).decode() for i in got] == texts


def test_speculation_and_merging_agree(codec):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefst", k=r.randrange(1, 25))).encode() for _ in range(2000)]
    before = codec.merged
    assert codec.encode_words(words) == [codec.merge(w) for w in words]
    assert 0 < codec.merged - before < len(words)


def test_pairs_are_compatible_exactly_if_merging_keeps_them(codec):
    r = np.random.default_rng(3)
    a, b = r.integers(0, 5000, 3000), r.integers(0, 5000, 3000)
    want = [codec.merge(codec.v.bytes_of[x] + codec.v.bytes_of[y]) == [x, y] for x, y in zip(a, b, strict=True)]
    assert codec.compatible(a, b).tolist() == want


def test_short_cache_gives_the_same(codec, monkeypatch):
    want = codec.encode_batch(["one two three"] * 2)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 0)
    assert codec.encode_batch(["one two three"] * 2) == want


def test_documents(spark, docs_of, library):
    out = bpe.encode_documents(docs_of(TEXTS), TOKENIZER_PATH, with_ids=True).orderBy("doc_id").collect()
    assert len(out) == len(TEXTS)
    for r, t in zip(out, TEXTS, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["input_ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs_of([]), TOKENIZER_PATH).count() == 0


def test_other_formats_are_refused(tmp_path):
    import json

    (tmp_path / "t.json").write_text(json.dumps({"pre_tokenizer": {"type": "Whitespace"}, "model": {"vocab": {}, "merges": []}}))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "t.json"))


def test_a_small_memory_gives_the_same(monkeypatch):
    texts = ["long " + "x" * 5000, "some words here", "x" * 3000 + " y", "some words here"]
    want = [bpe.Codec(bpe.Vocabulary(TOKENIZER_PATH)).encode(t).tolist() for t in texts]
    monkeypatch.setattr(bpe, "CACHE_CHARS", 10)
    codec = bpe.Codec(bpe.Vocabulary(TOKENIZER_PATH))
    assert [codec.encode(t).tolist() for t in texts] == want
