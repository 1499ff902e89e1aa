"""Quality and language: models on small corpora, odd rows."""

import random
import zlib

import numpy as np

from gazeframe.llm import langid, quality


def test_forest_learns_and_scores_in_range():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x[:1500], y[:1500])
    s = forest.score(x[1500:])
    assert s.min() >= 0 and s.max() <= 1 and ((s > 0.5) == y[1500:]).mean() > 0.95


def test_flat_trees_equal_a_walk():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(300, 3)), r.integers(0, 2, 300).astype(float)
    f = quality.fit(x, y, trees=5)
    for row, got in zip(x[:50], f.score(x[:50]), strict=True):
        total = f.start
        for feature, cut, value in zip(f.feature, f.cut, f.value, strict=True):
            node = 0
            for _ in range(f.depth):
                node = 2 * node + 1 + (row[feature[node]] > cut[node])
            total += value[node - (2**f.depth - 1)]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12


def test_quality_on_documents(spark, docs_of, words):
    good = [words(60, i) + "." for i in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in words(60, i).split()) for i in range(150)]
    odd = ["", None, "   \n ", words(30_000, 1)]
    docs = docs_of(good + bad + odd + good[:1], [*range(300), 1000, 1001, 1002, None, 0])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_documents(docs, quality.train(docs, labels)).collect()
    assert len(out) == 305
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 300]
    assert held and all(r["predicted"] == int(r["doc_id"] < 150) for r in held)
    assert quality.score_documents(docs_of([]), quality.train(docs_of([]), labels)).count() == 0


LANGS = {"en": "the and of that with from this have they were which their about", "de": "der die und nicht mit auch sich eine oder werden dass über für", "fr": "les des une est dans pour avec plus cette être nous où était"}


def test_languages(spark, docs_of):
    r = random.Random(4)
    texts, langs = [], []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        texts.append(" ".join(r.choices(LANGS[lang].split(), k=40)))
        langs.append(lang)
    mixed = " ".join(r.choices(LANGS["en"].split(), k=60) + r.choices(LANGS["de"].split(), k=20))
    odd = [None, "", "123 !!", mixed, LANGS["de"] * 3000]
    docs = docs_of(texts + odd, [*range(240), 900, 901, 902, 903, 904], [*langs, None, None, None, None, None])
    model = langid.train(docs)
    out = {x["doc_id"]: x for x in langid.predict_documents(docs, model).collect()}
    assert model.languages == ["de", "en", "fr"]
    assert all(out[i]["lang_pred"] == langs[i] for i in range(240))
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[900]["score"] == 0
    assert out[903]["languages"][:2] == ["en", "de"] and 0.6 < out[903]["score"] < 0.9
    assert out[904]["lang_pred"] == "de"
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    assert langid.predict_documents(docs, langid.Model([], np.empty((0, langid.BUCKETS)))).where("lang_pred <> 'und'").count() == 0


def test_em_finds_proportions():
    p = np.full((2, langid.BUCKETS), 1e-9)
    p[0, :50], p[1, 30:80] = 0.02, 0.02
    r = np.random.default_rng(5)
    drawn = np.concatenate((r.integers(0, 50, 7000), r.integers(30, 80, 3000)))
    pi = langid.Model(["a", "b"], p).proportions(drawn)
    assert abs(pi[0] - 0.7) < 0.03
