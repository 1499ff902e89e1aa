import random

import corpus_pipeline
from gazeframe.llm import decontaminate


def test_stages(spark, docs_of, words, tmp_path):
    r = random.Random(1)
    good = [". ".join(words(12, 10 * i + k) for k in range(5)) + "." for i in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in words(60, 5000 + i).split()) for i in range(60)]
    item = words(18, 99_999)
    copy = good[0].split()
    for _ in range(2):
        copy[r.randrange(len(copy))] = "changed"
    boiler = "this very line stands in many of the documents"
    texts = good + bad + [good[1], " ".join(copy), words(40, 7) + " " + item + " " + words(30, 8)]
    texts = [t + "\n" + boiler if i % 10 == 0 and i < 120 else t for i, t in enumerate(texts)] + ["", None]
    docs_of(texts).drop("row", "score", "n_lines", "id", "c").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert not any(i in kept["quality"] for i in range(120, 180)) and all(i in kept["quality"] for i in range(120))
    assert sum(boiler in (t or "") for t in kept["line_dedup"].values()) == 1
    assert 180 not in kept["line_dedup"]  # all its lines stand in an earlier document
    assert 181 not in kept["near_dedup"] and 0 in kept["near_dedup"]
    assert 182 in kept["near_dedup"] and 182 not in kept["decontamination"]
    assert all(i in kept["decontamination"] for i in range(2, 120))
    assert decontaminate.leaks(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in final} == set(kept["decontamination"]) and all(len(x["input_ids"]) == x["n_tokens"] for x in final)


def test_an_empty_corpus(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
