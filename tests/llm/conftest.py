import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, score string, n_lines int, id int, c int"


def make_docs(spark, texts, ids=None, lang=None):
    """A documents table with extra columns whose names clash with inner ones, written and read as Parquet."""
    import tempfile

    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang[k] if lang else "en", "s", len(t or ""), 7, "x", 3, 1, 2) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    path = tempfile.mkdtemp(prefix="spark-") + "/d.parquet"
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def docs_of(spark):
    return lambda texts, ids=None, lang=None: make_docs(spark, texts, ids, lang)


@pytest.fixture(scope="session")
def words():
    import random

    r = random.Random(5)
    syllables = "ka lo mi ner tu sha vel dor pi ran es qui bo fa gre".split()
    pool = ["".join(r.choices(syllables, k=r.randrange(1, 5))) for _ in range(3000)]
    return lambda n, seed: " ".join(random.Random(seed).choices(pool, k=n))
