"""Language identification as inference of a multilingual mixture.

A document is modelled as n-grams drawn from a mixture of languages. Expectation-maximisation estimates the
proportions from the languages' n-gram likelihoods; a language stays in the document's set only while it earns
its place by penalised likelihood (BIC). The prediction is the largest proportion, the score is that proportion.

Defined cases: a null text or one without a letter is ``und`` with score 0; repeated rows are treated each by
itself; training rows with a null language are left out; with nothing to learn from, all predictions are ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, id_remainder

#: Bound of the training documents of each language; Spark prunes such ranks before the shuffle up to 1,000.
MAX_TRAINING_DOCS = 1000
#: Hashed n-gram kinds; the model has this many columns for each language, whatever the corpus is.
BUCKETS = 1 << 15
_SHIFT = np.uint32(32 - 15)


def ngram_buckets(text: str | None) -> np.ndarray | None:
    """Hashed byte trigrams and 4-grams of the lower-cased letters of a text; None if it has no letter."""
    if not text:
        return None
    kept = "".join([c if c.isalpha() else " " for c in text.lower()]) if not text.isascii() else text.lower().translate(_ASCII)
    joined = " ".join(kept.split())
    if not joined:
        return None
    b = np.frombuffer(f"  {joined}  ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    three = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    four = (three[:-1] << 8) | b[3:]
    three, four = three * np.uint32(2654435761), (four ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)
    return np.concatenate((three, four)) >> _SHIFT


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


@dataclass
class Model:
    languages: list[str]
    #: P(bucket | language), a row for each language.
    likelihood: np.ndarray

    def proportions(self, buckets: np.ndarray, rounds: int = 25) -> np.ndarray:
        """The mixture's weights after EM and the choice of the language set."""
        count = np.bincount(buckets, minlength=BUCKETS)
        seen = np.flatnonzero(count)
        weight, p = count[seen].astype(float), self.likelihood[:, seen]
        total = weight.sum()

        def em(active: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
            q, pi = p[active], start / start.sum()
            for _ in range(rounds):
                new = pi * (q @ (weight / (pi @ q))) / total
                moved = np.abs(new - pi).max()
                pi = new
                if moved < 1e-3:
                    break
            return pi, float(weight @ np.log(pi @ q))

        active = np.arange(len(self.languages))
        pi, fit = em(active, np.ones(len(active)))
        while len(active) > 1:
            rest = np.delete(np.arange(len(active)), pi.argmin())
            fewer, fit_fewer = em(active[rest], pi[rest] + 1e-9)
            if fit - fit_fewer > 0.5 * np.log(total):  # the language's parameter earns its penalty
                break
            active, pi, fit = active[rest], fewer, fit_fewer
        out = np.zeros(len(self.languages))
        out[active] = pi
        return out


def train(docs: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Model:
    """N-gram likelihoods from at most ``max_docs`` training documents of each language (the smallest hashes of doc_id).

    The counts are summed by language and bucket on the executors; the driver gets at most languages x BUCKETS sums.
    """
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.coalesce(id_remainder(F.col("doc_id"), 4) != 2, F.lit(True)))
    ids = known.select(F.col("doc_id").alias("id"), "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)).alias("h"))
    # A threshold from the language's count leaves about twice as many as are wanted, so that ranks need few rows of it.
    counts = ids.groupBy("lang").agg(F.count("*").alias("of"))
    few = ids.join(counts, "lang").where(F.col("h") < F.lit(float(1 << 31)) * (2 * max_docs + 100) / F.col("of"))
    ids = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("n") <= max_docs)
    # At most max_docs ids for each language.
    chosen = known.select("doc_id", "lang", "text").join(F.broadcast(ids.select(F.col("id").alias("doc_id"), "lang").distinct()), ["doc_id", "lang"])

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (b := ngram_buckets(text)) is not None:
                    totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    totals[lang] += np.bincount(b, minlength=BUCKETS)
        for lang, c in totals.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

    sums = chosen.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique()) if len(sums) else []
    counts = np.full((len(languages), BUCKETS), 0.5)
    counts[pd.Categorical(sums["lang"], languages).codes, sums["bucket"].to_numpy(int)] += sums["n"].to_numpy(float)
    return Model(languages, counts / counts.sum(1, keepdims=True))


def predict_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the languages found, for every row. One pass, no shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            best, score, found = [], [], []
            for text in batch.column(1).to_pylist():
                b = ngram_buckets(text) if model.languages else None
                if b is None:
                    best.append("und")
                    score.append(0.0)
                    found.append([])
                    continue
                pi = model.proportions(b)
                best.append(model.languages[int(pi.argmax())])
                score.append(min(1.0, float(pi.max())))
                found.append([model.languages[i] for i in np.argsort(-pi, kind="stable") if pi[i] > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "lang_pred", "score", "languages"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>")
    return out.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
