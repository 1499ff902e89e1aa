"""The reordering stream against the batch operators, over micro-batches, restarts and late rows."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeframe.operators import sequence
from gazeframe.streaming import reorder

SCHEMA = "recording long, frame_idx int, ts_ms long, label string, last boolean"
DELAY = 500


def rows_of(n=160, seed=1):
    r = random.Random(seed)
    out, label = [], "NoAOI"
    for rec in (1, 2):
        for i in range(n):
            label = r.choice(["Board", "Screen", "NoAOI"]) if r.random() < 0.3 else label
            out.append((rec, i, i * 33, label, i == n - 1))
    return out


def shuffled(rows, seed=2):
    """Rows moved by less than the delay; the last of a recording stays last."""
    r = random.Random(seed)
    return sorted(rows, key=lambda x: (x[2] + (10**6 if x[4] else r.uniform(0, DELAY - 34)), x[0]))


def files(spark, folder, rows, size):
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, where):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = reorder.write_ordered(reorder.reordered_stream(stream, 33.0, DELAY), f"{where}/out", f"{where}/late", f"{where}/checkpoint")
    q.awaitTermination(300)


def batch(spark, rows):
    f = spark.createDataFrame(rows, SCHEMA)
    a = sequence.cumulative_visits(f).select("recording", "frame_idx", "label", "aoi_transition", "visits")
    b = sequence.time_in_area(f, 33.0).select("recording", "frame_idx", "time_in_current_aoi_ms")
    return sorted(map(tuple, a.join(b, ["recording", "frame_idx"]).collect()))


def given(spark, where):
    df = spark.read.parquet(f"{where}/out").select("recording", "frame_idx", "label", "aoi_transition", "visits", "time_in_current_aoi_ms", "batch")
    return sorted(tuple(x)[:6] for x in df.collect()), df


def test_any_order_within_the_delay_equals_the_batch_also_after_a_restart(spark):
    rows = rows_of()
    moved = shuffled(rows)
    assert moved != rows
    source, where = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    files(spark, source, moved[:200], 50)
    run(spark, source, where)
    first, df = given(spark, where)
    assert 0 < len(first) < 200
    files(spark, source, moved[200:], 60)  # a second run goes on from the checkpoint
    run(spark, source, where)
    got, df = given(spark, where)
    assert got == batch(spark, rows)
    assert spark.read.parquet(f"{where}/late").count() == 0
    # Later batches hold later frames.
    spans = df.groupBy("recording", "batch").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b")).orderBy("recording", "batch").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]) if x["recording"] == y["recording"])


def test_late_and_repeated_rows_go_to_a_table_of_their_own(spark):
    rows = [x for x in rows_of() if x[0] == 1]
    kept = [x for x in rows if x[1] != 5]
    source, where = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    files(spark, source, kept[:120], 60)
    run(spark, source, where)
    files(spark, source, [rows[5], rows[7], *kept[120:]], 100)
    run(spark, source, where)
    assert given(spark, where)[0] == batch(spark, kept)
    assert sorted(x["frame_idx"] for x in spark.read.parquet(f"{where}/late").collect()) == [5, 7]


def test_what_is_held_spans_less_than_the_delay():
    r = np.random.default_rng(3)
    for _ in range(50):
        times = np.sort(r.integers(0, 5000, 200))
        free = reorder.released(times, int(times.max()), DELAY, False)
        held = times[~free]
        assert held.max() - held.min() < DELAY
    assert reorder.released(times, int(times.max()), DELAY, True).all()


@pytest.mark.parametrize("cut", [1, 3, 10, 50])
def test_arrays_give_the_same_in_pieces(cut):
    labels = np.array(["NoAOI", "Board", "Board", "Screen", "NoAOI", "NoAOI", "Board"] * 8, object)
    frames = np.arange(10, 10 + len(labels))
    whole = reorder.sequence(frames, labels, "NoAOI", None, {})
    before, entry, visits, parts = "NoAOI", None, {}, []
    for i in range(0, len(labels), cut):
        t, v, e = reorder.sequence(frames[i : i + cut], labels[i : i + cut], before, entry, visits)
        parts.append((t, v, e))
        before, entry = labels[i : i + cut][-1], int(e[-1])
    for k in range(3):
        assert np.concatenate([p[k] for p in parts]).tolist() == whole[k].tolist()
