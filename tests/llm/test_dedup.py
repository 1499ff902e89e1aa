"""Near copies, similar lines, leaks and the pipeline, against brute force."""

import random
import tracemalloc
import re
from collections import defaultdict

import pytest

from gazeframe.llm import decontaminate, linededup, neardup


def edit(words, n, seed):
    r, w = random.Random(seed), words.split()
    for _ in range(n):
        i, kind = r.randrange(len(w)), r.random()
        if kind < 0.5:
            w[i] = f"new{r.randrange(10**6)}"
        elif kind < 0.75:
            w.insert(i, f"new{r.randrange(10**6)}")
        elif len(w) > 1:
            del w[i]
    return " ".join(w)


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_banded_distance_is_the_edit_distance():
    r = random.Random(1)
    for _ in range(3000):
        a = [r.choice("abc") for _ in range(r.randrange(0, 30))]
        b = list(edit(" ".join(a), r.randrange(0, 6), r.random()).split()) if a and r.random() < 0.7 else [r.choice("abc") for _ in range(r.randrange(0, 30))]
        t, d = r.randrange(0, 25), distance(a, b)
        assert neardup.banded_distance(a, b, t) == (d if d <= t else None)
        assert neardup.banded_distance(a, b, t, small=-1) == (d if d <= t else None)


def test_alignment_of_long_texts_takes_linear_memory():
    peaks = []
    for n in (20_000, 40_000):
        a = ["first", *map(str, range(n)), "last"]
        b = ["other", *map(str, range(n)), "word"]
        tracemalloc.start()
        assert neardup.banded_distance(a, b, neardup.budget_of(n, n)) == 2
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2.5 * peaks[0] and peaks[1] < 40e6


@pytest.mark.parametrize("n", [5, 8, 12, 20, 30, 60, 100])
@pytest.mark.parametrize("kind", ["replaced", "inserted", "deleted", "every fifth", "every sixth"])
def test_short_texts_at_the_rim_of_the_rule_meet(n, kind):
    """Pairs that the link rule just allows meet in a sketch in 9 of 10 cases at least."""
    r, met = random.Random(n), 0
    for _ in range(200):
        a = [f"w{r.randrange(10**6)}" for _ in range(n)]
        if kind.startswith("every"):
            step = 5 if kind == "every fifth" else 6
            b = [f"x{i}" if i % step == step - 1 else w for i, w in enumerate(a)]
        else:
            edits = neardup.budget_of(n, n) if kind != "inserted" else int(n / 4 + 1e-9)
            b, at = list(a), sorted(r.sample(range(n), edits), reverse=True)
            for i in at:
                b[i : i + (kind != "inserted")] = [] if kind == "deleted" else [f"x{i}"]
        assert neardup.banded_distance(a, b, neardup.budget_of(len(a), len(b))) is not None
        x, y = neardup.sketches_of(a), neardup.sketches_of(b)
        met += bool((x[: len(y)] == y[: len(x)]).any())
    assert met >= 180


def test_sketches_see_order():
    w = [f"w{i}" for i in range(300)]
    a, b = neardup.order_minhash(w).tolist(), neardup.order_minhash(w[150:] + w[:150]).tolist()
    assert a == neardup.order_minhash(list(w)).tolist() and sum(x == y for x, y in zip(a, b, strict=True)) < len(a)
    assert len(neardup.order_minhash(["one"])) == neardup.SKETCHES


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_near_copies_meet_in_a_sketch(similarity):
    r, met = random.Random(4), 0
    for n in range(500):
        a = [f"w{r.randrange(10**6)}" for _ in range(200)]
        b = list(a)
        for i in r.sample(range(200), round(200 * (1 - similarity))):
            b[i] = f"new{r.randrange(10**6)}"
        assert n or distance(a, b) <= neardup.budget_of(200, 200)
        met += any(x == y for x, y in zip(neardup.order_minhash(a), neardup.order_minhash(b), strict=True))
    assert met >= 0.97 * 500


def groups(texts):
    """Components of all pairs within the budget."""
    w = [neardup.words_of(t) for t in texts]
    root = list(range(len(w)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(w)):
        for j in range(i):
            if w[i] == w[j] or (w[i] and w[j] and distance(w[i], w[j]) <= neardup.budget_of(len(w[i]), len(w[j]))):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(w))]


def test_near_duplicates(spark, docs_of, words):
    base = [words(60, i) for i in range(8)]
    texts = base + [edit(base[i % 3], 2, i) for i in range(40)] + [base[1].upper(), base[1] + "!", "", None, "...", "one two", "one two", words(20_000, 9)]
    shared = words(12, 77)
    texts += [shared + " " + words(10, 200 + i) for i in range(30)]  # unrelated texts around one passage
    out = sorted((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs_of(texts)).collect())
    want = groups([t if t is None or len(t) < 5000 else "long " * 5 for t in texts])
    assert [c for _, c in out] == want


def test_near_duplicates_odd_tables(spark, docs_of, words):
    a = words(50, 1)
    out = neardup.near_duplicates(docs_of([a, a, edit(a, 1, 2), words(50, 3)], [5, 5, None, None])).collect()
    assert sorted(str((r["doc_id"], r["class_id"])) for r in out) == ["(5, 5)", "(5, 5)", "(None, 5)", "(None, None)"]
    assert neardup.near_duplicates(docs_of([])).count() == 0


def test_large_bucket_is_one_group(spark, docs_of, words):
    a = words(80, 1)
    texts = [edit(a, 2, i) for i in range(30)] + [words(80, 100 + i) for i in range(5)]
    out = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(texts)).collect()}
    assert [out[i] for i in range(35)] == groups(texts)


def grouped(spark, texts, sketches):
    """The root of each class; its text and its sketches are given."""
    table = spark.createDataFrame(list(enumerate(texts)), "c long, text string")
    classes = spark.createDataFrame([(c, len(neardup.words_of(texts[c])), sk) for c, sk in enumerate(sketches)], "c long, nw int, sk array<long>")
    roots = {r["c"]: r["root"] for r in neardup.class_groups(classes, lambda wanted: table.join(wanted, "c", "left_semi")).collect()}
    return [roots.get(i, i) for i in range(len(texts))]


@pytest.mark.parametrize("common, rows", [(20, 300_000), (1, 0)])
def test_many_groups_in_one_bucket(spark, words, monkeypatch, common, rows):
    monkeypatch.setattr("gazeframe.llm.common.COMMON", common)
    monkeypatch.setattr("gazeframe.llm.common.SAMPLE", 1)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", rows)
    texts = [words(60, 300)] + [edit(words(60, 301 + i % 7), 2, i) for i in range(21)]
    # Texts around one passage, near copies among them, some of them farther from each other than from a third one.
    passage = words(60, 400)
    for i in range(12):
        own = words(40, 500 + i)
        texts += [f"{passage} {own}", f"{passage} {edit(own, 12, i)}", f"{passage} {edit(edit(own, 12, i), 12, 90 + i)}"]
    random.Random(5).shuffle(texts)
    assert grouped(spark, texts, [[1]] * len(texts)) == groups(texts)  # all meet in one sketch only


def test_links_beside_the_first_class(spark, words):
    other = [[f"{c}{i}" for i in range(100)] for c in "pqr"]
    # A longer text x is linked with the first one, a; y is linked with x alone, and more than twice a's budget from a.
    a = [f"a{i}" for i in range(100)]
    x = a + [f"x{i}" for i in range(25)]
    texts = [" ".join(t) for t in (a, x, x[25:], *other)]
    assert groups(texts)[:3] == [0, 0, 0] and neardup.budget_of(100, 100) * 2 < distance(a, x[25:])
    assert grouped(spark, texts, [[1]] * len(texts)) == groups(texts)
    # x is in a's group by way of m, in other buckets; y is linked with x alone.
    part = lambda t, at, c: t[:at] + [f"{c}{i}" for i in range(15)] + t[at + 15 :]
    m = part(a, 0, "m")
    x = part(m, 20, "x")
    y = part(x, 40, "y")
    texts = [" ".join(t) for t in (a, m, x, y, *other)]
    assert groups(texts)[:4] == [0] * 4 and distance(a, x) > neardup.budget_of(100, 100)
    assert grouped(spark, texts, [[1, 10, 30], [2, 10, 11], [1, 12, 11], [1, 13, 31], *[[1, 20 + i, 40 + i] for i in range(3)]]) == groups(texts)


def removed_lines(texts):
    seen, sets, out = set(), [], defaultdict(list)
    for d, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            w = frozenset(x for x in re.split(r"[ \t\r]+", line.lower()) if x)
            if not w:
                continue
            if w in seen or any(5 * len(w & v) >= 4 * len(w | v) for v in sets):
                out[d].append(p)
            if w not in seen:
                sets.append(w)
            seen.add(w)
    return out


@pytest.mark.parametrize("rows", [linededup.BROADCAST_ROWS, 0])
def test_similar_lines(spark, docs_of, words, monkeypatch, rows):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", rows)
    r = random.Random(6)
    pool = [words(r.randrange(2, 30), i) for i in range(60)]
    texts = []
    for i in range(60):
        lines = [edit(x, r.randrange(0, 3), (i, k).__hash__()) if r.random() < 0.5 else x for k, x in enumerate(r.sample(pool, 5))]
        texts.append("\n".join(lines) + ("\n" if i % 7 == 0 else ""))
    texts += ["", None, "one two", "a\tb\tc\td\te", "a b c d e\r", texts[3], words(30_000, 4)]
    docs = docs_of(texts)
    out = {x["doc_id"]: x for x in linededup.remove_similar_lines(docs, prefix="z_").collect()}
    want = removed_lines(texts)
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert out[i]["z_removed"] == want[i], i
        lines = (t or "").split("\n")
        assert out[i]["text"] == (t if not want[i] else "\n".join(x for p, x in enumerate(lines) if p not in want[i]))
        assert out[i]["z_n_removed"] == len(want[i]) and out[i]["n_lines"] == 3
    assert linededup.remove_similar_lines(docs_of([]), prefix="z_").count() == 0


def test_lines_of_repeated_rows(spark, docs_of):
    line = "five different words stand here"
    out = [r["z_n_removed"] for r in linededup.remove_similar_lines(docs_of([line, line, line], [1, 1, None]), prefix="z_").collect()]
    assert sorted(out) == [0, 1, 1]


def test_lines_of_repeated_rows_without_ids_and_with_many_lines(spark, docs_of):
    text = "one\n\none two three four\none two three four five\n  \nsix"
    out = [(r["text"], r["z_removed"]) for r in linededup.remove_similar_lines(docs_of([text] * 3 + ["six\nseven"], [None, None, 4, 5]), prefix="z_").collect()]
    first, copy = ("one\n\none two three four\n  \nsix", [3]), ("\n  ", [0, 2, 3, 5])
    assert sorted(out) == sorted([first, copy, copy, ("seven", [0])])


@pytest.mark.parametrize("common", [20, 1])
def test_a_large_group_of_similar_lines(spark, docs_of, words, monkeypatch, common):
    monkeypatch.setattr("gazeframe.llm.common.COMMON", common)
    monkeypatch.setattr("gazeframe.llm.common.SAMPLE", 2)
    r = random.Random(11)
    base = words(40, 1)
    texts = [edit(base, r.randrange(0, 16), i) for i in range(150)] + [words(40, 1000 + i) for i in range(20)]
    texts += [" ".join([words(20, 2), words(20, 3000 + i)]) for i in range(60)]  # half of each line is common to all
    r.shuffle(texts)
    out = {x["doc_id"]: x["z_removed"] for x in linededup.remove_similar_lines(docs_of(texts), prefix="z_").collect()}
    want = removed_lines(texts)
    assert out == {i: want[i] for i in range(len(texts))} and 50 < sum(map(bool, out.values())) < 150


def test_lines_of_shuffled_documents(spark, docs_of):
    r, lines = random.Random(8), []
    for k in range(40):  # the middle one of three lines is similar to both others, which are not similar
        w = [f"w{k}x{i}" for i in range(20)]
        x = [*(f"b{k}x{i}" for i in range(2)), *w[2:]]
        y = [*x[:2], *(f"c{k}x{i}" for i in range(2)), *x[4:]]
        lines += [" ".join(t) for t in (w, x, y)]
    r.shuffle(lines)
    ids = r.sample(range(1000), len(lines))
    out = {x["doc_id"]: x["z_n_removed"] for x in linededup.remove_similar_lines(docs_of(lines, ids), prefix="z_").collect()}
    by_id = [t for _, t in sorted(zip(ids, lines, strict=True))]
    want = removed_lines(by_id)
    assert [out[i] for i in sorted(ids)] == [len(want[n]) for n in range(len(lines))]


def test_rows_keep_their_numbers_when_cores_change(spark, words, tmp_path, monkeypatch):
    texts = [words(12, i // 2) + f" own{i}" for i in range(24)]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(f"{tmp_path}/d")
    cores, store = iter([2, 12] * 100), linededup.stored

    def after_a_change(df, **how):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(next(cores)))
        return store(df, **how)

    monkeypatch.setattr(linededup, "stored", after_a_change)
    try:
        out = {x["doc_id"]: x["z_removed"] for x in linededup.remove_similar_lines(spark.read.parquet(f"{tmp_path}/d"), prefix="z_").collect()}
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    want = removed_lines(texts)
    assert out == {i: want[i] for i in range(24)} and any(out.values())


def test_least_distance_is_semi_global():
    r = random.Random(2)
    for _ in range(500):
        p, t = ("".join(r.choice("abc") for _ in range(r.randrange(lo, 40))) for lo in (1, 0))
        assert decontaminate.Pattern(0, p, 0.1).least_distance(t) == min(distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))


def test_pieces_cover_an_item():
    for n in (1, 7, 100):
        for k in (0, 1, 6):
            got = decontaminate.pieces(n, k)
            assert len(got) == k + 1 and got[0][0] == 0 and got[-1][1] == n and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_leaks(spark, docs_of, words, monkeypatch):
    items = [words(20, i) for i in range(12)] + [words(2, 500), words(1, 501)[:3]]  # the last one stands inside of words as well
    r = random.Random(3)
    texts, want = [], set()
    for d in range(60):
        t = words(80, 1000 + d)
        if d % 3 == 0:
            item = r.randrange(12)
            leaked = list(items[item])
            for _ in range(r.randrange(0, 9)):
                leaked[r.randrange(len(leaked))] = r.choice("abcxyz ")
            t = t + " " + "".join(leaked) + " " + words(30, 2000 + d)
        texts.append(t)
    texts += [f"{words(9, 5)} {items[12]}, {words(9, 6)}", items[13], items[12] + "s", None, "", items[0].upper() + "!", items[0] + " " + words(10, 1) + " " + items[1], "x " * 20_000 + items[2]]
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            p, n = decontaminate.normalised(item), decontaminate.normalised(t)
            if i >= 12:
                want |= {(d, i, 0)} if f" {p} " in f" {n} " else set()
                continue
            k = int(decontaminate.ERROR_RATE * len(p))
            best = decontaminate.Pattern(i, p, decontaminate.ERROR_RATE).least_distance(n) if n else k + 1
            if best <= k:
                want |= {(d, i, best)} if i else {(d, i, best), (d, None, best)}
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(50, None, 1), (51, "", 1), (52, "?!", 1), (None, items[0], 1)], "item_id long, text string, doc_id int")
    got = {tuple(x) for x in decontaminate.leaks(docs_of(texts), bench).collect()}
    assert got == want and len(want) > 10
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 4)  # several passes
    assert {tuple(x) for x in decontaminate.leaks(docs_of(texts), bench).collect()} == want
    assert decontaminate.leaks(docs_of([]), bench).count() == 0 and decontaminate.leaks(docs_of(texts), bench.limit(0)).count() == 0


def test_parities_leave_similar_lines_and_rule_out_others(spark, words):
    """Bits beside the pairs of words: no similar pair of lines is lost, lines alike by chance alone go before words are read."""
    from pyspark.sql import functions as F

    r, rows = random.Random(12), []
    for n in (5, 20, 63, 64, 65, 70, 100, 200):
        for i in range(20):
            a = [f"w{r.randrange(10**6)}" for _ in range(n)]
            k = n // 10
            rows += [(True, a, a[k:] + [f"x{j}" for j in range(k // 2)]), (False, a, [f"y{r.randrange(10**6)}" for _ in range(n)])]
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    table = spark.createDataFrame(rows, "near boolean, a array<string>, b array<string>")
    m, o = linededup._parities(hashed("b")), linededup._parities(hashed("a"))
    table = table.select("near", F.size("b").alias("n"), F.size("a").alias("m"), m[0].alias("m0"), m[1].alias("m1"), o[0].alias("a0"), o[1].alias("a1"))
    out = table.select("near", linededup._marks_allow(F.col("n"), F.col("m")).alias("may")).collect()
    assert all(x["may"] for x in out if x["near"]) and sum(x["may"] for x in out if not x["near"]) <= 8


def test_lines_of_a_large_group_are_decided_before_the_full_comparison(spark, docs_of, words, monkeypatch):
    """Rows that don't stand in the order of their ids: the lines tried first are earlier by place, not by row."""
    base, tried = words(60, 21), []
    texts = [edit(base, 2, i) for i in range(200)]
    ids = random.Random(22).sample(range(1000), len(texts))
    verified = linededup._verified

    def counted(pairs, *args, **how):
        tried.append(pairs.count())
        return verified(pairs, *args, **how)

    monkeypatch.setattr(linededup, "_verified", counted)
    out = {x["doc_id"]: x["z_n_removed"] for x in linededup.remove_similar_lines(docs_of(texts, ids), prefix="z_").collect()}
    want = removed_lines([t for _, t in sorted(zip(ids, texts, strict=True))])
    assert [out[i] for i in sorted(ids)] == [len(want[n]) for n in range(len(texts))]
    assert sum(tried) < 8 * len(texts) and tried[-1] < len(texts)


def test_marks_leave_near_copies_and_rule_out_long_texts_edited_too_much(spark):
    """Bits turned by words and by pairs of words: no pair within the budget is lost, others go though their texts fill many slots."""
    from pyspark.sql import functions as F

    r, texts = random.Random(13), []
    for k in range(40):
        n = (10, 60, 300, 800)[k % 4]
        a = [f"w{r.randrange(200 if k % 3 else 10**6)}" for _ in range(n)]
        texts += [a, edit(" ".join(a), neardup.budget_of(n, n), k).split()]
    near = len(texts) // 2
    for _ in range(20):
        a = [f"w{r.randrange(10**6)}" for _ in range(800)]
        texts += [a, [f"x{r.randrange(10**6)}" if i % 5 < 2 else w for i, w in enumerate(a)]]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "c long, text string")
    marked = neardup.class_words(table)
    one, other = marked.where("c % 2 = 0").withColumn("pair", F.col("c") / 2), neardup._as_other(marked.where("c % 2 = 1"), F.col("nw").alias("m"), ((F.col("c") - 1) / 2).alias("pair"))
    out = {x["pair"]: x["may"] for x in one.join(other, "pair").select("pair", neardup._may_link(F.col("nw"), F.col("m"), neardup.SIMILARITY).alias("may")).collect()}
    assert len(out) == len(texts) // 2
    for i, may in out.items():
        a, b = texts[2 * int(i)], texts[2 * int(i) + 1]
        assert may if i < near and neardup.banded_distance(a, b, neardup.budget_of(len(a), len(b))) is not None else i < near or not may


def test_marks_rule_out_long_texts_around_one_passage(spark):
    """610 words in common and 190 of their own: beyond the budget of 160, though one block of edits turns few pairs of words."""
    from pyspark.sql import functions as F

    r = random.Random(14)
    passage = [f"w{r.randrange(10**6)}" for _ in range(610)]
    texts = [passage + [f"w{r.randrange(10**6)}" for _ in range(k)] for k in [190] * 12 + [150] * 12]
    marked = neardup.class_words(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "c long, text string"))
    other = neardup._as_other(marked, F.col("nw").alias("m"), F.col("c").alias("a"))
    may = neardup._may_link(F.col("nw"), F.col("m"), neardup.SIMILARITY)
    out = {(x["c"], x["a"]) for x in marked.crossJoin(other).where((F.col("c") < F.col("a")) & may).select("c", "a").collect()}
    assert not any(b < 12 for a, b in out) and all((a, b) in out for a in range(12, 24) for b in range(a + 1, 24))


def test_classes_that_meet_in_many_sketches_are_joined(spark, words, monkeypatch):
    """Pairs are made in their first common bucket only; none is lost, wherever that bucket is."""
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    r, texts, sketches = random.Random(15), [], []
    for k in range(12):
        base = words(60, 700 + k)
        common = [None] * 60
        for at in r.sample(range(60), (1, 2, 20, 60)[k % 4]):
            common[at] = k
        for i in range(4):
            texts.append(edit(base, 3, 10 * k + i))
            sketches.append([1000 + 100 * k + i if v is None else v for v in common])
    assert grouped(spark, texts, sketches) == groups(texts)


@pytest.mark.parametrize("rows", [8192, 5])
def test_unlike_texts_of_one_bucket_make_no_rows_of_pairs(spark, words, monkeypatch, rows):
    """Texts around one passage meet in a bucket: their pairs are no rows of a join, whose number grew with the square of theirs."""
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows, raising=False)
    monkeypatch.setattr(neardup, "CHUNK_ROWS", rows, raising=False)
    monkeypatch.setattr(neardup, "BEFORE", 1)
    plans, store = [], neardup.stored

    def seen(df, **how):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, **how)

    monkeypatch.setattr(neardup, "stored", seen)
    passage, r = words(40, 1), random.Random(16)
    texts = [" ".join([passage, words(r.randrange(30, 50), 100 + i)]) for i in range(30)]
    texts += [edit(texts[i % 30], r.randrange(0, 20), i) for i in range(30)]
    sketches = [[1, 2 + i % 3, 10 + i % 2, *range(20, 20 + i % 7)] for i in range(60)]
    assert grouped(spark, texts, sketches) == groups(texts)
    assert not [p for p in plans if re.search(r"Join Inner, .*\(c#\d+L < c#\d+L\)", p)]


def test_pairs_that_fit_by_length_and_folded_marks(spark):
    """No near copies are lost by the folded marks, at lengths on both sides of a size of theirs; unlike texts go."""
    r, texts = random.Random(17), []
    for n in (3, 16, 62, 64, 66, 125, 130, 255, 260, 520, 1100):
        a = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts += [a, *(edit(" ".join(a), neardup.budget_of(n, n) // 2, 10 * n + i).split() for i in range(3)), [f"x{r.randrange(10**6)}" for _ in range(n)]]
    classes = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "c long, text string")
    marked = neardup.class_words(classes)
    met = marked.selectExpr("1L bucket", "c", "nw", "c root")
    pairs = {(x["a"], x["b"]) for x in neardup._apart_in_full(met, marked, neardup.SIMILARITY).collect()}
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            near = neardup.banded_distance(a, texts[j], neardup.budget_of(len(a), len(texts[j]))) is not None
            assert (i, j) in pairs if near else (i, j) not in pairs or i // 5 == j // 5 != (j - 4) / 5


def test_classes_are_open_where_another_group_fits(spark):
    """A class stays in a bucket for the classes of other groups that its length fits, not for any other group in the bucket."""
    rows = [(1, 1, 100), (1, 2, 100), (1, 3, 124), (1, 4, 200), (1, 5, 210), (1, 6, 300), (2, 1, 100), (2, 4, 200), (3, 4, 200), (3, 5, 210)]
    met = neardup.stored(spark.createDataFrame(rows, "bucket long, c long, nw int"))
    roots = neardup.stored(spark.createDataFrame([(1, 1), (2, 1), (4, 4), (5, 4)], "c long, root long"))
    out = {(x["bucket"], x["c"]) for x in neardup._open(met, roots, neardup.SIMILARITY).collect()}
    assert out == {(1, 1), (1, 2), (1, 3)}
