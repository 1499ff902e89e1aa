"""Pseudonyms, shards, top-k, and that the native ones hold no Python."""

import datetime
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from gazeframe.llm import linededup, pii, shards, topk


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def with_check(body):
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def changed(spark, docs_of, texts):
    rows = {r["doc_id"]: r for r in pii.pseudonymise_documents(docs_of(texts)).collect()}
    return [rows[i]["text"] for i in range(len(texts))], [rows[i]["n_changed"] for i in range(len(texts))]


def test_formats_hold_and_values_stay_linked(spark, docs_of):
    r = random.Random(1)
    cards = [with_check("".join(r.choices("0123456789", k=15))) for _ in range(30)]
    texts = [f"a {c} b {c}, and {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}." for c in cards]
    out, n = changed(spark, docs_of, texts)
    new = []
    for t, c in zip(out, cards, strict=True):
        got = re.findall(r"\d[\d ]{14,}\d", t)
        assert len(got) == 3 and got[0] == got[1] == got[2].replace(" ", "") and luhn(got[0]) and got[0] != c
        new.append(got[0])
    assert n == [3] * 30 and len(set(new)) == 30


def test_invalid_values_stay(spark, docs_of):
    texts = ["4111111111111112", "300.1.2.3", "1.2.3.4.5", "31.02.2001", "2001-02-30", "000-12-3456", "DE00370400440532013000", "v2.0 costs 15 or 1234567", "0" * 32, None, "", "no data"]
    out, n = changed(spark, docs_of, texts)
    assert out == texts and n == [0] * len(texts)


def test_numbers_and_words_beside_a_value(spark, docs_of):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    texts = [f"{card} 12/27", "4111111111111111 123", "3782 822463 10005 1234", f"{iban} EUR", f"{iban} BANK", f"pay {card} 123-45-6789 from 10.0.0.1, 12 {card}."]
    out, n = changed(spark, docs_of, texts)
    assert n == [1, 1, 1, 1, 1, 4]
    for a, b, end in zip(out, texts, (" 12/27", " 123", " 1234", " EUR", " BANK", "."), strict=True):
        assert a.endswith(end) and len(a) >= len(b) - 8 and card not in a and iban not in a and "123-45-6789" not in a
    assert all(luhn(re.sub(r"\D", "", t[:19] if i == 0 else t[:16] if i == 1 else t[:17])) for i, t in enumerate(out[:3]))


def test_each_kind(spark, docs_of):
    texts = ["on 2024-02-29 and 29.02.2024 or 12/31/1999", "from 10.0.0.1.", "Ann.Lee7@mail.example.com", "+1 (017) 555-7713", "123-45-6789", "GB82 WEST 1234 5698 7654 32", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"]
    out, n = changed(spark, docs_of, texts)
    assert n == [3, 1, 1, 1, 1, 1, 1] and all(a != b and len(a) == len(b) or i == 1 for i, (a, b) in enumerate(zip(out, texts, strict=True)))
    ymd, dmy, _ = re.findall(r"[\d./-]{10}", out[0])
    assert datetime.date.fromisoformat(ymd) == datetime.datetime.strptime(dmy, "%d.%m.%Y").date()
    assert all(int(x) < 256 for x in re.findall(r"\d+", out[1])) and out[1].endswith(".")
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@mail\.example\.com", out[2])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[3]) and re.fullmatch(r"[0-9a-f]{40}", out[6])
    iban = out[5].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_mail_names_outside_ascii(spark, docs_of):
    names = ["josé", "max.müller", "joão.da-silva", "o'neil", "İvan", "иван.Петров", "γιώργος", "王小明", "김철수", "たろう", "tom&lee", "zoe\u0301"]
    texts = [f"mail {n}@firma.de now" for n in names] + [f"'{n}@firma.de' ...{n}@firma.de\n<{n}@firma.de>" for n in names] + ["jörg@müller.de", "@ alone a@b", "a @ b.com", "....@x.org"]
    out, n = changed(spark, docs_of, texts)
    made = [t[len("mail ") : -len("@firma.de now")] for t in out[: len(names)]]
    for i, (name, new) in enumerate(zip(names, made, strict=True)):
        assert n[i] == 1 and len(name) == len(new)
        assert all(unicodedata.category(a) in ("Mn",) or a.isalpha() == b.isalpha() and a.isupper() == b.isupper() for a, b in zip(name, new, strict=True))
        assert out[len(names) + i] == f"'{new}@firma.de' ...{new}@firma.de\n<{new}@firma.de>"  # linked, whatever stands around
    assert len(set(made)) == len(names) and not set(made) & set(names)
    assert out[-4].endswith("@müller.de") and out[-4] != texts[-4] and out[-3:] == texts[-3:]


def test_long_runs_without_a_mail_are_linear(spark, docs_of):
    out, n = changed(spark, docs_of, ["a." * 200_000 + " @", "é'" * 200_000 + "1 ann@x.org"])
    assert n == [0, 1] and out[1].startswith("é'" * 200_000 + "1 ")


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.array((F.col("id") / 100).cast("int"), (F.col("id") / 10 % 10).cast("int"), (F.col("id") % 10).cast("int")).alias("s"))
    out = df.select(pii.feistel(F.col("s"), F.array(*[F.lit(10)] * 3), F.lit("k")).alias("o"))
    assert out.distinct().count() == 1000
    other = df.select(pii.feistel(F.col("s"), F.array(*[F.lit(10)] * 3), F.lit("k2")).alias("o"))
    assert out.intersect(other).count() == 1000 and out.collect() != other.collect()


def test_long_text(spark, docs_of):
    text = "word " * 50_000 + "10.1.2.3 " + "x" * 100_000
    out, n = changed(spark, docs_of, [text])
    assert n == [1] and len(out[0]) >= len(text) - 8


def test_long_repeats(spark, docs_of):
    # What makes no value a hundred thousand times over, what makes thousands of values less often.
    plain = ["a.", "1.", "1-", "ab1", "0f", "x@", "x+", "a@b.", "2024-01-", "123-45-", "1" * 7, "A1", "AB12"]
    texts = ["x@" + p * 100_000 for p in plain] + ["x@" + p * 1500 for p in ("4 ", "4-", "A1 ", "AB12 ", "DE44 1234 ", "+1 234 ", "(123) ", "x@a.bc ")]
    out, _ = changed(spark, docs_of, texts)
    assert all(len(o) >= len(t) // 2 for o, t in zip(out, texts, strict=True))


def test_lines_marks_and_odd_rows(spark, docs_of):
    texts = ["a 10.0.0.1\nb 10.0.0.1\n\nno data", f"held {pii._MARK} and 10.0.0.1 twice 10.0.0.1", "10.0.0.1", "4111 1111 1111\n1111", "x y\n"]
    out, n = changed(spark, docs_of, texts)
    new = out[2]
    assert n == [2, 2, 1, 0, 0] and new != "10.0.0.1"
    assert out == [texts[0].replace("10.0.0.1", new), texts[1].replace("10.0.0.1", new), new, texts[3], texts[4]]
    assert pii.pseudonymise_documents(docs_of([])).count() == 0
    same = [r["text"] for r in pii.pseudonymise_documents(docs_of(["10.0.0.1"] * 3, [1, 1, None])).collect()]
    assert same == [new] * 3


def test_the_key_comes_from_the_session(spark, docs_of):
    docs = docs_of(["from 10.0.0.1"])
    plain = pii.pseudonymise_documents(docs).first()["text"]
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        assert pii.pseudonymise_documents(docs).first()["text"] == pii.pseudonymise_documents(docs, "another").first()["text"] != plain
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def permuted(symbols, radix, key):
    """The network written out: turns of a keyed sum over one half, from a digest of the other."""
    half = (len(symbols) + 1) // 2
    parts, radices = [symbols[:half], symbols[half:]], [radix[:half], radix[half:]]
    for turn in range(pii.ROUNDS):
        a, b = turn % 2, 1 - turn % 2
        stream = hashlib.sha512(f"{key}|{turn}|{','.join(map(str, parts[b]))}".encode()).hexdigest()
        parts[a] = [(v + int(stream[i % 32 * 4 : i % 32 * 4 + 4], 16)) % m for i, (v, m) in enumerate(zip(parts[a], radices[a], strict=True))]
    return parts[0] + parts[1]


def test_pseudonyms_by_hand(spark, docs_of):
    key = pii.DEMO_KEY
    ip = permuted([192, 168, 7, 9], [256] * 4, f"{key}|ip")
    card = "411111111111111"
    body = "".join(map(str, permuted([int(c) for c in card], [10] * 15, f"{key}|card|{'0' * 15}")))
    area, group, serial = permuted([122, 44, 6788], [898, 99, 9999], f"{key}|ssn")
    day = (datetime.date(2024, 2, 29) - datetime.date(1900, 1, 1)).days
    a, b = permuted([day // 292, day % 292], [250, 292], f"{key}|date")
    date = datetime.date(1900, 1, 1) + datetime.timedelta(a * 292 + b)
    out, _ = changed(spark, docs_of, ["192.168.7.9", with_check(card), "123-45-6789", "2024-02-29", "29.02.2024"])
    assert out == [".".join(map(str, ip)), with_check(body), f"{area + (2 if area >= 665 else 1):03d}-{group + 1:02d}-{serial + 1:04d}", date.isoformat(), date.strftime("%d.%m.%Y")]


def sharded(spark, docs_of, texts, ids=None, **kw):
    return [r.asDict() for r in shards.byte_shards(docs_of(texts, ids), **kw).collect()]


def test_shards_are_even_and_slots_gapless(spark, docs_of, words):
    r = random.Random(2)
    texts = [words(r.randrange(1, 60), i) for i in range(600)] + ["same text"] * 300 + ["", None, "é" * 30]
    out = sharded(spark, docs_of, texts, parts=7)
    assert len(out) == len(texts)
    size = {}
    for x in out:
        t = (texts[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        size.setdefault(x["shard"], []).append(x)
    assert sorted(size) == list(range(40))
    mean, most = sum(x["size"] for x in out) / 40, max(x["size"] for x in out)
    for rows in size.values():
        assert sorted(x["slot"] for x in rows) == list(range(len(rows)))
        assert abs(sum(x["size"] for x in rows) - mean) <= most + 0.02 * mean
    assert sorted(map(str, sharded(spark, docs_of, texts, parts=3))) == sorted(map(str, out))


def test_shards_are_the_cuts_of_one_sequence(spark, docs_of, words):
    texts = [words(1 + i % 90, i % 400) for i in range(800)] + ["hot text"] * 400 + [None, "", words(30_000, 1)]
    r = random.Random(4)
    ids = [r.randrange(10**6) for _ in texts]
    line = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), i) for t, i in zip(texts, ids, strict=True))
    total, start, want, slots = sum(x[1] for x in line), 0, [], {}
    for _, size, crc, i in line:
        shard = min(7, (2 * start + size) * 8 // (2 * total))
        want.append((i, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        start += size
    got = [(x["doc_id"], x["size"], x["text_crc32"], x["shard"], x["slot"]) for x in sharded(spark, docs_of, texts, ids, shards=8, parts=5)]
    assert sorted(got) == sorted(want)


def test_shards_of_odd_tables(spark, docs_of):
    assert sharded(spark, docs_of, []) == []
    out = sharded(spark, docs_of, ["a", "a", None], [1, 1, None])
    assert len(out) == 3 and {x["size"] for x in out} == {16, 17}


def test_top_matches(spark):
    r = np.random.default_rng(3)
    v = [[float(x) for x in r.integers(-3, 4, 8) / 4] for _ in range(400)]
    v[7], v[50], v[51], v[52] = None, v[100], [*v[51][:7], None], [*v[52][:7], float("nan")]
    v[60], v[61] = v[61][:5], [0.0] * 8
    rows = [(i, x, 1, 2) for i, x in enumerate(v)] + [(200, v[3], 1, 2), (None, v[3], 1, 2), (0, v[0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank int")
    fine = [(i, [int(np.floor(np.float64(np.float32(c)) * 256)) for c in x]) for i, x, *_ in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    want = []
    for q, x in {(i, tuple(x)) for i, x in fine if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in fine if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    for block in (16_384, 37):
        got = topk.top_matches(df, df.where("vec_id % 50 = 0"), candidate_block=block, query_block=max(3, block // 10)).collect()
        assert sorted(tuple(x) for x in got) == sorted(want)
    assert topk.top_matches(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert topk.top_matches(few, few.where("vec_id = 0").dropDuplicates(["vec_id"])).count() == 2


def test_large_components_use_longs():
    q = np.array([[2**30, 1]])
    assert topk.block_top(np.array([9]), q, np.array([1, 2]), np.array([[2**30, 0], [2**29, 5]]), 1)[2].tolist() == [2**60]


@pytest.mark.parametrize("make", [lambda d: pii.pseudonymise_documents(d), lambda d: shards.byte_shards(d), lambda d: linededup.line_keys(linededup.identified(d), [0] * linededup.KINDS)])
def test_native_plans_hold_no_python(docs_of, make):
    plan = make(docs_of(["a b c d e f"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
