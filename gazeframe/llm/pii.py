"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Numbers (cards, accounts, social security, phone, IPv4), dates, e-mail names and secret hex keys are found by pattern
and validated (Luhn, mod 97, ranges, calendar). A keyed Feistel network permutes each value within its own format:
every position keeps its kind of character, cards and accounts keep valid check digits, addresses and dates stay
addresses and dates. The permutation depends on the key and the value alone, so equal values stay linked across
documents, and different values of one format never meet.

No value spans two lines and each holds a digit or an at sign, so only such lines are searched, once: a text is split
around its matches and joined again, and everything else stays byte for byte. No rows are shuffled. No pattern repeats
a group without a bound, so a text of any length is searched on a stack of fixed depth.

Mail names may hold letters, digits and marks of any script and the signs ``. _ + - ' & % * ~``; signs before the first
letter or digit (a quote, dots) are no part of the name. Letters are permuted within their own alphabet: ASCII, accented
Latin, Greek and Cyrillic by case, and the letters of Hebrew, Arabic, Devanagari, Thai, kana, Han and Hangul. Combining
marks and letters of other scripts stay in place.

Defined cases: null stays null and empty stays empty; an empty table gives an empty result; values that fail their check (a card number with a wrong
digit, 31 February) are no personal data and stay; dates run from 1900-01-01 for 73,000 days, others stay; of a
day-month ambiguity the day comes first where that is a date; repeated rows change alike; a mail name of one character
and other values of one symbol are shifted by a number that depends on key and format alone (still a permutation); a
host has at most 126 labels of 63 characters, as names on the net do; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The setting of the session that holds the key; without it the demonstration key is used.
KEY_SETTING, DEMO_KEY = "spark.gazeframe.pseudonym.key", "pseudonym-key-1"
#: Stands around matches while a text is split; texts that hold it themselves are searched twice instead.
_MARK = "\ue000"
_DATE_A, _DATE_B = 250, 292  # a x b = 73,000 days
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Accented Latin letters, lower then upper case, and the private code points that stand in for them in one block each.
_LATIN = [chr(c) for c in range(0xC0, 0x180)]
_CASES = [[c for c in _LATIN if c.islower()], [c for c in _LATIN if c.isupper()]]
_ACCENTED = "".join(c for case in _CASES for c in case)
_STAND_INS = "".join(chr(0xE100 + i) for i in range(len(_ACCENTED)))
#: Blocks of mail names that are permuted each within itself, as first and last code point: digits, then letters by script and case.
_BLOCKS = (
    (0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0xE100, 0xE100 + len(_CASES[0]) - 1), (0xE100 + len(_CASES[0]), 0xE100 + len(_ACCENTED) - 1),
    (0x3AC, 0x3CE), (0x391, 0x3A1), (0x430, 0x45F), (0x400, 0x42F), (0x5D0, 0x5EA), (0x621, 0x63A), (0x905, 0x939), (0xE01, 0xE2E),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
)

#: What a mail name may hold. The lookbehind lets a search begin at the first character of a run only.
_IN_NAME = r"\p{L}\p{M}\p{N}_.+'\u2019&%*~-"
EMAIL = rf"(?<![{_IN_NAME}])[{_IN_NAME}]++@(?:[\p{{L}}\p{{M}}\p{{N}}-]{{1,63}}\.){{1,126}}\p{{L}}[\p{{L}}\p{{M}}]+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
DATE_YMD = r"(?<![\w.])\d{4}([-/.])\d{1,2}\1\d{1,2}(?!\w|\.\d)"
DATE_DMY = r"(?<![\w.])\d{1,2}([-/.])\d{1,2}\2\d{4}(?!\w|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)"
PHONE = r"(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)"
HEX = r"(?<![A-Za-z0-9])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,64}(?![A-Za-z0-9])"
NO_MAIL = "|".join((IBAN, IP, DATE_YMD, DATE_DMY, SSN, CARD, PHONE, HEX))
ANY = f"{EMAIL}|{NO_MAIL}"
#: Lengths of account numbers by land.
_IBAN_LANDS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
#: The usual layouts alone, for the second look: a short number or word beside the value is no part of it.
IBAN_LAID_OUT = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{'|'.join(lands.split())})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, lands in _IBAN_LANDS.items()) + r")(?![A-Za-z0-9])"
CARD_LAID_OUT = r"(?<!\w)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"
AGAIN_NO_MAIL = "|".join((IBAN_LAID_OUT, IP, DATE_YMD, DATE_DMY, SSN, CARD_LAID_OUT, PHONE, HEX))
AGAIN = f"{EMAIL}|{AGAIN_NO_MAIL}"


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once; an expression that stands in a lambda is worked out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _stream(key: Column, part: Column, r: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, r.cast("string"), F.array_join(F.transform(part, lambda v: v.cast("string")), ",")), 512)


def _added(part: Column, radix: Column, stream: Column) -> Column:
    """Each symbol plus four hex digits of the stream, modulo the symbol's radix; the stream repeats after 32 symbols."""
    digits = lambda st, i: F.conv(F.substring(st, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
    return _let(stream, lambda st: F.transform(part, lambda v, i: F.pmod(v + digits(st, i), F.get(radix, i))))


def feistel(symbols: Column, radix: Column, key: Column) -> Column:
    """A keyed permutation of symbol arrays in which symbol i stays below radix i; halves take turns."""

    def turn(s: Column, r: Column) -> Column:
        left = F.when(r % 2 == 0, _added(s["a"], s["ra"], _stream(s["key"], s["b"], r))).otherwise(s["a"])
        right = F.when(r % 2 == 1, _added(s["b"], s["rb"], _stream(s["key"], s["a"], r))).otherwise(s["b"])
        return F.struct(left.alias("a"), right.alias("b"), s["ra"].alias("ra"), s["rb"].alias("rb"), s["key"].alias("key"))

    def turns(x: Column) -> Column:
        half = F.floor((F.size(x["s"]) + 1) / 2).cast("int")
        cut = [f(x[n]).alias(name) for n, names in (("s", ("a", "b")), ("r", ("ra", "rb"))) for name, f in zip(names, (lambda v: F.slice(v, F.lit(1), half), lambda v: F.slice(v, half + 1, F.size(v))), strict=True)]
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(*cut, x["key"].alias("key")), turn, lambda s: F.concat(s["a"], s["b"]))

    return _let(F.struct(symbols.alias("s"), radix.alias("r"), key.alias("key")), turns)


def permuted(value: Column, alphabets: tuple[str, ...], key: Column) -> Column:
    """``value`` with every character of one of the alphabets permuted inside that alphabet; others stay in place."""

    def pick(of, otherwise):
        return lambda c: _choose([(F.instr(F.lit(a), c) > 0, of(a, c)) for a in alphabets], otherwise(c))

    def of_chars(chars: Column) -> Column:
        symbols = F.transform(chars, pick(lambda a, c: F.instr(F.lit(a), c) - 1, lambda c: F.lit(0)))
        radix = F.transform(chars, pick(lambda a, c: F.lit(len(a)), lambda c: F.lit(1)))
        made = feistel(symbols, radix, F.concat_ws("|", key, F.array_join(F.transform(chars, pick(lambda a, c: F.lit(a[0]), lambda c: c)), "")))
        return F.array_join(F.zip_with(chars, made, lambda c, v: _choose([(F.instr(F.lit(a), c) > 0, F.substring(F.lit(a), v + 1, F.lit(1))) for a in alphabets], c)), "")

    return _let(_chars(value), of_chars)


def permuted_letters(value: Column, key: Column) -> Column:
    """``value`` with the letters and digits of any of the blocks permuted inside their block; others stay in place."""
    blocks = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b - a + 1).alias("n")) for a, b in _BLOCKS])

    def of_code(code: Column) -> Column:
        return F.get(F.filter(blocks, lambda b: (code >= b["lo"]) & (code < b["lo"] + b["n"])), F.lit(0))

    def of_parts(parts: Column) -> Column:
        symbols = F.transform(parts, lambda p: F.coalesce(F.ascii(p["c"]) - p["b"]["lo"], F.lit(0)))
        radix = F.transform(parts, lambda p: F.coalesce(p["b"]["n"], F.lit(1)))
        made = feistel(symbols, radix, F.concat_ws("|", key, F.array_join(F.transform(parts, lambda p: F.coalesce(p["b"]["lo"].cast("string"), p["c"])), " ")))
        letter = lambda v: F.decode(F.unhex(F.lpad(F.hex(v), 4, "0")), "UTF-16BE")
        return F.array_join(F.zip_with(parts, made, lambda p, v: F.coalesce(letter(p["b"]["lo"] + v), p["c"])), "")

    chars = _chars(F.translate(value, _ACCENTED, _STAND_INS))
    return F.translate(_let(F.transform(chars, lambda c: F.struct(c.alias("c"), of_code(F.ascii(c)).alias("b"))), of_parts), _STAND_INS, _ACCENTED)


def _choose(cases, otherwise) -> Column:
    out = F.when(*cases[0])
    for c in cases[1:]:
        out = out.when(*c)
    return out.otherwise(otherwise)


def _luhn(digits: Column, doubled_from: int) -> Column:
    """The Luhn sum; every second digit from the right is doubled, beginning with place ``doubled_from`` (0 or 1)."""
    values = F.reverse(F.transform(_chars(digits), lambda c: c.cast("int")))
    terms = F.transform(values, lambda v, i: F.when(i % 2 == doubled_from, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v))
    return F.aggregate(terms, F.lit(0), lambda s, v: s + v)


def _mod97(alnum: Column) -> Column:
    """The remainder of an account number's digits by 97, letters counted as 10 to 35."""
    values = F.transform(_chars(alnum), lambda c: F.instr(F.lit(_DIGITS + _UPPER), c) - 1)
    return F.aggregate(values, F.lit(0), lambda r, v: F.pmod(r * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def _refill(shape: Column, digits: Column) -> Column:
    """The digits put into the digit places of a value, in order."""

    def step(s: Column, c: Column) -> Column:
        place = c.rlike("[0-9A-Z]")
        return F.struct(F.concat(s["out"], F.when(place, F.substring(digits, s["n"], F.lit(1))).otherwise(c)).alias("out"), (s["n"] + place.cast("int")).alias("n"))

    return F.aggregate(_chars(shape), F.struct(F.lit("").alias("out"), F.lit(1).alias("n")), step, lambda s: s["out"])


def _card(value: Column, key: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    body = permuted(F.left(digits, F.length(digits) - 1), (_DIGITS,), F.concat(key, F.lit("|card")))
    whole = _let(body, lambda d: F.concat(d, F.pmod(10 - _luhn(d, 0) % 10, F.lit(10)).cast("string")))
    return F.when(_luhn(digits, 1) % 10 == 0, _let(whole, lambda d: _refill(value, d))).otherwise(value)


def _iban(value: Column, key: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    land, account = F.left(plain, F.lit(2)), F.substring(plain, F.lit(5), F.length(plain))
    valid = (_mod97(F.concat(account, F.left(plain, F.lit(4)))) == 1) & F.length(plain).between(15, 34)
    new = permuted(account, (_DIGITS, _UPPER), F.concat(key, F.lit("|iban"), land))
    check = lambda a: F.lpad((98 - _mod97(F.concat(a, land, F.lit("00")))).cast("string"), 2, "0")
    whole = _let(new, lambda a: F.concat(land, check(a), a))
    return F.when(valid, _let(whole, lambda d: _refill(value, d))).otherwise(value)


def _ip(value: Column, key: Column) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda c: c.cast("int"))
    new = feistel(octets, F.array(*[F.lit(256)] * 4), F.concat(key, F.lit("|ip")))
    return F.when(F.forall(octets, lambda o: o <= 255), F.array_join(F.transform(new, lambda o: o.cast("string")), ".")).otherwise(value)


def _ssn(value: Column, key: Column) -> Column:
    valid = value.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")
    # Mixed radix over the valid ranges: 898 areas (001-899 but 666), 99 groups, 9999 serials.
    area, group, serial = (F.split_part(value, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    symbols = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    new = feistel(symbols, F.array(F.lit(898), F.lit(99), F.lit(9999)), F.concat(key, F.lit("|ssn")))
    place = lambda n: F.when(F.get(n, F.lit(0)) >= 665, F.get(n, F.lit(0)) + 2).otherwise(F.get(n, F.lit(0)) + 1)
    shaped = _let(new, lambda n: F.format_string("%03d-%02d-%04d", place(n), F.get(n, F.lit(1)) + 1, F.get(n, F.lit(2)) + 1))
    return F.when(valid, shaped).otherwise(value)


def _date(value: Column, key: Column, year_first: bool) -> Column:
    sep = F.substring(F.regexp_replace(value, "[0-9]", ""), 1, 1)
    part = lambda i: F.get(F.split(value, "[-/.]"), F.lit(i)).cast("int")
    parsed = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    first = parsed(part(0), part(1), part(2)) if year_first else parsed(part(2), part(1), part(0))
    date = first if year_first else F.coalesce(first, parsed(part(2), part(0), part(1)))
    month_first = F.lit(False) if year_first else first.isNull()
    day = F.datediff(date, F.lit("1900-01-01").cast("date"))
    new = feistel(F.array(F.floor(day / _DATE_B).cast("int"), day % _DATE_B), F.array(F.lit(_DATE_A), F.lit(_DATE_B)), F.concat(key, F.lit("|date")))
    moved = _let(new, lambda n: F.date_add(F.lit("1900-01-01").cast("date"), F.get(n, F.lit(0)) * _DATE_B + F.get(n, F.lit(1))))

    def shaped(t: Column) -> Column:
        y, m, d = (F.format_string(p, f(t)) for p, f in (("%04d", F.year), ("%02d", F.month), ("%02d", F.day)))
        return F.concat_ws("", y, sep, m, sep, d) if year_first else F.when(month_first, F.concat_ws("", m, sep, d, sep, y)).otherwise(F.concat_ws("", d, sep, m, sep, y))

    return F.when(day.between(0, _DATE_A * _DATE_B - 1), _let(moved, shaped)).otherwise(value)


def _email(value: Column, key: Column) -> Column:
    before, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    signs = F.regexp_extract(before, r"^[^\p{L}\p{N}]*", 0)
    name, secret = F.substring(before, F.length(signs) + 1, F.length(before)), F.concat(key, F.lit("|mail|"), F.lower(host))
    plain = permuted(name, (_DIGITS, _LOWER, _UPPER), secret)
    return F.concat(signs, F.when(name.rlike(r"^\p{ASCII}*$"), plain).otherwise(permuted_letters(name, secret)), F.lit("@"), host)


def _phone(value: Column, key: Column) -> Column:
    land = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)
    return F.concat(land, permuted(F.substring(value, F.length(land) + 1, F.length(value)), (_DIGITS,), F.concat(key, F.lit("|phone|"), land)))


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of one matched value; the value itself where it fails its check."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    date_dmy = DATE_DMY.replace(r"\2", r"\1")
    return (
        F.when(F.contains(value, F.lit("@")), _email(value, key))
        .when(whole(IBAN), _iban(value, key))
        .when(whole(IP), _ip(value, key))
        .when(whole(DATE_YMD), _date(value, key, True))
        .when(whole(date_dmy), _date(value, key, False))
        .when(whole(SSN), _ssn(value, key))
        .when(whole(CARD), _card(value, key))
        .when(whole(PHONE), _phone(value, key))
        .otherwise(permuted(value, (_DIGITS + "abcdef",), F.concat(key, F.lit("|hex"))))
    )


def pieces_of(text: Column, pattern: str, without_mail: str) -> Column:
    """A text cut around the matches of a pattern that needs a digit or an at sign and stays in one line: gap, value, gap, ..., gap.

    ``without_mail`` is the pattern for lines that hold no at sign.
    """
    around = lambda line, p: F.regexp_replace(line, p, f"{_MARK}$0{_MARK}")
    marked = F.transform(F.split(text, "\n"), lambda line: F.when(F.contains(line, F.lit("@")), around(line, pattern)).when(line.rlike("[0-9]"), around(line, without_mail)).otherwise(line))
    twice = F.flatten(F.zip_with(F.split(text, pattern, -1), F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit(""))), lambda gap, value: F.array(gap, value)))
    return F.when(F.contains(text, F.lit(_MARK)), F.slice(twice, F.lit(1), F.size(twice) - 1)).otherwise(F.split(F.array_join(marked, "\n"), _MARK))


def _every_second(pieces: Column, first: int) -> Column:
    return F.filter(pieces, lambda x, i: i % 2 == first)


def _joined(gaps: Column, values: Column) -> Column:
    """Gaps and the values between them, in turn; there is one gap more."""
    return F.array_join(F.flatten(F.zip_with(gaps, F.concat(values, F.array(F.lit(""))), lambda gap, value: F.array(gap, value))), "")


def _n_changed(found: Column, made: Column) -> Column:
    return F.size(F.filter(F.zip_with(found, made, lambda a, b: a != b), lambda x: x))


def _unchanged_gaps(pieces: Column, found: Column, made: Column) -> Column:
    """The stretches of a text between the values that passed their check; values that failed it are part of them."""
    steps = F.zip_with(F.zip_with(found, made, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(pieces, F.lit(2), F.size(found)), lambda v, gap: F.struct(v["a"].alias("a"), v["b"].alias("b"), gap.alias("gap")))
    start = F.struct(F.array().cast("array<string>").alias("all"), F.get(pieces, F.lit(0)).alias("now"))

    def step(s: Column, v: Column) -> Column:
        passed = v["a"] != v["b"]
        return F.struct(F.when(passed, F.concat(s["all"], F.array(s["now"]))).otherwise(s["all"]).alias("all"), F.when(passed, v["gap"]).otherwise(F.concat(s["now"], v["a"], v["gap"])).alias("now"))

    return F.aggregate(steps, start, step, lambda s: F.concat(s["all"], F.array(s["now"])))


def pseudonymise_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, n_found (values matched) and n_changed (values that passed their checks).

    A card or account that fails its check may have taken in a number or word beside it: the stretches of such a text
    that are still unchanged are searched again for the usual layouts, and for what the long match had covered.
    """
    secret = F.lit(key or docs.sparkSession.conf.get(KEY_SETTING, DEMO_KEY))
    none, whole = F.array().cast("array<string>"), lambda v: v.rlike(f"^(?:{IBAN}|{CARD})$")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = base.withColumn("pieces", pieces_of(F.col("text"), ANY, NO_MAIL))
    out = out.withColumn("found", F.when(F.size("pieces") > 1, _every_second(F.col("pieces"), 1)).otherwise(none)).withColumn("around", F.when(F.size("pieces") > 1, _every_second(F.col("pieces"), 0)).otherwise(none))
    out = out.withColumn("made", F.transform("found", lambda v: pseudonym(v, secret)))
    failed = F.exists(F.zip_with("found", "made", lambda a, b: (a == b) & whole(a)), lambda x: x)
    out = out.withColumn("gaps", F.when(failed, _unchanged_gaps(F.col("around"), F.col("found"), F.col("made"))).otherwise(none))
    out = out.withColumn("inner", F.transform("gaps", lambda g: pieces_of(g, AGAIN, AGAIN_NO_MAIL)))
    out = out.withColumn("again", F.transform("inner", lambda p: _every_second(p, 1))).withColumn("remade", F.transform("again", lambda f: F.transform(f, lambda v: pseudonym(v, secret))))
    changed = _n_changed(F.col("found"), F.col("made"))
    more = F.aggregate(F.zip_with("again", "remade", _n_changed), F.lit(0), lambda s, n: s + n)
    passed = F.filter(F.zip_with("found", "made", lambda a, b: F.when(a != b, b)), lambda v: v.isNotNull())
    twice = _joined(F.zip_with("inner", "remade", lambda p, m: _joined(_every_second(p, 0), m)), passed)
    return out.select(
        "doc_id",
        F.when(F.size("gaps") > 0, twice).when(F.size("found") > 0, _joined(F.col("around"), F.col("made"))).otherwise(F.col("text")).alias("text"),
        F.greatest(F.size("found"), changed + more, F.lit(0)).alias("n_found"),
        F.greatest(changed + more, F.lit(0)).alias("n_changed"),
    )
