"""Format-preserving pseudonyms for personal numbers and dates by keyed Feistel networks, in DataFrame functions only.

Numbers and dates in a text are found, validated and replaced by a keyed permutation of their own kind, so a card number stays a card number of
the same length, an address stays an address and a date stays a real date in the same notation. The same value has the same pseudonym in
every document, whatever separators it is written with, so documents stay linked; without the key it cannot be told back.

=========  =====================================================  ==========================================================
kind       found and valid                                        permuted
=========  =====================================================  ==========================================================
email      local part, ``@`` and a dotted host                     letters and digits of the local part, each within its class
                                                                   (digits; Latin, Greek and Cyrillic letters by case)
ip         four numbers up to 255                                  all 2 ** 32 addresses
iso date   yyyy-mm-dd, yyyy/mm/dd; a real day                      the days of 1800 to 2199
date       dd.mm.yyyy, dd/mm/yyyy, dd-mm-yyyy; a real day, else    the days of 1800 to 2199, in the same order
           mm.dd.yyyy and so on
ssn        ddd-dd-dddd with area, group and serial in use          all numbers in use
phone      ``+`` and country code, then 4 to 20 digits; or 3, 3    the digits after the country code, which the digits
           and 4 digits with brackets, dots or dashes              themselves tell, whatever blanks there are; or all
number     13 to 19 digits, also in groups by blanks or dashes     all digits but the last, which keeps the Luhn check as it was
=========  =====================================================  ==========================================================

Everything else, invalid dates and addresses included, stays as it is. A permutation can map a value to itself, as any permutation can, with the
probability of one in the number of values.

Results for odd rows: null texts stay null, empty ones empty; repeated rows get equal results; an empty table gives an empty result. Other columns
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
ISO_DATE = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)|(?<!\d)\d{4}/\d{2}/\d{2}(?!\d)"
DATE = r"(?<!\d)\d{2}\.\d{2}\.\d{4}(?!\d)|(?<!\d)\d{2}/\d{2}/\d{4}(?!\d)|(?<!\d)\d{2}-\d{2}-\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
NATIONAL = r"(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d.-])\d{3}\.\d{3}\.\d{4}(?![\d.-])"
NUMBER = r"(?<![\dA-Za-z])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])"
KINDS = ("email", "ip", "iso_date", "date", "ssn", "phone", "number")
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, IP, ISO_DATE, DATE, SSN, PHONE, NATIONAL, NUMBER))

# A full Gregorian cycle, so its days are a whole number of both factors.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def _prf(key: str, *parts: Column) -> Column:
    """A keyed number below 2 ** 60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts], F.lit(key)), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, left: int, right: int, key: str, domain: str) -> Column:
    """A permutation of 0 .. left * right - 1: an alternating Feistel network over the two digits of a mixed radix."""
    state = F.struct(F.floor(value / right).cast("long").alias("a"), F.pmod(value, F.lit(right)).cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + _prf(key, F.lit(domain), i, s["b"]), F.lit(left))).otherwise(s["a"]).cast("long").alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _prf(key, F.lit(domain), i, s["a"]), F.lit(right))).cast("long").alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step, lambda s: s["a"] * right + s["b"])


# Letters and digits that take each other's place.
CLASSES = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŸ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
)
# The country codes of one and of two digits; all others have three.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"


def _shifted(half: Column, other: Column, round_: Column, key: str, domain: str) -> Column:
    """Every letter and digit of ``half`` moved on within its class, by keyed steps that depend on its place and on ``other``."""

    def char(c: Column, place: Column) -> Column:
        step = _prf(key, F.lit(domain), round_, place, other)
        out = c
        for letters in reversed(CLASSES):
            at = F.instr(F.lit(letters), c)
            out = F.when((at > 0) & (c != ""), F.substring(F.lit(letters), F.pmod(at - 1 + step, F.lit(len(letters))).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(half, ""), char), "")


def feistel_text(value: Column, key: str, domain: str) -> Column:
    """A permutation of the texts of one pattern of letters and digits; all other characters stay where they are."""
    cut = F.ceil(F.length(value) / 2).cast("int")
    state = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, _shifted(s["a"], s["b"], i, key, domain)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(_shifted(s["b"], s["a"], i, key, domain)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step, lambda s: F.concat(s["a"], s["b"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _dressed(value: Column, digits: Column, after: Column) -> Column:
    """``digits`` in place of the digits of ``value`` that follow its first ``after`` digits, separators kept."""
    place = F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.length(_digits(F.substring(value, F.lit(1), i + 1)))).otherwise(F.lit(0)))
    return F.array_join(F.zip_with(F.split(value, ""), place, lambda c, n: F.when(n > after, F.substring(digits, n - after, F.lit(1))).otherwise(c)), "")


def luhn_digit(payload: Column) -> Column:
    """The digit that makes the payload pass the Luhn check when it follows."""

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(F.length(payload) - i, F.lit(2)) == 1, F.lit(2)).otherwise(F.lit(1))
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.split(payload, ""), weighed), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def _number(value: Column, key: str) -> Column:
    digits = _digits(value)
    payload, last = F.substring(digits, F.lit(1), F.length(digits) - 1), F.substring(digits, F.length(digits), F.lit(1)).cast("int")

    def built(pair: Column) -> Column:
        check = F.pmod(luhn_digit(pair["new"]) + pair["off"], F.lit(10)).cast("string")
        return _dressed(value, F.concat(pair["new"], check), F.lit(0))

    pair = F.struct(feistel_text(payload, key, "number").alias("new"), (last - luhn_digit(payload)).alias("off"))
    return F.element_at(F.transform(F.array(pair), built), 1)


def _phone(value: Column, key: str) -> Column:
    digits = _digits(value)
    head = F.when(value.startswith("+"), F.length(F.regexp_extract(digits, COUNTRY, 0))).otherwise(0)
    return _dressed(value, feistel_text(F.substring(digits, head + 1, F.length(value)), key, "phone"), head)


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o)

    def built(n: Column) -> Column:
        return F.array_join(F.transform(F.array(*map(F.lit, (24, 16, 8, 0))), lambda s: F.pmod(F.floor(n / F.pow(F.lit(2.0), s)), F.lit(256)).cast("long").cast("string")), ".")

    moved = F.element_at(F.transform(F.array(feistel(number, 1 << 16, 1 << 16, key, "ip")), built), 1)
    return F.when(F.forall(octets, lambda o: o <= 255), moved).otherwise(value)


def _date(value: Column, key: str, year_first: bool) -> Column:
    sep = F.substring(value, F.lit(5 if year_first else 3), F.lit(1))
    p = F.split(value, r"[-/.]")
    year, month, day = (p[0], p[1], p[2]) if year_first else (p[2], p[1], p[0])
    usual = F.concat_ws("-", year, month, day).try_cast("date")
    parsed = usual if year_first else F.coalesce(usual, F.concat_ws("-", year, day, month).try_cast("date"))
    index = F.datediff(parsed, F.lit(FIRST_DAY).cast("date")).cast("long")

    def built(n: Column) -> Column:
        d = F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
        y, m, x = (F.date_format(d, part) for part in ("yyyy", "MM", "dd"))
        first, second = (m, x) if year_first else (F.when(usual.isNull(), m).otherwise(x), F.when(usual.isNull(), x).otherwise(m))
        return F.concat(y, sep, first, sep, second) if year_first else F.concat(first, sep, second, sep, y)

    moved = F.element_at(F.transform(F.array(feistel(index, *DAYS, key, "date")), built), 1)
    return F.when(index.between(0, DAYS[0] * DAYS[1] - 1), moved).otherwise(value)


def _ssn(value: Column, key: str) -> Column:
    p = F.transform(F.split(value, "-"), lambda x: x.cast("long"))
    area = p[0] - 1 - F.when(p[0] > 666, 1).otherwise(0)  # 001 to 899 without 666
    valid = p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)

    def built(n: Column) -> Column:
        high = F.floor(n / 9999).cast("long")
        area_ = F.floor(high / 99).cast("long")
        area_ = area_ + 1 + F.when(area_ >= 665, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", area_, F.pmod(high, F.lit(99)) + 1, F.pmod(n, F.lit(9999)) + 1)

    moved = F.element_at(F.transform(F.array(feistel((area * 99 + p[1] - 1) * 9999 + p[2] - 1, 898 * 99, 9999, key, "ssn")), built), 1)
    return F.when(valid, moved).otherwise(value)


def _email(value: Column, key: str) -> Column:
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    return F.concat(feistel_text(local, key, "email"), F.lit("@"), host)


def kind_of(value: Column) -> Column:
    whole = lambda p: value.rlike(rf"\A(?:{p})\z")
    return (
        F.when(value.contains("@"), "email").when(whole(IP), "ip").when(whole(ISO_DATE), "iso_date").when(whole(DATE), "date").when(whole(SSN), "ssn")
        .when(value.startswith("+") | whole(NATIONAL), "phone").otherwise("number")
    )


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value."""
    kind = kind_of(value)
    return (
        F.when(kind == "email", _email(value, key)).when(kind == "ip", _ip(value, key)).when(kind == "iso_date", _date(value, key, True))
        .when(kind == "date", _date(value, key, False)).when(kind == "ssn", _ssn(value, key)).when(kind == "phone", _phone(value, key)).otherwise(_number(value, key))
    )


def with_pseudonyms(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text rewritten, and ``__llm_found``: an array of ``kind, value, pseudonym`` in the order of the text.

    Texts are searched once; only those with a find are cut and put together again.
    """
    text = F.col(text_col).cast("string")
    rows = docs.withColumn("__llm_values", F.coalesce(F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1)), F.array().cast("array<string>")))
    found = F.transform("__llm_values", lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value"), pseudonym(v, key).alias("pseudonym")))
    rows = rows.withColumn("__llm_found", found)
    between = F.split(text, PATTERN, -1)
    new = F.concat(F.transform("__llm_found", lambda f: f["pseudonym"]), F.array(F.lit("")))
    built = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, b)), "")
    return rows.withColumn(text_col, F.when(F.size("__llm_values") == 0, F.col(text_col)).otherwise(built)).drop("__llm_values")
