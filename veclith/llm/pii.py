"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Candidates are found by pattern and validated (octet ranges, Luhn and mod-97 checks,
calendar dates, assignable social security numbers); what fails validation stays as it is.
A valid value becomes a vector of small integers with a radix each, which a keyed Feistel
network permutes: halves take turns, each adding a SHA-256 stream of the other modulo its
radices. That is a bijection on exactly the values of that format, so equal values get
equal pseudonyms in every document, different ones stay different, no table of values is
kept, and the key holder can turn pseudonyms back. Check digits are computed anew.

Everything happens inside a row: a text is cut at its matches, the matches are replaced and
the parts joined again. There is no shuffle, so hot values and hot sources cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
#: For tests and the registered query; production callers pass a secret of their own.
DEMO_KEY = "veclith-demonstration-key"

#: The forms that are looked for, the first that fits counts. Names of hosts have
#: at most 127 labels; a bound keeps the pattern from recursing with the text.
PATTERNS = {
    "email": r"[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}",
    "phone": r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}(?!\d)|\(\d{3}\) \d{3}-\d{4}(?!\d)|\+\d{1,3}[ -]\d{3}[ -]\d{3}[ -]\d{4}(?!\d)",
    "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![\p{L}\p{N}])",
    "card": r"(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{13,19})(?![\p{L}\p{N}])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\p{L}\p{N}])",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
}
#: Nothing that goes on to the left, except a sign, makes a match part of something longer.
ANY = r"(?<![\p{L}\p{N}._%+-])(?:" + "|".join(PATTERNS.values()) + ")"
#: A Gregorian cycle of 400 years from 1800 on has 146,097 = 189 x 773 days.
FIRST_DAY, DAY_RADICES = "1800-01-01", (189, 773)
_DIGITS = "0123456789"


def _letters(*ranges: tuple[int, int]) -> str:
    return "".join(chr(c) for first, last in ranges for c in range(first, last + 1))


#: Each character moves among those of its kind: digits; Latin, accented Latin, Greek and Cyrillic letters of a case.
_KINDS = (_DIGITS, common.LOWER, common.UPPER, _letters((0xDF, 0xF6), (0xF8, 0xFF)), _letters((0xC0, 0xD6), (0xD8, 0xDE)), _letters((0x3B1, 0x3C9)), _letters((0x391, 0x3A1), (0x3A3, 0x3A9)), _letters((0x430, 0x44F)), _letters((0x410, 0x42F)))
_MOVABLE = "[" + "".join(_KINDS) + "]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(values: Column, radices: Column, key: str, tweak: str, reverse: bool = False) -> Column:
    """``values`` (array<int>) permuted within ``radices``; ``reverse`` undoes it.

    Round r adds to one half, element i, 32 bits number i of the SHA-256 stream of
    ``key|tweak|r|i div 8|other half`` modulo the element's radix.
    """

    def rounds(v: Column) -> Column:
        half = (F.size(v) / 2).cast("int")

        def one(state: Column, r: Column) -> Column:
            left = r % 2 == 0  # of which the values change
            other = F.when(left, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, F.lit(1), half))

            def added(text: Column) -> Column:
                def step(x: Column, i: Column) -> Column:
                    at = F.when(left, i).otherwise(i - half)
                    block = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), r.cast("string"), (at / 8).cast("int").cast("string"), text).cast("binary"), 256)
                    number = F.conv(F.substring(block, (at % 8) * 8 + 1, F.lit(8)), 16, 10).cast("long")
                    turned = F.pmod(x + (-number if reverse else number), F.get(radices, i).cast("long")).cast("int")
                    return F.when((i < half) == left, turned).otherwise(x)

                return F.transform(state, step)

            return _let(F.array_join(other, ","), added)

        order = F.array(*map(F.lit, reversed(range(ROUNDS)) if reverse else range(ROUNDS)))
        return F.aggregate(order, v, one)

    return _let(values, rounds)


def _text(value: Column, key: str, tweak: str, reverse: bool) -> Column:
    """Digits become digits, letters of ``_KINDS`` letters of their kind; all else stays."""

    def code(c: Column) -> Column:
        return F.greatest(*(F.instr(F.lit(kind), c) for kind in _KINDS)) - 1

    def kind(c: Column) -> Column:
        found = F.when(F.contains(F.lit(_DIGITS), c), _DIGITS)
        for other in _KINDS[1:]:
            found = found.when(F.contains(F.lit(other), c), other)
        return found

    def done(all_chars: Column) -> Column:
        movable = F.filter(all_chars, lambda c: kind(c).isNotNull())

        def put(chars: Column) -> Column:
            values = F.transform(chars, code)
            radices = F.transform(chars, lambda c: F.length(kind(c)))

            def merge(new: Column) -> Column:
                # how many movable characters stand before each place tells which value it gets
                def char(c: Column, i: Column) -> Column:
                    before = F.size(F.filter(F.slice(all_chars, F.lit(1), i), lambda x: kind(x).isNotNull()))
                    return F.when(kind(c).isNull(), c).otherwise(F.substring(kind(c), F.get(new, before) + 1, F.lit(1)))

                return F.array_join(F.transform(all_chars, char), "")

            return _let(_let(radices, lambda r: feistel(values, r, key, tweak, reverse)), merge)

        return _let(movable, put)

    return _let(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), done)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    values = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: _let(d.cast("int") * (i % 2 + 1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def mod97(value: Column) -> Column:
    """Remainder of an IBAN-like string, its letters as two digits each."""
    numbers = F.transform(F.split(value, "(?<=.)(?=.)"), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(numbers, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _card(m: Column, key: str, reverse: bool) -> Column:
    def valid(d: Column) -> Column:
        new = _text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", reverse)

        def checked(body: Column) -> Column:
            return F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0")))) % 10).cast("string"))

        fresh = _let(new, checked)
        # separators, if any, stand after every fourth digit
        grouped = F.when(F.contains(m, F.lit(" ")), F.regexp_replace(fresh, r"(\d{4})(?=\d)", "$1 ")).when(F.contains(m, F.lit("-")), F.regexp_replace(fresh, r"(\d{4})(?=\d)", "$1-")).otherwise(fresh)
        return F.when((luhn_sum(d) == 0) & d.rlike("[1-9]"), grouped)

    return _let(_digits(m), valid)


def _iban(m: Column, key: str, reverse: bool) -> Column:
    def put(bban: Column) -> Column:
        check = 98 - mod97(F.concat(bban, F.substring(m, 1, 2), F.lit("00")))
        return F.concat(F.substring(m, 1, 2), F.lpad(check.cast("string"), 2, "0"), bban)

    fits = mod97(F.concat(F.substring(m, F.lit(5), F.length(m)), F.substring(m, 1, 4))) == 1
    return F.when(fits, _let(_text(F.substring(m, F.lit(5), F.length(m)), key, "iban", reverse), put))


def _phone(m: Column, key: str, reverse: bool) -> Column:
    country = F.regexp_extract(m, r"^(\+\d{1,3}[ -])?", 0)
    return F.concat(country, _text(F.substring(m, F.length(country) + 1, F.length(m)), key, "phone", reverse))


def _email(m: Column, key: str, reverse: bool) -> Column:
    local = F.substring_index(m, "@", 1)
    # without a character that can move there is nothing to replace, and nothing is said to be
    return F.when(local.rlike(_MOVABLE), F.concat(_text(local, key, "email", reverse), F.lit("@"), F.substring_index(m, "@", -1)))


def _ip(m: Column, key: str, reverse: bool) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    put = F.array_join(feistel(octets, F.array(*[F.lit(256)] * 4), key, "ip", reverse), ".")
    return F.when(F.forall(octets, lambda x: x < 256) & ~m.rlike(r"(^|\.)0\d"), put)


def _ssn(m: Column, key: str, reverse: bool) -> Column:
    area, group, serial = (F.split(m, "-")[k].cast("int") for k in range(3))
    values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)

    def put(v: Column) -> Column:
        a = F.get(v, F.lit(0)) + 1
        return F.format_string("%03d-%02d-%04d", a + F.when(a > 665, 1).otherwise(0), F.get(v, F.lit(1)) + 1, F.get(v, F.lit(2)) + 1)

    fits = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    return F.when(fits, _let(feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn", reverse), put))


def _date(m: Column, key: str, reverse: bool) -> Column:
    # slashes: the month first; taking either order would make pseudonyms ambiguous
    forms = [(m.rlike(r"^\d{4}-"), "yyyy-MM-dd"), (m.rlike(r"\."), "dd.MM.yyyy"), (m.rlike("/"), "MM/dd/yyyy")]
    first, a, b = F.lit(FIRST_DAY).cast("date"), *DAY_RADICES
    found = None

    def moved(form: str) -> Callable[[Column], Column]:
        def put(v: Column) -> Column:
            return F.date_format(F.date_add(first, F.get(v, F.lit(0)) * b + F.get(v, F.lit(1))), form)

        def of_day(day: Column) -> Column:
            number = F.datediff(day, first)
            new = feistel(F.array((number / b).cast("int"), number % b), F.array(F.lit(a), F.lit(b)), key, "date", reverse)
            return F.when((number >= 0) & (number < a * b), _let(new, put))

        return of_day

    for of, form in forms:
        one = F.when(of, _let(F.try_to_timestamp(m, F.lit(form)).cast("date"), moved(form)))
        found = one if found is None else F.coalesce(found, one)
    return found


#: How each kind is replaced; the result is null where the value isn't valid.
_REPLACE = {"email": _email, "phone": _phone, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date, "ip": _ip}


def replaced(text: Column, key: str, reverse: bool = False) -> Column:
    """For each candidate in a text, struct(kind, new); ``new`` is null where it isn't valid."""

    def one(m: Column) -> Column:
        kind, new = None, None
        for name, pattern in PATTERNS.items():
            fits = m.rlike(f"^(?:{pattern})$")
            kind = F.when(fits, name) if kind is None else kind.when(fits, name)
            new = F.when(fits, _REPLACE[name](m, key, reverse)) if new is None else new.when(fits, _REPLACE[name](m, key, reverse))
        return F.struct(m.alias("old"), kind.alias("kind"), new.alias("new"))

    return F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), one)


def _is(name: str) -> Callable[[Column], Column]:
    return lambda x: (x["kind"] == name) & x["new"].isNotNull()


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", reverse: bool = False, counts: bool = True) -> DataFrame:
    """``docs`` with its text replaced and, with ``counts``, n_email, n_phone, ... after it.

    Null text stays null and counts 0; texts without a valid value stay byte for byte.
    ``reverse`` turns pseudonyms of the same key back. Whole texts are processed, whatever
    their length; ids play no part, repeated rows give repeated results, an empty table
    gives an empty result. Columns that have the names of the counts are replaced, all
    others stay.

    What stays as it is, and isn't counted: the host of a mail address; an address whose
    local part has no digit and no Latin, Greek or Cyrillic letter, or whose host has more than
    127 labels; dates before 1800 and after 2199 and dates that don't exist; numbers that fail
    their check; country codes of telephone numbers.
    """
    name = common.unused(docs, "__found")
    text, found = F.col(text_col), F.col(name)
    some = text.rlike("[0-9@]")
    rows = docs.withColumn(name, F.when(some, replaced(text, key, reverse)))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.transform(gaps, lambda g, i: _let(F.get(found, i), lambda x: F.array(g, F.coalesce(x["new"], x["old"], F.lit("")))))), "")
    out = rows.withColumn(text_col, F.when(F.exists(found, lambda x: x["new"].isNotNull()), joined).otherwise(text))
    if counts:
        out = out.withColumns({f"n_{kind}": F.coalesce(F.size(F.filter(found, _is(kind))), F.lit(0)).cast("int") for kind in PATTERNS})
    return out.drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, DEMO_KEY)
