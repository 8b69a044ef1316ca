"""Format-preserving pseudonyms for personal numbers, dates, addresses and keys.

What looks personal is found by one pattern and then validated: Luhn for card numbers, modulo 97
for IBANs, calendar for dates, ranges for IPv4 addresses and social security numbers. A valid
value is permuted by a keyed Feistel network within its own format, so equal values get equal
pseudonyms in every document, different ones get different ones, and the result is valid in the
same way (check digits are computed anew). What fails validation stays as it is.

Two networks: over characters, each staying in its class (digits, a-f, g-z, A-F, G-Z; the first
digit of a group stays within 0-1 or 2-9), and over the numbers of a x b. Both are
bijections for any round function. DataFrame operations only; no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import text_of

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
# card numbers in one piece or as cards print them; a group of three digits or more beside them makes it a row of numbers
CARD = (r"(?<![\d-])(?<!\d{3}[ -])(?:\d{13,19}|\d{4}([ -])(?:\d{4}\1\d{4}\1\d{4}(?:\1\d{3}(?!\d))?|\d{6}\1\d{4,5})|\d{6}([ -])\d{4}\2\d{6})"
        r"(?![\d-]*\d| \d{3})")
# issuers' prefixes and lengths (ISO/IEC 7812 ranges as published by the networks).
ISSUERS = (r"4(?:\d{12}|\d{15}|\d{18})", r"5[1-5]\d{14}", r"2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}", r"3[47]\d{13}", r"3(?:0[0-5]|[689]\d)\d{11,16}",
           r"6(?:011|4[4-9]\d|5\d\d)\d{12,15}", r"35(?:2[89]|[3-8]\d)\d{12,15}", r"(?:62|81)\d{14,17}", r"(?:50|5[6-9]|6\d)\d{11,17}", r"220[0-4]\d{12,15}")
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)"
LAND = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"     # ITU country codes; none begins another
NATIONAL = r"(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{4}"
PHONE = rf"(?<![\d(])(?:(?:\+\d{{1,3}}[ .-]?)?{NATIONAL}|{LAND}(?:[ .-]?\(\d{{1,4}}\))?(?:[ .-]?\d){{6,12}})(?!\d)"
DATE = r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)"
SECRET = r"(?<=[\"'=: ])[0-9a-f]{32,64}(?![0-9A-Za-z])"


def numbered(pattern: str, before: int) -> str:
    """The pattern with its back references moved on by the groups before it."""
    return re.sub(r"\\([1-9])", lambda m: f"\\{int(m[1]) + before}", pattern)


PERSONAL = "|".join((EMAIL, IBAN, IPV4, numbered(CARD, 0), SSN, PHONE, numbered(DATE, 2), SECRET))
DAYS = (270, 271)                       # dates are permuted within windows of 270 * 271 days
FIRST_DAY = "1900-01-01"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once."""
    return F.transform(F.array(value), fn)[0]


def _draw(key: str, tweak: Column, round_: Column, seen: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, round_.cast("string"), seen).cast("binary"), 256)


def _hex(digest: Column, start: Column, length: int) -> Column:
    return F.conv(F.substring(digest, start, F.lit(length)), 16, 10).cast("bigint")


def permute_text(s: Column, key: str, tweak: Column) -> Column:
    """Keyed permutation of the strings of one length and one sequence of character classes."""
    classes = [("0", 2), ("2", 8), ("0", 10), ("a", 6), ("g", 20), ("A", 6), ("G", 20)]

    def class_of(c, before):
        lead = ~before.rlike("[0-9]")
        kind = F.when(c.rlike("[01]") & lead, 0).when(c.rlike("[2-9]") & lead, 1).when(c.rlike("[0-9]"), 2).when(c.rlike("[a-f]"), 3).when(
            c.rlike("[g-z]"), 4).when(c.rlike("[A-F]"), 5).when(c.rlike("[G-Z]"), 6)
        base = F.array(*[F.lit(ord(b)) for b, _ in classes])[kind]
        size = F.array(*[F.lit(n) for _, n in classes])[kind]
        return F.struct(c.alias("c"), base.alias("base"), F.coalesce(size, F.lit(1)).alias("size"),
                        F.coalesce(F.ascii(c) - base, F.lit(0)).cast("bigint").alias("v"))

    def run(chars):
        half = F.floor(F.size(chars) / 2).cast("int")

        def step(v, r):
            odd = r % 2
            other = F.when(odd == 0, F.slice(v, half + 1, F.size(v))).otherwise(F.slice(v, F.lit(1), half))
            # a digest has draws for sixteen places, the next sixteen have one of their own
            seen = F.array_join(other.cast("array<string>"), ",")
            draws = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 16).cast("int")), lambda j: _draw(key, tweak, r, F.concat_ws(":", j.cast("string"), seen)))
            return let(draws, lambda d: F.transform(v, lambda x, i: F.when((i < half) == (odd == 0),
                                                    (x + _hex(F.get(d, F.floor(i / 16).cast("int")), 4 * (i % 16) + 1, 4)) % F.get(chars, i)["size"]).otherwise(x)))
        values = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.transform(chars, lambda c: c["v"]), step)
        return F.array_join(F.zip_with(chars, values, lambda c, v: F.coalesce(F.char(c["base"] + v), c["c"])), "")

    return let(F.split(s, ""), lambda cs: let(F.transform(cs, lambda c, i: class_of(c, F.coalesce(F.get(cs, i - 1), F.lit("")))), run))


def permute_number(x: Column, a: int, b: int, key: str, tweak: Column) -> Column:
    """Keyed permutation of the numbers 0 .. a*b - 1."""
    def step(s, r):
        def moved(mine, other, size):
            return F.pmod(mine + _hex(_draw(key, tweak, r, other.cast("string")), F.lit(1), 12), F.lit(size).cast("bigint"))
        return F.struct(F.when(r % 2 == 0, moved(s["l"], s["r"], a)).otherwise(s["l"]).alias("l"),
                        F.when(r % 2 == 1, moved(s["r"], s["l"], b)).otherwise(s["r"]).alias("r"))
    start = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn sum of a digit string; shift 1: as if a check digit followed."""
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when((i + shift) % 2 == 0, c.cast("int")).otherwise(
        F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10)), F.lit(0), lambda a, d: a + d)


def mod97(s: Column) -> Column:
    """Remainder of an IBAN's letters (A = 10) and digits, in the order given."""
    def step(a, c):
        return F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by those of ``digits``."""
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(
        digits, F.char_length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[^0-9]", "")) + 1, F.lit(1))).otherwise(c)), "")


def _card(m: Column, key: str) -> Column:
    """All digits are the card's, or all but a last group of three behind four fours (its check code)."""
    def changed(shape):
        digits = F.regexp_replace(shape, "[ -]", "")
        valid = digits.rlike("^(?:" + "|".join(ISSUERS) + ")$") & (luhn_sum(digits, 0) % 10 == 0)
        body = permute_text(F.substring(digits, F.lit(1), F.char_length(digits) - 1), key, F.lit("card"))
        new = let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, 1), F.lit(10)).cast("string")))
        return F.when(valid, let(new, lambda d: refill(shape, d)))

    code = F.regexp_extract(m, r"^(?:\d{4}[ -]){4}\d{3}$", 0)
    return let(changed(m), lambda whole: F.coalesce(whole, F.when(code != "", F.concat(changed(F.substring(m, 1, 19)), F.substring(m, 20, 4)))))


def _phone(m: Column, key: str) -> Column:
    land = F.regexp_extract(m, rf"^({LAND}[ .-]?)?", 0)
    rest = F.regexp_replace(m, rf"^{LAND}[ .-]?", "")
    digits = F.regexp_replace(rest, "[^0-9]", "")
    grouped = F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3")      # leading digits of area and exchange
    return F.concat(land, let(F.regexp_replace(permute_text(grouped, key, F.lit("phone")), "-", ""), lambda d: refill(rest, d)))


def _iban(m: Column, key: str) -> Column:
    whole = F.replace(m, F.lit(" "), F.lit(""))
    land, rest = F.substring(whole, 1, 2), F.substring(whole, F.lit(5), F.char_length(whole))
    new = let(permute_text(rest, key, land), lambda r: F.concat(land, F.lpad((98 - mod97(F.concat(r, land, F.lit("00")))).cast("string"), 2, "0"), r))
    spaced = let(new, lambda n: F.when(F.contains(m, F.lit(" ")), F.regexp_replace(n, "(.{4})(?=.)", "$1 ")).otherwise(n))
    return F.when(mod97(F.concat(rest, F.substring(whole, 1, 4))) == 1, spaced)


def _ipv4(m: Column, key: str) -> Column:
    part = [F.split_part(m, F.lit("."), F.lit(k)).cast("bigint") for k in range(1, 5)]
    number = part[0] * (1 << 24) + part[1] * (1 << 16) + part[2] * 256 + part[3]
    new = let(permute_number(number, 1 << 16, 1 << 16, key, F.lit("ipv4")), lambda x: F.concat_ws(".", *[
        F.shiftright(x, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(F.greatest(*part) < 256, new)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("bigint"), F.substring(m, 5, 2).cast("bigint"), F.substring(m, 8, 4).cast("bigint")
    index = (area - 1 - (area > 666).cast("bigint")) * 99 + group - 1       # areas 001 to 899 without 666

    def spell(x):
        a = F.floor(F.floor(x / 9999) / 99)
        return F.concat_ws("-", F.lpad((a + 1 + (a >= 665).cast("bigint")).cast("string"), 3, "0"),
                           F.lpad((F.floor(x / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((x % 9999 + 1).cast("string"), 4, "0"))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, let(permute_number(index * 9999 + serial - 1, 898 * 99, 9999, key, F.lit("ssn")), spell))


def _date(m: Column, key: str) -> Column:
    days, out = DAYS[0] * DAYS[1], F.lit(None).cast("string")
    year_first = m.rlike(r"^\d{4}")
    mark, short = F.regexp_extract(m, "[-/.]", 0), m.rlike(r"(?<!\d)\d(?!\d)")     # short: without leading zeros
    a, b, c = (F.split_part(m, mark, F.lit(k)) for k in (1, 2, 3))
    a, b, c = (F.when(F.char_length(x) == 1, F.concat(F.lit("0"), x)).otherwise(x) for x in (a, b, c))

    def day_of(d):
        return F.when(short, F.date_format(d, "d")).otherwise(F.date_format(d, "dd"))

    def month_of(d):
        return F.when(short, F.date_format(d, "M")).otherwise(F.date_format(d, "MM"))
    tries = [(year_first, (a, b, c), lambda d: F.concat(F.date_format(d, "yyyy"), mark, month_of(d), mark, day_of(d))),
             (~year_first, (c, b, a), lambda d: F.concat(day_of(d), mark, month_of(d), mark, F.date_format(d, "yyyy"))),
             (~year_first, (c, a, b), lambda d: F.concat(month_of(d), mark, day_of(d), mark, F.date_format(d, "yyyy")))]
    for fits, ymd, spell in reversed(tries):
        day = F.datediff(F.try_to_date(F.concat_ws("-", *ymd), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("bigint")

        def moved(x):
            window = F.floor(x / days)
            return let(permute_number(F.pmod(x, F.lit(days)), *DAYS, key, F.lit("date")),
                       lambda y: let(F.date_add(F.lit(FIRST_DAY).cast("date"), (window * days + y).cast("int")), spell))
        # a window has to lie within the years 1000 to 9999
        out = F.when(fits & day.isNotNull() & (F.floor(day / days) >= -4) & (F.floor(day / days) < 40), let(day, moved)).otherwise(out)
    return out


def pseudonym(m: Column, key: str) -> Column:
    """(kind, value) for what the pattern found; kind is null and the value as found if invalid."""
    def whole(p):
        return m.rlike(f"^(?:{p})$")
    kinds = [("email", EMAIL, F.concat(permute_text(F.substring_index(m, "@", 1), key, F.lit("email")), F.lit("@"), F.substring_index(m, "@", -1))),
             ("iban", IBAN, _iban(m, key)), ("ipv4", IPV4, _ipv4(m, key)), ("card", CARD, _card(m, key)), ("ssn", SSN, _ssn(m, key)),
             ("phone", PHONE, _phone(m, key)),
             ("date", DATE, _date(m, key)),
             ("secret", r"[0-9a-f]{32,64}", permute_text(m, key, F.lit("secret")))]
    new = F.lit(None).cast("struct<kind:string,value:string>")

    def named(kind):
        return lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), F.coalesce(v, m).alias("value"))
    for kind, pattern, value in reversed(kinds):
        new = F.when(whole(pattern), let(value, named(kind))).otherwise(new)
    return F.coalesce(new, F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced, kinds) of every row of ``docs``; ``kinds`` lists the replaced values'
    kinds in order of place.

    A null text stays null with nothing replaced; the empty text stays empty; repeated rows come back
    as often as given, with equal pseudonyms; a null doc_id stays null; an empty table gives an
    empty table; other columns are not read. The text around the values is left untouched."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    some = F.col("text").rlike("[0-9][0-9.:() -]{2,}[0-9]|@|[0-9a-f]{32}")
    t = t.withColumn("found", F.when(some, F.regexp_extract_all("text", F.lit(PERSONAL), 0)).otherwise(F.array().cast("array<string>")))
    t = t.withColumn("new", F.transform("found", lambda m: pseudonym(m, key)))
    between = F.split("text", PERSONAL, -1)
    joined = F.array_join(F.zip_with(between, "new", lambda b, n: F.concat(F.coalesce(b, F.lit("")), F.coalesce(n["value"], F.lit("")))), "")
    kinds = F.filter(F.transform("new", lambda n: n["kind"]), lambda k: k.isNotNull())
    return t.select("doc_id", F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias("text"),
                    F.coalesce(F.size(kinds), F.lit(0)).cast("bigint").alias("n_replaced"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))
