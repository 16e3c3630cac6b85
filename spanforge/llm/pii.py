"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Payment card numbers (Luhn), IPv4 addresses, phone numbers, social security
numbers, calendar dates and the local parts of e-mail addresses are found by one
pattern, validated, and replaced by a keyed permutation of the values of their own
format: an eight-round Feistel network whose halves are added modulo the sizes of
their domains, with SHA-256 of key, kind, round and other half as round function.
It is a bijection, so equal values get equal pseudonyms in every document and
different values different ones; separators, lengths and validity stay: a card
number passes Luhn, a date is a day of 1900 to 2099, an address has four octets.
E-mail local parts keep the class of every character, domains stay.  Octets have
the digits that their new values take, all else keeps its length.

Dates of each format are permuted among the dates of that format: year first; day
before month, by the digits of either; month before day, with a day over 12 (else
it reads day first), by the digits of the month.  Formats that can spell every day
share one permutation, so that 1999-12-31 and 31.12.1999 stay the same day; the
others permute years and days of the year, and a 29th of February among leap years.

The key isn't in the plan, so neither explain nor the event log shows it: a hash of
it comes from a scalar subquery on a table of one row.

What doesn't validate is left as it is.  The halves come from substrings or
remainders, so nothing exceeds a long.  No join, no shuffle, no Python.

Cases.  Null text stays null, empty text empty.  Repeated rows repeat.  All other
columns pass through unchanged.
"""

from __future__ import annotations

import datetime
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "date", "ip", "card", "ssn", "phone")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: One pattern for each kind; the first that matches at a place counts.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9](?:[\w.%+-]{0,62}[A-Za-z0-9_])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?!\w)",
    "date": r"(?<![\w/.-])(?:\d{4}([-/])\d{2}\1\d{2}|\d{1,2}([/.])\d{1,2}\2\d{4})(?!\d)",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "card": r"(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{4}|\d{4}([ -])\d{6}\4\d{5})(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<!\w)\+\d{11,14}(?!\w)",
}
PATTERN = "|".join(PATTERNS.values())
#: What an already found value looks like, by kind.
SHAPES = {
    "email": r"@",
    "date": r"^(\d{4}[-/]\d{2}[-/]\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})$",
    "ip": r"^(\d{1,3}\.){3}\d{1,3}$",
    "card": r"^(\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hash(key: Column, kind: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), i.cast("string"), other.cast("string")), 256)


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, kind: str) -> Column:
    """A permutation of the pairs (0 <= l < a, 0 <= r < b) as struct<l, r>."""

    def step(x: Column, i: Column) -> Column:
        l, r = x["l"], x["r"]
        more = lambda other: _number(F.substring(_hash(key, kind, i, other), 1, 15))  # noqa: E731  60 bits
        return F.when(i % 2 == 0, F.struct(((l + more(r) % a) % a).alias("l"), r.alias("r"))).otherwise(F.struct(l.alias("l"), ((r + more(l) % b) % b).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _shift(half: Column, pad: Column) -> Column:
    """Move each letter or digit within its class by two hexadecimal digits of ``pad``."""

    def move(c: Column, j: Column) -> Column:
        k = F.conv(F.substring(pad, (j % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        turn = lambda base, size: F.char(F.lit(base) + (code - base + k) % size)
        return F.when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).when(c.rlike("^[0-9]$"), turn(48, 10)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), move), "")


def _email(m: Column, key: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    half = F.floor((F.length(local) + 1) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r"))

    def step(x: Column, i: Column) -> Column:
        l, r = x["l"], x["r"]
        return F.when(i % 2 == 0, F.struct(_shift(l, _hash(key, "email", i, r)).alias("l"), r.alias("r"))).otherwise(
            F.struct(l.alias("l"), _shift(r, _hash(key, "email", i, l)).alias("r"))
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: F.concat(x["l"], x["r"]))
    return F.concat(done, F.substring(m, F.length(local) + 1, F.length(m)))


def _fill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("out"), digits.alias("rest"))

    def step(x: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), F.struct(F.concat(x["out"], F.substring(x["rest"], 1, 1)).alias("out"), F.substring(x["rest"], F.lit(2), F.length(x["rest"])).alias("rest"))).otherwise(
            F.struct(F.concat(x["out"], c).alias("out"), x["rest"].alias("rest"))
        )

    return F.aggregate(F.split(form, ""), start, step, lambda x: x["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _pad(n: Column, size) -> Column:
    return F.lpad(n.cast("string"), size, "0")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, every second digit from the last but one doubled."""
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, j: F.when(j % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: Column) -> Column:
    def change(d: Column) -> Column:
        n = F.length(d) - 1  # the last digit is computed
        half = F.floor((n + 1) / 2).cast("int")
        power = lambda k: F.pow(F.lit(10.0), k).cast("long")  # noqa: E731  at most 10^9: exact
        mixed = feistel(F.substring(d, F.lit(1), half), F.substring(d, half + 1, n - half), power(half), power(n - half), key, "card")
        new = _let(mixed, lambda x: F.concat(_pad(x["l"], half), _pad(x["r"], n - half)))
        return _let(new, lambda x: F.concat(x, ((F.lit(10) - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))

    return _let(_digits(m), lambda d: F.when(luhn_sum(d) % 10 == 0, _fill(m, change(d))).otherwise(m))


def _ip(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    mixed = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    return _let(mixed, lambda x: F.concat_ws(".", F.shiftright(x["l"], 8), x["l"] % 256, F.shiftright(x["r"], 8), x["r"] % 256))


def _ssn(m: Column, key: Column) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    d = _digits(m)
    area, group, serial = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 2).cast("long"), F.substring(d, 6, 4).cast("long")
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    mixed = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def spell(x: Column) -> Column:
        at = F.floor(x["l"] / 99)
        return F.concat_ws("-", _pad(at + 1 + F.when(at >= 665, 1).otherwise(0), 3), _pad(x["l"] % 99 + 1, 2), _pad(x["r"] + 1, 4))

    return F.when(valid, _let(mixed, spell)).otherwise(m)


def _phone(m: Column, key: Column) -> Column:
    """The last ten digits; numbers whose area begins with 2 to 9 stay so."""

    def change(d: Column) -> Column:
        n = F.length(d)
        own = F.substring(d, n - 9, F.lit(10))
        left, right = F.substring(own, 1, 5).cast("long"), F.substring(own, 6, 5).cast("long")
        least = F.when(left >= 20000, 20000).otherwise(0)
        # numbers below are their own domain, so that either kind is permuted among its own
        mixed = feistel(left - least, right, F.when(left >= 20000, 80000).otherwise(20000), F.lit(100000), key, "phone")
        return _let(mixed, lambda x: F.concat(F.substring(d, F.lit(1), n - 10), _pad(x["l"] + least, 5), _pad(x["r"], 5)))

    return _let(_digits(m), lambda d: _fill(m, change(d)))


#: Days of a year that isn't a leap year, from 0.
_YEAR = [datetime.date(2001, 1, 1) + datetime.timedelta(i) for i in range(365)]
#: Formats that can't spell every day: which days they can spell, and whether a 29th of February.
_PARTIAL = {
    "d/m": ([i for i, x in enumerate(_YEAR) if x.day < 10 and x.month < 10], False),
    "d/mm": ([i for i, x in enumerate(_YEAR) if x.day < 10], False),
    "dd/m": ([i for i, x in enumerate(_YEAR) if x.month < 10], True),
    "m/DD": ([i for i, x in enumerate(_YEAR) if x.day > 12 and x.month < 10], True),
    "mm/DD": ([i for i, x in enumerate(_YEAR) if x.day > 12], True),
}


def _days(form: str, day: Column, key: Column) -> Column:
    """The date that stands for ``day`` among those that a format of ``_PARTIAL`` can spell."""
    days, leap = _PARTIAL[form]
    table = F.expr(f"array({', '.join(map(str, days))})")
    year, first = F.year(day).cast("long") - 1900, F.lit("2001-01-01").cast("date")
    at = F.datediff(F.make_date(F.lit(2001), F.month(day), F.dayofmonth(day)), first)
    mixed = feistel(year, F.array_position(table, at) - 1, F.lit(200), F.lit(len(days)), key, form)

    def spell(x: Column) -> Column:
        other = F.date_add(first, F.element_at(table, (x["r"] + 1).cast("int")))
        return F.make_date((x["l"] + 1900).cast("int"), F.month(other), F.dayofmonth(other))

    out = _let(mixed, spell)
    if not leap:
        return out
    # leap years from 1904 to 2096 are 49, seven times seven
    n = F.floor((year - 4) / 4).cast("long")
    leaps = _let(feistel(F.floor(n / 7), n % 7, F.lit(7), F.lit(7), key, "leap " + form), lambda x: F.make_date(((x["l"] * 7 + x["r"]) * 4 + 1904).cast("int"), F.lit(2), F.lit(29)))
    return F.when((F.month(day) == 2) & (F.dayofmonth(day) == 29), leaps).otherwise(out)


def _date(m: Column, key: Column) -> Column:
    """Year first, or day and month before the year: day first where that is a date, else month first."""
    p = F.split(m, r"[-/.]")
    whole = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    day_first, wide = p[1].cast("int") <= 12, lambda at: F.length(p[at]) == 2
    form = (
        F.when(m.rlike(r"^\d{4}"), "ymd")
        .when(day_first, F.concat(F.when(wide(0), "dd").otherwise("d"), F.when(wide(1), "/mm").otherwise("/m")))
        .otherwise(F.when(wide(0), "mm/DD").otherwise("m/DD"))
    )

    def dated(x: Column) -> Column:
        form = x["form"]
        day = F.when(form == "ymd", whole(p[0], p[1], p[2])).when(form.endswith("DD"), whole(p[2], p[0], p[1])).otherwise(whole(p[2], p[1], p[0]))
        return F.struct(form.alias("form"), day.alias("day"))

    def change(x: Column) -> Column:
        form, day = x["form"], x["day"]
        days = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")

        def spell(new: Column) -> Column:
            sep = F.regexp_extract(m, r"[-/.]", 0)
            part = lambda number, at: F.when(wide(at), _pad(number, 2)).otherwise(number.cast("string"))
            year, month, d = _pad(F.year(new), 4), F.month(new), F.dayofmonth(new)
            return (
                F.when(form == "ymd", F.concat(year, sep, _pad(month, 2), sep, _pad(d, 2)))
                .when(form.endswith("DD"), F.concat(part(month, 0), sep, part(d, 1), sep, year))
                .otherwise(F.concat(part(d, 0), sep, part(month, 1), sep, year))
            )

        # 1900 to 2099 are 73,049 days, 17 times 4,297
        all_days = _let(feistel(F.floor(days / 4297), days % 4297, F.lit(17), F.lit(4297), key, "date"), lambda y: F.date_add(F.lit("1900-01-01").cast("date"), (y["l"] * 4297 + y["r"]).cast("int")))
        new = F.when(form.isin("ymd", "dd/mm"), all_days)
        for name in _PARTIAL:
            new = new.when(form == name, _days(name, day, key))
        return F.when(days.isNotNull() & (days >= 0) & (days < 73049), _let(new, spell)).otherwise(m)

    return _let(_let(F.struct(form.alias("form")), dated), change)


def kind_of(m: Column) -> Column:
    out = None
    for kind, shape in SHAPES.items():
        out = F.when(m.rlike(shape), kind) if out is None else out.when(m.rlike(shape), kind)
    return out.otherwise("phone")


def pseudonym(m: Column, key: Column) -> Column:
    """The replacement of a found value."""
    by_kind = {"email": _email, "date": _date, "ip": _ip, "card": _card, "ssn": _ssn}
    out = None
    for kind, shape in SHAPES.items():
        new = by_kind[kind](m, key)
        out = F.when(m.rlike(shape), new) if out is None else out.when(m.rlike(shape), new)
    return out.otherwise(_phone(m, key))


def hidden(spark: SparkSession, key: str) -> Column:
    """A hash of the key, as a scalar subquery whose value no plan shows."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"key": [hashlib.sha256(key.encode()).hexdigest()]})).scalar()


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` replaced; ``counts`` adds n_<kind>, what was changed by kind."""
    taken = set(docs.columns)
    own = lambda name: next(n for n in (f"{name}{'_' * i}" for i in range(99)) if n not in taken)
    found, new, secret = own("_found"), own("_new"), own("_key")
    # a value has a digit or an at sign: texts without aren't searched
    step = docs.withColumn(found, F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    step = step.withColumn(secret, hidden(docs.sparkSession, key)).withColumn(new, F.transform(found, lambda m: pseudonym(m, F.col(secret))))
    gaps = F.split(F.col(text), PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.concat(F.col(new), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = {k: F.size(F.filter(F.zip_with(found, new, lambda a, b: F.when(a != b, kind_of(a))), lambda x: x == k)) for k in KINDS} if counts else {}
    out = [F.when(F.size(found) > 0, joined).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return step.select(*out, *(F.coalesce(n, F.lit(0)).alias(f"n_{k}") for k, n in changed.items()))
