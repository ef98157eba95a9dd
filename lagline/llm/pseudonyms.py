"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in SQL functions.

Numbers and dates found in a text are validated (check digits, ranges, calendar) and, where
valid, permuted within their format: the digits split into two halves, and eight rounds add to
one half a keyed hash of the other, modulo the half's size. The permutation is one to one on
each format, so equal values get equal pseudonyms in all documents and different ones different
pseudonyms; separators stay, check digits are computed anew, dates stay dates.

=========  ==========================================================================
card       13-19 digits with a valid Luhn digit
iban       valid modulo 97, in one piece or in groups; known countries at their length
phone      international in groups of 1-8 digits, 7-15 digits in all, or national in three
           groups; the country code stays
ssn        3-2-4 digits with a valid area, group and serial
ip         four octets of 0-255, permuted as one number of 32 bits
date       yyyy-mm-dd, mm/dd/yyyy, dd/mm/yyyy (also with dots), 1900-01-01 to 2100-05-01
email      letters and digits replaced by a keyed stream over the whole address
secret     hexadecimal strings of 32-64 digits and common access keys, by a keyed stream
=========  ==========================================================================

An international number of a country whose numbers have one length ends at that length. Any other
takes every further group that keeps it at 15 digits or fewer, unless the group begins a date, an
address, a card or a national number: no part of a number stays in clear, and a short number that
stands right behind it may be taken in.

E-mails and secrets have no bounded format to permute; their keyed stream depends on the whole
value, so equal values stay linked. What fails validation is left as it stands.

Only DataFrame functions run. A null text stays null with nothing found, an empty text stays
empty; rows are independent, so repeated rows and null ids need no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
FIRST_DAY = "1900-01-01"
DAY_RADIX = (270, 271)  # their product is the number of days that dates are permuted among

# Registered IBAN lengths.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC",
}
# Country codes whose numbers all have this many further digits.
PHONE_LENGTHS = {10: "1 7 91", 9: "33 34 48 351", 8: "45 47"}

_IBANS = "|".join(
    f"(?:{c.replace(' ', '|')})[0-9]{{2}}"
    + (f"(?:[A-Z0-9]{{{n - 4}}}|(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}})" if n % 4 else ")"))
    for n, c in IBAN_LENGTHS.items()
)
_KNOWN = "|".join(f"(?:{c.replace(' ', '|')})(?:[ .()-]{{0,3}}[0-9]){{{n}}}" for n, c in PHONE_LENGTHS.items())
# What a further group of a number must not begin.
_OTHERS = (
    r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9])(?![0-9])"
)
_GROUP = rf"[ .-](?!{_OTHERS})[0-9]{{1,8}}(?![0-9%]|[/:,][0-9])"
# Between 7 and 15 digits since the plus: written out, because a look-behind knows no repeated groups.
_DIGIT = "[0-9][ .()-]{0,3}"
_LONG_ENOUGH = rf"(?<=\+{_DIGIT * 7}{f'(?:{_DIGIT}' * 8}{')?' * 8})"
_OTHER_COUNTRY = (
    rf"[1-9][0-9]{{0,14}}(?:[ .-]?\([0-9]{{1,4}}\)[ .-]?[0-9]{{1,8}}(?![0-9]))?(?:{_GROUP}){{0,6}}" + _LONG_ENOUGH
)

# The formats.
FORMATS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?<day>[/.])[0-9]{1,2}\k<day>[0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": (
        r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<four>[ -])[0-9]{4}\k<four>[0-9]{4}\k<four>[0-9]{1,7}"
        r"|[0-9]{4}(?<six>[ -])[0-9]{6}\k<six>[0-9]{5})(?![0-9])"
    ),
    "phone": (
        rf"(?<![0-9+])(?:\+(?:{_KNOWN})|\+{_OTHER_COUNTRY}"
        r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"
    ),
}
ANY = "|".join(f"(?:{p})" for p in FORMATS.values())


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def _hash(key: str, *parts: Column) -> Column:
    """A non-negative long of 56 bits from a keyed hash."""
    text = F.concat_ws(":", F.lit(key), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")


def _feistel(key: str, kind: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Struct (l, r): a permutation of pairs below the two sizes."""

    def turn(pair, i):
        return F.struct(
            F.when(i % 2 == 0, F.pmod(pair["l"] + F.pmod(_hash(key, kind, i, pair["r"]), left_size), left_size))
            .otherwise(pair["l"])
            .cast("long")
            .alias("l"),
            F.when(i % 2 == 1, F.pmod(pair["r"] + F.pmod(_hash(key, kind, i, pair["l"]), right_size), right_size))
            .otherwise(pair["r"])
            .cast("long")
            .alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """Another string of as many digits (up to 36), one to one for each length."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    b = n - a

    def ten_to(k):
        return F.pow(F.lit(10.0), k).cast("long")

    left = F.coalesce(F.substr(digits, F.lit(1), a).try_cast("long"), F.lit(0))
    right = F.coalesce(F.substr(digits, a + 1, b).try_cast("long"), F.lit(0))
    pair = _feistel(key, F.concat(F.lit(kind), n.cast("string")), left, right, ten_to(a), ten_to(b))
    return let(
        pair,
        lambda p: F.concat(
            F.when(a > 0, F.lpad(p["l"].cast("string"), a, "0")).otherwise(""), F.lpad(p["r"].cast("string"), b, "0")
        ),
    )


def _with_digits(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order."""
    done = F.aggregate(
        F.sequence(F.lit(1), F.length(value)),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, i: F.when(
            F.substr(value, i, F.lit(1)).between("0", "9"),
            F.struct(F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k")),
        ).otherwise(F.struct(F.concat(s["out"], F.substr(value, i, F.lit(1))).alias("out"), s["k"].alias("k"))),
    )
    return done["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, odd_doubled: bool) -> Column:
    """Luhn sum, doubling every second digit from the right (the last one too if ``odd_doubled``)."""
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, n + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == (1 if odd_doubled else 0), twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(key: str, value: Column) -> Column:
    def of(digits):
        body = permuted_digits(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1))
        checked = let(
            body,
            lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(b, True), F.lit(10)), F.lit(10)).cast("string")),
        )
        valid = (luhn_sum(digits, False) % 10 == 0) & F.length(digits).between(13, 19)
        return F.when(valid, _with_digits(value, checked))

    return let(_digits(value), of)


def _iban_remainder(text: Column) -> Column:
    """Remainder modulo 97 with letters as 10-35."""

    def add(rest, i):
        c = F.substr(text, i, F.lit(1))
        letter = c.between("A", "Z")
        return F.when(letter, (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _iban(key: str, value: Column) -> Column:
    country, account = F.substring(value, 1, 2), F.substr(value, F.lit(5))

    def numbered(changed):
        check = 98 - _iban_remainder(F.concat(F.replace(changed, F.lit(" ")), country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), changed)

    valid = _iban_remainder(F.concat(F.replace(account, F.lit(" ")), F.substring(value, 1, 4))) == 1
    digits = let(_digits(account), lambda d: permuted_digits(key, "iban", d))
    return F.when(valid, let(_with_digits(account, digits), numbered))


def _phone(key: str, value: Column) -> Column:
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)

    def of(parts):
        number, digits = parts["number"], parts["digits"]
        valid = F.length(_digits(value)).between(7, 15) & (F.length(digits) > 5)
        return F.when(valid, F.concat(parts["country"], _with_digits(number, permuted_digits(key, "phone", digits))))

    number = F.substr(value, F.length(country) + 1)
    return let(F.struct(country.alias("country"), number.alias("number"), _digits(number).alias("digits")), of)


def _ssn(key: str, value: Column) -> Column:
    area, group, serial = F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4)
    valid = ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    return F.when(valid, _with_digits(value, let(_digits(value), lambda d: permuted_digits(key, "ssn", d))))


def _ip(key: str, value: Column) -> Column:
    side = F.lit(65536).cast("long")

    def of(octets):
        pair = _feistel(key, F.lit("ip"), octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], side, side)
        new = let(
            pair,
            lambda p: F.concat_ws(
                ".",
                F.floor(p["l"] / 256).cast("string"),
                (p["l"] % 256).cast("string"),
                F.floor(p["r"] / 256).cast("string"),
                (p["r"] % 256).cast("string"),
            ),
        )
        return F.when(~F.exists(octets, lambda o: o > 255), new)

    return let(F.transform(F.split(value, r"\."), lambda o: o.cast("int")), of)


def _date(key: str, value: Column) -> Column:
    iso = value.rlike("^[0-9]{4}-")
    parts = F.split(value, "[-/.]")
    mark = F.regexp_extract(value, "[/.]", 0)
    first_day = F.lit(FIRST_DAY).cast("date")
    left, right = DAY_RADIX

    def made(y, m, d):
        return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    def number(n, old):
        return F.lpad(n.cast("string"), F.greatest(F.length(old), F.length(n.cast("string"))), "0")

    def moved(place):
        pair = _feistel(
            key, F.lit("date"), F.floor(place / right), place % right, F.lit(left).cast("long"), F.lit(right).cast("long")
        )
        return let(pair, lambda p: F.date_add(first_day, (p["l"] * right + p["r"]).cast("int")))

    def written(read):
        new = moved(F.datediff(read["day"], first_day))
        return let(
            new,
            lambda d: F.when(iso, d.cast("string")).otherwise(
                F.concat_ws(
                    "",
                    number(F.when(read["month_first"], F.month(d)).otherwise(F.dayofmonth(d)), parts[0]),
                    mark,
                    number(F.when(read["month_first"], F.dayofmonth(d)).otherwise(F.month(d)), parts[1]),
                    mark,
                    F.year(d).cast("string"),
                )
            ),
        )

    month_first = made(parts[2], parts[0], parts[1])
    day = F.when(iso, made(parts[0], parts[1], parts[2])).otherwise(
        F.coalesce(month_first, made(parts[2], parts[1], parts[0]))
    )
    read = F.struct(day.alias("day"), month_first.isNotNull().alias("month_first"))
    inside = lambda r: F.datediff(r["day"], first_day).between(0, left * right - 1)
    return let(read, lambda r: F.when(inside(r), written(r)))


def _stream(key: str, value: Column, i: Column) -> Column:
    """The i-th byte of a keyed stream over the whole value."""
    block = F.sha2(F.concat_ws(":", F.lit(key), F.floor((i - 1) / 32).cast("string"), value), 256)
    return F.conv(F.substr(block, (((i - 1) % 32) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _scrambled(key: str, value: Column, changeable: Column) -> Column:
    """Letters and digits among the first ``changeable`` characters replaced within their kind."""

    def change(i):
        def of(at):
            c, x = at["c"], at["x"]
            return (
                F.when(i > changeable, c)
                .when(c.between("0", "9"), F.chr(x % 10 + 48))
                .when(c.between("A", "Z"), F.chr(x % 26 + 65))
                .when(c.isin(".", "_", "%", "+", "-", "@"), c)
                .otherwise(F.chr(x % 26 + 97))
            )

        return let(F.struct(F.substr(value, i, F.lit(1)).alias("c"), _stream(key, value, i).alias("x")), of)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), change), "")


def _email(key: str, value: Column) -> Column:
    return _scrambled(key, value, F.length(value) - F.length(F.substring_index(value, ".", -1)))


def _secret(key: str, value: Column) -> Column:
    stream = F.concat(*(F.sha2(F.concat_ws(":", F.lit(key), F.lit(str(i)), value), 256) for i in range(2)))
    hexadecimal = F.substr(stream, F.lit(1), F.length(value))
    prefix = F.regexp_extract(value, "^(AKIA|gh[pousr]_)", 0)
    tail = F.substr(value, F.length(prefix) + 1)
    return (
        F.when(prefix != "", F.concat(prefix, _scrambled(key, tail, F.length(tail))))
        .when(value.rlike("[A-F]"), F.upper(hexadecimal))
        .otherwise(hexadecimal)
    )


MAKERS = {
    "email": _email,
    "iban": _iban,
    "secret": _secret,
    "date": _date,
    "ip": _ip,
    "ssn": _ssn,
    "card": _card,
    "phone": _phone,
}


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, found): texts with pseudonyms, and (kind, pseudonym) of each replaced value."""
    # Alone, a format needs no context: its look-arounds have been checked in the text.
    whole = {k: f"^(?:{p})$" for k, p in FORMATS.items()}

    def replaced(value):
        choice = F.lit(None).cast("struct<kind:string,pseudonym:string>")
        for kind in reversed(MAKERS):
            made = F.struct(F.lit(kind).alias("kind"), MAKERS[kind](key, value).alias("pseudonym"))
            choice = F.when(value.rlike(whole[kind]), made).otherwise(choice)
        return choice

    text = F.col("text")
    candidates = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", candidates.alias("values"))
    rows = rows.withColumn("new", F.transform("values", replaced))
    kept = F.zip_with("values", "new", lambda v, n: F.coalesce(n["pseudonym"], v))
    pieces = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(F.concat(F.array(F.lit("")), kept), pieces, lambda a, b: F.concat(a, b)), "")
    found = F.filter("new", lambda n: n["pseudonym"].isNotNull())
    empty = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    return rows.select(
        "doc_id",
        F.when(F.size(F.coalesce("values", F.array().cast("array<string>"))) > 0, joined).otherwise(text).alias("text"),
        F.coalesce(found, empty).alias("found"),
    )
