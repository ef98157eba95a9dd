"""Written forms of numbers, and every pseudonym against a plain Feistel network."""

import hashlib

import pytest

from lagline.llm import pseudonyms

KEY = "secret"
PHONES = [
    "+34 612 34 56 78", "+46 70 123 45 67", "+41 44 668 18 00", "+44 7911 123456", "+49 30 12345678",
    "+91 98765 43210", "+4915112345678", "+44 (0)20 7946 0958", "+49 30 1234-5678", "+1 (017) 555-7713",
    "+1-212-555-0187", "(212) 555-0187", "212-555-0187", "+493012345 678", "+86 138 0013 8000", "+358 9 123 4567",
]
IBANS = [
    "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "BE68 5390 0754 7034",
    "FR14 2004 1010 0505 0001 3M02 606", "DE89370400440532013000",
]


def feistel(kind: str, digits: str) -> str:
    a = len(digits) // 2
    left, right = int(digits[:a] or 0), int(digits[a:])
    for i in range(pseudonyms.ROUNDS):
        part = right if i % 2 == 0 else left
        mixed = hashlib.sha256(f"{KEY}:{kind}{len(digits)}:{i}:{part}".encode()).hexdigest()[:14]
        if i % 2 == 0:
            left = (left + int(mixed, 16)) % 10**a
        else:
            right = (right + int(mixed, 16)) % 10 ** (len(digits) - a)
    return (f"{left:0{a}d}" if a else "") + f"{right:0{len(digits) - a}d}"


def filled(form: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def phone(value: str) -> str:
    code = len(value) - len(value.lstrip("+0123456789"))
    code = code if value[0] == "+" and 2 <= code <= 4 and value[code:] else 0
    return value[:code] + filled(value[code:], feistel("phone", only_digits(value[code:])))


def iban(value: str) -> str:
    changed = filled(value[4:], feistel("iban", only_digits(value[4:])))
    number = "".join(str(int(c, 36)) for c in changed.replace(" ", "") + value[:2] + "00")
    return f"{value[:2]}{98 - int(number) % 97:02d}{changed}"


def pseudonymised(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pseudonyms.pseudonymise(docs, KEY).collect()}


# What stands around a value changes nothing: none of these goes on with the number.
AROUND = ["{}", "call {}, now", "a {} 2024-01-05 b", "x {} 10.1.2.3", "{}: 12/31/1999", "{} 10:30", "{} 078-05-1120", "({})."]


@pytest.mark.parametrize("around", AROUND)
def test_values_equal_a_plain_feistel_network(spark, around):
    values = PHONES + IBANS
    got = pseudonymised(spark, [around.format(v) for v in values])
    for i, value in enumerate(values):
        kind, made = ("iban", iban(value)) if value in IBANS else ("phone", phone(value))
        assert [f.pseudonym for f in got[i].found if f.kind == kind] == [made], (value, got[i])
        assert got[i].text.startswith(around.format(made)[: around.index("{}") + len(made)])


def test_numbers_stay_apart_and_known_lengths_end_them(spark):
    texts = ["+34 612 34 56 78", "+34 612 34 56 79", "+34 612 34 56 78 20 people", "+1 555 123 4567 8 times"]
    got = pseudonymised(spark, texts)
    names = [got[i].found[0].pseudonym for i in range(4)]
    assert names[0] != names[1] and names[2] == names[0]
    assert got[2].text == names[0] + " 20 people" and got[3].text.endswith(" 8 times")


def test_what_is_no_number_stays(spark):
    texts = ["+12 34", "+0 123 456 789", "GB82 WEST 1234 5698 7654 33", "DE89 is a road", "1 + 2345678", "AT 40"]
    got = pseudonymised(spark, texts)
    assert [got[i].text for i in range(len(texts))] == texts
