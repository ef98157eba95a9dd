"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from conftest import SMALL
from lagline.llm import catalog, periods


def plain_runs(words, least=24, repeats=3):
    """Every stretch of every lag, kept where no smaller period holds on it."""
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, repeats * q):
                seen = words[i : i + length]
                if not any(seen[d:] == seen[: length - d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, repeats", [(24, 3), (5, 3), (40, 4)])
def test_runs_of_random_repeats(least, repeats):
    rng, seen = random.Random(least), 0
    for _ in range(600):
        letters, words = rng.choice([1, 2, 3, 5]), []
        while len(words) < rng.randint(0, 160):
            unit = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(1, 45))]
            repeated = unit * rng.randint(1, 5)
            words += repeated[: rng.randint(1, len(repeated))]
        expected = plain_runs(words, least, repeats)
        seen += len(expected)
        assert periods.find_runs(words, least, repeats) == expected
    assert seen > 100


def test_a_period_whose_every_gram_comes_twice():
    """Loops a and b through one long passage: no 16-gram's next occurrence is a period of a a b b away."""
    passage = [b"p%d" % i for i in range(20)]
    a, b = passage + [b"a"], passage + [b"b", b"c"]
    words = (a + a + b + b) * 4
    found = periods.find_runs(words)
    assert found == plain_runs(words) and (0, len(words), 86) in found


def test_one_word_repeated_is_linear():
    words = [b"x"] * 200_000
    assert periods.find_runs(words) == [(0, 200_000, 1)]
    assert periods.collapsed(words, [(0, 200_000, 1)]) == [b"x"]


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in catalog.op13_periods(spark, SMALL).collect()}
    assert len(got) == len(docs)
    short = [r for r in docs if len((r.text or "").split()) <= 3000]
    assert len(short) > 0.9 * len(docs)
    assert all(got[r.doc_id] == plain_row(r.doc_id, r.text) for r in short)
    assert any(got[r.doc_id][0] for r in short)


def test_awkward_rows(spark):
    twice = " ".join(f"w{i}" for i in range(12))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (None, "x " * 30), (None, None), (4, f"{twice} {twice} {twice}"), (4, f"{twice} {twice} {twice}"),
        (5, " ".join(["ñ"] * 23)), (6, "y\x0bz " * 40), (7, " ".join(f"v{i % 700}" for i in range(60_000))),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, runs string").repartition(3)
    got = sorted((tuple(r) for r in periods.summary(docs).where("doc_id IS NULL OR doc_id <> 7").collect()), key=str)
    assert got == sorted(((i, *plain_row(i, t)) for i, t in rows if i != 7), key=str)
    found = {r.doc_id: r for r in periods.periodic_runs(docs).collect() if r.doc_id}
    assert [tuple(r) for r in found[4].runs] == [(0, 36, 12)] and found[4].text == twice
    assert found[6].text == "y z" and found[6].n_words == 80 and found[1].n_words == 0
    assert [tuple(r) for r in found[7].runs] == [(0, 60_000, 700)]
    assert periods.summary(docs.limit(0)).count() == 0
