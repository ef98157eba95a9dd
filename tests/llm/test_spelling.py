"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import SMALL
from lagline.llm import catalog, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def neighbours(words):
    """Near words through shared deletions, each candidate checked letter by letter."""
    cut = {}
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            cut.setdefault(v, []).append(w)
    return {
        w: {x for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in cut[v] if x != w and one_edit(w, x)}
        for w in words
    }


def plain_counts(rows, thin=True):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if thin and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return counts


def plain_table(counts, shortest=5, least=3):
    n = {w: c for w, c in counts.items() if len(w) >= shortest and c >= least}
    near = neighbours(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return rows


def got_rows(frame):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()}


def test_index_of_random_words():
    """All three recurrences, both sides of the key, with letters the block doesn't have."""
    rng = random.Random(2)
    for _ in range(150):
        length, letters = rng.randint(1, 7), "abc"[: rng.randint(1, 3)] + rng.choice(["", "ÿ"])
        words = sorted({"".join(rng.choice(letters) for _ in range(length + rng.randint(0, 1))) for _ in range(rng.randint(1, 150))})
        n = {w: rng.randint(1, 9) for w in words}
        block = spelling.Block(length, words, [n[w] for w in words])
        for m in (length, length + 1):
            asked = [w for w in words if len(w) == m] + ["".join(rng.choice(letters + "z") for _ in range(m))]
            for side in (True, False):
                found = block.near(asked, side)
                count, first = block.best(found)
                for i, w in enumerate(asked):
                    half = length // 2
                    expected = [v for v in words if one_edit(w, v) and min(len(v), m) == length and (v[:half] == w[:half]) == side]
                    bits = np.unpackbits(found[i].view(np.uint8), bitorder="little")[: len(words)]
                    assert sorted(block.words[k] for k in np.flatnonzero(bits)) == expected and count[i] == len(expected)
                    assert not expected or block.words[first[i]] == min(expected, key=lambda v: (-n[v], v))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain_table(plain_counts(rows))
    assert sum(r[3] is not None for r in expected) > 20
    assert got_rows(catalog.op12_spelling(spark, SMALL)) == expected


@pytest.mark.parametrize("block", [3, 50, 4096])
def test_crowded_keys(spark, block, monkeypatch):
    """Short words of two letters crowd every key; small blocks divide them, and chains of forms appear."""
    rng = random.Random(block)
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(260)}
    rows = [(i, " ".join([w] * int(3 * 2 ** rng.uniform(0, 7)))) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain_table(plain_counts(rows, thin=False), shortest=1)
    got = got_rows(spelling.variants(docs, shortest=1, block=block))
    assert got == expected
    assert max(len(w) for w in words) == 9 and any(r[3] and r[5] != r[3] for r in expected)


def test_awkward_rows(spark):
    long = "q" * 5000
    rows = [
        (1, None), (2, ""), (None, "Hello hello HELLO hallo"), (None, None), (3, "hello hello hello hello Éclair éclair ÉCLAIR"),
        (4, "hallo hallo, hallo\tworld"), (4, "hallo hallo, hallo\tworld"), (5, f"{long} {long} {long} {long}x {long}x {long}x"),
        (6, "ʒʒʒʒʒ 12345 ×××××× ÷÷÷÷÷÷ ÷÷÷÷÷÷ ÷÷÷÷÷÷"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(3)
    got = got_rows(spelling.variants(docs, changed=spelling.thinned))
    assert got == plain_table(plain_counts(rows)) and len(got) >= 5
    assert got_rows(spelling.variants(docs.limit(0))) == set()
