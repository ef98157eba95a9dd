"""Licenses against their next of kin, and coverage against plain subsequences."""

import random

import pytest

from lagline.llm import licenses

PROSE = "it was a bright cold day and the clocks were striking while people went to work under the lamp " * 8


def longest(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def named(text: str):
    return [(hit[0], hit[1]) for hit in licenses.Scanner().scan(text.encode())]


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_each_notice_is_its_own_license(name):
    text = f"{PROSE}{licenses.TEMPLATES[name][0]} {PROSE}"
    assert named(text) == [(name, len(PROSE.split()))]


def test_one_word_spelt_differently():
    assert named(licenses.TEMPLATES["MIT"][0].replace("sublicense", "sublicence"))[0][0] == "MIT"
    gpl = licenses.TEMPLATES["GPL-2.0-or-later"][0]
    assert [n for n, _ in named(gpl.replace("redistribute", "hand on"))] == ["GPL-2.0-or-later"]
    # The version decides: an unknown one is no notice of the others.
    assert named(gpl.replace("version 2", "version 7")) == []


def test_edited_notices_against_all_windows():
    draw = random.Random(5)
    scanner = licenses.Scanner()
    prose = licenses.words_of(PROSE.encode())
    for name, (notice, telling) in licenses.TEMPLATES.items():
        template = licenses.words_of(notice.encode())
        kept = set(licenses.words_of(telling.encode()))
        for _ in range(4):
            edited = [b"zzz" if w not in kept and draw.random() < 0.15 else w for w in template]
            words = prose[:40] + edited + prose[:40]
            reach = len(template) + len(template) // 4
            best = max(longest(template, words[i : i + reach]) for i in range(0, len(words) - len(edited) + 1, 4))
            got = [hit for hit in scanner.scan(b" ".join(words)) if hit[0] == name]
            assert all(hit[3] * len(template) <= best + 1e-9 or len(template) < 20 for hit in got)
            if sum(w != b"zzz" for w in edited) / len(template) >= licenses.COVERAGE:
                assert len(got) == 1 and got[0][1] < 40 + len(template) and got[0][2] >= 40, (name, words)


def test_many_notices_do_not_overlap():
    texts = [licenses.TEMPLATES[n][0] for n in licenses.TEMPLATES]
    hits = licenses.Scanner().scan(" ".join(texts * 3).encode())
    spans = sorted((first, last) for _, first, last, _ in hits)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(h[0] for h in hits) == sorted(list(licenses.TEMPLATES) * 3)
