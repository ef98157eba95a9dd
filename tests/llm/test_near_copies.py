"""The pipeline's near copies against brute force, and which rows stay."""

from __future__ import annotations

from collections import Counter

import xxhash

import corpus_pipeline
from lagline.llm import simhash

FOLDER = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """The smallest id reachable over pairs of at most three differing bits, all pairs compared."""
    owner, ids = {i: i for i in prints}, sorted(prints)

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                owner[b] = a
    return {i: root(i) for i in ids}


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    owner = plain_groups({r.doc_id: plain_fingerprint(r.text) for r in docs.collect()})
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()]
    assert sorted(kept) == sorted(i for i in owner if owner[i] == i)


def test_null_and_repeated_ids(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(60))

    rows = [
        (1, text("a")), (None, text("a").upper()),  # a copy without an id goes, and only that row
        (None, text("b")), (None, text("c")),  # clean texts without an id stay
        (2, text("d")), (2, text("a")), (2, text("e")),  # one id: only the copy goes
        (None, text("f")), (None, text("f")), (None, text("f").upper()),  # one of a group of nulls stays
        (3, text("g")), (3, text("g")), (3, text("g").upper()),
        (4, ""), (None, None), (4, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, (r.text or "")[:2].lower()) for r in simhash.deduplicate(docs).collect())
    expected = [(1, "a0"), (None, "b0"), (None, "c0"), (2, "d0"), (2, "e0"), (None, "f0"), (3, "g0"), (4, "")]
    assert kept == Counter(expected)
