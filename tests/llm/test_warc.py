"""Archives: the round trip, and what is recovered from damaged ones."""

from __future__ import annotations

import gzip
import hashlib
import random
import re

import pytest

from conftest import SMALL
from lagline.llm import catalog, warc

PAYLOADS = [b"", b"short", b"<p>" + b"long page " * 300, "ñandú – 💡".encode() * 200, bytes(range(256)) * 40]


def plain_records(n=20):
    return [warc.record(i, f"http://h/{i}", PAYLOADS[i % 5] + b"%d" % i, None, False) for i in range(n)]


def scanned(content):
    found = list(warc.salvage(warc.Source.of(content)))
    names = [re.fullmatch(r"<urn:page:(\d+)>", f.fields["warc-record-id"]) for f in found if not f.damage]
    ids = [int(m[1]) if m else None for m in names]
    return ids, [(f.start, f.stop) for f in found if f.damage], found


@pytest.mark.parametrize("packed", [False, True])
def test_damage_costs_its_records_only(packed):
    """Flipped, cut out, put in and lost bytes: all other records are read, gaps cover what is not."""
    rng = random.Random(packed)
    parts = [warc.member(r) if packed else r for r in plain_records()]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    whole = b"".join(parts)
    assert scanned(whole)[:2] == (list(range(20)), [])
    for _ in range(150):
        hit = rng.randrange(20)
        at = rng.randrange(starts[hit], starts[hit + 1])
        kind = rng.choice(["flip", "cut", "put", "end"])
        if kind == "flip":
            content = whole[:at] + bytes([whole[at] ^ (1 << rng.randrange(8))]) + whole[at + 1 :]
        elif kind == "cut":
            content = whole[:at] + whole[min(starts[hit + 1] - 1, at + 40) :]
        elif kind == "put":
            content = whole[:at] + rng.randbytes(50) + whole[at:]
        else:
            content = whole[:at]
        ids, gaps, found = scanned(content)
        others = [i for i in range(20) if i != hit and (kind != "end" or i < hit)]
        # A hurt header of a record that no member guards may give another name to it.
        assert [i for i in ids if i in others] == others and len(ids) <= len(others) + 1
        if hit in ids:
            f = next(f for f in found if not f.damage and f.fields["warc-record-id"] == f"<urn:page:{hit}>")
            assert f.payload == PAYLOADS[hit % 5] + b"%d" % hit
        places = sorted((f.start, f.stop) for f in found)
        assert places[0][0] == 0 and all(a[1] == b[0] for a, b in zip(places, places[1:])) and places[-1][1] == len(content)


def test_records_inside_one_member_and_other_digests():
    first, second, third = plain_records(3)
    broken = second.replace(b"short1", b"shorT1")
    content = gzip.compress(first + broken + third) + gzip.compress(b"nothing of the kind") + third
    ids, gaps, found = scanned(content)
    assert ids == [0, 2, 2] and len(gaps) == 2 and "block digest" in next(f.damage for f in found if f.damage)
    hexed = b"sha256:" + hashlib.sha256(b"body").hexdigest().upper().encode()
    head = b"WARC/1.0\nWARC-Type: resource\nWARC-Record-ID: <urn:page:7>\nX-Long: a\n b\nWARC-Block-Digest: %s\nContent-Length: 4\n\nbody\n\n"
    (one,) = warc.salvage(warc.Source.of(head % hexed))
    assert one.payload == b"body" and one.fields["x-long"] == "a b" and one.digest == hashlib.sha1(b"body").hexdigest()
    (gap,) = warc.salvage(warc.Source.of(head % hexed[:-1]))
    assert gap.damage == "block digest differs"


def plain_table(rows):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    owner = {}
    for i, p in payloads:
        if len(p) >= 1000 and i is not None:
            owner[p] = max(owner.get(p, i), i)
    out = []
    for i, p in payloads:
        revisit = p in owner and owner[p] != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", owner[p] if revisit else None))
    return sorted(out, key=str)


def test_copies_revisit_the_largest_page(spark):
    a, b = "a" * 1000, "ñ" * 500
    rows = [
        (1, "http://x/ y\r\nWARC-Type: no", a), (5, None, a), (3, "", a), (None, "u", a), (2, "u", b), (9, "u", b), (4, "u", "a" * 999),
        (8, "u", "a" * 999), (6, "u", None), (7, "u", ""), (None, "u", None), (-3, "u", "n" * 2000), (10, "u", "t" * 1500),
        (10, "u", "t" * 1500), (None, "u", "z" * 1200), (None, "u", "z" * 1200), (11, "u", "WARC/1.1\r\n" * 300),
    ]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, payload string, owner int").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(pages, limit=2000).collect()), key=str)
    assert got == plain_table([(i, h) for i, _, h in rows])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_query_equals_brute_force_and_keeps_texts(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = sorted((tuple(r) for r in catalog.op11_warc(spark, SMALL).collect()), key=str)
    assert got == plain_table([(r.page_id, r.html) for r in rows])
    again = warc.read(warc.write(spark.read.parquet(f"{SMALL}/pages.parquet"))).where("record_type = 'response'").collect()
    pages = {f"<urn:page:{r.page_id}>": (r.html or "").encode() for r in rows}
    assert all(bytes(r.payload) == pages[r.record_id] for r in again)


def test_folder_with_a_damaged_archive(spark, tmp_path):
    parts = [warc.member(r) for r in plain_records(6)]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "two.warc.gz").write_bytes(parts[0] + b"junk" + parts[1][:-9] + parts[2])
    (tmp_path / "three.warc").write_bytes(b"".join(plain_records(2)))
    (tmp_path / "four.warc.gz").write_bytes(b"")
    found = warc.read(warc.in_folder(spark, str(tmp_path)))
    assert sorted(r.archive.rsplit("/", 1)[1] for r in warc.records(found).collect()) == ["one.warc.gz"] * 6 + ["three.warc"] * 2 + ["two.warc.gz"] * 2
    (gap,) = warc.gaps(found).collect()
    assert (gap.offset, gap.length) == (len(parts[0]), 4 + len(parts[1]) - 9)
