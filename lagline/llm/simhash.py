"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits over word shingles. Two fingerprints within ``d`` = 3 bits are cut
into fewer segments than ``d`` + 1: of two halves one differs by at most one bit. Each half is
indexed once per bit with that bit taken out, so such a pair meets in an equality join on
(half, bit, remaining 31 bits); pairs are then verified by their full distance. Of pairs whose
halves are equal only the first bit's bucket is used, the others hold pairs that differ in
exactly their bit.

Equal fingerprints are one row before the index, so exact copies cost nothing. A bucket of more
than ``BUCKET`` fingerprints is cut again in the same way along its other half, and once more
along the remaining quarter; then at most 11 bits are free, so no bucket stays larger. Within a
bucket only a spanning forest of its links is emitted. Components come from large-star and
small-star rounds.

A text without words has the fingerprint 0 and links like any other; null texts are empty; a
null ``doc_id`` sorts last and gives a null component only where all of it is null; repeated
rows are repeated in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lagline.llm.common import narrow
from lagline.llm.components import components
from lagline.sources.work import materialize

DISTANCE = 3
BUCKET = 2048
SEED = 42
ROW = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("must", pa.int64())])


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text's word shingles, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, bits) for every row; bits is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            bits = np.fromiter(
                (fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], schema=ROW)

    return narrow(docs).mapInArrow(run, "doc_id long, bits long")


def _keyed_fingerprints(rows: DataFrame, words_per_shingle: int) -> DataFrame:
    """(doc_id, text_key, bits) of rows (doc_id, text, text_key)."""

    def run(batches):
        for batch in batches:
            bits = np.fromiter(
                (fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)), np.uint64, batch.num_rows
            )
            columns = [batch.column(0), batch.column(2), pa.array(bits.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "bits"])

    return rows.mapInArrow(run, "doc_id long, text_key string, bits long")


def _link_runs(key: np.ndarray, bits: np.ndarray, must: np.ndarray):
    """Spanning links of complete runs of equal keys: arrays of left and right fingerprints."""
    left, right = [], []
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    small = np.repeat(size, size) <= 3
    for shift in (1, 2):  # all pairs of runs of two and three
        if len(key) > shift:
            i = np.flatnonzero(small[:-shift] & (key[shift:] == key[:-shift]))
            other = bits[i] ^ bits[i + shift]
            ok = (np.bitwise_count(other) <= DISTANCE) & ((other & must[i]) == must[i])
            left.append(bits[i[ok]])
            right.append(bits[i[ok] + shift])
    for s, n in zip(start[size > 3], size[size > 3]):
        run, need = bits[s : s + n], must[s]
        left_of, right_of = _forest(run, need)
        left.append(left_of)
        right.append(right_of)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _forest(run: np.ndarray, need: np.uint64):
    """Breadth-first spanning forest of the links within one bucket."""
    waiting, left, right = run, [], []
    while len(waiting) > 1:
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            node = front.pop()
            other = waiting ^ node
            ok = (np.bitwise_count(other) <= DISTANCE) & ((other & need) == need)
            if ok.any():
                near = waiting[ok]
                left.append(np.full(len(near), node, np.uint64))
                right.append(near)
                front.extend(near)
                waiting = waiting[~ok]
    none = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _link_task(limit: int):
    """mapInArrow over rows sorted by bucket: links (a, b), or members of buckets over ``limit``.

    A link has no bucket; a member is (bits, null, bucket, must) and waits for the next cut.
    """

    def batch(a, b, bucket, must):
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (a, b, bucket, must)],
            schema=FOUND,
        )

    def linked(key, bits, must):
        a, b = _link_runs(key, bits.view(np.uint64), must.view(np.uint64))
        if len(a):
            yield batch(a, b, None, None)

    def run(batches):
        held = None  # the run still open at the end of a batch
        passing = None  # the bucket that has exceeded the limit: its further rows go through
        for found in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in found.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
                held = None
            key, bits, must = rows
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            large = size > limit
            if passing is not None:
                large |= key[start] == passing
            over = np.repeat(large, size)
            if over.any():
                yield batch(bits[over], None, key[over], must[over])
            passing = key[-1] if large[-1] else None
            open_end = ~large[-1]
            ready = ~large & (size > 1)
            ready[-1] = False
            ready = np.repeat(ready, size)
            if ready.any():
                yield from linked(key[ready], bits[ready], must[ready])
            if open_end:
                held = [x[start[-1] :] for x in rows]
        if held is not None and len(held[0]) > 1:
            yield from linked(*held)

    return run


def _variants(rows: DataFrame, width: int) -> DataFrame:
    """(bucket, bits, must): one row per piece and taken-out bit of each fingerprint.

    The lowest three bits of a bucket say where the stretch of bits begins (in eights) of which
    the bucket knows nothing yet; it is cut into two pieces of ``width`` bits. The other bits
    hash the old bucket and what is left of the piece: a collision could only add candidates,
    which verification drops.
    """
    free = F.col("bucket").bitwiseAND(F.lit(7)) * 8
    cut = rows.select("*", free.alias("free"), F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))).alias("i"))
    cut = cut.withColumn("piece", F.expr(f"CAST(free + (i div {width}) * {width} AS INT)"))
    taken = F.expr("shiftleft(1L, CAST(free + i AS INT))")
    seen = F.expr(f"shiftleft({(1 << width) - 1}L, piece)").bitwiseAND(F.bitwise_not(taken))
    rest = F.when(F.col("i") < width, F.col("free") + width).otherwise(F.col("free"))
    name = F.xxhash64("bucket", "i", F.col("bits").bitwiseAND(seen))
    return cut.select(
        F.shiftleft(F.shiftright(name, 3), 3).bitwiseOR((rest / 8).cast("long")).alias("bucket"),
        "bits",
        F.when(F.col("i") % width == 0, F.col("must")).otherwise(F.col("must").bitwiseOR(taken)).alias("must"),
    )


def links(prints: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all fingerprints within three bits of each other.

    ``prints`` has one column of distinct fingerprints, ``bits``.
    """
    rows = prints.select(F.lit(0).cast("long").alias("bucket"), "bits", F.lit(0).cast("long").alias("must"))
    found = None
    for width in (32, 16, 8):
        sorted_rows = _variants(rows, width).repartition("bucket").sortWithinPartitions("bucket")
        task = _link_task(limit if width > 8 else 1 << 62)
        step = materialize(sorted_rows.mapInArrow(task, "a long, b long, bucket long, must long"), "simhash-links")
        here = step.where("bucket IS NULL").select("a", "b")
        found = here if found is None else found.union(here)
        rows = step.where("bucket IS NOT NULL").select("bucket", F.col("a").alias("bits"), "must")
        if rows.isEmpty():
            break
    return found


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, limit: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: hex fingerprint, smallest reachable doc_id."""
    rows = materialize(fingerprints(docs, words_per_shingle), "fingerprints")
    classes = materialize(rows.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    groups = components(links(classes.select("bits"), limit))
    named = classes.join(groups, F.col("bits") == F.col("node"), "left").select(
        "bits", "first_id", F.coalesce("component", "bits").alias("component")
    )
    named = materialize(named, "fingerprint-groups")
    owners = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    answer = named.join(owners, "component").select("bits", "component_id")
    return rows.join(answer, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one row of each component.

    ``found`` has (doc_id, text_key, component) for every row, ``text_key`` being the MD5 of the
    text's bytes. The smallest doc_id stays, a null one only where there is no other; among rows
    that share it the smallest text_key, and of rows equal in both any one.
    """
    found = materialize(found, "near-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    best = found.groupBy("component").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    marks = found.join(best, "component").select(
        F.col("doc_id").alias("mark_id"), F.col("text_key").alias("mark_key"), stays.alias("mark_stays")
    )
    marks = materialize(marks.distinct(), "near-marks")
    key = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("mark_id")) & (key == F.col("mark_key"))
    single = docs.join(marks, same, "left_anti")
    chosen = docs.join(marks.where("mark_stays"), same).dropDuplicates(["mark_id", "mark_key"])
    return single.unionByName(chosen.drop("mark_id", "mark_key", "mark_stays"))


def deduplicate(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id (null last).

    Rows are told apart by doc_id and text, so null and repeated ids need no rule of their own.
    """
    keyed = narrow(docs).withColumn("text_key", F.md5("text"))
    rows = materialize(_keyed_fingerprints(keyed, words_per_shingle), "fingerprints")
    classes = materialize(rows.select("bits").distinct(), "fingerprint-classes")
    groups = components(links(classes))
    found = rows.join(groups, F.col("bits") == F.col("node"), "left")
    return one_of_each(docs, found.select("doc_id", "text_key", F.coalesce("component", "bits").alias("component")))
