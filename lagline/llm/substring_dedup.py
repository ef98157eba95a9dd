"""Removal of repeated word windows, found by doubling their length.

Level one takes windows of half the length. Of the half windows inside each full window only
the one with the smallest hash is looked at (equal full windows agree on it), so a seventh of
the positions is counted. Half windows that occur once are dropped; only full windows around a
surviving half are formed, grouped by that half, and compared by a second, independent hash.
A window whose sequence also starts earlier (smaller ``doc_id``, or earlier in the same
document) is covered, and all words of covered windows go.

Texts with the same word sequence are one class: all but the first lose every word without
being compared, provided they have a full window. Half windows with more than ``HOT``
occurrences are compared through aggregation and a join instead of one sorted run, so a passage
that a third of all documents share is not gathered anywhere.

Nulls: a null text has no words, a null ``doc_id`` sorts last. Rows that repeat a ``doc_id``
are judged against smaller ids and against themselves, not against each other. Texts shorter
than a window lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from lagline.llm.common import NO_ID, narrow
from lagline.sources.work import discard, materialize

WINDOW = 20
HOT = 4096
VOCABULARY = 1 << 19  # words a task remembers the hash of

_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, 64, dtype=np.uint64) * 2 + 1

PROFILE = "doc_id long, n_words long, k1 long, k2 long, halves array<long>"
FULL = "half long, doc_id long, windows array<long>"
WORDS = "doc_id long, k1 long, k2 long, text binary"
LEFT = "doc_id long, n_words long, removed array<long>, text string"
KEPT = "doc_id long, k1 long, k2 long, removed array<long>"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])


class Words:
    """Word hashes with a bounded memory of words already met."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > VOCABULARY:
            self.known.clear()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        get = known.get
        out = []
        for word in words:
            value = get(word)
            if value is None:
                value = known[word] = digest(word)
            out.append(value)
        return np.array(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _half_windows(words: np.ndarray, half: int) -> np.ndarray:
    n = len(words) - half + 1
    total = np.zeros(n, np.uint64)
    for j in range(half):
        total += words[j : j + n] * _MULTIPLIERS[j]
    return _mixed(total)


def _smallest(halves: np.ndarray, half: int) -> np.ndarray:
    """The smallest half-window hash inside each full window."""
    n = len(halves) - half
    smallest = halves[:n].copy()
    for j in range(1, half + 1):
        np.minimum(smallest, halves[j : j + n], out=smallest)
    return smallest


def _full_windows(words: np.ndarray, half: int) -> np.ndarray:
    """Hashes of full windows, from the words by other multipliers than the halves."""
    n = len(words) - 2 * half + 1
    total = np.zeros(n, np.uint64)
    for j in range(2 * half):
        total += words[j : j + n] * _MULTIPLIERS[half + j]
    return _mixed(total + np.uint64(1))


def _class_of(words: np.ndarray) -> tuple[int, int]:
    raw = np.frombuffer(xxhash.xxh3_128_digest(words.tobytes()), np.int64)
    return int(raw[0]), int(raw[1])


def _profiles(half: int):
    """Per document: its class and the hashes of the half windows to be counted."""
    schema = _schema(PROFILE)

    def run(batches):
        hashed = Words()
        for batch in batches:
            n, k1, k2, ends, parts = [], [], [], [0], []
            for text in batch.column(1):
                words = text.as_py().split()
                ids = hashed(words)
                one, two = _class_of(ids)
                n.append(len(words))
                k1.append(one)
                k2.append(two)
                chosen = np.empty(0, np.uint64)
                if len(ids) >= 2 * half:
                    halves = _half_windows(ids, half)
                    smallest = _smallest(halves, half)
                    picked = np.zeros(len(halves), bool)
                    for j in range(half + 1):
                        picked[j : j + len(smallest)] |= halves[j : j + len(smallest)] == smallest
                    value, times = np.unique(halves[picked], return_counts=True)
                    chosen = np.concatenate([value, value[times > 1]])  # twice where it repeats itself
                parts.append(chosen)
                ends.append(ends[-1] + len(chosen))
            values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, k1, k2)), lists]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _packed(batches):
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [squeeze.compress(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "packed"])


def _windows_of(half: int):
    """Per surviving half window of a document: the distinct full windows whose smallest half it is."""
    schema = _schema(FULL)

    def run(batches):
        hashed, unpack = Words(), zstandard.ZstdDecompressor()
        for batch in batches:
            owner, key, ends, parts = [], [], [0], []
            for doc_id, packed, alive in zip(*(batch.column(i) for i in range(3))):
                words = hashed(unpack.decompress(packed.as_py()).split())
                if len(words) < 2 * half:
                    continue
                alive = np.asarray(alive.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                smallest = _smallest(_half_windows(words, half), half)
                at = np.flatnonzero(np.isin(smallest, alive))
                if not len(at):
                    continue
                pairs = np.stack([smallest[at], _full_windows(words, half)[at]], axis=1)
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                fresh = np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]
                pairs = pairs[fresh]
                first = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
                key.append(pairs[first, 0])
                owner.append(np.full(len(first), doc_id.as_py(), np.int64))
                parts.append(pairs[:, 1])
                ends.extend((ends[-1] + np.r_[first[1:], len(pairs)]).tolist())
            if key:
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64))
                )
                columns = [pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(owner)), lists]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _later(batches):
    """Rows sorted by (half, doc_id): the windows of each row that a smaller doc_id has too."""
    half, owner, seen, fresh = None, None, set(), []
    for batch in batches:
        rows, found = [], []
        for key, doc_id, windows in zip(*(c.to_pylist() for c in batch.columns)):
            if key != half:
                half, owner, seen, fresh = key, doc_id, set(), []
            elif doc_id != owner:
                seen.update(*fresh)
                owner, fresh = doc_id, []
            again = [w for w in windows if w in seen]
            if again:
                rows.append(doc_id)
                found.append(again)
            fresh.append(windows)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "windows"]
            )


def covered_words(full: np.ndarray, gone: np.ndarray, window: int) -> np.ndarray:
    """Mask of words covered by windows in ``gone`` or by windows repeated within the document."""
    _, first = np.unique(full, return_index=True)
    bad = np.ones(len(full), bool)
    bad[first] = False
    bad |= np.isin(full, gone)
    edge = np.zeros(len(full) + window, np.int64)
    np.add.at(edge, np.flatnonzero(bad), 1)
    np.add.at(edge, np.flatnonzero(bad) + window, -1)
    return np.cumsum(edge)[:-1] > 0


def _spans(covered: np.ndarray) -> np.ndarray:
    """Starts and ends (the word after the last) of the covered stretches, in turn."""
    return np.flatnonzero(np.diff(np.r_[False, covered, False]))


def _kept(half: int):
    """Per candidate: its removed stretches of words."""
    schema = _schema(KEPT)

    def run(batches):
        hashed, unpack = Words(), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, packed, gone in zip(*(batch.column(i) for i in range(3))):
                words = unpack.decompress(packed.as_py()).split()
                ids = hashed(words)
                if len(ids) < 2 * half:
                    continue
                gone = np.empty(0, np.int64) if not gone.is_valid else gone.values.to_numpy(zero_copy_only=False)
                covered = covered_words(_full_windows(ids, half), np.asarray(gone).view(np.uint64), 2 * half)
                if covered.any():
                    rows.append((doc_id.as_py(), *_class_of(ids), _spans(covered)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
                )

    return run


def _classed(batches):
    """Each text with the class of its words."""
    hashed, schema = Words(), _schema(WORDS)
    for batch in batches:
        classes = [_class_of(hashed(text.as_py().split())) for text in batch.column(1)]
        keys = [pa.array([c[i] for c in classes], pa.int64()) for i in range(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *keys, batch.column(1).cast(pa.binary())], schema=schema)


def _left(batches):
    """The words of (doc_id, text, removed) outside the removed stretches."""
    schema = _schema(LEFT)
    for batch in batches:
        ids = [None if i == NO_ID else i for i in batch.column(0).to_pylist()]
        n, removed, texts = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            words, spans = text.as_py().split(), spans.as_py() or []
            edges = [0, *spans, len(words)]
            kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
            n.append(len(words))
            removed.append(spans)
            texts.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, n, removed, texts), schema)], schema=schema)


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, removed, text) per row; ``window`` is even.

    ``text`` holds the words that stay, one space between them. ``removed`` has the removed
    stretches in order, of each the place of its first word and the place after its last one.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")
    half = window // 2
    rows = narrow(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    profile = materialize(rows.mapInArrow(_profiles(half), PROFILE), "word-profiles")

    # Level one: half windows that occur more than once, and the documents that have them.
    halves = profile.select("doc_id", F.explode("halves").alias("half"))
    counted = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = materialize(counted, "repeated-halves")
    first = profile.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"))
    alive = (
        halves.join(counted.select("half"), "half").groupBy("doc_id").agg(F.collect_set("half").alias("alive"))
    )
    first = materialize(first, "word-classes")
    alive = alive.join(first.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    candidates = rows.mapInArrow(_packed, "doc_id long, packed binary").join(alive, "doc_id")
    candidates = materialize(candidates.select("doc_id", "packed", "alive"), "window-candidates")

    # Level two: full windows around them, judged within the half they share.
    full = candidates.mapInArrow(_windows_of(half), FULL)
    hot = counted.where(F.col("n") > HOT).select("half")
    full = materialize(full, "full-windows")
    runs = full.join(hot, "half", "left_anti").repartition("half").sortWithinPartitions("half", "doc_id")
    usual = runs.mapInArrow(_later, "doc_id long, windows array<long>")
    spread = full.join(hot, "half", "left_semi").select("half", "doc_id", F.explode("windows").alias("w"))
    earliest = spread.groupBy("half", "w").agg(F.min("doc_id").alias("earliest"))
    common = spread.join(earliest, ["half", "w"]).where("doc_id > earliest").select("doc_id", F.array("w").alias("windows"))
    gone = usual.union(common).groupBy("doc_id").agg(F.flatten(F.collect_list("windows")).alias("gone"))

    kept = candidates.select("doc_id", "packed").join(gone, "doc_id", "left").mapInArrow(_kept(half), KEPT)
    kept = kept.dropDuplicates(["doc_id", "k1", "k2"])
    has_window = F.col("n_words") >= window
    copy = has_window & (F.col("doc_id") > F.col("first_id"))
    whole = F.array(F.lit(0).cast("long"), F.col("n_words"))
    removed = (
        profile.drop("halves")
        .join(first, ["k1", "k2"])
        .join(kept, ["doc_id", "k1", "k2"], "left")
        .select("doc_id", "k1", "k2", F.when(copy, whole).otherwise(F.col("removed")).alias("removed"))
        .where("removed IS NOT NULL")
        .dropDuplicates(["doc_id", "k1", "k2"])
    )
    removed = materialize(removed, "removed-words")
    # What follows reads the texts and this table only.
    discard(profile, counted, first, candidates, full)
    texts = rows.mapInArrow(_classed, WORDS).join(removed, ["doc_id", "k1", "k2"], "left")
    return texts.select("doc_id", "text", "removed").mapInArrow(_left, LEFT)


def remove_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, removed) per row: ``kept_texts`` with counts and digests.

    ``removed`` lists the removed stretches as in ``kept_texts``, with commas between.
    """
    removed = F.expr("aggregate(transform(removed, (x, i) -> IF(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return kept_texts(docs, window).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
        F.col("text").alias("kept_text"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t
), windows AS (
  SELECT *, string_agg(word, ' ') OVER f AS win, count(*) OVER f AS n FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), starts AS (
  SELECT doc_id, word, pos,
         CASE WHEN n = 20 AND row_number() OVER (PARTITION BY win, n ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS bad
  FROM windows
), marked AS (
  SELECT doc_id, word, pos,
         max(bad) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM starts
), edges AS (
  SELECT *, lag(gone, 1, 0) OVER p AS before, lead(gone, 1, 0) OVER p AS after FROM marked
  WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
), kept AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS txt,
         array_to_string(list_sort(list_concat(
           coalesce(list(pos - 1) FILTER (WHERE gone = 1 AND before = 0), []),
           coalesce(list(pos) FILTER (WHERE gone = 1 AND after = 0), []))), ',') AS stretches
  FROM edges GROUP BY doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256, coalesce(txt, '') AS kept_text, coalesce(stretches, '') AS removed
FROM t LEFT JOIN kept USING (doc_id)
"""
