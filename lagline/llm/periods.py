"""Maximal runs of periodic words, by seeds and their diagonals.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are identical), of at
least ``max(LEAST, REPEATS * q)`` words, that neither neighbour extends. Compared with itself
``q`` words on, a run overlaps in at least ``max(LEAST - q, 2 * q)`` words: 16 for every period
up to 16, over ``k`` for periods in (k / 2, k]. So the index holds the k-grams of 16, 32, 64, ...
words of a document, each length made from exact codes of the one before and of repeated k-grams
only, and a period is sought at the first length that is not below it.

At that length a period's occurrence pairs are those of neighbouring occurrences of one k-gram: a
k-gram not shorter than the run's smallest period comes again exactly one period on. No group of
equal k-grams is paired within itself, so a document of one word repeated has a pair per position.
A pair is a seed on the diagonal of its lag. Seeds go by lag and place; a table per lag holds how
far its diagonal is covered, and a seed below that is not extended again. An extension compares
words in growing blocks to both sides.

Texts are read one at a time in the tasks that read the table, and nothing is shuffled: a document
is one task's work, linear in its words per length of k-gram. A null text has no words, a null
``doc_id`` stays null, repeated rows give repeated results, further columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lagline.llm.common import narrow

LEAST, REPEATS = 24, 3
FIRST = 64  # words compared at once when an extension begins

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("text", pa.string())])
FOUND_DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


def _codes(words: Sequence[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _repeated(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Codes per position of the keys that occur more than once, -1 elsewhere."""
    out = np.full(n, -1, np.int64)
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    out[at[again]] = inverse[again]
    return out


def _doubled(grams: np.ndarray, k: int) -> np.ndarray:
    """Codes of the repeated 2k-grams from those of the repeated k-grams."""
    n = len(grams)
    at = np.flatnonzero((grams[: n - k] >= 0) & (grams[k:] >= 0)) if n > k else np.empty(0, np.int64)
    return _repeated(grams[at] * n + grams[at + k], at, n)


def _seeds(grams: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) of neighbouring occurrences of one k-gram with a lag in (low, high], by lag and place."""
    at = np.flatnonzero(grams >= 0)
    at = at[np.argsort(grams[at], kind="stable")]
    same = grams[at[1:]] == grams[at[:-1]]
    place, lag = at[:-1][same], np.diff(at)[same]
    wanted = (lag > low) & (lag <= high)
    place, lag = place[wanted], lag[wanted]
    order = np.lexsort((place, lag))
    return lag[order], place[order]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal, compared in growing blocks."""
    n, at, step = min(len(a), len(b)), 0, FIRST
    while at < n:
        stop = min(n, at + step)
        wrong = a[at:stop] != b[at:stop]
        if wrong.any():
            return at + int(wrong.argmax())
        at, step = stop, step * 2
    return n


def find_runs(words: Sequence[bytes], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    if repeats < 3 or least < 1:
        raise ValueError("a run must repeat three times at least")
    n = len(words)
    if n < least:
        return []
    codes = _codes(words)
    k, grams, found = 1, _repeated(codes, np.arange(n), n), []
    # The first seeds are as long as the largest power of two within what every run overlaps itself.
    smallest = min(max(least - q, (repeats - 1) * q) for q in range(1, least + 1))
    seed = 1 << (smallest.bit_length() - 1)
    low = 0
    while (grams >= 0).any():
        if k >= seed:
            found.extend(_extended(codes, *_seeds(grams, low, k), k, least, repeats))
            low = k
        if repeats * (low + 1) > n:
            break
        grams, k = _doubled(grams, k), 2 * k
    return sorted(found, key=lambda r: (r[0], r[2]))


def _extended(codes: np.ndarray, lags: np.ndarray, places: np.ndarray, k: int, least: int, repeats: int):
    """The maximal stretches along the seeds' diagonals that are long enough."""
    # A seed right after another on its diagonal lies in that one's extension: only firsts are looked up.
    first = np.ones(len(lags), bool)
    first[1:] = (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)
    covered: dict[int, int] = {}  # lag -> the place after the last one its extensions cover
    for lag, place in zip(lags[first].tolist(), places[first].tolist()):
        if place < covered.get(lag, 0):
            continue
        right = place + k + _agree(codes[place + k :], codes[place + k + lag :])
        left = place - _agree(codes[:place][::-1], codes[lag : place + lag][::-1])
        covered[lag] = right
        length = right - left + lag
        if length >= max(least, repeats * lag):
            yield left, length, lag


def collapsed(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return [w for w, g in zip(words, gone) if not g]


def periodic_runs(
    docs: DataFrame,
    least: int = LEAST,
    repeats: int = REPEATS,
    words_of: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, runs, text) per row: its runs by start and period, and its collapsed words.

    ``words_of(doc_id, words)`` may replace the words of a document before they are read.
    """

    def run(batches):
        for batch in batches:
            n, runs, texts = [], [], []
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1)):
                words = text.as_py().split()
                if words_of is not None:
                    words = words_of(doc_id, words)
                found = find_runs(words, least, repeats)
                n.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(collapsed(words, found) if found else words).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip((ids, n, runs, texts), FOUND)], schema=FOUND
            )

    return narrow(docs).mapInArrow(run, FOUND_DDL)


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: the tail of a tenth of the documents, by crc32 of the id, becomes periodic.

    A document without an id stays as it is.
    """
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


def summary(docs: DataFrame) -> DataFrame:
    """Counts, the run of greatest exponent and digests of ``periodic_runs`` under the rule of ``looped``."""
    found = periodic_runs(docs, words_of=looped)
    # Exponents are compared as l1 * p2 against l2 * p1, which is exact; the runs come by start and period.
    first = F.expr(
        "aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (a, r) -> CASE"
        " WHEN a IS NULL OR CAST(r.length AS DECIMAL(19, 0)) * a.period > CAST(a.length AS DECIMAL(19, 0)) * r.period"
        " THEN r ELSE a END)"
    )
    lines = F.concat_ws("", F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"))
    found = found.withColumn("best", first)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
