"""Benchmark passages in documents, by the q-gram lemma.

Texts and items are folded alike: lower case, every run of characters that are neither letters
nor digits becomes one space. A region within ``k`` edits of a passage of ``m`` characters
shares at least ``m - q + 1 - k q`` q-grams with it, on neighbouring diagonals. A document is
read once: stretches too poor in benchmark q-grams for any passage are left at once; in the
others shared q-grams are counted in overlapping diagonal bands, bands that meet the bound are
kept and verified by banded alignment. Nothing is decided by the counts alone.

The edit budget is ``RATE`` of the passage. Items longer than ``PIECE`` characters are searched
as overlapping pieces; items under ``SHORTEST`` characters would match by chance and are not
searched. The item index is sent to the tasks in blocks of at most ``BLOCK_CHARS`` characters,
with one pass over the documents per block, so what is broadcast does not grow.

Nulls: a null text is empty and clean, a null item text is not searched, a null ``doc_id`` is
reported as null. Repeated documents are reported each, repeated items under each of their ids.
Empty documents or an empty benchmark give no findings.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Q = 10
RATE = 0.05
PIECE = 512
SHORTEST = 24
BLOCK_CHARS = 8_000_000
CHUNK_CHARS = 1 << 18  # characters examined together

FOUND = "doc_id long, item_id long, first_char long, last_char long, edits int"
FOUND_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_char", pa.int64()), ("last_char", pa.int64()), ("edits", pa.int32())]
)

_word_character: np.ndarray | None = None


def _is_word(codes: np.ndarray) -> np.ndarray:
    global _word_character
    if _word_character is None:
        _word_character = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x10000)])
    return _word_character[np.minimum(codes, 0xFFFF)]


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points and the place of each in the lower-cased text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _is_word(codes)
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    return np.where(word, codes, np.uint32(32))[at], at


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each q-gram, by doubling."""
    if len(codes) < Q:
        return np.empty(0, np.uint32)
    with np.errstate(over="ignore"):
        a, b, c, d = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263))
        two = codes[:-1] * a + (codes[1:] ^ np.uint32(0x5BD1))
        two = two ^ (two >> np.uint32(15))
        four = two[:-2] * b + two[2:]
        eight = four[:-4] * c + four[4:]
        ten = eight[:-2] * d + two[8:]
        ten = ten ^ (ten >> np.uint32(13))
        return ten * a


class Index:
    """Q-grams of folded passages with their places, and what every passage must share."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.item, self.text, self.edits = [], [], []
        for item_id, raw in items:
            codes, _ = fold(raw.lower())
            text = _as_text(codes).strip()
            step = PIECE // 2
            starts = [0] if len(text) <= PIECE else [*range(0, len(text) - PIECE, step), len(text) - PIECE]
            for start in starts:
                piece = text[start : start + PIECE]
                if len(piece) >= SHORTEST:
                    self.item.append(item_id)
                    self.text.append(piece)
                    self.edits.append(int(rate * len(piece)))
        grams, owner, place = [], [], []
        for i, text in enumerate(self.text):
            h = _hashes(np.array([ord(c) for c in text], np.uint32))
            grams.append(h)
            owner.append(np.full(len(h), i, np.int64))
            place.append(np.arange(len(h)))
        self.empty = not grams
        if self.empty:
            return
        grams, owner, place = map(np.concatenate, (grams, owner, place))
        order = np.argsort(grams, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.last = np.r_[self.first[1:], len(order)]
        self.shift = np.uint32(32 - max(16, int(np.ceil(np.log2(len(self.grams) * 32)))))
        self.table = np.zeros(1 << (32 - int(self.shift)), bool)
        self.table[self.grams >> self.shift] = True
        length = np.array([len(t) for t in self.text])
        self.length, self.budget = length, np.array(self.edits)
        self.bound = length - Q + 1 - self.budget * Q
        # A region of length m + k lies in this many windows of the width below, one of which
        # must hold its share of the bound.
        self.width = int(length.min() + self.budget[length.argmin()])
        self.least = int(np.ceil(self.bound / np.ceil((length + self.budget) / self.width)).min())

    def candidates(self, hashes: np.ndarray):
        """(passage, first diagonal, one hit) of diagonal bands that meet the bound."""
        hit = self.table[hashes >> self.shift]
        sums = np.zeros(len(hit) + 1, np.int32)
        np.cumsum(hit, out=sums[1:])
        width = min(self.width, len(hit))
        rich = np.flatnonzero(sums[width:] - sums[:-width] >= self.least)
        if not len(rich):
            return
        edge = np.zeros(len(hit) + 1, np.int32)
        np.add.at(edge, rich, 1)
        np.add.at(edge, rich + width, -1)
        at = np.flatnonzero(hit & (np.cumsum(edge)[:-1] > 0))
        where = np.searchsorted(self.grams, hashes[at])
        where[where == len(self.grams)] = 0
        real = self.grams[where] == hashes[at]
        at, where = at[real], where[real]
        times = self.last[where] - self.first[where]
        posting = np.repeat(self.first[where] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        owner, position = self.owner[posting], np.repeat(at, times)
        diagonal = position - self.place[posting] + PIECE
        step = 2 * self.budget[owner] + 1
        band = diagonal // step
        key = (owner << 40) | band
        order = np.argsort(key, kind="stable")
        key, position = key[order], position[order]
        found, begin, count = np.unique(key, return_index=True, return_counts=True)
        follows = np.zeros(len(found), np.int64)
        follows[:-1] = np.where(found[1:] == found[:-1] + 1, count[1:], 0)
        piece = found >> 40
        # Bands overlap by half: a band and its successor together cover every stretch of 2k + 1
        # diagonals.
        good = np.flatnonzero(count + follows >= self.bound[piece])
        for i in good:
            p = int(piece[i])
            low = int(found[i] & ((1 << 40) - 1)) * (2 * self.edits[p] + 1) - PIECE
            yield p, low, low + 2 * (2 * self.edits[p] + 1) - 1, int(position[begin[i]])


def _as_text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _agree(a: str, i: int, b: str, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:]."""
    low, high = 0, min(len(a) - i, len(b) - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a[i + low : i + middle] == b[j + low : j + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def align(passage: str, text: str, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the passage in ``text`` on diagonals low..high, or nothing.

    Furthest points per diagonal and number of edits; the alignment may begin on any diagonal.
    """
    goal = len(passage)
    reach: dict[int, tuple[int, int]] = {}  # diagonal -> (passage characters used, starting diagonal)
    for d in range(max(low, 0), min(high, len(text)) + 1):
        reach[d] = (_agree(passage, 0, text, d), d)
    for edits in range(budget + 1):
        done = [(start, d) for d, (i, start) in reach.items() if i >= goal]
        if done:
            start, d = done[0]
            return edits, start, goal + d
        after: dict[int, tuple[int, int]] = {}
        for d in range(low - budget, high + budget + 1):
            options = []
            if d in reach:
                options.append((reach[d][0] + 1, reach[d][1]))
            if d - 1 in reach:
                options.append(reach[d - 1])
            if d + 1 in reach:
                options.append((reach[d + 1][0] + 1, reach[d + 1][1]))
            options = [(min(i, goal), s) for i, s in options if 0 <= min(i, goal) + d <= len(text)]
            if options:
                i, start = max(options)
                after[d] = (i + _agree(passage, i, text, i + d), start)
        reach = after
    return None


def find(index: Index, texts: list[str]) -> list[tuple[int, int | None, int, int, int]]:
    """(text number, item id, first and last character, edits), best alignment per text and item."""
    if index.empty or not texts:
        return []
    lowered = [t.lower() for t in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    codes, at = fold("\n".join(lowered))
    hashes = _hashes(codes)
    best: dict[tuple[int, int | None], tuple[int, int, int]] = {}
    if not len(hashes):
        return []
    edges = np.searchsorted(at, starts)
    for p, low, high, hit in index.candidates(hashes):
        number = int(np.searchsorted(starts, at[hit], side="right")) - 1
        begin, end = int(edges[number]), int(edges[number + 1])
        passage, budget = index.text[p], index.edits[p]
        left = max(begin, low - budget)
        right = min(end, high + len(passage) + budget + 1)
        if right <= left:
            continue
        match = align(passage, _as_text(codes[left:right]), low - left, high - left, budget)
        if match is not None:
            edits, first, last = match
            first_char = int(at[left + first]) - int(starts[number])
            last_char = int(at[left + max(first, last - 1)]) - int(starts[number])
            key, value = (number, index.item[p]), (edits, first_char, last_char)
            best[key] = min(best.get(key, value), value)
    return [(n, item, first, last, edits) for (n, item), (edits, first, last) in sorted(best.items(), key=str)]


def _chunks(texts: list[str]):
    """Slices of the list that hold about CHUNK_CHARS characters."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_CHARS:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _blocks(benchmark: DataFrame):
    """The benchmark's indexes, each over a bounded share of its items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    for block in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        yield Index([tuple(r) for r in part.collect()])


def findings(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_char, last_char, edits): items found in documents.

    Places count characters of the lower-cased text.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    result = None
    for index in _blocks(benchmark):
        shared = context.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = [
                    (ids[part.start + n], item, first, last, edits)
                    for part in _chunks(texts)
                    for n, item, first, last, edits in find(shared.value, texts[part])
                ]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*found), FOUND_SCHEMA)], schema=FOUND_SCHEMA
                    )

        part = rows.mapInArrow(run, FOUND)
        result = part if result is None else result.union(part)
    return result


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark passage, with all their columns."""
    context, place = docs.sparkSession.sparkContext, docs.columns.index("text")
    for index in _blocks(benchmark):
        shared = context.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                texts = [t or "" for t in batch.column(place).to_pylist()]
                keep = np.ones(len(texts), bool)
                for part in _chunks(texts):
                    for n, *_ in find(shared.value, texts[part]):
                        keep[part.start + n] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
