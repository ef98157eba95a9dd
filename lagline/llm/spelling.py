"""Spelling variants: words that differ by one letter, by a bit-sliced position index.

The vocabulary is laid out as bits: word ``i`` of a block is bit ``i``, and for each (position,
letter) a bitset holds the words with that letter there. A query word is read letter by letter.
``zero`` holds the words that agreed so far; ``put``, ``more`` and ``less`` hold those with one
letter replaced, inserted or deleted so far, read from the same position, one further on and one
before. Every step is a handful of AND and OR over machine words, for many queries at once, and
no pair of words is looked at by itself.

Two words within one edit, the shorter of L letters, share their first L / 2 letters or their
last L - L / 2. So each word is filed under four keys (L its length or one less; beginning or
end) and a key's words are searched among themselves: with the beginning only words that share
it count, with the end only words that don't, so every near word is met exactly once. What a
search returns is a count and the best near word, never a list.

A key with more words than ``BLOCK`` has them dealt over several blocks by their hash, and its
queries go to every one: a query set against all of its words, in blocks, with nothing dropped. A
task holds one block of words, packed from whole keys of the same length.

Words are runs of ``LETTERS`` in lower case (A-Z only); counts are collected in a bounded table
per task before they meet. A null text has no words; a null ``doc_id`` is the empty string in the
rule of ``thinned``; repeated rows count again; further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lagline.llm.common import narrow
from lagline.sources.work import materialize

LETTERS = "a-zÀ-ÿ"  # after lower-casing A-Z
SHORTEST, LEAST = 5, 3  # code points and occurrences of a word
RATIO = 2  # a form is at least so many times as frequent
BLOCK = 4096  # words of one block of the index
ANSWERS = 1 << 16  # query words x machine words that a step works on at once
WAITING = 1 << 18  # distinct words a task counts before it passes them on

COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
NEAR_DDL = "word string, n long, near long, best_n long, best string"
OWN, INDEX, QUERY = 0, 1, 2  # a row is both, or it is one of the index or one of the questions


def word_counts(docs: DataFrame, changed: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, n) over all texts; ``changed(crc, run)`` may rewrite a run, ``crc`` being that of ``<doc_id>:<run>``."""

    def run(batches):
        runs = re.compile(f"[{LETTERS}]+").findall
        counts: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                begun = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in Counter(runs(text.as_py().lower().decode())).items():
                    if changed is not None:
                        word = changed(zlib.crc32(word.encode(), begun), word)
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > WAITING:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()))], schema=COUNTED)
                    counts = {}
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()))], schema=COUNTED)

    return narrow(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def thinned(crc: int, word: str) -> str:
    """The query's rule: a run whose crc32 97 divides loses one letter."""
    if crc % 97:
        return word
    at = crc % len(word)
    return word[:at] + word[at + 1 :]


class Block:
    """A bit-sliced index over words of L and L + 1 letters, the most frequent in the lowest bits."""

    def __init__(self, length: int, words: list[str], counts: list[int]):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.length, self.words = length, [words[i] for i in order]
        self.counts = np.array([counts[i] for i in order], np.int64)
        self.size = -(-len(words) // 64)
        long = np.array([len(w) > length for w in self.words])
        self.short, self.long = self._bits(np.flatnonzero(~long)), self._bits(np.flatnonzero(long))
        codes = self._codes(self.words)
        self.letters = np.unique(codes)
        self.slices = np.zeros((length + 1, len(self.letters) + 1, self.size), np.uint64)
        letter = np.searchsorted(self.letters, codes)
        bit = np.arange(len(self.words))
        for p in range(length + 1):
            has = codes[:, p] != 0
            np.bitwise_or.at(self.slices[p], (letter[has, p], bit[has] >> 6), np.uint64(1) << (bit[has] & 63).astype(np.uint64))

    def _bits(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, np.uint64)
        np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return out

    def _codes(self, words: list[str]) -> np.ndarray:
        """Code points by position; a word of L letters ends in 0."""
        width = self.length + 1
        return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(-1, width)

    def near(self, words: list[str], share_beginning: bool) -> np.ndarray:
        """Bitsets of the words within exactly one edit of each of ``words``, all of one length L or L + 1.

        Queries of L letters find words of L and L + 1, those of L + 1 letters find words of L.
        """
        m, half = len(words[0]), self.length // 2
        codes = self._codes(words)
        letter = np.searchsorted(self.letters, codes)
        letter[(letter == len(self.letters)) | (self.letters[np.minimum(letter, len(self.letters) - 1)] != codes)] = len(self.letters)
        zero = np.full((len(words), self.size), ~np.uint64(0))
        nothing, same = np.zeros_like(zero), m == self.length
        put, more, less, begun = nothing.copy(), nothing.copy(), nothing.copy(), zero
        for j in range(m):
            if j == half:
                begun = zero.copy()
            here = self.slices[j, letter[:, j]]
            if same:
                put = (put & here) | (zero & ~here)
                # An insertion before letter j has the letter one place further on.
                more = (more | zero) & self.slices[j + 1, letter[:, j]]
            else:
                # A deletion of an earlier letter has letter j one place before; deleting j itself starts one.
                less = (less & self.slices[j - 1, letter[:, j]] if j else nothing) | zero
            zero &= here
        found = ((put & self.short) | ((more | zero) & self.long)) if same else less & self.short
        return found & begun if share_beginning else found & ~begun

    def best(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bits each row has, and its lowest bit (where it has one)."""
        n = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
        at = (found != 0).argmax(axis=1)
        low = found[np.arange(len(found)), at]
        low = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
        return n, at * 64 + low


def _answers(block: Block, beginning: bool, asked: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    step = max(1, ANSWERS // block.size)
    for m in (block.length, block.length + 1):
        queries = [q for q in asked if len(q[0]) == m]
        for at in range(0, len(queries), step):
            part = queries[at : at + step]
            n, first = block.best(block.near([w for w, _ in part], beginning))
            hit = np.flatnonzero(n)
            if len(hit):
                columns = [
                    [part[i][0] for i in hit], [part[i][1] for i in hit], n[hit],
                    block.counts[first[hit]], [block.words[i] for i in first[hit]],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NEAR)], schema=NEAR)


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (length, beginning, key, block, role, word, n) in this order: blocks of whole keys, searched by their queries.

    Keys are packed into one block of the index while they have the same length and side and
    there is room; the rows of a divided key's block fill one alone, their queries pass by.
    """
    kind, key, words, counts, asked, index, whole = None, None, [], [], [], None, True

    def closed():
        if words and asked:
            yield from _answers(index or Block(kind[0], words, counts), kind[1], asked)

    for batch in batches:
        for length, beginning, name, part, role, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            packs = whole and role == OWN and len(words) < BLOCK
            if kind != (length, beginning) or (key != (name, part) and not packs):
                yield from closed()
                kind, words, counts, asked, index, whole = (length, beginning), [], [], [], None, role == OWN
            key = (name, part)
            if role != QUERY:
                words.append(word)
                counts.append(n)
            elif index is None:
                index = Block(length, words, counts) if words else None
            if role != INDEX:
                asked.append((word, n))
                if role == QUERY and len(asked) >= BLOCK:
                    yield from closed()
                    asked = []
    yield from closed()


def filed(words: DataFrame) -> DataFrame:
    """(length, beginning, key, word, n): each word under its beginnings and ends."""
    sides = F.array(
        *(F.struct((F.length("word") - less).alias("length"), F.lit(side).alias("beginning")) for less in (0, 1) for side in (True, False))
    )
    out = words.select("word", "n", F.inline(sides)).where("length > 0")
    half = F.floor(F.col("length") / 2).cast("int")
    key = F.when(F.col("beginning"), F.substring("word", F.lit(1), half)).otherwise(
        F.substring("word", F.length("word") - (F.col("length") - half) + 1, F.col("length") - half)
    )
    return out.select("length", "beginning", key.alias("key"), "word", "n")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, best_n, best) of the words of ``words`` (word, n) that have near words.

    ``near`` counts them, ``best`` is the most frequent one (ties: smallest in code-point order).
    """
    names = ["length", "beginning", "key"]
    rows = materialize(filed(words), "spelling-keys")
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = rows.join(materialize(sizes, "spelling-sizes"), names)
    parts = F.ceil(F.col("size") / block).cast("int")
    one = rows.where(F.col("size") <= block).select(*names, F.lit(0).alias("part"), F.lit(OWN).alias("role"), "word", "n")
    large = rows.where(F.col("size") > block)
    index = large.select(*names, F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), F.lit(INDEX).alias("role"), "word", "n")
    asked = large.select(*names, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(QUERY).alias("role"), "word", "n")
    dealt = one.union(index).union(asked).repartition(*names, "part").sortWithinPartitions(*names, "part", "role")
    found = dealt.mapInArrow(_search, NEAR_DDL)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select(
        "word", "near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of (word, form): forms are followed by doubling until no word moves.

    Frequencies at least double along a chain, so it has at most 63 forms and this at most 7 rounds.
    """
    found = materialize(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = found.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = materialize(moved, "spelling-roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        found = moved.select("word", "root")


def variants(
    docs: DataFrame,
    shortest: int = SHORTEST,
    least: int = LEAST,
    ratio: int = RATIO,
    changed: Callable[[int | None, str], str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of enough letters and occurrences.

    A word's form is its most frequent near word, if that is ``ratio`` times as frequent; its
    root is the last form reached from it, itself if it has none.
    """
    words = word_counts(docs, changed).where((F.length("word") >= shortest) & (F.col("n") >= least))
    words = materialize(words, "spelling-words")
    near = materialize(near_words(words, block), "spelling-near")
    held = F.col("best_n") >= ratio * F.col("n")
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"),
        F.when(held, F.col("best")).alias("form"), F.when(held, F.col("best_n")).alias("form_n"),
    )
    table = materialize(table, "spelling-table")
    last = roots(table.where("form IS NOT NULL"))
    return table.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
