"""Exact duplicates by Patricia tries over whole byte strings.

Texts are equal when they are identical after deleting space and the characters 0x09-0x0D.
Each task first inserts its own rows into a compressed radix trie, so a group holding a third
of all rows leaves it as one row per task; what is left is partitioned by length and content
hash and inserted again. A terminal node keeps the row that stays (most code points in the
original text, then smallest ``doc_id``) and counts its group. A trie over its byte budget
gives up whole subtrees: before the shuffle as partial owners, after it (where keys arrive in
order) as finished ones.

Nulls: a null text is empty, a null ``doc_id`` sorts last. Repeated rows are members of one
group and only one of them is an owner. An empty table has no owners.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from lagline.llm.common import NO_ID, SPACES

TRIE_BYTES = 24 << 20  # bytes a task's trie holds before it gives up subtrees
BATCH_BYTES = 4 << 20


class Trie:
    """A radix trie with bytes on its edges; ``merge`` combines values meeting at a terminal."""

    def __init__(self, merge, weight):
        self.merge, self.weight = merge, weight
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, list] = {}  # first byte -> [edge bytes, children, value]
        self.held: dict[int, int] = {}  # bytes held below each first byte
        self.empty = None  # value of the empty string
        self.total = 0

    def _hold(self, head: int, n: int) -> None:
        self.held[head] = self.held.get(head, 0) + n
        self.total += n

    def insert(self, key: bytes, value) -> None:
        if not key:
            self.empty = value if self.empty is None else self.merge(self.empty, value)
            return
        level, at, head = self.children, 0, key[0]
        while True:
            node = level.get(key[at])
            if node is None:
                level[key[at]] = [key[at:], {}, value]
                self._hold(head, len(key) - at + self.weight(value))
                return
            edge = node[0]
            if not key.startswith(edge, at):
                shared = _common(edge, key, at)
                below = [edge[shared:], node[1], node[2]]
                node[0], node[1], node[2] = edge[:shared], {edge[shared]: below}, None
                edge = node[0]
            at += len(edge)
            if at == len(key):
                before = 0 if node[2] is None else self.weight(node[2])
                node[2] = value if node[2] is None else self.merge(node[2], value)
                self._hold(head, self.weight(node[2]) - before)
                return
            level = node[1]

    def _values(self, node: list) -> Iterator:
        stack = [node]
        while stack:
            node = stack.pop()
            if node[2] is not None:
                yield node[2]
            stack.extend(node[1].values())

    def spill(self, down_to: int) -> Iterator:
        """Give up the largest subtrees until no more than ``down_to`` bytes are held."""
        while self.total > down_to and self.held:
            head = max(self.held, key=self.held.get)
            yield from self._values(self.children.pop(head))
            self.total -= self.held.pop(head)

    def drain(self) -> Iterator:
        if self.empty is not None:
            yield self.empty
        for node in self.children.values():
            yield from self._values(node)
        self.clear()


def _common(edge: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of edge and key[at:], by halving."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[:middle] == key[at : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _owner_task(names: list[str], types: list[pa.DataType], doc_id: str, text: str, partial: bool):
    """mapInArrow function; ``partial`` before the shuffle, where rows are still plain documents."""
    text_at = names.index(text)
    id_at = names.index(doc_id)
    out = [*names, "text_size", "text_sha256", "code_points", "group_size"]
    out_types = [*types, pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def rank(value):
        row = value[0]
        return -value[3], NO_ID if row[id_at] is None else row[id_at], row[id_at] is None

    def merge(a, b):
        best, other = (a, b) if rank(a) <= rank(b) else (b, a)
        return (*best[:4], best[4] + other[4])

    def weight(value):
        return 200 + len(value[0][text_at] or "")

    def batch_of(values):
        columns = [[v[0][i] for v in values] for i in range(len(names))]
        columns += [[v[i] for v in values] for i in range(1, 5)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(columns, out_types)], names=out
        )

    def in_batches(values):
        held, size = [], 0
        for value in values:
            held.append(value)
            size += weight(value)
            if size >= BATCH_BYTES:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    def run(batches):
        trie, last = Trie(merge, weight), None
        for batch in batches:
            columns = [batch.column(n) for n in batch.schema.names]
            where = {n: i for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                row = tuple(columns[where[n]][i].as_py() for n in names)
                points = columns[where["code_points"]][i].as_py()
                key = (row[text_at] or "").encode().translate(None, SPACES)
                if partial:
                    value = (row, len(key), hashlib.sha256(key).hexdigest(), points, 1)
                else:
                    size, sha, n = (columns[where[c]][i].as_py() for c in out[-4:] if c != "code_points")
                    value = (row, size, sha, points, n)
                    if trie.total > TRIE_BYTES and (size, sha) != last:
                        yield from in_batches(trie.drain())  # keys come in order: all are finished
                    last = (size, sha)
                trie.insert(key, value)
                if partial and trie.total > TRIE_BYTES:
                    yield from in_batches(trie.spill(TRIE_BYTES // 2))
        yield from in_batches(trie.drain())

    return run


def owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each group of equal texts that stays, with all columns of ``docs``, and its group.

    Adds ``text_size`` (bytes of the normalised text), ``text_sha256``, ``code_points`` and
    ``group_size``.
    """
    names = docs.columns
    rows = docs.withColumn("code_points", F.length(F.coalesce(text, F.lit(""))).cast("long"))
    fields = [
        *docs.schema.fields,
        T.StructField("text_size", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("code_points", T.LongType()),
        T.StructField("group_size", T.LongType()),
    ]
    kinds = [to_arrow_type(f.dataType) for f in docs.schema.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    local = rows.mapInArrow(_owner_task(names, kinds, doc_id, text, True), schema)
    keyed = local.repartition("text_size", "text_sha256").sortWithinPartitions("text_size", "text_sha256")
    return keyed.mapInArrow(_owner_task(names, kinds, doc_id, text, False), schema)


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per document: keep_id, group_size, kept and the hash of its normalised text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES.decode(), "")
    members = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(bare, 256).alias("text_sha256"),
        F.octet_length(bare).cast("long").alias("text_size"),
    )
    found = owners(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        F.col("text_sha256"), F.col("text_size"), F.col("doc_id").alias("keep_id"), "group_size"
    )
    return members.join(found, ["text_sha256", "text_size"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``."""
    # Under names of their own, whatever further columns the documents have.
    inner = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (inner[docs.columns.index(c)] for c in ("doc_id", "text"))
    return owners(docs.toDF(*inner), doc_id, text).select(*inner).toDF(*docs.columns)


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
), r AS (
  SELECT doc_id, sha256(bare) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY bare) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
