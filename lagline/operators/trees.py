"""Boosted regression trees for absolute error, several fits over the same rows at once.

Features are cut into at most 255 bins once per training period. Trees grow leaf by leaf: the
leaf with the largest gain is split until the tree has all its leaves. A split's gain comes from
summed gradients and row counts per bin, shrunk by ``Settings.l2``; categories are ordered by
their gradient. A leaf's value is the median residual of its rows.

A fit of at most ``WHOLE`` rows goes to one task that holds them through all rounds. For the others
one Spark job counts (fit, node, feature, bin) for all fits together and every node that may
still be split; of two siblings the smaller is counted, the other is the difference. What comes back has
a size that rows don't change. A node of at most ``SMALL`` rows is not counted further: one more
job brings its rows together, one bounded group a node, and grows what may hang below it. The
order of splits is decided over all nodes afterwards, so the trees are the same as without. Predictions
live beside the binned features in blocks of rows that the executors keep, written to the shared folder
every few rounds, so a lost executor costs its blocks' last rounds.

Residuals are whole multiples of ``1 / UNIT`` seconds. All sums are of whole numbers, so the same
rows give the same trees however they are dealt, and medians are exact: their leading digit is
one more counted feature, the rest is one job of counts within that digit.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from lagline.session import use_checkpoints
from lagline.sources.work import spread

BINS = 255  # of a feature; one more, behind those it has, is for missing and unknown values
UNIT = 1024  # residuals per second
DIGIT, DIGITS, MIDDLE = 12, 256, 128  # a leading digit spans 2 ** DIGIT units; MIDDLE is the one from 0 on
FAR = 36  # residuals beyond the leading digits lie within 2 ** FAR units
BLOCK_ROWS, LEAST_ROWS = 1 << 18, 1 << 13
SMALL = 1 << 19  # rows of a node that one task may hold to grow it to its end, some 40 bytes each
WHOLE = 1 << 22  # rows of a fit that one task may hold through all rounds, some 60 bytes each
PIECE = 1 << 15  # rows that go to such a task at once
JOINED, CHUNK = 1 << 14, 1 << 17  # combinations of bins counted together; rows counted at once
KEPT_ROUNDS = 20  # rounds between two writes to the shared folder
AT_ONCE = 64  # partitions whose counts the driver adds up itself; more go through a tree of tasks


@dataclass(frozen=True)
class Settings:
    """How trees grow. ``support`` rows make a category count; as many smooth its gradient."""

    rounds: int
    step: float
    least: int
    l2: float
    support: float = 10.0


@dataclass(frozen=True)
class Fit:
    """One model: rows before day number ``before``, trees of ``leaves`` leaves."""

    name: str
    before: int
    leaves: int


@dataclass
class Tree:
    """Nodes by number: where a row goes by the bin of a feature, or the value it gets."""

    feature: np.ndarray  # -1 in a leaf
    goes_left: np.ndarray  # node x bin
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Tree:
        """Leaves only, of value 0."""
        return cls(np.full(size, -1, np.int8), np.zeros((size, BINS + 1), bool), *(np.zeros(size, t) for t in (np.int32, np.int32, np.int64)))

    def reach(self, bins: np.ndarray, wanted: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(node, its rows in order) of the ``wanted`` nodes; rows of ``bins`` (feature x row) elsewhere are not followed.

        Children have larger numbers than their node.
        """
        sought = np.zeros(len(self.feature), bool)
        sought[list(wanted)] = True
        on_way, inner = sought.copy(), self.feature >= 0
        for i in np.flatnonzero(inner)[::-1]:
            on_way[i] |= on_way[self.left[i]] | on_way[self.right[i]]
        waiting: list[tuple[int, np.ndarray | None]] = [(0, None)] if on_way[0] else []
        while waiting:
            node, rows = waiting.pop()
            if sought[node]:
                yield node, np.arange(bins.shape[1]) if rows is None else rows
            if not inner[node]:
                continue
            own = bins[self.feature[node]] if rows is None else bins[self.feature[node]].take(rows)
            to_left = self.goes_left[node].take(own)
            for child, side in ((int(self.right[node]), ~to_left), (int(self.left[node]), to_left)):
                if on_way[child]:
                    waiting.append((child, np.flatnonzero(side) if rows is None else rows[side]))

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``bins`` (feature x row)."""
        node = np.zeros(bins.shape[1], np.int32)
        for k, rows in self.reach(bins, np.flatnonzero(self.feature < 0)):
            node[rows] = k
        return node


@dataclass
class Bins:
    """Upper edges of the numbers' bins and codes of the categories, from one training period."""

    edges: list[np.ndarray]
    codes: list[dict[str, int]]

    @property
    def sizes(self) -> list[int]:
        """Bins of each feature without the one for missing values."""
        return [len(e) + 1 for e in self.edges] + [len(c) for c in self.codes]

    @property
    def starts(self) -> np.ndarray:
        """Where each feature's bins begin when all are laid in a row, and their number."""
        return np.r_[0, np.cumsum([n + 1 for n in self.sizes])]

    def of(self, numbers: Sequence[np.ndarray], categories: Sequence[Sequence[str]]) -> np.ndarray:
        """Bin numbers, feature x row."""
        out = np.empty((len(self.edges) + len(self.codes), len(numbers[0])), np.uint8)
        for i, (edges, values) in enumerate(zip(self.edges, numbers)):
            values = np.asarray(values, np.float64)
            out[i] = np.where(np.isnan(values), len(edges) + 1, np.searchsorted(edges, values, side="left"))
        for i, (codes, values) in enumerate(zip(self.codes, categories), len(self.edges)):
            out[i] = [codes.get(v, len(codes)) for v in values]
        return out


@dataclass
class Boosted:
    """A fitted model: bins, the first estimate and the trees, in residual units."""

    bins: Bins
    first: int
    trees: list[Tree] = field(default_factory=list)

    def predict(self, numbers: Sequence[np.ndarray], categories: Sequence[Sequence[str]]) -> np.ndarray:
        bins = self.bins.of(numbers, categories)
        total = np.full(bins.shape[1], self.first, np.int64)
        for tree in self.trees:
            total += tree.value[tree.leaf(bins)]
        return total / UNIT


# ---- bins ----------------------------------------------------------------------------------


def fit_bins(rows: DataFrame, day: str, numbers: Sequence[str], categories: Sequence[str], ends: Sequence[int]) -> dict[int, Bins]:
    """Bins per training period (rows with ``day`` before each end).

    Values are counted first. A number with at most 255 values has an edge between any two
    neighbours; another has 254 edges that cut its rows into equal parts. Of more than 255
    categories the most frequent have codes, the rest are like missing ones.
    """
    named = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x"), F.lit(None).cast("string").alias("s")) for c in numbers]
    named += [F.struct(F.lit(c).alias("field"), F.lit(None).cast("double").alias("x"), F.col(c).alias("s")) for c in categories]
    periods = ", ".join(f"named_struct('ending', {e}, 'n', n{i})" for i, e in enumerate(ends))
    counts = (
        rows.select(day, F.inline(F.array(*named)))
        .where("x IS NOT NULL OR s IS NOT NULL")
        .groupBy("field", "x", "s")
        .agg(*[F.count_if(F.col(day) < e).alias(f"n{i}") for i, e in enumerate(ends)])
        .selectExpr("field", "x", "s", f"inline(array({periods}))")
        .where("n > 0")
    )
    # Windows over value counts: as many rows as a field has values.
    ranked = counts.selectExpr(
        "*",
        "count(1) OVER (PARTITION BY field, ending) AS n_values",
        "sum(n) OVER (PARTITION BY field, ending) AS total",
        "sum(n) OVER (PARTITION BY field, ending ORDER BY x, s ROWS UNBOUNDED PRECEDING) AS upto",
        "lead(x) OVER (PARTITION BY field, ending ORDER BY x) AS following",
        "row_number() OVER (PARTITION BY field, ending ORDER BY n DESC, s) AS place",
    )
    crosses = f"(upto * {BINS}) div total > ((upto - n) * {BINS}) div total"
    wanted = ranked.where(f"CASE WHEN s IS NOT NULL THEN place <= {BINS} ELSE n_values <= {BINS} OR {crosses} END")
    edges: dict[tuple, list[float]] = {}
    known: dict[tuple, list[str]] = {}
    for r in wanted.select("field", "ending", "x", "s", "following", "n_values").collect():
        if r.s is not None:
            known.setdefault((r.field, r.ending), []).append(r.s)
        elif r.following is not None:
            edges.setdefault((r.field, r.ending), []).append((r.x + r.following) / 2 if r.n_values <= BINS else r.x)
    return {
        e: Bins(
            [np.array(sorted(edges.get((c, e), []))) for c in numbers],
            [{v: i for i, v in enumerate(sorted(known.get((c, e), [])))} for c in categories],
        )
        for e in ends
    }


# ---- blocks of rows ------------------------------------------------------------------------


def blocks(
    rows: DataFrame, day: str, target: Column, numbers: Sequence[str], categories: Sequence[str], bins: dict[int, Bins],
    fits: Sequence[Fit], most: int,
) -> RDD:
    """Rows as arrays, by day: bins per training period, and residuals."""

    def block(table: pa.Table) -> bytes:
        days = table.column(0).to_numpy()
        order = np.argsort(days, kind="stable")
        table, days = table.take(pa.array(order)), days[order]
        y = np.rint(table.column(1).to_numpy() * UNIT).astype(np.int64)
        values = [table.column(2 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(numbers))]
        texts = [table.column(2 + len(numbers) + i).to_pylist() for i in range(len(categories))]
        cut = {}
        for e, b in bins.items():
            n = int(np.searchsorted(days, e))
            cut[e] = b.of([v[:n] for v in values], [t[:n] for t in texts])
        return pickle.dumps((cut, y), 5)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield pa.RecordBatch.from_pydict({"block": [block(pa.Table.from_batches(held))]})
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_pydict({"block": [block(pa.Table.from_batches(held))]})

    inputs = rows.select(
        F.col(day).cast("int").alias("day"), target.cast("double").alias("y"), *[F.col(c).cast("double") for c in numbers], *categories
    )
    inputs = inputs.where(f"y IS NOT NULL AND day < {max(f.before for f in fits)}")
    # A job's fixed cost is that of reading some ten thousand rows: fewer make no partition of their own.
    n = max(1, -(-most // LEAST_ROWS))
    made = spread(inputs).coalesce(n).mapInArrow(run, "block binary")
    return made.rdd.map(lambda r: pickle.loads(r[0]))


def _scored(fits: Sequence[Fit]):
    """A block with a prediction per fit."""

    def start(block):
        cut, y = block
        return cut, y, [np.zeros(cut[f.before].shape[1], np.int64) for f in fits]

    return start


def _updated(trees: Sequence[Tree], fits: Sequence[Fit]):
    def update(block):
        cut, y, scores = block
        moved = [s.copy() for s in scores]
        for fit, tree, score in zip(fits, trees, moved):
            for leaf, rows in tree.reach(cut[fit.before], np.flatnonzero(tree.feature < 0)):
                score[rows] += tree.value[leaf]
        return cut, y, moved

    return update


def signed(bins: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Two numbers per bin, feature x row: the second for residuals below 0."""
    return 2 * bins.astype(np.uint16) + (r < 0)


def counted(keys: np.ndarray, start: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows of one node by (bin, residual below 0) of all features in a row, then by leading digit.

    ``keys`` is what ``signed`` makes, ``start`` says where a feature's bins begin.
    """
    width = 2 * int(start[-1])
    table = np.empty(width + DIGITS, np.int32)  # of one block
    for own, low, high in zip(keys, 2 * start[:-1], 2 * start[1:]):
        table[low:high] = np.bincount(own, minlength=high - low)
    table[width:] = np.bincount(np.clip((r >> DIGIT) + MIDDLE, 0, DIGITS - 1), minlength=DIGITS)
    return table


def _counts(trees: Sequence[Tree], wanted: Sequence[Sequence[int]], fits: Sequence[Fit], bins: dict[int, Bins]):
    """Per fit the sums of ``counted`` over the rows of the wanted nodes, in their order."""
    starts = {e: b.starts for e, b in bins.items()}

    def count(block):
        cut, y, scores = block
        out = []
        for fit, tree, nodes, score in zip(fits, trees, wanted, scores):
            own, start, slot = cut[fit.before], starts[fit.before], {node: k for k, node in enumerate(nodes)}
            table = np.zeros((len(nodes), 2 * int(start[-1]) + DIGITS), np.int32)
            for node, rows in tree.reach(own, nodes):
                r = y[rows] - score[rows]
                inside = own if len(rows) == own.shape[1] else own.take(rows, axis=1)
                table[slot[node]] = counted(signed(inside, r), start, r)
            out.append(table)
        return out

    return count


def _rows_of(trees: Sequence[Tree], wanted: Sequence[dict[int, int]], fits: Sequence[Fit]):
    """((fit, node), (bins, residuals)) of the rows in each wanted node."""

    def pick(block):
        cut, y, scores = block
        for i, (fit, tree, nodes, score) in enumerate(zip(fits, trees, wanted, scores)):
            bins = cut[fit.before]
            for node, rows in tree.reach(bins, list(nodes)):
                if len(rows):
                    yield (i, node), (bins.take(rows, axis=1), y[rows] - score[rows])

    return pick


class Held:
    """Rows in one task, with a code for each group of features and a bit for residuals below 0.

    Features share a group while the combinations of their bins are few: one count of the codes,
    summed over the others' bins, has each feature's counts.
    """

    def __init__(self, bins: np.ndarray, r: np.ndarray, cuts: Bins):
        self.bins, self.r, self.cuts, self.every = bins, r, cuts, np.arange(len(r))
        self.widths, self.starts = [n + 1 for n in cuts.sizes], cuts.starts
        self.groups: list[list[int]] = []
        most = min(JOINED, len(r) // 4)
        for f in sorted(range(len(self.widths)), key=lambda f: -self.widths[f]):
            fitting = [g for g in self.groups if math.prod(self.widths[k] for k in (*g, f)) <= most]
            if fitting:
                fitting[0].append(f)
            else:
                self.groups.append([f])
        self.codes = []
        for group in self.groups:
            code = np.zeros(len(r), np.uint16)
            for f in group:
                code *= np.uint16(self.widths[f])
                code += bins[f]
            self.codes.append(code << np.uint16(1))
        self.sign()

    def sign(self) -> None:
        """Set the codes' bits by the residuals as they are now."""
        below = self.r < 0
        for code in self.codes:
            code &= np.uint16(0xFFFE)
            code |= below

    def counted(self, rows: np.ndarray | None = None) -> np.ndarray:
        """What the function ``counted`` makes, without the leading digits."""
        table = np.empty(2 * int(self.starts[-1]), np.int64)
        for group, code in zip(self.groups, self.codes):
            own = code if rows is None else code.take(rows)
            shape = [*(self.widths[f] for f in group), 2]
            joint = np.bincount(own[:CHUNK], minlength=math.prod(shape))
            for at in range(CHUNK, len(own), CHUNK):
                joint += np.bincount(own[at : at + CHUNK], minlength=len(joint))
            joint = joint.reshape(shape)
            for axis, f in enumerate(group):
                others = tuple(k for k in range(len(group)) if k != axis)
                table[2 * self.starts[f] : 2 * self.starts[f + 1]] = joint.sum(axis=others).ravel()
        return table

    def median(self, rows: np.ndarray) -> float:
        r = self.r.take(rows)
        high = len(r) // 2
        r.partition(high)
        return (int(r[high]) + int(r[high] if len(r) % 2 else r[:high].max())) / 2

    def grow(self, splits: int, settings: Settings, medians: bool) -> list[dict]:
        """Nodes by number, all rows' node first, split in order of gain ``splits`` times at most.

        Ends keep their rows; ``medians`` gives every node the median of its residuals.
        """

        def nodes_of(tables, parts):
            found = best_splits(np.stack(tables), self.cuts, settings) if splits else [(0.0, -1, None)] * len(parts)
            return [
                {"rows": rows, "table": table, "gain": gain, "feature": feature, "goes_left": goes_left, "left": -1}
                | ({"median": self.median(rows)} if medians else {})
                for table, rows, (gain, feature, goes_left) in zip(tables, parts, found)
            ]

        nodes, ends = nodes_of([self.counted()], [self.every]), [0]
        for _ in range(splits):
            best = max(ends, key=lambda k: (nodes[k]["gain"], -k))
            top = nodes[best]
            if top["gain"] <= 0:
                break
            rows, table = top.pop("rows"), top.pop("table")
            to_left = top["goes_left"].take(self.bins[top["feature"]].take(rows))
            left, right = rows.compress(to_left), rows.compress(~to_left)
            fewer = self.counted(left if len(left) <= len(right) else right)
            top["left"] = len(nodes)
            ends.remove(best)
            ends += [len(nodes), len(nodes) + 1]
            nodes += nodes_of((fewer, table - fewer) if len(left) <= len(right) else (table - fewer, fewer), (left, right))
        return nodes


def _subtree(wanted: Sequence[dict[int, int]], fits: Sequence[Fit], bins: dict[int, Bins], settings: Settings):
    """A small node's rows to the nodes that may hang below it, with their medians; the node itself is first."""

    def grow(i, node, parts):
        own, r = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])
        parts.clear()
        nodes = Held(own, r, bins[fits[i].before]).grow(wanted[i][node], settings, medians=True)
        for n in nodes:
            n.pop("rows", None), n.pop("table", None)
        return (i, node), nodes

    def run(pairs):
        groups: dict[tuple[int, int], list] = {}
        for key, part in pairs:
            groups.setdefault(key, []).append(part)
        for i, node in list(groups):
            yield grow(i, node, groups.pop((i, node)))

    return run


def _pieces(fits: Sequence[Fit]):
    """(fit, (bins, residuals)) of a block's rows for each fit."""

    def pick(block):
        cut, y = block
        for i, fit in enumerate(fits):
            own = cut[fit.before]
            for at in range(0, own.shape[1], PIECE):
                end = min(at + PIECE, own.shape[1])
                yield i, (own[:, at:end], y[at:end])

    return pick


def _boosted(fits: Sequence[Fit], bins: dict[int, Bins], settings: Settings):
    """All rounds of the fits whose rows have come to this task: (fit, first estimate, trees)."""

    def boost(fit, parts):
        own, r = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])
        parts.clear()
        first = round(Held.median(held := Held(own, r, bins[fit.before]), held.every))
        held.r -= first
        trees = []
        for _ in range(settings.rounds):
            held.sign()
            nodes = held.grow(fit.leaves - 1, settings, medians=False)
            tree = Tree.empty(len(nodes))
            for k, node in enumerate(nodes):
                if node["left"] >= 0:
                    tree.feature[k], tree.goes_left[k] = node["feature"], node["goes_left"]
                    tree.left[k], tree.right[k] = node["left"], node["left"] + 1
                else:
                    tree.value[k] = round(held.median(node["rows"]) * settings.step)
                    held.r[node["rows"]] -= tree.value[k]
            trees.append(compact(tree))
        return first, trees

    def run(pairs):
        held: dict[int, list] = {}
        for i, part in pairs:
            held.setdefault(i, []).append(part)
        for i in list(held):
            yield i, *boost(fits[i], held.pop(i))

    return run


def _whole(made: RDD, fits: Sequence[Fit], sizes: Sequence[int], bins: dict[int, Bins], settings: Settings) -> list[tuple[int, list[Tree]]]:
    """First estimate and trees of each fit, one task each, those with most to do first."""
    order = sorted(range(len(fits)), key=lambda i: (-sizes[i] * fits[i].leaves, i))
    task = {i: at for at, i in enumerate(order)}
    out: list[tuple[int, list[Tree]]] = [(0, [Tree.empty(1)] * settings.rounds) for _ in fits]
    rows = made.flatMap(_pieces(fits)).partitionBy(len(fits), lambda i: task[i])
    for i, first, trees in rows.mapPartitions(_boosted(fits, bins, settings)).collect():
        out[i] = (first, trees)
    return out


def _grown(state: RDD, fits: Sequence[Fit], grown: Sequence[Growth], bins: dict[int, Bins], settings: Settings) -> None:
    """Grow all small nodes of all fits to their end, dealt over tasks by their rows."""
    wanted = [g.small() for g in grown]
    sizes = sorted(((grown[i].nodes[k].n, i, k) for i, nodes in enumerate(wanted) for k in nodes), reverse=True)
    if not sizes:
        return
    tasks = min(len(sizes), max(state.getNumPartitions(), state.context.defaultParallelism))
    task = {(i, k): at % tasks for at, (_, i, k) in enumerate(sizes)}
    rows = state.flatMap(_rows_of([g.tree()[0] for g in grown], wanted, fits)).partitionBy(tasks, lambda key: task[key])
    for (i, node), found in rows.mapPartitions(_subtree(wanted, fits, bins, settings)).collect():
        grown[i].hang(node, found)


def _inside(trees: Sequence[Tree], sought: Sequence[list[tuple[int, int, int]]], fits: Sequence[Fit]):
    """Per fit: counts of residuals in the 2 ** DIGIT parts of each sought range (leaf, start, shift).

    Counts are (keys, n) with range * 2 ** DIGIT + part as key, only of parts that have rows.
    """

    def count(block):
        cut, y, scores = block
        out = []
        for fit, tree, ranges, score in zip(fits, trees, sought, scores):
            keys = [np.empty(0, np.int64)]
            of_node: dict[int, list[tuple[int, int, int]]] = {}
            for k, (node, start, shift) in enumerate(ranges):
                of_node.setdefault(node, []).append((k, start, shift))
            for node, rows in tree.reach(cut[fit.before], list(of_node)):
                r = y[rows] - score[rows]
                for k, start, shift in of_node[node]:
                    part = (r - start) >> shift
                    keys.append((k << DIGIT) + part[(part >= 0) & (part < 1 << DIGIT)])
            out.append(np.unique(np.concatenate(keys), return_counts=True))
        return out

    return count


def _added(a, b):
    """Both sums of counts, per fit: tables, or keys with counts."""
    out = []
    for p, q in zip(a, b):
        if isinstance(p, tuple):
            keys, place = np.unique(np.concatenate([p[0], q[0]]), return_inverse=True)
            out.append((keys, np.bincount(place, np.concatenate([p[1], q[1]]), len(keys)).astype(np.int64)))
        else:
            out.append(np.add(p, q, dtype=np.int64))
    return out


def _total(rdd: RDD, task: Callable):
    """The sum over all blocks; each partition adds up its own first."""

    def whole(parts):
        total = None
        for block in parts:
            made = task(block)
            total = made if total is None else _added(total, made)
        return [total] if total is not None else []

    made = rdd.mapPartitions(whole)
    n = rdd.getNumPartitions()
    if n > AT_ONCE:
        return made.treeReduce(_added, depth=max(2, math.ceil(math.log(n, AT_ONCE))))
    parts = made.collect()
    return functools.reduce(_added, parts)


# ---- growing -------------------------------------------------------------------------------


@dataclass
class Node:
    counts: np.ndarray | None  # as made by the tasks, none below a small node
    n: int
    left: int = -1
    right: int = -1
    gain: float = 0.0
    feature: int = -1
    goes_left: np.ndarray | None = None
    left_n: int = 0  # rows that go left
    median: float | None = None


def _padded(counts: np.ndarray, bins: Bins, features: Sequence[int]) -> tuple[np.ndarray, ...]:
    """Rows and gradients, node x feature x bin, and those of missing values, node x feature."""
    widest = max((bins.sizes[f] for f in features), default=1)
    held = np.zeros((len(counts), len(features), widest, 2))
    lost = np.zeros((len(counts), len(features), 2))
    for i, f in enumerate(features):
        n, start = bins.sizes[f], int(bins.starts[f])
        own = counts[:, 2 * start : 2 * (start + n + 1)].reshape(len(counts), n + 1, 2)
        held[:, i, :n], lost[:, i] = own[:, :n], own[:, n]
    n, lost_n = held.sum(axis=3), lost.sum(axis=2)
    return n, 2 * held[..., 1] - n, lost_n, 2 * lost[..., 1] - lost_n


def best_splits(counts: np.ndarray, bins: Bins, settings: Settings) -> list[tuple[float, int, np.ndarray | None]]:
    """(gain, feature, bins that go left) of each node of ``counts`` (node x counts as made by tasks); gain 0 if none."""
    n_numbers = len(bins.edges)
    n, g, lost_n, lost_g = _padded(counts, bins, range(n_numbers))
    cat_n, cat_g, cat_lost, cat_lost_g = _padded(counts, bins, range(n_numbers, len(bins.sizes)))
    every = n if n_numbers else cat_n  # every feature has every row
    total_n = (every[:, :1].sum(axis=2) + (lost_n if n_numbers else cat_lost)[:, :1])[:, :, None]
    total_g = ((g if n_numbers else cat_g)[:, :1].sum(axis=2) + (lost_g if n_numbers else cat_lost_g)[:, :1])[:, :, None]
    whole = total_g**2 / (total_n + settings.l2)

    def gains(left_n, left_g):
        right_n, right_g = total_n - left_n, total_g - left_g
        gain = left_g**2 / (left_n + settings.l2) + right_g**2 / (right_n + settings.l2) - whole
        return np.where((left_n >= settings.least) & (right_n >= settings.least), gain, -np.inf)

    upto_n, upto_g = n.cumsum(axis=2), g.cumsum(axis=2)
    # Categories with enough rows, by smoothed gradient; the others stay behind and go right.
    weak = cat_n < settings.support
    order = np.argsort(np.where(weak, np.inf, cat_g / (cat_n + settings.support)), axis=2, kind="stable")
    used = (~weak).sum(axis=2, keepdims=True)
    here = np.arange(cat_n.shape[2]) < used
    sort_n = np.where(here, np.take_along_axis(cat_n, order, 2), 0).cumsum(axis=2)
    sort_g = np.where(here, np.take_along_axis(cat_g, order, 2), 0).cumsum(axis=2)
    options = [
        gains(upto_n, upto_g),  # numbers, missing ones right
        None,  # missing ones left
        np.where(here, gains(sort_n, sort_g), -np.inf),  # the first categories left
        np.where(here, gains(sort_n[:, :, -1:] - sort_n, sort_g[:, :, -1:] - sort_g), -np.inf),  # the last ones left
    ]
    if lost_n.any():
        with_lost = gains(upto_n + lost_n[:, :, None], upto_g + lost_g[:, :, None])
        options[1] = np.where(lost_n[:, :, None] > 0, with_lost, -np.inf)
    out = []
    tops = np.array([o.reshape(len(o), -1).max(axis=1, initial=-np.inf) if o is not None else np.full(len(counts), -np.inf) for o in options])
    kinds = tops.argmax(axis=0)
    for i, kind in enumerate(kinds):
        if not tops[kind, i] > 0:
            out.append((0.0, -1, None))
            continue
        f, b = np.unravel_index(options[kind][i].argmax(), options[kind][i].shape)
        goes_left = np.zeros(BINS + 1, bool)
        if kind < 2:
            goes_left[: b + 1] = True
            own, lost, feature = n[i, f], lost_n[i, f], f
        else:
            by_gradient = order[i, f]
            goes_left[by_gradient[: b + 1] if kind == 2 else by_gradient[b + 1 : int(used[i, f, 0])]] = True
            own, lost, feature = cat_n[i, f], cat_lost[i, f], f + n_numbers
        # Missing values, where there were none, go with the larger side.
        larger = 2 * own[goes_left[: len(own)]].sum() > own.sum()
        goes_left[bins.sizes[feature]] = kind == 1 or (lost == 0 and larger)
        out.append((float(tops[kind, i]), int(feature), goes_left))
    return out


class Growth:
    """One fit's tree while it grows: nodes known so far, and which of them belong to the tree."""

    def __init__(self, root: np.ndarray, leaves: int):
        self.nodes, self.leaves, self.most, self.asked = [Node(root, int(root[-DIGITS:].sum()))], [0], leaves, []

    def hopeful(self) -> list[int]:
        """Nodes without children that may be split yet, by gain.

        Leaves of the tree with a larger gain come first, so a node that has as many of them
        before it as there are splits left will not be split.
        """
        rest = self.most - len(self.leaves)
        before = sorted((self.nodes[i].gain for i in self.leaves), reverse=True)
        bound = before[rest - 1] if 0 < rest <= len(before) else 0.0
        found = [i for i, n in enumerate(self.nodes) if n.left < 0 and n.gain > 0 and n.gain >= bound]
        return sorted(found, key=lambda i: (-self.nodes[i].gain, i)) if rest > 0 else []

    def ask(self) -> list[int]:
        """Large nodes whose children are to be counted, before it is known whether they belong to the tree."""
        self.asked = []
        if not self.commit():
            self.asked = [i for i in self.hopeful() if self.nodes[i].n > SMALL][: self.most]
        return self.asked

    def small(self) -> dict[int, int]:
        """Small nodes to be grown to their end, with the number of splits each may take.

        Leaves that will not be split are among them for their median.
        """
        ready, rest = self.commit(), self.most - len(self.leaves)
        found = set() if ready else {i for i in self.hopeful() if self.nodes[i].n <= SMALL}
        found |= {i for i in self.leaves if 0 < self.nodes[i].n <= SMALL and self.nodes[i].left < 0 and self.nodes[i].median is None}
        return {i: rest for i in sorted(found)}

    def hang(self, at: int, found: list[dict]) -> None:
        """Put what was grown below a small node in its place."""
        place = {0: at} | {k: len(self.nodes) + k - 1 for k in range(1, len(found))}
        self.nodes += [Node(None, 0) for _ in found[1:]]
        for k, f in enumerate(found):
            node = self.nodes[place[k]]
            node.gain, node.feature, node.goes_left, node.median = f["gain"], f["feature"], f["goes_left"], f["median"]
            if f["left"] >= 0:
                node.left, node.right = place[f["left"]], place[f["left"] + 1]

    def commit(self) -> bool:
        """Split leaves in order of gain as far as their children are counted; whether the tree is ready."""
        while len(self.leaves) < self.most:
            best = max(self.leaves, key=lambda i: (self.nodes[i].gain, -i))
            node = self.nodes[best]
            if node.gain <= 0:
                return True
            if node.left < 0:
                return False
            self.leaves.remove(best)
            self.leaves += [node.left, node.right]
        return True

    def grow(self, counts: np.ndarray) -> list[int]:
        """Add the asked nodes' children: the smaller ones as counted, the others as the difference."""
        new = []
        for i, fewer in zip(self.asked, counts):
            node = self.nodes[i]
            node.left, node.right = len(self.nodes), len(self.nodes) + 1
            pair = (fewer, node.counts - fewer) if 2 * node.left_n <= node.n else (node.counts - fewer, fewer)
            self.nodes += [Node(c, int(c[-DIGITS:].sum())) for c in pair]
            new += [node.left, node.right]
        return new

    def tree(self, ready: bool = False) -> tuple[Tree, list[int]]:
        """The nodes counted or asked for so far as a tree, and each asked node's child with fewer rows.

        A ready tree ends at its own leaves.
        """
        n = len(self.nodes)
        size = n + 2 * len(self.asked)
        tree = Tree.empty(size)
        ends = set(self.leaves) if ready else set()
        new = {i: n + 2 * k for k, i in enumerate(self.asked)}
        for i, node in enumerate(self.nodes):
            left = new.get(i, node.left)
            if left >= 0 and i not in ends:
                tree.feature[i], tree.goes_left[i], tree.left[i], tree.right[i] = node.feature, node.goes_left, left, left + 1
        return tree, [at if 2 * self.nodes[i].left_n <= self.nodes[i].n else at + 1 for i, at in new.items()]


def _place(counts: np.ndarray, rank: int) -> tuple[int, int]:
    """Which of the ordered counts holds the rank-th (from 0) row, and the rank within it."""
    upto = counts.cumsum()
    at = int(np.searchsorted(upto, rank, side="right"))
    return at, rank - int(upto[at] - counts[at])


def _medians(rdd: RDD, fits: Sequence[Fit], trees: Sequence[Tree], grown: Sequence[Growth]) -> None:
    """Give every leaf that has none its median residual, exact, in units."""
    open_ranks: dict[tuple[int, int, int], tuple[int, int, int]] = {}  # (fit, leaf, rank) -> (start, shift, rank inside)
    found: dict[tuple[int, int, int], int] = {}
    ranks: dict[tuple[int, int], tuple[int, int]] = {}
    for i, growth in enumerate(grown):
        for leaf in growth.leaves:
            if growth.nodes[leaf].median is not None:
                continue
            counts = growth.nodes[leaf].counts[-DIGITS:]
            n = int(counts.sum())
            ranks[i, leaf] = ((n - 1) // 2, n // 2) if n else (0, 0)
            for rank in set(ranks[i, leaf]) if n else ():
                digit, within = _place(counts, rank)
                start, shift = (digit - MIDDLE) << DIGIT, 0
                if digit in (0, DIGITS - 1):
                    shift = FAR - DIGIT
                    start = start + (1 << DIGIT) - (1 << FAR) if digit == 0 else start
                open_ranks[i, leaf, rank] = (start, shift, within)
            if not n:
                found[i, leaf, 0] = 0
    while open_ranks:
        sought = [sorted({(leaf, s, h) for (k, leaf, _), (s, h, _) in open_ranks.items() if k == i}) for i in range(len(fits))]
        parts = _total(rdd, _inside(trees, sought, fits))
        for key, (start, shift, rank) in list(open_ranks.items()):
            i, leaf, _ = key
            keys, counts = parts[i]
            first = sought[i].index((leaf, start, shift)) << DIGIT
            low, high = np.searchsorted(keys, (first, first + (1 << DIGIT)))
            at, within = _place(counts[low:high], rank)
            start += (int(keys[low + at]) - first) << shift
            if shift == 0:
                found[key] = start
                del open_ranks[key]
            else:
                open_ranks[key] = (start, max(0, shift - DIGIT), within)
    for (i, leaf), (low, high) in ranks.items():
        grown[i].nodes[leaf].median = (found[i, leaf, low] + found[i, leaf, high]) / 2


def fit(
    rows: DataFrame, day: str, target: Column, numbers: Sequence[str], categories: Sequence[str], fits: Sequence[Fit], settings: Settings
) -> dict[str, Boosted]:
    """All ``fits`` over ``rows``: whole-numbered ``day``, real ``target``, numbers and text categories.

    A fit without rows estimates 0. Rows without a target teach nothing.
    """
    use_checkpoints(rows.sparkSession)
    ends = sorted({f.before for f in fits})
    bins = fit_bins(rows.where(target.isNotNull()), day, numbers, categories, ends)
    models = [Boosted(bins[f.before], 0) for f in fits]
    n = rows.where(target.isNotNull()).agg(*[F.count_if(F.col(day).cast("int") < e).alias(f"n{e}") for e in ends]).first()
    sizes = [n[f"n{f.before}"] for f in fits]
    if max(sizes) == 0:
        return {f.name: m for f, m in zip(fits, models)}

    def made(some: Sequence[int]) -> RDD:
        own = [fits[i] for i in some]
        return blocks(rows, day, target, numbers, categories, {f.before: bins[f.before] for f in own}, own, max(sizes[i] for i in some))

    whole, large = ([i for i, size in enumerate(sizes) if (size <= WHOLE) == small] for small in (True, False))
    if whole:
        for i, (first, trees) in zip(whole, _whole(made(whole), [fits[i] for i in whole], [sizes[i] for i in whole], bins, settings)):
            models[i].first, models[i].trees = first, trees
    if large:
        _rounds(made(large), [fits[i] for i in large], [models[i] for i in large], bins, settings)
    return {f.name: m for f, m in zip(fits, models)}


def _rounds(made: RDD, fits: Sequence[Fit], models: Sequence[Boosted], bins: dict[int, Bins], settings: Settings) -> None:
    """Fill the models, a few jobs a round over all of their rows."""
    bins = {f.before: bins[f.before] for f in fits}
    state = made.map(_scored(fits)).persist(StorageLevel.MEMORY_AND_DISK)
    waiting: list[Tree] = []
    for done in range(settings.rounds + 1):
        if done:
            before, state = state, state.map(_updated(waiting, fits)).persist(StorageLevel.MEMORY_AND_DISK)
            if done % KEPT_ROUNDS == 0:
                state.checkpoint()
        single = Tree.empty(1)
        roots = _total(state, _counts([single] * len(fits), [[0]] * len(fits), fits, bins))
        if done:
            before.unpersist()
        # The first estimate is the median of all rows: a tree that never splits.
        grown = [Growth(r[0], f.leaves if done else 1) for f, r in zip(fits, roots)]
        _choose([(g, [0]) for g in grown], fits, bins, settings)
        while not all([g.commit() for g in grown]):
            while any([g.ask() for g in grown]):
                made = [g.tree() for g in grown]
                counts = _total(state, _counts([t for t, _ in made], [s for _, s in made], fits, bins))
                _choose([(g, g.grow(c)) for g, c in zip(grown, counts)], fits, bins, settings)
            _grown(state, fits, grown, bins, settings)
        trees = [g.tree(ready=True)[0] for g in grown]
        _medians(state, fits, trees, grown)
        for tree, growth, model in zip(trees, grown, models):
            for leaf in growth.leaves:
                tree.value[leaf] = round(growth.nodes[leaf].median * (settings.step if done else 1))
            if done:
                model.trees.append(compact(tree))
            else:
                model.first = int(tree.value[0])
        waiting = trees
    state.unpersist()


def _choose(new: Sequence[tuple[Growth, list[int]]], fits: Sequence[Fit], bins: dict[int, Bins], settings: Settings) -> None:
    """Find the best split of all new nodes, those of one training period at once."""
    for e, own in bins.items():
        nodes = [g.nodes[i] for f, (g, at) in zip(fits, new) for i in at if f.before == e and g.most > 1]
        if nodes:
            for node, split in zip(nodes, best_splits(np.stack([n.counts for n in nodes]), own, settings)):
                node.gain, node.feature, node.goes_left = split
                if node.feature >= 0:
                    low, high = 2 * own.starts[node.feature : node.feature + 2]
                    held = node.counts[low:high].reshape(-1, 2).sum(axis=1)
                    node.left_n = int(held[node.goes_left[: len(held)]].sum())


def compact(tree: Tree) -> Tree:
    """The tree without nodes that no row reaches."""
    order, new = [0], {}
    for i in order:
        new[i] = len(new)
        if tree.feature[i] >= 0:
            order += [int(tree.left[i]), int(tree.right[i])]
    at = np.array(order)
    step = np.array([new.get(i, 0) for i in range(len(tree.feature))], np.int32)
    return Tree(tree.feature[at], tree.goes_left[at], step[tree.left[at]], step[tree.right[at]], tree.value[at])
