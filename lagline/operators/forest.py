"""Random forest for squared error over coded predictors.

Rows with equal codes can't be told apart by any tree, so each tree needs only their bootstrap
count and sum. Rows are brought together by cell (all codes in one number) once; every row is
drawn a Poisson number of times per tree, as Spark ML's forests do, from its cell and its place in
it. The rest reads cells, whose number is bounded by the codes and not by the rows.

Columns are those of the one-hot vector: a category's value or a number in at most ``BINS`` bins;
a node looks at a random part of them. Nodes with more than ``SMALL`` cells are split by Spark's
sums over all cells, the others are brought together, one bounded group each, and grown to their
end by one task, level by level. Trees stay a table; only importances come to the driver. Draws depend on tree and node alone and
whole targets have exact sums, so neither partitions nor ``SMALL`` change a tree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from lagline.sources.work import materialize

BINS = 32  # of a number
SMALL = 1 << 21  # cells of a node that one task may hold, some 60 bytes each
BLOCK_CELLS, QUESTION_CELLS = 1 << 14, 1 << 18
EPSILON = 1e-6  # gains at or below it are rounding

BLOCK = "cells binary, times binary, sums binary"
PART = "tree int, node long, cells binary, times binary, sums binary"
GROWN = "tree int, node long, column binary, upto binary, left binary, value binary, gain binary"


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    leaf: int
    seed: int
    rate: float = 1.0  # draws per row and tree


@dataclass(frozen=True)
class Layout:
    """Labels per category and edges per number; a category's last code is for unknown values."""

    labels: tuple[int, ...]
    edges: tuple[tuple[float, ...], ...]

    @property
    def sizes(self) -> list[int]:
        return [n + 1 for n in self.labels] + [len(e) + 1 for e in self.edges]

    @property
    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """Per column its field, and the code it stands for or -1 for a number."""
        field = [i for i, n in enumerate(self.labels) for _ in range(n)] + [len(self.labels) + i for i in range(len(self.edges))]
        code = [k for n in self.labels for k in range(n)] + [-1] * len(self.edges)
        return np.array(field, np.int32), np.array(code, np.int32)

    def cell(self, codes: Sequence[Column]) -> Column:
        """All codes of a row in one number."""
        if math.prod(self.sizes) >= 1 << 62:
            raise ValueError("the predictors have too many codes for one number")
        total = F.lit(0).cast("long")
        for code, size in zip(codes, self.sizes, strict=True):
            total = total * F.lit(size).cast("long") + code.cast("long")
        return total

    def codes(self, cells: np.ndarray) -> np.ndarray:
        """Codes, field x cell."""
        out = np.empty((len(self.sizes), len(cells)), np.int32)
        for i in range(len(self.sizes) - 1, -1, -1):
            cells, out[i] = np.divmod(cells, self.sizes[i])
        return out


def fit_edges(rows: DataFrame, numbers: Sequence[str]) -> tuple[tuple[float, ...], ...]:
    """Edges of at most ``BINS`` bins: between any two neighbours, or of equal parts of the rows."""
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in numbers]
    counts = rows.select(F.inline(F.array(*cells))).where("x IS NOT NULL").groupBy("field", "x").agg(F.count(F.lit(1)).alias("n"))
    # Windows over value counts: as many rows as a field has values.
    ranked = counts.selectExpr(
        "*",
        "count(1) OVER (PARTITION BY field) AS n_values",
        "sum(n) OVER (PARTITION BY field) AS total",
        "sum(n) OVER (PARTITION BY field ORDER BY x ROWS UNBOUNDED PRECEDING) AS upto",
        "lead(x) OVER (PARTITION BY field ORDER BY x) AS following",
    )
    crosses = f"(upto * {BINS}) div total > ((upto - n) * {BINS}) div total"
    wanted = ranked.where(f"following IS NOT NULL AND (n_values <= {BINS} OR {crosses})")
    found: dict[str, list[float]] = {c: [] for c in numbers}
    for r in wanted.select("field", F.expr("(x + following) / 2").alias("edge")).collect():
        found[r.field].append(r.edge)
    return tuple(tuple(sorted(found[c])) for c in numbers)


def coded(rows: DataFrame, layout: Layout, categories: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """``rows`` with ``cell``. ``categories`` are columns of indexes; a missing number is refused, as by a vector."""
    for c, edges in zip(numbers, layout.edges, strict=True):
        rows = rows.withColumn(f"__number_{c}", F.col(c).cast("double"))
        rows = Bucketizer(
            splits=[-math.inf, *(edges or (0.0,)), math.inf], inputCol=f"__number_{c}", outputCol=f"__bin_{c}", handleInvalid="error"
        ).transform(rows)
    bins = [F.col(f"__bin_{c}") if e else F.col(f"__bin_{c}") * 0 for c, e in zip(numbers, layout.edges)]
    made = [f"__{kind}_{c}" for c in numbers for kind in ("number", "bin")]
    return rows.withColumn("cell", layout.cell([*map(F.col, categories), *bins])).drop(*made)


# ---- draws -----------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson(rate: float) -> np.ndarray:
    """Draws by 16 random bits."""
    chance, total, k, upto = math.exp(-rate), 0.0, 0, []
    while total < 1 - 1e-9 and k < 255:
        total += chance
        upto.append(total)
        k += 1
        chance *= rate / k
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _blocks(settings: Settings, centre: float):
    """(cell, y) in order of both to blocks of cells with their draws and drawn sums per tree."""
    table = _poisson(settings.rate)
    words = -(-settings.trees // 4)
    salts = _mixed(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(settings.seed))

    def drawn(cells, places):
        base = _mixed(cells.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + places.astype(np.uint64))
        bits = _mixed(base[:, None] ^ salts[None, :]).view(np.uint16)
        return table[bits[:, : settings.trees]]

    def packed(cells, times, sums):
        return pa.RecordBatch.from_pydict({
            "cells": [np.concatenate(cells).tobytes()],
            "times": [np.ascontiguousarray(np.concatenate(times).T.astype(np.int64)).tobytes()],
            "sums": [np.ascontiguousarray(np.concatenate(sums).T).tobytes()],
        })

    def run(batches):
        cells, times, sums, held = [], [], [], 0
        last, seen = None, 0  # the cell that may go on in the next batch, and its rows so far
        for batch in batches:
            cell, y = batch.column(0).to_numpy(), batch.column(1).to_numpy() - centre
            if not len(cell):
                continue
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            size = np.diff(np.r_[start, len(cell)])
            place = np.arange(len(cell)) - np.repeat(start, size)
            goes_on = last is not None and cell[0] == last
            if goes_on:
                place[: size[0]] += seen
            w = drawn(cell, place)
            n = np.add.reduceat(w, start, axis=0, dtype=np.int64)
            s = np.add.reduceat(w * y[:, None], start, axis=0)
            seen = int(size[-1]) + (seen if goes_on and len(start) == 1 else 0)
            last, own = cell[-1], cell[start]
            if goes_on:
                times[-1][-1] += n[0]
                sums[-1][-1] += s[0]
                own, n, s = own[1:], n[1:], s[1:]
            elif held >= BLOCK_CELLS:
                yield packed(cells, times, sums)
                cells, times, sums, held = [], [], [], 0
            if len(own):
                cells.append(own)
                times.append(n)
                sums.append(s)
                held += len(own)
        if held:
            yield packed(cells, times, sums)

    return run


# ---- growing ---------------------------------------------------------------------------------


def looked_at(tree: int, nodes: np.ndarray, layout: Layout, seed: int) -> np.ndarray:
    """Different columns, the square root of their number, that each node may split by: node x place, ascending."""
    width = len(layout.columns[0])
    wanted = math.ceil(math.sqrt(width))
    base = _mixed(nodes.astype(np.uint64) + _mixed(np.array([(tree << 20) + seed], np.uint64)))
    out = np.full((len(nodes), wanted), -1, np.int64)
    salts = _mixed(np.arange(1, wanted + 1, dtype=np.uint64))
    for k, top in enumerate(range(width - wanted, width)):  # Floyd's sampling without repetition
        drawn = (_mixed(base ^ salts[k]) % np.uint64(top + 1)).astype(np.int64)
        out[:, k] = np.where((out[:, :k] == drawn[:, None]).any(axis=1), top, drawn)
    return np.sort(out, axis=1)


def bin_of(codes: np.ndarray, column: np.ndarray, layout: Layout) -> np.ndarray:
    """Of each cell its bin in its own column: whether it has the value, or the number's bin."""
    field, code = layout.columns
    own, value = codes[field[column], np.arange(codes.shape[1])], code[column]
    return np.where(value < 0, own, own == value)


def sums_of(codes, times, sums, at, column, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Draws and drawn sums of nodes by the bin of each node's column, node x bin."""
    width = max([2, *(len(e) + 1 for e in layout.edges)])
    key = at * width + bin_of(codes, column[at], layout)
    shape = (len(column), width)
    return (np.bincount(key, w, shape[0] * width).reshape(shape) for w in (times, sums))


def best_cut(n: np.ndarray, s: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node the largest gain and the last bin of its left side."""
    left_n, left_s = np.cumsum(n, axis=1), np.cumsum(s, axis=1)
    all_n, all_s = left_n[:, -1:], left_s[:, -1:]
    right_n, right_s = all_n - left_n, all_s - left_s
    gain = left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1) - all_s**2 / np.maximum(all_n, 1)
    gain[(left_n < leaf) | (right_n < leaf)] = -1
    upto = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), upto], upto


def grow(tree: int, root: int, codes, times, sums, layout: Layout, settings: Settings, centre: float):
    """The nodes from ``root`` down: column (-1 in a leaf), last bin of the left side, left child (the right follows), value, gain.

    Nodes are numbered as in a heap, from 1.
    """
    nodes, at = np.array([root], np.int64), np.zeros(codes.shape[1], np.int64)
    out, made = [], 1
    numeric = layout.columns[1] < 0
    flat = Layout(layout.labels, ((),) * len(layout.edges))  # two bins are enough for values
    while len(nodes):
        n, s = np.bincount(at, times, len(nodes)), np.bincount(at, sums, len(nodes))
        column, upto, gain = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes), np.int32), np.full(len(nodes), EPSILON)
        open_ = (n >= 2 * settings.leaf) & (nodes < 1 << settings.depth)
        inside = np.flatnonzero(open_[at])
        spot = np.flatnonzero(open_)
        rank = np.cumsum(open_) - 1
        own, w, y, place = codes[:, inside], times[inside], sums[inside], rank[at[inside]]
        choices = looked_at(tree, nodes[spot], layout, settings.seed)
        for choice in choices.T if len(spot) else ():
            for kind, form in ((True, layout), (False, flat)):
                those = numeric[choice] == kind
                if not those.any():
                    continue
                part = slice(None) if those.all() else np.flatnonzero(those[place])
                here = (np.cumsum(those) - 1)[place[part]]
                g, u = best_cut(*sums_of(own[:, part], w[part], y[part], here, choice[those], form), settings.leaf)
                target = spot[those]
                better = g > gain[target]
                gain[target[better]], upto[target[better]], column[target[better]] = g[better], u[better], choice[those][better]
        split = column >= 0
        gain[~split] = 0
        order = np.cumsum(split) - 1
        out.append((column, upto, np.where(split, made + 2 * order, -1).astype(np.int32), centre + s / np.maximum(n, 1), gain))
        made += 2 * int(split.sum())
        keep = np.flatnonzero(split[at])
        codes, times, sums, at = codes[:, keep], times[keep], sums[keep], at[keep]
        right = bin_of(codes, column[at], layout) > upto[at]
        at = 2 * order[at] + right
        nodes = (2 * nodes[split][:, None] + np.arange(2)).ravel()
    return [np.concatenate(part) for part in zip(*out)]


def routed(codes: np.ndarray, tops: dict[int, tuple[int, int]], layout: Layout) -> np.ndarray:
    """The node below the splits of ``tops`` that each cell comes to."""
    node = np.ones(codes.shape[1], np.int64)
    for k in sorted(tops):
        rows = np.flatnonzero(node == k)
        column, upto = tops[k]
        node[rows] = 2 * k + (bin_of(codes[:, rows], np.full(len(rows), column), layout) > upto)
    return node


def _arrays(batch, i, *kinds):
    return [np.frombuffer(batch.column(j)[i].as_py(), kind) for j, kind in enumerate(kinds, batch.num_columns - len(kinds))]


def _trees_of(batch, i, layout, settings, tops):
    """(tree, codes, cells, draws, sums, nodes) of a block, cells that were drawn only."""
    cells, times, sums = _arrays(batch, i, np.int64, np.int64, np.float64)
    codes = layout.codes(cells)
    for tree, (w, s) in enumerate(zip(times.reshape(settings.trees, -1), sums.reshape(settings.trees, -1))):
        drawn = np.flatnonzero(w)
        own = codes[:, drawn]
        yield tree, own, cells[drawn], w[drawn], s[drawn], routed(own, tops[tree], layout)


def _top_splits(blocks: DataFrame, layout: Layout, settings: Settings, centre: float):
    """Splits of the nodes over more than ``SMALL`` cells, and the values of those that stay leaves."""
    tops: list[dict[int, tuple[int, int]]] = [{} for _ in range(settings.trees)]
    gains: list[dict[int, float]] = [{} for _ in range(settings.trees)]
    leaves: dict[tuple[int, int], float] = {}

    def sizes(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for tree, _, _, w, s, node in _trees_of(batch, i, layout, settings, tops):
                    ids, at = np.unique(node, return_inverse=True)
                    columns = [np.full(len(ids), tree, np.int32), ids, *(np.bincount(at, x, len(ids)) for x in (None, w, s))]
                    names = ["tree", "node", "cells", "n", "s"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 2, *[pa.float64()] * 2))], names=names)

    def tables(wanted):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    for tree, own, _, w, s, node in _trees_of(batch, i, layout, settings, tops):
                        for k in wanted.get(tree, ()):
                            rows = np.flatnonzero(node == k)
                            for column in looked_at(tree, np.array([k]), layout, settings.seed)[0] if len(rows) else ():
                                n, y = sums_of(own[:, rows], w[rows], s[rows], np.zeros(len(rows), np.int64), np.array([column]), layout)
                                bins = np.flatnonzero(n[0])
                                parts = [np.full(len(bins), v) for v in (tree, k, column)]
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(c, t) for c, t in zip([*parts, bins, n[0][bins], y[0][bins]], (pa.int32(), *[pa.int64()] * 3, *[pa.float64()] * 2))],
                                    names=["tree", "node", "column", "bin", "n", "s"],
                                )

        return run

    while True:
        counted = blocks.mapInArrow(sizes, "tree int, node long, cells long, n double, s double").groupBy("tree", "node")
        large = counted.agg(F.sum("cells").alias("cells"), F.sum("n").alias("n"), F.sum("s").alias("s")).where(F.col("cells") > SMALL).collect()
        large = [r for r in large if (r.tree, r.node) not in leaves]
        for r in large:  # until it is split
            leaves[r.tree, r.node] = centre + r.s / r.n
        wanted: dict[int, list[int]] = {}
        for r in large:
            if r.n >= 2 * settings.leaf and r.node < 1 << settings.depth:
                wanted.setdefault(r.tree, []).append(r.node)
        if not wanted:
            return tops, gains, leaves
        width = max([2, *(len(e) + 1 for e in layout.edges)])
        found: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        summed = blocks.mapInArrow(tables(wanted), "tree int, node long, column long, bin long, n double, s double")
        for r in summed.groupBy("tree", "node", "column", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
            n, s = found.setdefault((r.tree, r.node, r.column), (np.zeros((1, width)), np.zeros((1, width))))
            n[0, r.bin], s[0, r.bin] = r.n, r.s
        best: dict[tuple[int, int], float] = {}
        for tree, node, column in sorted(found):
            gain, upto = best_cut(*found[tree, node, column], settings.leaf)
            if gain[0] > best.get((tree, node), EPSILON):
                best[tree, node] = float(gain[0])
                tops[tree][node], gains[tree][node] = (column, int(upto[0])), float(gain[0])
        for key in best:
            del leaves[key]


def _parts(layout, settings, tops, leaves):
    """Blocks to (tree, node) with the node's cells, for nodes that are still to be grown."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for tree, _, cells, w, s, node in _trees_of(batch, i, layout, settings, tops):
                    for k in np.unique(node).tolist():
                        if (tree, k) not in leaves:
                            rows = slice(None) if not tops[tree] else np.flatnonzero(node == k)
                            yield pa.RecordBatch.from_pydict(
                                {"tree": pa.array([tree], pa.int32()), "node": [k], **{c: [x[rows].tobytes()] for c, x in zip(("cells", "times", "sums"), (cells, w, s))}}
                            )

    return run


def _grown(layout, settings, centre):
    def run(key, table):
        tree, node = (k.as_py() for k in key)
        cells, times, sums = (
            np.concatenate([np.frombuffer(b.as_py(), t) for b in table.column(c)])
            for c, t in (("cells", np.int64), ("times", np.int64), ("sums", np.float64))
        )
        order = np.argsort(cells)
        column, upto, left, value, gain = grow(tree, node, layout.codes(cells[order]), times[order], sums[order], layout, settings, centre)
        weight = np.bincount(column[column >= 0], gain[column >= 0], len(layout.columns[0]))
        return pa.table({
            "tree": pa.array([tree], pa.int32()), "node": [node],
            **{c: [x.tobytes()] for c, x in zip(("column", "upto", "left", "value", "gain"), (column, upto.astype(np.int32), left, value, weight))},
        })

    return run


@dataclass
class Forest:
    """A fitted forest: layout, the splits above the grown nodes, and a table of those."""

    layout: Layout
    settings: Settings
    categories: list[str]
    numbers: list[str]
    tops: list[dict[int, tuple[int, int]]]
    leaves: dict[tuple[int, int], float]
    grown: DataFrame
    importances: np.ndarray

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``estimate``: cells are asked once, block by block in every tree."""
        layout, tops, leaves, settings = self.layout, self.tops, self.leaves, self.settings
        asked = coded(rows, layout, self.categories, self.numbers)
        blocks = asked.select("cell").distinct().mapInArrow(_questions, "cells binary")
        pairs = blocks.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(settings.trees - 1))))

        def above(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    cells, tree = np.frombuffer(batch.column(0)[i].as_py(), np.int64), batch.column(1)[i].as_py()
                    node = routed(layout.codes(cells), tops[tree], layout)
                    for (t, k), value in leaves.items():
                        own = cells[node == k] if t == tree else ()
                        if len(own):
                            yield _answers(own, np.full(len(own), value))

        def below(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    tree, node = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                    cells = np.frombuffer(batch.column(0)[i].as_py(), np.int64)
                    column, upto, left, value = _arrays(batch, i, np.int32, np.int32, np.int32, np.float64)
                    codes = layout.codes(cells)
                    own = np.flatnonzero(routed(codes, tops[tree], layout) == node)
                    codes, at = codes[:, own], np.zeros(len(own), np.int64)
                    moving = np.flatnonzero(column[at] >= 0)
                    while len(moving):
                        here = at[moving]
                        at[moving] = left[here] + (bin_of(codes[:, moving], column[here], layout) > upto[here])
                        moving = moving[column[at[moving]] >= 0]
                    yield _answers(cells[own], value[at])

        tasks = 2 * settings.trees
        trees = self.grown.select("tree", "node", "column", "upto", "left", "value").repartition(tasks, "tree")
        met = pairs.repartition(tasks, "tree").join(trees, "tree").select("cells", "tree", "node", "column", "upto", "left", "value")
        answers = met.mapInArrow(below, "cell long, value double")
        if leaves:
            answers = answers.union(pairs.mapInArrow(above, "cell long, value double"))
        means = answers.groupBy("cell").agg((F.sum("value") / settings.trees).alias("estimate"))
        return asked.join(means, "cell").drop("cell")


def _answers(cells, values):
    return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(values, pa.float64())], names=["cell", "value"])


def _questions(batches):
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy())
        n += batch.num_rows
        if n >= QUESTION_CELLS:
            yield pa.RecordBatch.from_pydict({"cells": [np.concatenate(held).tobytes()]})
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_pydict({"cells": [np.concatenate(held).tobytes()]})


def fit(rows: DataFrame, target: str, centre: float, layout: Layout, categories: Sequence[str], numbers: Sequence[str], settings: Settings) -> Forest:
    """A forest on ``rows``, whose ``categories`` are columns of indexes. ``centre`` is a whole number near the mean target."""
    pairs = coded(rows, layout, categories, numbers).select("cell", F.col(target).cast("double").alias("y"))
    blocks = pairs.repartition("cell").sortWithinPartitions("cell", "y").mapInArrow(_blocks(settings, centre), BLOCK)
    blocks = materialize(blocks, "forest-cells")
    tops, gains, leaves = _top_splits(blocks, layout, settings, centre)
    parts = blocks.mapInArrow(_parts(layout, settings, tops, leaves), PART).repartition(2 * settings.trees, "tree", "node")
    grown = materialize(parts.groupBy("tree", "node").applyInArrow(_grown(layout, settings, centre), GROWN), "forest")
    # Of every tree the gain per column as parts of one, then the mean of the trees.
    weights = np.zeros((settings.trees, len(layout.columns[0])))
    for r in grown.select("tree", "gain").toLocalIterator():
        weights[r.tree] += np.frombuffer(r.gain, np.float64)
    for tree, own in enumerate(gains):
        for node, gain in own.items():
            weights[tree, tops[tree][node][0]] += gain
    weights /= np.maximum(weights.sum(axis=1, keepdims=True), EPSILON)
    importances = weights.sum(axis=0) / max(weights.sum(), EPSILON)
    return Forest(layout, settings, list(categories), list(numbers), tops, leaves, grown, importances)
