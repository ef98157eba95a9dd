"""The forest against plain recursion over the same draws, however rows and jobs are cut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagline.operators import forest as O

SETTINGS = O.Settings(trees=5, depth=6, leaf=8, seed=42)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 2500
    a, b, x = rng.integers(0, 6, n), rng.integers(0, 4, n), rng.integers(0, 50, n)
    y = np.round((a == 2) * 40 + (x > 20) * 25 - (b == 1) * (x > 40) * 60 + rng.normal(size=n) * 9)
    rows = [tuple(map(float, r)) for r in zip(a, b, x, y)]
    return spark.createDataFrame(rows, "a double, b double, x double, y double").repartition(5)


def layout_of(frame):
    return O.Layout((6, 3), O.fit_edges(frame, ["x"]))  # the last code of b is an unknown value


def estimates(frame, rows):
    model = O.fit(frame, "y", 10.0, layout_of(frame), ["a", "b"], ["x"], SETTINGS)
    found = model.predict(rows).select("a", "b", "x", "estimate").distinct().collect()
    return {tuple(r[:3]): r[3] for r in found}, model


def plain(frame):
    layout = layout_of(frame)
    pairs = sorted((r.cell, r.y) for r in O.coded(frame, layout, ["a", "b"], ["x"]).collect())
    batch = pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs]) for i in range(2)], names=["cell", "y"])
    (block,) = O._blocks(SETTINGS, 10.0)([batch])
    cells, times, sums = O._arrays(block, 0, np.int64, np.int64, np.float64)
    codes, (field, code) = layout.codes(cells), layout.columns
    total = np.zeros(len(cells))

    def split(tree, node, rows, w, s):
        best = (O.EPSILON, None)
        if node < 1 << SETTINGS.depth:
            for c in O.looked_at(tree, np.array([node]), layout, SETTINGS.seed)[0]:
                own = codes[field[c], rows] if code[c] < 0 else codes[field[c], rows] == code[c]
                for cut in range(int(own.max())):
                    left = own <= cut
                    n, m = w[rows[left]].sum(), w[rows[~left]].sum()
                    if min(n, m) >= SETTINGS.leaf:
                        gain = s[rows[left]].sum() ** 2 / n + s[rows[~left]].sum() ** 2 / m - s[rows].sum() ** 2 / (n + m)
                        best = max(best, (gain, left), key=lambda o: o[0])
        if best[1] is None:
            drawn = w[rows].sum()
            total[rows] += 10 + s[rows].sum() / drawn
        else:
            split(tree, 2 * node, rows[best[1]], w, s)
            split(tree, 2 * node + 1, rows[~best[1]], w, s)

    for tree in range(SETTINGS.trees):
        w, s = times.reshape(SETTINGS.trees, -1)[tree], sums.reshape(SETTINGS.trees, -1)[tree]
        split(tree, 1, np.arange(len(cells)), w, s)
    return dict(zip(cells.tolist(), total / SETTINGS.trees))


def test_equals_plain_recursion(frame):
    want = plain(frame)
    asked = O.coded(frame, layout_of(frame), ["a", "b"], ["x"])
    got, model = estimates(frame, frame)
    assert len(want) > 200
    for r in asked.select("a", "b", "x", "cell").distinct().collect():
        assert got[r.a, r.b, r.x] == pytest.approx(want[r.cell])
    assert model.importances.sum() == pytest.approx(1.0) and (model.importances >= 0).all()


def test_same_trees_however_cut(spark, frame, monkeypatch):
    want, model = estimates(frame, frame)
    monkeypatch.setattr(O, "SMALL", 60)
    monkeypatch.setattr(O, "BLOCK_CELLS", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got, cut = estimates(frame.repartition(3), frame)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert any(cut.tops)  # some nodes were split before their cells met
    assert got == pytest.approx(want)
    assert np.allclose(cut.importances, model.importances)


def test_trees_read_cells_not_rows(frame):
    many = frame.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    layout = layout_of(frame)

    def read(rows):
        pairs = O.coded(rows, layout, ["a", "b"], ["x"]).select("cell", "y").repartition("cell").sortWithinPartitions("cell", "y")
        blocks = pairs.mapInArrow(O._blocks(SETTINGS, 10.0), O.BLOCK).collect()
        drawn = sum(np.frombuffer(b.times, np.int64).sum() for b in blocks)
        return sum(len(b.cells) // 8 for b in blocks), drawn / SETTINGS.trees

    (few, once), (same, often) = read(frame), read(many)
    assert few == same == O.coded(frame, layout, ["a", "b"], ["x"]).select("cell").distinct().count()
    assert once == pytest.approx(2500, rel=0.05) and often == pytest.approx(50000, rel=0.02)


def test_a_constant_number_and_an_empty_question(frame):
    flat = frame.withColumn("x", F.lit(3.0))
    got, _ = estimates(flat, flat)
    assert len(got) == 24
    assert estimates(flat, flat.where("a < 0"))[0] == {}
