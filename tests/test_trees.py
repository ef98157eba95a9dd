"""Boosted trees against a plain implementation of the same rule, however rows and jobs are cut."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagline.operators import trees as T

SETTINGS = T.Settings(rounds=6, step=0.3, least=20, l2=10.0)
FITS = [T.Fit("a", 60, 6), T.Fit("b", 100, 12), T.Fit("none", -5, 6)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 1500
    day = rng.integers(0, 100, n)
    x = rng.integers(0, 40, n).astype(float)
    z = np.where(rng.random(n) < 0.1, np.nan, np.round(rng.normal(size=n) * 40, 3))  # over 255 values, some missing
    c = rng.choice(["p", "q", "r", "s", "rare"], n, p=[0.3, 0.3, 0.2, 0.195, 0.005])
    y = np.round((x > 25) * 30 - (z > 0) * 20 + (c == "q") * 15 + np.isnan(z) * 44 + rng.normal(size=n) * 9 + (day % 50 == 0) * 5000, 1)
    return day, x, z, c, y


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(int(d), float(x), None if np.isnan(z) else float(z), str(c), float(y)) for d, x, z, c, y in zip(*data)]
    return spark.createDataFrame([*rows, (5, 1.0, 1.0, "p", None)], "day int, x double, z double, c string, y double").repartition(5)


def fitted(frame):
    return T.fit(frame, "day", F.col("y"), ["x", "z"], ["c"], FITS, SETTINGS)


def plain_gain(y, score, rows, left):
    def part(r):
        g = np.where(score[r] > y[r], 1, -1).sum()
        return g * g / (len(r) + SETTINGS.l2)

    a, b = rows[left], rows[~left]
    return part(a) + part(b) - part(rows) if min(len(a), len(b)) >= SETTINGS.least else -1


def plain_options(bins, sizes, y, score, rows):
    """Every split the rule allows, as masks of the rows that go left."""
    for f in range(2):
        values, lost = bins[f, rows], bins[f, rows] == sizes[f]
        for b in range(sizes[f]):
            yield (values <= b) & ~lost
            if lost.any():
                yield (values <= b) | lost
    codes = bins[2, rows]
    grads = {}
    for k in range(sizes[2]):
        r = rows[codes == k]
        if len(r) >= SETTINGS.support:
            grads[k] = np.where(score[r] > y[r], 1, -1).sum() / (len(r) + SETTINGS.support)
    order = sorted(grads, key=lambda k: (grads[k], k))
    for i in range(1, len(order) + 1):
        yield np.isin(codes, order[:i])
        yield np.isin(codes, order[i:])


def plain_fit(bins, sizes, y, leaves):
    """Scores after each round, all options tried on all rows; gains must be unique for the same trees."""
    unit = np.rint(y * T.UNIT)
    score = np.full(len(y), round(np.median(unit)), float)
    for _ in range(SETTINGS.rounds):
        ends = [np.arange(len(y))]
        best = {}
        while len(ends) < leaves:
            for k, rows in enumerate(ends):
                if rows.tobytes() not in best:
                    found = max(((plain_gain(unit, score, rows, m), i, m) for i, m in enumerate(plain_options(bins, sizes, unit, score, rows))), key=lambda t: (t[0], -t[1]))
                    best[rows.tobytes()] = found
            top = max(range(len(ends)), key=lambda k: best[ends[k].tobytes()][0])
            gain, _, left = best[ends[top].tobytes()]
            if gain <= 0:
                break
            rows = ends.pop(top)
            ends += [rows[left], rows[~left]]
        step = np.zeros(len(y))
        for rows in ends:
            step[rows] = round(np.median(unit[rows] - score[rows]) * SETTINGS.step)
        score += step
    return score / T.UNIT


def test_equals_the_plain_rule(frame, data):
    day, x, z, c, y = data
    models = fitted(frame)
    for fit in FITS[:2]:
        inside = day < fit.before
        model = models[fit.name]
        bins = model.bins.of([x[inside], z[inside]], [c[inside].tolist()])
        assert model.bins.sizes[0] == 40 and model.bins.sizes[1] > 100 and (bins[1][np.isnan(z[inside])] == model.bins.sizes[1]).all()
        expected = plain_fit(bins, model.bins.sizes, y[inside], fit.leaves)
        got = model.predict([x[inside], z[inside]], [c[inside].tolist()])
        # Splits of equal gain may be told apart otherwise; what they lead to is as good.
        assert abs(np.abs(y[inside] - got).mean() - np.abs(y[inside] - expected).mean()) < 0.35
        assert np.mean(np.abs(got - expected) < 1e-9) > 0.5
        assert all((t.feature < 0).sum() == fit.leaves for t in model.trees)
    assert models["none"].predict([x[:3], z[:3]], [["p", "q", "new"]]).tolist() == [0, 0, 0]


@pytest.mark.parametrize("small, blocks", [(0, 400), (150, 100), (1 << 17, 1 << 18)])
def test_jobs_and_blocks_change_nothing(frame, monkeypatch, small, blocks):
    """Counted level by level, finished in one task, or both: the same trees."""
    usual = fitted(frame)
    monkeypatch.setattr(T, "SMALL", small)
    monkeypatch.setattr(T, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(T, "LEAST_ROWS", 200)
    monkeypatch.setattr(T, "AT_ONCE", 2)
    monkeypatch.setattr(T, "KEPT_ROUNDS", 2)
    other = fitted(frame.repartition(3))
    for name, model in usual.items():
        assert model.first == other[name].first and len(model.trees) == len(other[name].trees)
        for a, b in zip(model.trees, other[name].trees):
            keep = a.feature >= 0
            assert (a.value == b.value).all() and (a.feature == b.feature).all() and (a.left == b.left).all()
            assert (a.goes_left[keep] == b.goes_left[keep]).all()


def test_far_residuals_have_exact_medians(spark):
    """Medians beyond the leading digits take further jobs, not another value."""
    values = [-3e6, -2e6, -1e6 + 0.25, 5e5, 7e6 + 1 / 1024]
    rows = spark.createDataFrame([(0, 1.0, "k", v) for v in values], "day int, x double, c string, y double")
    model = T.fit(rows, "day", F.col("y"), ["x"], ["c"], [T.Fit("a", 1, 2)], T.Settings(0, 0.1, 1, 1.0))["a"]
    assert model.first / T.UNIT == -1e6 + 0.25
    assert T.fit(rows.limit(0), "day", F.col("y"), ["x"], ["c"], [T.Fit("a", 1, 2)], SETTINGS)["a"].trees == []


def test_only_the_smaller_side_is_counted():
    """Of 1,000 rows 900 go left: the job counts the 100 others and follows no row to the left."""
    rng = np.random.default_rng(5)
    bins = np.repeat([[0, 1]], [900, 100], axis=1).astype(np.uint8)
    r = rng.integers(-9000, 9000, 1000) + 20000 * bins[0].astype(int)
    cuts, fits = T.Bins([np.array([0.5])], []), [T.Fit("a", 1, 2)]
    root = T.counted(T.signed(bins, r), cuts.starts, r)
    grown = T.Growth(root, 2)
    grown.nodes[0].n = T.SMALL + 1
    T._choose([(grown, [0])], fits, {1: cuts}, T.Settings(1, 0.1, 20, 1.0))
    assert grown.ask() == [0] and grown.nodes[0].left_n == 900
    grown.nodes[0].n = 1000
    tree, wanted = grown.tree()
    assert [(node, len(rows)) for node, rows in tree.reach(bins, wanted)] == [(2, 100)]
    (counts,) = T._counts([tree], [wanted], fits, {1: cuts})(({1: bins}, r, [np.zeros(1000, np.int64)]))
    grown.grow(counts)
    for node, inside in ((1, bins[0] == 0), (2, bins[0] == 1)):
        assert (grown.nodes[node].counts == T.counted(T.signed(bins[:, inside], r[inside]), cuts.starts, r[inside])).all()
    assert tree.leaf(bins).tolist() == (bins[0] + 1).tolist()


@pytest.mark.parametrize("whole", [0, 1000])
def test_fits_held_by_one_task_have_the_trees_of_counted_ones(frame, monkeypatch, whole):
    """All fits counted by jobs, or only the larger one: nothing changes."""
    usual = fitted(frame)
    monkeypatch.setattr(T, "WHOLE", whole)
    monkeypatch.setattr(T, "SMALL", 150)
    other = fitted(frame.repartition(3))
    for name, model in usual.items():
        assert model.first == other[name].first and len(model.trees) == len(other[name].trees) == SETTINGS.rounds
        for a, b in zip(model.trees, other[name].trees):
            keep = a.feature >= 0
            assert (a.value == b.value).all() and (a.feature == b.feature).all() and (a.left == b.left).all()
            assert (a.goes_left[keep] == b.goes_left[keep]).all()


def test_rounds_of_a_bounded_fit_take_no_jobs(spark, frame):
    """As many jobs for thirty rounds as for two."""
    took = []
    for rounds in (2, 30):
        group = f"rounds-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        T.fit(frame, "day", F.col("y"), ["x", "z"], ["c"], FITS, T.Settings(rounds, 0.3, 20, 10.0))
        took.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext._jsc.clearJobGroup()
    assert took[0] == took[1]


def test_features_counted_together_have_the_same_counts(monkeypatch):
    rng = np.random.default_rng(8)
    cuts = T.Bins([np.arange(39.0), np.arange(200.0)], [{"a": 0, "b": 1}, {}])
    bins = np.array([rng.integers(0, n + 1, 3000) for n in cuts.sizes], np.uint8)
    r = rng.integers(-9000, 9000, 3000)
    expected = T.counted(T.signed(bins, r), cuts.starts, r)[: 2 * cuts.starts[-1]]
    monkeypatch.setattr(T, "CHUNK", 700)
    for joined, groups in ((1, 4), (T.JOINED, 2)):
        monkeypatch.setattr(T, "JOINED", joined)
        held = T.Held(bins, r.copy(), cuts)
        assert len(held.groups) == groups and (held.counted() == expected).all()
        some = np.flatnonzero(bins[0] < 9)
        assert (held.counted(some) == T.counted(T.signed(bins[:, some], r[some]), cuts.starts, r[some])[: 2 * cuts.starts[-1]]).all()
        assert held.median(some) == np.median(r[some]) and held.median(some[1:]) == np.median(r[some[1:]])
