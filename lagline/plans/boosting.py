"""Residual correction of historical medians by boosted trees."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lagline import schema as S
from lagline.functions import columns as C
from lagline.operators import trees as T
from lagline.operators.metrics import score_real
from lagline.operators.sampling import sample_rows
from lagline.sources import model_folder
from lagline.sources.work import materialize

# ---- Fixed values: inputs and settings of the correction -------------------------------
BOOST_NUMERIC = [
    "stop_sequence",
    "scheduled_minute_of_service_day",
    "est_original_grouped",
    "est_schedule_slot",
    "est_day_type",
    "support_log",
    "depth",
]
BOOST_CATEGORY = ["route_name", "direction_code", "weekday"]
ITERATIONS = 140
STEP = 0.08
LEAF = 100
L2 = 10
SEED = 42
COMPLEXITIES = (15, 31)  # leaves of a tree

KIND = "delay correction"
_EPOCH = dt.date(1970, 1, 1)
_NODES = "tree int, node int, feature int, goes_left array<int>, left int, right int, value long"
_BINS = "field string, place int, edge double, category string"


def _inputs(rows: DataFrame) -> dict[str, Column]:
    """Input columns under names of their own: numbers as doubles, categories as filled text."""
    numbers = {f"__{c}": F.col(c).cast("double") for c in BOOST_NUMERIC}
    return numbers | {f"__{c}": C.filled(F.col(c).cast("string")) for c in BOOST_CATEGORY}


@dataclass
class Correction:
    """Bins and trees fitted on the same history, and where that history ends."""

    model: T.Boosted
    leaves: int
    before: dt.date | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        """Append ``prediction``: the exact-minute median plus the learned residual.

        A row without that median gets none; categories the history didn't have count as missing.
        """
        model, n = self.model, len(BOOST_NUMERIC)

        @F.pandas_udf("double")
        def residual(inputs: pd.DataFrame) -> pd.Series:
            columns = [inputs.iloc[:, i] for i in range(inputs.shape[1])]
            return pd.Series(model.predict([c.to_numpy(np.float64) for c in columns[:n]], [c.tolist() for c in columns[n:]]))

        learned = residual(F.struct(*[c.alias(name) for name, c in _inputs(rows).items()]))
        return rows.withColumn("prediction", F.col("est_schedule_slot") + learned)

    def save(self, path: str, mark: str | None = None) -> str:
        """A new version in the model folder ``path``."""
        spark = SparkSession.active()
        nodes = [
            (k, i, int(t.feature[i]), np.flatnonzero(t.goes_left[i]).tolist(), int(t.left[i]), int(t.right[i]), int(t.value[i]))
            for k, t in enumerate(self.model.trees)
            for i in range(len(t.feature))
        ]
        bins = [(c, i, float(x), None) for c, edges in zip(BOOST_NUMERIC, self.model.bins.edges) for i, x in enumerate(edges)]
        bins += [(c, i, None, v) for c, codes in zip(BOOST_CATEGORY, self.model.bins.codes) for v, i in codes.items()]
        about = {
            "numeric": BOOST_NUMERIC, "categories": BOOST_CATEGORY, "leaves": self.leaves, "trees": len(self.model.trees),
            "before": self.before.isoformat() if self.before else None, "first": self.model.first, "unit": T.UNIT,
        }
        tables = {"nodes": spark.createDataFrame(nodes, _NODES).coalesce(1), "bins": spark.createDataFrame(bins, _BINS).coalesce(1)}
        return model_folder.save(path, KIND, about, tables, mark)

    @classmethod
    def load(cls, path: str, mark: str | None = None) -> Correction:
        """The newest version; one with other inputs, or of another state of the data than ``mark``, is refused."""
        version, about = model_folder.manifest(path, KIND, mark)
        if (about["numeric"], about["categories"], about["unit"]) != (BOOST_NUMERIC, BOOST_CATEGORY, T.UNIT):
            raise ValueError(f"{path} has other inputs: {about['numeric']}, {about['categories']}")
        bins = model_folder.table(path, version, "bins").orderBy("field", "place").collect()
        cuts = T.Bins(
            [np.array([r.edge for r in bins if r.field == c], np.float64) for c in BOOST_NUMERIC],
            [{r.category: r.place for r in bins if r.field == c} for c in BOOST_CATEGORY],
        )
        trees: list[list] = [[] for _ in range(about["trees"])]
        for r in model_folder.table(path, version, "nodes").orderBy("tree", "node").collect():
            trees[r.tree].append(r)
        model = T.Boosted(cuts, about["first"], [_tree(nodes) for nodes in trees])
        return cls(model, about["leaves"], dt.date.fromisoformat(about["before"]) if about["before"] else None)


def _tree(nodes: Sequence) -> T.Tree:
    goes_left = np.zeros((len(nodes), T.BINS + 1), bool)
    for i, r in enumerate(nodes):
        goes_left[i, r.goes_left] = True
    columns = ((name, kind) for name, kind in (("left", np.int32), ("right", np.int32), ("value", np.int64)))
    return T.Tree(np.array([r.feature for r in nodes], np.int8), goes_left, *(np.array([r[c] for r in nodes], k) for c, k in columns))


def fit_corrections(
    history: DataFrame, wanted: dict[str, tuple[dt.date | None, int]], sample: int | None = None, iterations: int = ITERATIONS
) -> dict[str, Correction]:
    """Several corrections at once: ``wanted`` has the day each one's history ends before, and its leaves.

    Each learns target minus exact-minute median from all its rows, or from a seeded sample of
    ``sample`` of them. Rounds of all fits go together, so seven fits take about the jobs of one.
    """
    found: dict[str, Correction] = {}
    ends = {name: (end - _EPOCH).days if end else 1 << 30 for name, (end, _) in wanted.items()}
    groups = [list(wanted)] if not sample else [[name] for name in wanted]
    for names in groups:
        rows = history.where(F.col("service_date") < F.lit(wanted[names[0]][0])) if sample and wanted[names[0]][0] else history
        rows = sample_rows(rows, "event_key", sample, SEED) if sample else rows
        inputs = _inputs(rows)
        rows = rows.select(
            F.datediff("service_date", F.lit(_EPOCH)).alias("__day") if "service_date" in rows.columns else F.lit(0).alias("__day"),
            (F.col(S.TARGET) - F.col("est_schedule_slot")).alias("__residual"),
            *[c.alias(name) for name, c in inputs.items()],
        )
        fits = [T.Fit(name, ends[name], wanted[name][1]) for name in names]
        names_in = list(inputs)
        models = T.fit(
            rows, "__day", F.col("__residual"), names_in[: len(BOOST_NUMERIC)], names_in[len(BOOST_NUMERIC) :], fits,
            T.Settings(iterations, STEP, LEAF, L2),
        )
        found |= {name: Correction(models[name], wanted[name][1], wanted[name][0]) for name in names}
    return found


def fit_correction(history: DataFrame, leaves: int, sample: int | None = None, iterations: int = ITERATIONS) -> Correction:
    """One correction from the whole history."""
    return fit_corrections(history, {"all": (None, leaves)}, sample, iterations)["all"]


def history_end(month: str, embargo: int = S.EMBARGO_DAYS) -> dt.date:
    return dt.date.fromisoformat(month) - dt.timedelta(days=embargo)


def fit_months(
    history: DataFrame, leaves: Sequence[int] = COMPLEXITIES, months: Sequence[str] = tuple(S.DEVELOPMENT_MONTHS),
    embargo: int = S.EMBARGO_DAYS, **settings,
) -> dict[tuple[int, str], Correction]:
    """The corrections each month may use, by leaves and month: fitted on history before the month's embargo."""
    wanted = {f"{n} {m}": (history_end(m, embargo), n) for n in leaves for m in months}
    fitted = fit_corrections(history, wanted, **settings)
    return {(n, m): fitted[f"{n} {m}"] for n in leaves for m in months}


def estimates(history: DataFrame, corrections: dict[tuple[int, str], Correction]) -> DataFrame:
    """Corrected estimates of every month by its own corrections."""
    parts = [
        c.apply(history.where(C.in_months(F.col("service_date"), month))).withColumn("candidate", F.lit(f"residual_boost_{leaves}"))
        for (leaves, month), c in corrections.items()
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def compare(history: DataFrame, corrections: dict[tuple[int, str], Correction]) -> tuple[DataFrame, DataFrame]:
    """Predictions and scores of every complexity and month."""
    predicted = materialize(estimates(history, corrections), "boost-backtest", ["candidate"])
    scores = score_real(
        predicted.withColumn("error", F.abs(F.col(S.TARGET) - F.col("prediction"))), ["candidate", "month"]
    )
    return predicted, scores
