"""Bounded samples of labelled documents for fitting, and the folds that keep rows out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows of the held-out fold: crc32 of the id as text; rows without an id never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def chosen(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, longest: int):
    """(label, doc_id, text) of at most ``rows`` documents per label value, and rows per label value.

    Only rows outside the held-out fold are taken. They are chosen by a hash of the id, so the
    choice is the same at every run, and only the chosen ids meet the documents. Texts over
    ``longest`` characters don't teach. A document with several labels takes the largest; null
    labels and null ids are left out. Without labels there is no table.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("string").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .where(~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ids = None
    for value in sorted(counts):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        ids = part if ids is None else ids.union(part)
    if ids is None:
        return None, counts
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        F.col("text").isNotNull() & (F.length("text") <= longest)
    )
    # At most rows x label values ids: a proven size.
    return texts.join(F.broadcast(ids), "doc_id").select("label", "doc_id", "text"), counts


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, longest: int):
    """The chosen texts on the driver, at most ``rows`` x ``longest`` characters per label value.

    Returns ({label value: [text, ...]}, {label value: rows outside the fold}).
    """
    found, counts = chosen(docs, labels, label, folds, fold, rows, longest)
    texts: dict[str, list[str]] = {value: [] for value in counts}
    if found is not None:
        for row in found.orderBy("doc_id", "text").toLocalIterator():
            texts[row["label"]].append(row["text"])
    return texts, counts


def logistic(x, y, weight, penalty: float = 1.0, steps: int = 60):
    """Penalised logistic regression by Newton steps; x has a leading column of ones."""
    import numpy as np

    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(curvature, gradient)
        move *= min(1.0, 5 / max(1e-9, np.abs(move).max()))
        beta += move
        if np.abs(move).max() < 1e-8:
            break
    return beta
