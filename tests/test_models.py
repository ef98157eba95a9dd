"""Encodings and models against direct arithmetic."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagline import schema as S
from lagline.operators import encoding as N
from lagline.operators import events as E
from lagline.plans import boosting as G
from lagline.plans import regression as R
from lagline.sources.work import materialize


@pytest.fixture(scope="module")
def features(raw):
    return materialize(E.with_day_keys(E.regression_features(E.derive(raw))), "features")


def test_ridge_equals_the_closed_form(features):
    training = features.where(F.col("data_split") == "train")
    encoder, model = R.fit_model("ridge", training)
    rows = encoder.transform(training).select("features", S.TARGET).collect()
    x = np.array([r[0].toArray() for r in rows])
    y = np.array([float(r[1]) for r in rows])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + R.RIDGE_ALPHA * np.eye(x.shape[1]), xc.T @ yc)
    assert np.allclose(model.stages[-1].coefficients.toArray(), want, atol=1e-6)
    assert len(encoder.field_of_position()) == x.shape[1]
    importance = R.importance(features.sparkSession, encoder, model).collect()
    assert {r["feature"] for r in importance} == set(S.PREDICTORS)
    assert sum(r["importance"] for r in importance) == pytest.approx(1.0)


def test_rare_and_unknown_categories(features):
    training = features.where(F.col("data_split") == "train")
    encoder = N.Encoder.fit(training, rare_below=100)
    rare = [r[0] for r in encoder.rare.where("field = 'stop_id'").select("value").collect()]
    assert rare and N.INFREQUENT in encoder.labels("stop_id")
    width = len(encoder.labels("route_name")) + len(encoder.labels("direction_code"))
    place = slice(width, width + len(encoder.labels("stop_id")))

    def stop_part(value):
        row = training.limit(1).withColumn("stop_id", F.lit(value))
        return encoder.transform(row).first()["features"].toArray()[place]

    assert stop_part("never seen").sum() == 0
    assert stop_part(rare[0])[-1] == 1 and stop_part(rare[0]).sum() == 1


def test_ordinal_codes_ignore_the_outcome(features):
    training = features.where(F.col("data_split") == "train")
    shifted = training.withColumn(S.TARGET, F.col(S.TARGET) * 100)
    unseen = training.limit(1).withColumn("route_name", F.lit("never seen"))
    for source in (training, shifted):
        tables = N.ordinal_codes(source, ["route_name", "direction_code"])
        row = N.encode_ordinal(unseen, tables).first()
        assert row["code_route_name"] is None and row["code_direction_code"] is not None
    assert sorted((r["value"], r["code"]) for r in tables["route_name"].collect()) == [("1", 0.0), ("4", 1.0), ("70", 2.0), ("X1", 3.0)]


def test_correction_learns_and_survives_saving(spark, tmp_path):
    rows = spark.range(4000).selectExpr(
        "concat('e', id) AS event_key", "id % 7 AS stop_sequence", "CAST(id % 1440 AS INT) AS scheduled_minute_of_service_day",
        "100D AS est_original_grouped", "100D AS est_schedule_slot", "100D AS est_day_type", "1D AS support_log", "0 AS depth",
        "IF(id % 2 = 0, 'a', 'b') AS route_name", "CAST(NULL AS STRING) AS direction_code", "CAST(id % 7 AS INT) AS weekday",
        "CAST(100 + IF(id % 2 = 0, 50, -50) AS BIGINT) AS departure_delay_seconds",
    )
    correction = G.fit_correction(rows, 15, iterations=15)
    predicted = correction.apply(rows)
    error = predicted.agg(F.avg(F.abs(F.col(S.TARGET) - F.col("prediction")))).first()[0]
    assert error < 45  # the uncorrected error is 50
    correction.save(str(tmp_path / "m"))
    again = G.Correction.load(str(tmp_path / "m"))
    assert again.apply(rows.withColumn("route_name", F.lit("never seen"))).where("prediction IS NULL").count() == 0
    both = predicted.select("event_key", "prediction").exceptAll(again.apply(rows).select("event_key", "prediction"))
    assert both.count() == 0 and again.leaves == 15
    correction.save(str(tmp_path / "m"), mark="second state")
    assert G.Correction.load(str(tmp_path / "m"), mark="second state").model.first == correction.model.first
    with pytest.raises(ValueError, match="second state"):
        G.Correction.load(str(tmp_path / "m"), mark="third state")
