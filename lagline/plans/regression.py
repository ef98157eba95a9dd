"""Chronological comparison of historical baselines and regression models."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from lagline import schema as S
from lagline.operators import encoding as N
from lagline.operators import fallback as B
from lagline.operators import forest as O
from lagline.operators.metrics import regression_metrics

# ---- Fixed values: model names and settings --------------------------------------------
GLOBAL_MEDIAN = "Global median baseline"
GROUPED_MEDIAN = "Historical grouped median"
MODELS = {"ridge": "Ridge regression", "random_forest": "Random Forest"}
RIDGE_ALPHA = 10.0
FOREST = {"trees": 60, "depth": 18, "leaf": 25, "seed": 42}
HOURLY = B.Config("hourly", minutes=60, minimum=30)
PHASES = {"validation": S.VALIDATION_START, "test": S.TEST_START}


def baseline_predictions(
    features: DataFrame,
    minimum: int = HOURLY.minimum,
    validation_start: str = S.VALIDATION_START,
    test_start: str = S.TEST_START,
    embargo: int = 0,
) -> DataFrame:
    """Both later splits with the grouped median and the global median of all earlier rows.

    Validation looks back on train, test on train and validation: two cutoffs of one fit.
    A missing key is a group of its own here, in the fit and in the lookup.
    """
    config = B.Config(HOURLY.name, HOURLY.minutes, minimum)
    cutoffs = [dt.date.fromisoformat(d) for d in (validation_start, test_start)]
    model = B.fit(features, [(config, cutoffs)], embargo)
    later = features.where(F.col("data_split") != "train")
    cutoff = F.when(F.col("data_split") == "test", F.lit(cutoffs[1])).otherwise(F.lit(cutoffs[0]))
    asked = B.ask(later, [config], cutoff, embargo)
    predicted = B.predict(asked, model, keep_null_keys=True)
    overall = model.where(F.col("depth") == B.GLOBAL_DEPTH).select(
        "hist_end", F.col("median").alias("global_median")
    )
    return predicted.join(overall, "hist_end").withColumnRenamed("data_split", "phase")


def baseline_metrics(predicted: DataFrame) -> DataFrame:
    """MAE, RMSE, R squared per phase and baseline."""
    methods = F.array(
        F.struct(F.lit(GLOBAL_MEDIAN).alias("model"), F.col("global_median").alias("estimate")),
        F.struct(F.lit(GROUPED_MEDIAN).alias("model"), F.col("estimate").alias("estimate")),
    )
    long = predicted.select("phase", S.TARGET, F.inline(methods))
    return regression_metrics(long, ["phase", "model"])


def comparison(features: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metric rows with the dates they were trained and evaluated on."""
    days = features.groupBy("service_date", "data_split").agg(F.lit(1).alias("one"))
    spans = days.where(F.col("data_split") != "train").groupBy(F.col("data_split").alias("phase")).agg(
        F.min("service_date").alias("lo"), F.max("service_date").alias("hi")
    )

    def span(a, b):
        return F.concat(a.cast("string"), F.lit(" to "), b.cast("string"))

    # both sides are one row per service date at most
    periods = spans.join(days.select("service_date"), F.col("service_date") < F.col("lo")).groupBy("phase", "lo", "hi").agg(
        F.min("service_date").alias("first"), F.max("service_date").alias("last")
    )
    return metrics.join(
        periods.select(
            "phase",
            span(F.col("first"), F.col("last")).alias("training_period"),
            span(F.col("lo"), F.col("hi")).alias("evaluation_period"),
        ),
        "phase",
    )


def full_comparison(
    features: DataFrame, baselines: DataFrame, validation: DataFrame, test: DataFrame, chosen: str
) -> DataFrame:
    """Baselines and models on validation and test, the chosen one marked, with their periods."""
    rows = baselines.unionByName(validation.withColumn("phase", F.lit("validation"))).unionByName(
        test.withColumn("phase", F.lit("test"))
    )
    return comparison(features, rows).withColumn("selected_for_test", F.col("model") == MODELS[chosen])


def ridge(rows: int, target_spread: float) -> LinearRegression:
    """The fixed, untuned linear model over the encoded vector."""
    # Spark divides the squared loss by the rows and scales the target by its spread;
    # undoing both gives the penalty alpha on raw coefficients.
    return LinearRegression(
        featuresCol="features",
        labelCol=S.TARGET,
        solver="auto",  # the normal equations up to 4,096 columns, l-bfgs on the same objective beyond
        maxIter=1000,
        tol=1e-10,
        elasticNetParam=0.0,
        standardization=False,
        regParam=RIDGE_ALPHA / rows * target_spread,
    )


def fit_model(name: str, training: DataFrame, rows_per_tree: int | None = None) -> tuple[N.Encoder, PipelineModel | O.Forest]:
    """Encoder and model, both fitted on the training rows only; a forest's trees may see fewer rows."""
    if name not in MODELS:
        raise ValueError(f"unknown model: {name}")
    encoder = N.Encoder.fit(training)
    rows, spread, mean = training.agg(F.count(F.lit(1)), F.stddev_pop(S.TARGET), F.avg(S.TARGET)).first()
    if name == "ridge":
        encoded = encoder.transform(training).select("features", F.col(S.TARGET).cast("double").alias(S.TARGET))
        return encoder, Pipeline(stages=[ridge(rows, spread)]).fit(encoded)
    layout = O.Layout(tuple(len(encoder.labels(c)) for c in S.CATEGORICAL), O.fit_edges(training, S.NUMERICAL))
    settings = O.Settings(**FOREST, rate=min(1.0, rows_per_tree / rows) if rows_per_tree else 1.0)
    indexes = [f"__{c}_index" for c in S.CATEGORICAL]
    return encoder, O.fit(encoder.indexed(training), S.TARGET, float(round(mean)), layout, indexes, S.NUMERICAL, settings)


def predict(encoder: N.Encoder, model: PipelineModel | O.Forest, rows: DataFrame) -> DataFrame:
    if isinstance(model, O.Forest):
        return model.predict(encoder.indexed(rows)).select(*rows.columns, "estimate")
    return model.transform(encoder.transform(rows)).withColumnRenamed("prediction", "estimate")


def compare_candidates(features: DataFrame, names: tuple[str, ...] = tuple(MODELS)) -> tuple[DataFrame, str]:
    """Validation scores of the models and the name of the one with the lowest MAE."""
    training = features.where(F.col("data_split") == "train")
    validation = features.where(F.col("data_split") == "validation")
    scores = None
    for name in names:
        predicted = predict(*fit_model(name, training), validation)
        row = regression_metrics(predicted.withColumn("model", F.lit(MODELS[name])), ["model"])
        scores = row if scores is None else scores.unionByName(row)
    # two rows of numbers: kept, so that choosing does not run the fits again
    kept = features.sparkSession.createDataFrame(scores.collect(), scores.schema)
    best = kept.orderBy("mae_seconds", "model").first()["model"]
    return kept, next(key for key, label in MODELS.items() if label == best)


def final_predictions(features: DataFrame, name: str) -> tuple[DataFrame, N.Encoder, PipelineModel]:
    """Refit on everything before the test period, then predict it once."""
    encoder, model = fit_model(name, features.where(F.col("data_split") != "test"))
    predicted = predict(encoder, model, features.where(F.col("data_split") == "test"))
    return (
        predicted.select(
            "event_key", "service_date", "scheduled_event_time", "route_name", "direction_code", "stop_id",
            S.TARGET,
            F.col("estimate").alias("predicted_departure_delay_seconds"),
            F.abs(F.col(S.TARGET) - F.col("estimate")).alias("absolute_error_seconds"),
        ),
        encoder,
        model,
    )


def importance(spark, encoder: N.Encoder, model: PipelineModel | O.Forest) -> DataFrame:
    """Importance of the encoded columns, added up to the fields they came from."""
    if isinstance(model, O.Forest):
        weights, method = model.importances, "impurity-based importance"
    else:
        weights = abs(model.stages[-1].coefficients.toArray())
        weights, method = weights / weights.sum(), "normalized absolute coefficient"
    pairs = list(zip(encoder.field_of_position(), map(float, weights), strict=True))
    return (
        spark.createDataFrame(pairs, "feature string, weight double")
        .groupBy("feature")
        .agg(F.sum("weight").alias("importance"))
        .withColumn("method", F.lit(method))
        .orderBy(F.desc("importance"), "feature")
    )
