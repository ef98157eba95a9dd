"""Model fits and what follows from them: checked by row counts here, by numeric tests in the test suite."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline import schema as S
from lagline.catalog.backtests import SCREEN, requests, selection
from lagline.catalog.registry import feature_table, query, remembered
from lagline.functions import columns as C
from lagline.operators import audit as A
from lagline.operators import encoding as N
from lagline.operators import metrics as M
from lagline.plans import audit as P
from lagline.plans import backtest as T
from lagline.plans import boosting as G
from lagline.plans import regression as R
from lagline.plans import scoring
from lagline.catalog.prelude import over, real, whole
from lagline.sources.work import materialize


@query(
    "m3_category_counts",
    over(
        "feat",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS field, coalesce({c}, '<MISSING>') AS value, {whole('count(*)', 'n')}, count(*) < 20 AS rare
            FROM feat WHERE data_split = 'train' GROUP BY 2"""
            for c in S.CATEGORICAL
        ),
    ),
)
def _(spark, folder):
    counts = N.category_counts(feature_table(spark, folder).where(F.col("data_split") == "train"))
    return counts.withColumn("rare", F.col("n") < N.RARE_BELOW)


@query(
    "m3b_numeric_moments",
    over(
        "feat",
        " UNION ALL ".join(
            f"SELECT '{c}' AS field, {real(f'avg({c})', 'mean')}, {real(f'stddev_pop({c})', 'spread')} FROM feat WHERE data_split = 'train'"
            for c in S.NUMERICAL
        ),
    ),
)
def _(spark, folder):
    return N.numeric_moments(feature_table(spark, folder).where(F.col("data_split") == "train"))


@query("m4_ridge")
def ridge(spark, folder):
    scores, _ = R.compare_candidates(feature_table(spark, folder), ("ridge",))
    return scores


@query("m5_random_forest")
def forest(spark, folder):
    scores, _ = R.compare_candidates(feature_table(spark, folder), ("random_forest",))
    return scores


def candidates(spark, folder):
    """Validation scores of all models and the winner's name."""
    return remembered("regression-candidates", lambda s, f: R.compare_candidates(feature_table(s, f)), spark, folder)


def final(spark, folder):
    """The winner refitted on all rows before the test period, with its test predictions."""

    def build(s, f):
        _, chosen = candidates(s, f)
        predicted, encoder, model = R.final_predictions(feature_table(s, f), chosen)
        return chosen, materialize(predicted, "test-predictions"), encoder, model

    return remembered("regression-final", build, spark, folder)


def final_metrics(spark, folder):
    chosen, predicted, _, _ = final(spark, folder)
    return R.regression_metrics(
        predicted.withColumn("model", F.lit(R.MODELS[chosen])), ["model"], "predicted_departure_delay_seconds"
    )


@query("m6_candidate_selection")
def _(spark, folder):
    scores, chosen = candidates(spark, folder)
    return scores.withColumn("selected_for_test", F.col("model") == R.MODELS[chosen])


@query("m7_final_test_scores")
def _(spark, folder):
    return final_metrics(spark, folder)


@query("m8_importance")
def _(spark, folder):
    _, _, encoder, model = final(spark, folder)
    return R.importance(spark, encoder, model)


@query("m9b_full_comparison")
def _(spark, folder):
    rows = feature_table(spark, folder)
    scores, chosen = candidates(spark, folder)
    return R.full_comparison(rows, R.baseline_metrics(R.baseline_predictions(rows)), scores, final_metrics(spark, folder), chosen)


@query("m10b_final_predictions")
def _(spark, folder):
    return final(spark, folder)[1].select("event_key", "predicted_departure_delay_seconds", "absolute_error_seconds")


# ---- residual boosting -----------------------------------------------------------------------


def history(spark, folder):
    return remembered(
        "history", lambda s, f: materialize(T.cross_fitted_history(feature_table(s, f)), "history"), spark, folder
    )


def corrections(spark, folder):
    """All fits at once: every complexity for the development months and for the audit month."""
    months = (*S.DEVELOPMENT_MONTHS, S.AUDIT_MONTH)
    return remembered("corrections", lambda s, f: G.fit_months(history(s, f), months=months), spark, folder)


def boosted(spark, folder):
    """Predictions and scores of every complexity and development month."""

    def build(s, f):
        past = {k: c for k, c in corrections(s, f).items() if k[1] in S.DEVELOPMENT_MONTHS}
        predicted, scores = G.compare(history(s, f), past)
        return predicted, materialize(scores, "boost-scores")

    return remembered("boost", build, spark, folder)


def chosen_leaves(spark, folder) -> int:
    best = T.best(T.candidate_summary(boosted(spark, folder)[1])).first()["candidate"]
    return int(best.rsplit("_", 1)[1])


def corrected(spark, folder):
    """The chosen complexity's estimates: development months from the comparison, then the audit month."""

    def build(s, f):
        leaves = chosen_leaves(s, f)
        development = boosted(s, f)[0].where(F.col("candidate") == f"residual_boost_{leaves}")
        audit = G.estimates(history(s, f), {(leaves, S.AUDIT_MONTH): corrections(s, f)[leaves, S.AUDIT_MONTH]})
        return materialize(development.unionByName(audit), "corrected")

    return remembered("corrected", build, spark, folder)


@query("m21_residual_boost")
def _(spark, folder):
    return boosted(spark, folder)[0].select("candidate", "event_key", "month", "est_schedule_slot", "prediction")


@query("m22_boost_comparison")
def _(spark, folder):
    return boosted(spark, folder)[1]


@query("m23_boost_outcome")
def _(spark, folder):
    """The correction against the best of all medians over both cycles, on the same months."""
    chosen = T.best(T.candidate_summary(boosted(spark, folder)[1])).first()
    prior = T.best(T.candidate_summary(selection(spark, folder).scores)).first()
    june = corrected(spark, folder).where(C.in_months(F.col("service_date"), S.AUDIT_MONTH))
    audit = M.score_real(june.withColumn("error", F.abs(F.col(S.TARGET) - F.col("prediction"))), ["candidate"])
    return (
        audit.withColumn("development_mae", F.lit(chosen["mean_month_mae"]))
        .withColumn("prior_best", F.lit(prior["candidate"]))
        .withColumn("prior_best_mae", F.lit(prior["mean_month_mae"]))
        .withColumn("beats_prior", F.col("development_mae") < F.col("prior_best_mae"))
    )


# ---- the corrected estimate through audit, blend and requests --------------------------------


def corrected_detail(spark, folder):
    return remembered(
        "corrected-detail",
        lambda s, f: materialize(P.corrected_detail(feature_table(s, f), corrected(s, f)), "corrected-detail"),
        spark,
        folder,
    )


def final_detail(spark, folder):
    return remembered(
        "final-detail",
        lambda s, f: materialize(P.final_detail(corrected_detail(s, f), M.score_real), "final-detail"),
        spark,
        folder,
    )


def reliable(spark, folder):
    return A.reliable_routes(M.error_table(corrected_detail(spark, folder), "month", "route_name"), **SCREEN)


@query("m24b_corrected_detail", text=("month", "service_date"))
def _(spark, folder):
    return corrected_detail(spark, folder)


@query("m25b_reliable_routes")
def _(spark, folder):
    return reliable(spark, folder)


@query("m25c_corrected_subset", text=("month",))
def _(spark, folder):
    return A.subset_audit(corrected_detail(spark, folder), reliable(spark, folder))


@query("m26b_corrected_blend_search", text=("month",))
def _(spark, folder):
    return A.blend_scores(corrected_detail(spark, folder), M.score_real)


@query("m27b_corrected_final_scores", text=("month",))
def _(spark, folder):
    control = P.weekly_control(feature_table(spark, folder), [*S.DEVELOPMENT_MONTHS, S.AUDIT_MONTH])
    return P.scores_with_control(final_detail(spark, folder), control, M.score_real)


@query("m27c_final_daily_errors", text=("month", "service_date"))
def _(spark, folder):
    return M.daily_errors(final_detail(spark, folder))


@query("m27d_final_uncertainty", text=("month",))
def _(spark, folder):
    return A.day_bootstrap(M.daily_errors(final_detail(spark, folder)))


@query("m27e_final_error_tables")
def _(spark, folder):
    return P.final_error_tables(final_detail(spark, folder))


@query("m28b_scored_requests")
def _(spark, folder):
    rows = feature_table(spark, folder)
    correction = corrections(spark, folder)[chosen_leaves(spark, folder), S.AUDIT_MONTH]
    weight = A.best_weight(A.blend_scores(corrected_detail(spark, folder), M.score_real)).first()["boost_weight"]
    estimates = scoring.historical_estimates(requests(spark, folder), rows)
    return scoring.score_requests(estimates, correction, weight, reliable(spark, folder)).select(
        "event_key", "baseline_prediction", "prediction", "departure_delay_estimate_seconds",
        "departure_delay_estimate_minutes", "met_reliability_screen", "historical_group_records", "depth",
    )
