"""Fallback medians, as-of history, backtests and audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lagline import schema as S
from lagline.catalog import history_sql as H
from lagline.catalog.prelude import over, real, whole
from lagline.catalog.registry import feature_table, query, remembered
from lagline.catalog.summaries import HISTOGRAM_SELECT, histogram_sql
from lagline.functions import columns as C
from lagline.operators import audit as A
from lagline.operators import fallback as B
from lagline.operators import metrics as M
from lagline.operators import summaries as Y
from lagline.operators.encoding import encode_ordinal, ordinal_codes
from lagline.operators.sampling import sample_rows
from lagline.plans import audit as P
from lagline.plans import backtest as T
from lagline.plans import regression as R
from lagline.plans import scoring
from lagline.sources.work import materialize

ORIGINAL = B.BY_NAME["original_grouped"]
SLOT = B.BY_NAME["schedule_slot"]
DEV = S.DEVELOPMENT_MONTHS
ALL = [*DEV, S.AUDIT_MONTH]
_DEV_ROWS = "month BETWEEN DATE '2026-03-01' AND DATE '2026-05-01'"
_ALL_ROWS = "month BETWEEN DATE '2026-03-01' AND DATE '2026-06-01'"


# ---- fallback tables and lookups ----------------------------------------------------------


def _level(prefix: str, i: int, *keys: str) -> str:
    kinds = {"route_name": "VARCHAR", "stop_id": "VARCHAR", "day_key": "VARCHAR", "slot": "VARCHAR"}
    listed = ", ".join(f"CAST({k if k in keys else 'NULL'} AS {t}) AS {k}" for k, t in kinds.items())
    return f"SELECT CAST({i} AS INTEGER) AS depth, {listed}, {real('m', 'median')}, {whole('n', 'n')} FROM {prefix}_l{i}"


def _levels(prefix: str) -> list[str]:
    keys = ["route_name", "stop_id", "day_key", "slot"]
    by_level = [keys, ["route_name", "stop_id", "slot"], keys[:2], keys[:1], []]
    return [_level(prefix, i, *k) for i, k in enumerate(by_level)]


_LEVELS = " UNION ALL ".join(_levels("a"))


def levels_of(model, config):
    return model.where((F.col("n") >= config.minimum) | (F.col("depth") == B.GLOBAL_DEPTH)).select(
        "depth", "route_name", "stop_id", F.col("day_key").cast("string"), F.col("slot").cast("string"), "median", "n"
    )


@query(
    "a20_grouped_medians",
    over(
        "feat",
        _LEVELS,
        H.cut_list("a", ORIGINAL, [dt.date(2026, 5, 1)]),
        *H.tables("a", ORIGINAL),
    ),
)
def _(spark, folder):
    model = B.fit(feature_table(spark, folder), [(ORIGINAL, B.month_cutoffs(["2026-05-01"]))])
    return levels_of(model, ORIGINAL)


_BASELINE = [
    H.cut_list("b", R.HOURLY, [dt.date(2026, 5, 1), dt.date(2026, 6, 1)], 0),
    *H.tables("b", R.HOURLY),
    *H.estimates(
        "b", R.HOURLY, "CASE WHEN data_split = 'test' THEN DATE '2026-06-01' ELSE DATE '2026-05-01' END", "data_split <> 'train'"
    ),
    "bp AS (SELECT p.*, g.m AS global_median FROM b_pred p JOIN b_l4 g ON p.cutoff = g.cutoff)",
]


def baseline(spark, folder):
    return R.baseline_predictions(feature_table(spark, folder))


@query(
    "j1_fallback_lookup",
    over(
        "feat",
        f"SELECT event_key, data_split AS phase, {real('est', 'estimate')}, CAST(depth AS INTEGER) AS depth FROM bp",
        *_BASELINE,
    ),
)
def _(spark, folder):
    return baseline(spark, folder).select("event_key", "phase", "estimate", "depth")


@query(
    "j2_lookup_with_support",
    over(
        "feat",
        f"SELECT event_key, {real('est', 'estimate')}, {whole('support', 'support')}, CAST(depth AS INTEGER) AS depth FROM s_pred",
        *H.backtest("s", SLOT, [dt.date(2026, 5, 1)], "month", "month = DATE '2026-05-01'"),
    ),
)
def _(spark, folder):
    predicted = T.monthly(feature_table(spark, folder), [SLOT], ["2026-05-01"])
    return predicted.select("event_key", "estimate", "support", "depth")


_WINDOWS = [(c, m) for c in B.CANDIDATES for m in B.month_cutoffs(DEV)]


@query(
    "j3_history_windows",
    over(
        "feat",
        f"""SELECT w.candidate, w.cutoff, {whole('count(*)', 'rows')}, min(f.service_date) AS first_day, max(f.service_date) AS last_day
        FROM w JOIN feat f ON f.service_date < w.he AND f.service_date >= w.hs GROUP BY w.candidate, w.cutoff""",
        "w(candidate, cutoff, hs, he) AS (VALUES "
        + ", ".join(
            f"('{c.name}', DATE '{m}', DATE '{m - dt.timedelta(days=2 + c.days) if c.days else dt.date(1900, 1, 1)}', "
            f"DATE '{m - dt.timedelta(days=2)}')"
            for c, m in _WINDOWS
        )
        + ")",
    ),
    text=("cutoff", "first_day", "last_day"),
)
def _(spark, folder):
    return T.history_windows(feature_table(spark, folder), [(c, B.month_cutoffs(DEV)) for c in B.CANDIDATES])


@query(
    "j4_refresh_week",
    over("feat", f"SELECT event_key, {H.WEEK} AS week_start FROM feat"),
    text=("week_start",),
)
def _(spark, folder):
    return feature_table(spark, folder).select("event_key", C.week_start(F.col("service_date")).alias("week_start"))


@query(
    "j5_alignment",
    over(
        "feat",
        f"""SELECT {whole("count(*) FILTER (WHERE data_split <> 'validation')", 'without_prediction')}, {whole('0', 'without_event')},
        {whole("count(*) FILTER (WHERE data_split = 'validation' AND stop_sequence = 1)", 'different')} FROM feat""",
    ),
)
def _(spark, folder):
    rows = feature_table(spark, folder)
    stored = rows.where(F.col("data_split") == "validation").withColumn(
        S.TARGET, F.when(F.col("stop_sequence") == 1, F.col(S.TARGET) + 1).otherwise(F.col(S.TARGET))
    )
    return A.misaligned(rows, stored, ["service_date", "route_name", S.TARGET])


@query(
    "a29_fallback_usage",
    over(
        "feat",
        f"""SELECT p.phase, CAST(l.depth AS INTEGER) AS depth, l.fallback_level, {whole('coalesce(c.n, 0)', 'records')},
        {real('100.0 * coalesce(c.n, 0) / p.total', 'percent')}
        FROM (SELECT data_split AS phase, count(*) AS total FROM bp GROUP BY 1) p
        CROSS JOIN (VALUES (0, 'route + stop + weekday + hour'), (1, 'route + stop + hour'), (2, 'route + stop'),
          (3, 'route'), (4, 'global median')) l(depth, fallback_level)
        LEFT JOIN (SELECT data_split AS phase, depth, count(*) AS n FROM bp GROUP BY 1, 2) c
        ON c.phase = p.phase AND c.depth = l.depth""",
        *_BASELINE,
    ),
)
def _(spark, folder):
    return B.depth_usage(baseline(spark, folder), ["phase"])


def _r_metrics(estimate: str, model: str) -> str:
    y = "departure_delay_seconds"
    return f"""SELECT data_split AS phase, '{model}' AS model, {whole('count(*)', 'evaluation_rows')},
    {real(f'avg(abs({y} - {estimate}))', 'mae_seconds')}, {real(f'sqrt(avg(({y} - {estimate}) * ({y} - {estimate})))', 'rmse_seconds')},
    {real(f'1 - sum(({y} - {estimate}) * ({y} - {estimate})) / (count(*) * var_pop({y}))', 'r2')} FROM bp GROUP BY data_split"""


_GLOBAL, _GROUPED = _r_metrics("global_median", R.GLOBAL_MEDIAN), _r_metrics("est", R.GROUPED_MEDIAN)


@query("m1_global_median_baseline", over("feat", _GLOBAL, *_BASELINE))
def _(spark, folder):
    return R.baseline_metrics(baseline(spark, folder)).where(F.col("model") == R.GLOBAL_MEDIAN)


@query("m2_grouped_median_baseline", over("feat", _GROUPED, *_BASELINE))
def _(spark, folder):
    return R.baseline_metrics(baseline(spark, folder)).where(F.col("model") == R.GROUPED_MEDIAN)


_COMPARISON = f"{_GLOBAL} UNION ALL {_GROUPED}"


@query("a21_regression_metrics", over("feat", _COMPARISON, *_BASELINE))
def _(spark, folder):
    return R.baseline_metrics(baseline(spark, folder))


@query(
    "m9_comparison_table",
    over(
        "feat",
        f"""SELECT c.*, t.training_period, t.evaluation_period FROM ({_COMPARISON}) c JOIN (
        SELECT e.phase, min(f.service_date)::VARCHAR || ' to ' || max(f.service_date)::VARCHAR AS training_period,
          min(e.lo)::VARCHAR || ' to ' || max(e.hi)::VARCHAR AS evaluation_period
        FROM (SELECT data_split AS phase, min(service_date) AS lo, max(service_date) AS hi FROM feat
              WHERE data_split <> 'train' GROUP BY 1) e
        JOIN feat f ON f.service_date < e.lo GROUP BY e.phase) t ON c.phase = t.phase""",
        *_BASELINE,
    ),
)
def _(spark, folder):
    rows = feature_table(spark, folder)
    return R.comparison(rows, R.baseline_metrics(R.baseline_predictions(rows)))


@query(
    "w5_phase_view",
    over("feat", f"SELECT * FROM ({_COMPARISON}) WHERE phase = 'validation' ORDER BY mae_seconds", *_BASELINE),
)
def _(spark, folder):
    return R.baseline_metrics(baseline(spark, folder)).where(F.col("phase") == "validation").orderBy("mae_seconds", "model")


@query(
    "m10_baseline_predictions",
    over(
        "feat",
        f"""SELECT event_key, route_name, stop_id, {real('est', 'predicted_departure_delay_seconds')},
        {real('abs(departure_delay_seconds - est)', 'absolute_error_seconds')} FROM bp WHERE data_split = 'test'""",
        *_BASELINE,
    ),
)
def _(spark, folder):
    test = baseline(spark, folder).where(F.col("phase") == "test")
    return test.select(
        "event_key", "route_name", "stop_id",
        F.col("estimate").alias("predicted_departure_delay_seconds"),
        F.abs(F.col(S.TARGET) - F.col("estimate")).alias("absolute_error_seconds"),
    )


@query(
    "a30_error_quantiles",
    over(
        "feat",
        "SELECT data_split AS phase, "
        + ", ".join(
            real(f"quantile_cont(abs(departure_delay_seconds - est), {p})", a)
            for p, a in ((0.5, "median_error"), (0.9, "p90_error"), (0.95, "p95_error"), (0.99, "p99_error"))
        )
        + " FROM bp GROUP BY data_split",
        *_BASELINE,
    ),
)
def _(spark, folder):
    return M.error_quantiles(M.with_error(baseline(spark, folder)), ["phase"])


@query(
    "a30b_error_quantiles_real",
    over(
        "feat",
        "SELECT data_split AS phase, "
        + ", ".join(
            real(f"quantile_cont(abs(departure_delay_seconds - est) / 7.0, {p})", a)
            for p, a in ((0.5, "median_error"), (0.9, "p90_error"), (0.95, "p95_error"), (0.99, "p99_error"))
        )
        + " FROM bp GROUP BY data_split",
        *_BASELINE,
    ),
)
def _(spark, folder):
    rows = M.with_error(baseline(spark, folder)).withColumn("error", F.col("error") / 7.0)
    return M.error_quantiles(rows, ["phase"], real=True)


@query(
    "a32_error_histogram",
    over(
        "feat",
        HISTOGRAM_SELECT.format(n=60),
        *_BASELINE,
        "err AS (SELECT abs(departure_delay_seconds - est) AS e FROM bp WHERE data_split = 'test')",
        *histogram_sql("err", "e", "min(e)", "quantile_cont(e, 0.99)", 60),
    ),
)
def _(spark, folder):
    rows = M.with_error(baseline(spark, folder).where(F.col("phase") == "test"))
    return Y.error_histogram(rows, "error", 0.99, 60)


@query(
    "a33_density",
    over(
        "feat",
        f"""SELECT {whole('floor(departure_delay_seconds / 30.0)', 'x_cell')}, {whole('floor(est / 30.0)', 'y_cell')},
        {whole('count(*)', 'records')} FROM bp WHERE data_split = 'test' GROUP BY 1, 2""",
        *_BASELINE,
    ),
)
def _(spark, folder):
    return Y.density(baseline(spark, folder).where(F.col("phase") == "test"), S.TARGET, "estimate", 30.0)


@query(
    "j12_unseen_categories",
    over(
        "feat",
        f"""SELECT n.data_split, {whole('count(DISTINCT n.pair)', 'unseen_values')}, {whole('count(*)', 'rows_affected')}
        FROM (SELECT data_split, stop_id || '@' || scheduled_minute_of_service_day AS pair FROM feat WHERE data_split <> 'train') n
        WHERE n.pair NOT IN (SELECT stop_id || '@' || scheduled_minute_of_service_day FROM feat WHERE data_split = 'train')
        GROUP BY n.data_split""",
    ),
)
def _(spark, folder):
    rows = feature_table(spark, folder).withColumn(
        "pair", F.concat_ws("@", "stop_id", F.col("scheduled_minute_of_service_day").cast("string"))
    )
    return P.unseen(rows, "pair")


@query(
    "j13_config_month_grid",
    over(
        "feat",
        f"""SELECT c.candidate, month, {whole('count(*)', 'rows')} FROM feat
        CROSS JOIN (VALUES {', '.join(f"('{c.name}')" for c in B.CANDIDATES)}) c(candidate)
        WHERE {_DEV_ROWS} GROUP BY c.candidate, month""",
    ),
    text=("month",),
)
def _(spark, folder):
    return T.grid(feature_table(spark, folder), B.CANDIDATES, DEV)


# ---- backtests ------------------------------------------------------------------------------

_MONTHLY = [part for c in B.CANDIDATES for part in H.backtest(c.name, c, B.month_cutoffs(DEV), "month", _DEV_ROWS)]
_ERROR = "abs(departure_delay_seconds - est)"


def _scores(names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS candidate, month, {H.metric_columns(_ERROR)} FROM {n}_pred GROUP BY month" for n in names
    )


_ALL_SCORES = _scores([c.name for c in B.CANDIDATES])


def monthly_scores(spark, folder, configs=B.CANDIDATES, months=DEV):
    return T.scored(T.monthly(feature_table(spark, folder), configs, months))


def grid_scores(spark, folder):
    """The scores of the whole grid as a written table, once per session and state of the tables."""
    return remembered("grid-scores", lambda s, f: materialize(monthly_scores(s, f), "grid-scores"), spark, folder)


@query("m12_monthly_backtest", over("feat", _ALL_SCORES, *_MONTHLY), text=("month",))
def _(spark, folder):
    return monthly_scores(spark, folder)


@query(
    "a22_error_metrics",
    over("feat", _scores([ORIGINAL.name]), *H.backtest(ORIGINAL.name, ORIGINAL, B.month_cutoffs(DEV), "month", _DEV_ROWS)),
    text=("month",),
)
def _(spark, folder):
    return monthly_scores(spark, folder, [ORIGINAL])


_SUMMARY = f"""SELECT candidate, {real('avg(mae)', 'mean_month_mae')}, {real('max(mae)', 'worst_month_mae')},
{real('avg(within_120)', 'within_120')} FROM sc GROUP BY candidate"""
_SCORES_TABLE = [
    *_MONTHLY,
    "sc AS ("
    + " UNION ALL ".join(
        f"SELECT '{c.name}' AS candidate, month, avg({_ERROR}) AS mae, avg(CAST({_ERROR} <= 120 AS INTEGER)) AS within_120 "
        f"FROM {c.name}_pred GROUP BY month"
        for c in B.CANDIDATES
    )
    + ")",
]


@query("a26_candidate_summary", over("feat", _SUMMARY, *_SCORES_TABLE))
def _(spark, folder):
    return T.candidate_summary(grid_scores(spark, folder))


@query(
    "w6_best_candidate",
    over(
        "feat",
        f"""SELECT candidate, {real('m', 'mean_month_mae')} FROM (SELECT candidate, avg(mae) AS m FROM sc GROUP BY 1)
        ORDER BY m, candidate LIMIT 1""",
        *_SCORES_TABLE,
    ),
)
def _(spark, folder):
    return T.best(T.candidate_summary(grid_scores(spark, folder)))


@query(
    "j11_candidate_pivot",
    over(
        "feat",
        "SELECT month, "
        + ", ".join(real(f"max(mae) FILTER (WHERE candidate = '{c.name}')", c.name) for c in B.CANDIDATES)
        + ", "
        + ", ".join(
            real(
                f"(1 - max(mae) FILTER (WHERE candidate = '{c.name}') / max(mae) FILTER (WHERE candidate = 'original_grouped')) * 100",
                f"gain_{c.name}",
            )
            for c in B.CANDIDATES
            if c is not ORIGINAL
        )
        + " FROM sc GROUP BY month",
        *_SCORES_TABLE,
    ),
    text=("month",),
)
def _(spark, folder):
    return T.pivoted_gains(grid_scores(spark, folder), [c.name for c in B.CANDIDATES])


# The winner of the monthly cycle, its weekly cycle, and the winner of both, chosen in SQL.
_FIRST = """w1 AS (SELECT candidate FROM (SELECT candidate, avg(mae) AS m FROM sc GROUP BY 1)
  ORDER BY m, candidate LIMIT 1)"""
_WEEKLY = [
    part
    for c in B.CANDIDATES
    for part in H.backtest(f"w_{c.name}", c, B.week_cutoffs(DEV), H.WEEK, f"{_DEV_ROWS} AND '{c.name}' = (SELECT candidate FROM w1)")
]
_CYCLES = [
    *_SCORES_TABLE,
    _FIRST,
    *_WEEKLY,
    "cyc AS (SELECT candidate, month, mae FROM sc UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{c.name}_weekly' AS candidate, month, avg({_ERROR}) AS mae FROM w_{c.name}_pred GROUP BY month" for c in B.CANDIDATES
    )
    + ")",
    """w2 AS (SELECT candidate, m FROM (SELECT candidate, avg(mae) AS m FROM cyc GROUP BY 1)
      ORDER BY m, candidate LIMIT 1)""",
]


def selection(spark, folder):
    """The search over both cycles, once per session and state of the tables."""
    return remembered("selection", lambda s, f: T.select_cycles(feature_table(s, f), first=grid_scores(s, f)), spark, folder)


@query(
    "m13_weekly_backtest",
    over(
        "feat",
        " UNION ALL ".join(
            f"SELECT '{c.name}_weekly' AS candidate, month, {H.metric_columns(_ERROR)} FROM w_{c.name}_pred GROUP BY month"
            for c in B.CANDIDATES
        ),
        *_CYCLES,
    ),
    text=("month",),
)
def _(spark, folder):
    found = selection(spark, folder)
    return found.scores.where(F.col("candidate") == found.first.name + T.WEEKLY)


@query(
    "m14_select_over_cycles",
    over("feat", f"SELECT candidate, {real('m', 'mean_month_mae')} FROM w2", *_CYCLES),
)
def _(spark, folder):
    return T.best(T.candidate_summary(selection(spark, folder).scores))


@query(
    "m18_final_model",
    over(
        "feat",
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c.name}' AS candidate, * FROM ({part})" for c in B.CANDIDATES for part in _levels(f"f_{c.name}")
        )
        + ") WHERE candidate = (SELECT replace(candidate, '_weekly', '') FROM w2)",
        *_CYCLES,
        *[
            part
            for c in B.CANDIDATES
            for part in (H.cut_list(f"f_{c.name}", c, [dt.date(2026, 7, 3)]), *H.tables(f"f_{c.name}", c))
        ],
    ),
)
def _(spark, folder):
    found = selection(spark, folder)
    model = T.final_model(feature_table(spark, folder), found)
    return levels_of(model, found.config).withColumn("candidate", F.lit(found.config.name))


_HISTORY = [
    part
    for n in T.CROSS_FIT
    for part in H.backtest(f"h_{n}", B.BY_NAME[n], B.week_cutoffs(S.CROSS_FIT_MONTHS), H.WEEK, "month >= DATE '2026-02-01'")
]
_HISTORY_JOIN = """hist AS (SELECT a.*, a.est AS est_original_grouped, b.est AS est_schedule_slot, c.est AS est_day_type,
  ln(1 + b.support) AS support_log, b.depth AS slot_depth
  FROM h_original_grouped_pred a JOIN h_schedule_slot_pred b ON a.event_key = b.event_key
  JOIN h_day_type_pred c ON a.event_key = c.event_key)"""


@query(
    "m19_cross_fitted_history",
    over(
        "feat",
        f"""SELECT event_key, cutoff, {real('est_original_grouped', 'est_original_grouped')},
        {real('est_schedule_slot', 'est_schedule_slot')}, {real('est_day_type', 'est_day_type')},
        {real('support_log', 'support_log')}, CAST(slot_depth AS INTEGER) AS depth FROM hist""",
        *_HISTORY,
        _HISTORY_JOIN,
    ),
    text=("cutoff",),
)
def _(spark, folder):
    return T.cross_fitted_history(feature_table(spark, folder)).select(
        "event_key", "cutoff", "est_original_grouped", "est_schedule_slot", "est_day_type", "support_log", "depth"
    )


# ---- audits: the weekly exact-minute estimate stands in for the corrected one ---------------

_DETAIL = [
    *H.backtest("db", ORIGINAL, B.month_cutoffs(ALL), "month", _ALL_ROWS),
    *H.backtest("dc", SLOT, B.week_cutoffs(ALL), H.WEEK, _ALL_ROWS),
    """detail AS (SELECT c.event_key, c.month, c.service_date, c.route_name, c.weekday, c.scheduled_minute_of_service_day,
      CAST(c.scheduled_minute_of_service_day // 60 AS INTEGER) AS hour, c.departure_delay_seconds,
      c.est AS prediction, b.est AS baseline_prediction, abs(c.departure_delay_seconds - c.est) AS error,
      abs(c.departure_delay_seconds - b.est) AS baseline_error, abs(c.departure_delay_seconds - c.est) <= 120 AS within120
      FROM dc_pred c JOIN db_pred b ON c.event_key = b.event_key)""",
]


def detail(spark, folder):
    return T.audit_detail(feature_table(spark, folder), SLOT, refresh="week")


_DETAIL_COLUMNS = f"""SELECT event_key, month, service_date, route_name, weekday, scheduled_minute_of_service_day, hour,
departure_delay_seconds, {real('prediction', 'prediction')}, {real('baseline_prediction', 'baseline_prediction')},
{real('error', 'error')}, {real('baseline_error', 'baseline_error')}, within120 FROM detail"""


@query("m24_audit_detail", over("feat", _DETAIL_COLUMNS, *_DETAIL), text=("month", "service_date"))
def _(spark, folder):
    return detail(spark, folder)


_WON = "(SELECT candidate FROM w2)"


@query(
    "m15_winner_detail",
    over(
        "feat",
        " UNION ALL ".join(
            f"""SELECT '{label}' AS candidate, c.event_key, c.month, {real('c.est', 'prediction')},
            {real('b.est', 'baseline_prediction')} FROM {prefix}_pred c JOIN db_pred b ON c.event_key = b.event_key"""
            for c in B.CANDIDATES
            for label, prefix in ((c.name, f"dm_{c.name}"), (f"{c.name}_weekly", f"dw_{c.name}"))
        ),
        *_CYCLES,
        *H.backtest("db", ORIGINAL, B.month_cutoffs(ALL), "month", _ALL_ROWS),
        *[
            part
            for c in B.CANDIDATES
            for part in (
                *H.backtest(f"dm_{c.name}", c, B.month_cutoffs(ALL), "month", f"{_ALL_ROWS} AND '{c.name}' = {_WON}"),
                *H.backtest(f"dw_{c.name}", c, B.week_cutoffs(ALL), H.WEEK, f"{_ALL_ROWS} AND '{c.name}_weekly' = {_WON}"),
            )
        ],
    ),
    text=("month",),
)
def _(spark, folder):
    found = selection(spark, folder)
    rows = T.audit_detail(feature_table(spark, folder), found.config, refresh=found.refresh)
    return rows.select(F.lit(found.name).alias("candidate"), "event_key", "month", "prediction", "baseline_prediction")


@query(
    "a23_daily_errors",
    over(
        "feat",
        f"""SELECT month, service_date, {whole('count(*)', 'rows')}, {real('sum(error)', 'error_sum')},
        {real('sum(baseline_error)', 'baseline_error_sum')} FROM detail GROUP BY month, service_date""",
        *_DETAIL,
    ),
    text=("month", "service_date"),
)
def _(spark, folder):
    return M.daily_errors(detail(spark, folder))


_TABLE = f"""{whole('count(*)', 'rows')}, {real('avg(error)', 'mae')}, {real('avg(baseline_error)', 'baseline_mae')},
{real('avg(CAST(within120 AS INTEGER))', 'within120')}"""


@query(
    "a24_route_errors",
    over("feat", f"SELECT month, route_name, {_TABLE} FROM detail GROUP BY month, route_name", *_DETAIL),
    text=("month",),
)
def _(spark, folder):
    return M.error_table(detail(spark, folder), "month", "route_name")


@query(
    "a25_hour_errors",
    over("feat", f"SELECT hour, {_TABLE} FROM detail WHERE {_DEV_ROWS} GROUP BY hour", *_DETAIL),
)
def _(spark, folder):
    return M.error_table(P.development(detail(spark, folder)), "hour")


@query(
    "a25b_weekday_errors",
    over("feat", f"SELECT weekday, {_TABLE} FROM detail WHERE {_DEV_ROWS} GROUP BY weekday", *_DETAIL),
)
def _(spark, folder):
    return M.error_table(P.development(detail(spark, folder)), "weekday")


_METHODS = {"original_grouped": "db", "weekly_original_grouped": "wo", "selected": "dc"}


@query(
    "a27_method_scores",
    over(
        "feat",
        " UNION ALL ".join(
            f"SELECT '{m}' AS method, month, {H.metric_columns(_ERROR)} FROM {t}_pred GROUP BY month" for m, t in _METHODS.items()
        ),
        *_DETAIL,
        *H.backtest("wo", ORIGINAL, B.week_cutoffs(ALL), H.WEEK, _ALL_ROWS),
    ),
    text=("month",),
)
def _(spark, folder):
    return P.method_scores(feature_table(spark, folder), SLOT, ALL)


_ROUTES = "routes AS (SELECT month, route_name, count(*) AS rows, avg(error) AS mae, avg(CAST(within120 AS INTEGER)) AS within120 FROM detail GROUP BY month, route_name)"
_SCREEN = """screened AS (SELECT route_name, count(*) AS months, min(rows) AS fewest_rows, max(mae) AS worst_mae,
 min(within120) AS worst_within120 FROM routes WHERE month < DATE '2026-06-01' GROUP BY route_name
 HAVING count(*) = 3 AND min(rows) >= 300 AND max(mae) <= 160 AND min(within120) >= 0.40)"""
SCREEN = {"rows": 300, "mae": 160.0, "within120": 0.40}


def _screened(spark, folder):
    rows = detail(spark, folder)
    return rows, A.reliable_routes(M.error_table(rows, "month", "route_name"), **SCREEN)


@query(
    "a28_reliable_routes",
    over(
        "feat",
        f"""SELECT route_name, {whole('months', 'months')}, {whole('fewest_rows', 'fewest_rows')}, {real('worst_mae', 'worst_mae')},
        {real('worst_within120', 'worst_within120')} FROM screened""",
        *_DETAIL,
        _ROUTES,
        _SCREEN,
    ),
)
def _(spark, folder):
    return _screened(spark, folder)[1]


@query(
    "j9_selected_routes",
    over(
        "feat",
        f"SELECT event_key, route_name, {real('error', 'error')} FROM detail WHERE route_name IN (SELECT route_name FROM screened)",
        *_DETAIL,
        _ROUTES,
        _SCREEN,
    ),
)
def _(spark, folder):
    return A.only_routes(*_screened(spark, folder)).select("event_key", "route_name", "error")


@query(
    "m25_subset_audit",
    over(
        "feat",
        f"""SELECT month, {H.metric_columns('error')},
        {real("count(*) * 1.0 / (SELECT count(*) FROM detail WHERE month = DATE '2026-06-01')", 'coverage')} FROM detail
        WHERE month = DATE '2026-06-01' AND route_name IN (SELECT route_name FROM screened) GROUP BY month""",
        *_DETAIL,
        _ROUTES,
        _SCREEN,
    ),
    text=("month",),
)
def _(spark, folder):
    return A.subset_audit(*_screened(spark, folder))


_BOOT = """days AS (SELECT month, service_date, count(*) AS rows, sum(baseline_error) - sum(error) AS gain FROM detail GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY service_date) AS place, count(*) OVER (PARTITION BY month) AS n FROM days),
picks AS (SELECT p.month, r.rep, p.place AS pick,
  CAST('0x' || substr(md5('42-' || CAST(p.month AS VARCHAR) || '-' || r.rep || '-' || p.place), 1, 8) AS BIGINT) % p.n + 1 AS place
  FROM placed p, range(1, 2001) r(rep)),
reps AS (SELECT k.month, k.rep, sum(p.gain) / sum(p.rows) AS g FROM picks k JOIN placed p ON k.month = p.month AND k.place = p.place GROUP BY 1, 2),
bounds AS (SELECT month, quantile_cont(g, 0.025) AS lo, quantile_cont(g, 0.975) AS hi FROM reps GROUP BY 1)"""


@query(
    "m16_day_bootstrap",
    over(
        "feat",
        f"""SELECT p.month, {real('sum(p.gain) / sum(p.rows)', 'mae_gain')}, {real('any_value(b.lo)', 'lower95')},
        {real('any_value(b.hi)', 'upper95')}, {whole('count(*) FILTER (WHERE p.gain > 0)', 'days_improved')}, {whole('count(*)', 'days')}
        FROM placed p JOIN bounds b ON p.month = b.month GROUP BY p.month""",
        *_DETAIL,
        _BOOT,
    ),
    text=("month",),
)
def _(spark, folder):
    return A.day_bootstrap(M.daily_errors(detail(spark, folder)))


@query(
    "m17_gates",
    over(
        "feat",
        f"""SELECT {real('avg((1 - mae / bmae) * 100)', 'mean_of_gains')}, {real('(1 - avg(mae) / avg(bmae)) * 100', 'gain_of_means')},
        bool_and(mae < bmae) AS better_every_month, avg((1 - mae / bmae) * 100) >= 5 AND bool_and(mae < bmae) AS search_gate_passed,
        (1 - avg(mae) / avg(bmae)) * 100 >= 5 AND bool_and(mae < bmae) AS audit_gate_passed
        FROM (SELECT month, avg(error) AS mae, avg(baseline_error) AS bmae FROM detail WHERE {_DEV_ROWS} GROUP BY month)""",
        *_DETAIL,
    ),
)
def _(spark, folder):
    return A.gate(P.gain_table(detail(spark, folder)))


_BLENDS = f"""blends AS (SELECT w.boost_weight, d.month, abs(d.departure_delay_seconds - (w.boost_weight * d.prediction
  + (1 - w.boost_weight) * d.baseline_prediction)) AS error FROM detail d
  CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) w(boost_weight) WHERE {_DEV_ROWS})"""


@query(
    "m26_blend_search",
    over("feat", f"SELECT boost_weight, month, {H.metric_columns('error')} FROM blends GROUP BY boost_weight, month", *_DETAIL, _BLENDS),
    text=("month",),
)
def _(spark, folder):
    return A.blend_scores(detail(spark, folder))


_FINAL = [
    *_DETAIL,
    _BLENDS,
    """pick AS (SELECT boost_weight FROM (SELECT boost_weight, avg(mae) AS mae FROM (SELECT boost_weight, month, avg(error) AS mae
      FROM blends GROUP BY 1, 2) GROUP BY 1) ORDER BY mae, boost_weight LIMIT 1)""",
    """fin AS (SELECT d.*, p.boost_weight, abs(d.departure_delay_seconds - (p.boost_weight * d.prediction
      + (1 - p.boost_weight) * d.baseline_prediction)) AS final_error FROM detail d, pick p)""",
    *H.backtest("wo", ORIGINAL, B.week_cutoffs(ALL), H.WEEK, _ALL_ROWS),
    f"wk AS (SELECT month, avg({_ERROR}) AS weekly_baseline_mae FROM wo_pred GROUP BY month)",
]


@query(
    "m27_final_scores",
    over(
        "feat",
        f"""SELECT f.month, any_value(f.boost_weight) AS boost_weight, {H.metric_columns('final_error')},
        {real('avg(baseline_error)', 'baseline_mae')}, {real('any_value(wk.weekly_baseline_mae)', 'weekly_baseline_mae')},
        {real('(1 - avg(final_error) / avg(baseline_error)) * 100', 'gain_percent')}
        FROM fin f JOIN wk ON f.month = wk.month GROUP BY f.month""",
        *_FINAL,
    ),
    text=("month",),
)
def _(spark, folder):
    return P.final_scores(feature_table(spark, folder), SLOT, ALL)


@query(
    "j10_weekly_control",
    over(
        "feat",
        f"""SELECT b.month, {real('b.mae', 'baseline_mae')}, {real('w.weekly_baseline_mae', 'weekly_baseline_mae')},
        {real('(1 - w.weekly_baseline_mae / b.mae) * 100', 'gain_percent')} FROM
        (SELECT month, avg(baseline_error) AS mae FROM detail GROUP BY month) b JOIN wk w ON b.month = w.month""",
        *_FINAL,
    ),
    text=("month",),
)
def _(spark, folder):
    return P.weekly_control(feature_table(spark, folder), ALL)


@query(
    "u1_union_of_splits",
    over("feat", f"SELECT {whole('count(*)', 'rows')}, {whole('sum(departure_delay_seconds)', 'delay_sum')} FROM feat WHERE data_split IN ('train', 'validation')"),
)
def _(spark, folder):
    rows = feature_table(spark, folder)
    parts = [rows.where(F.col("data_split") == s) for s in ("train", "validation")]
    return parts[0].unionByName(parts[1]).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(S.TARGET).alias("delay_sum")
    )


@query(
    "u4_seeded_sample",
    over("feat", "SELECT event_key FROM feat ORDER BY md5(event_key || '-42'), event_key LIMIT 5000"),
)
def _(spark, folder):
    return sample_rows(feature_table(spark, folder), "event_key", 5000).select("event_key")


_CODE_SOURCES = {"route_name": "route_name", "direction_code": "direction_code", "stop_id": "stop_id"}


@query(
    "m20_ordinal_codes",
    over(
        "feat",
        "SELECT f.event_key, "
        + ", ".join(f"CAST(c_{c}.code AS DOUBLE) AS code_{c}" for c in _CODE_SOURCES)
        + " FROM feat f "
        + " ".join(f"LEFT JOIN c_{c} ON coalesce(f.{c}, '<MISSING>') = c_{c}.value" for c in _CODE_SOURCES)
        + "",
        *[
            f"c_{c} AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM "
            f"(SELECT DISTINCT coalesce({c}, '<MISSING>') AS value FROM feat WHERE data_split = 'train'))"
            for c in _CODE_SOURCES
        ],
    ),
)
def _(spark, folder):
    rows = feature_table(spark, folder)
    tables = ordinal_codes(rows.where(F.col("data_split") == "train"), list(_CODE_SOURCES))
    coded = encode_ordinal(rows, tables)
    return coded.select("event_key", *[f"code_{c}" for c in _CODE_SOURCES])


# ---- requests --------------------------------------------------------------------------------


def requests(spark, folder):
    """Every departure asks for an estimate; some ask for what cannot be answered."""
    r = F.col("stop_sequence")
    late = F.col("scheduled_minute_of_service_day") == 1440
    return feature_table(spark, folder).select(
        "event_key",
        F.when(late, F.date_add("service_date", 200)).otherwise(F.col("service_date")).alias("service_date"),
        "route_name", "stop_id", "direction_code",
        F.when(r == 6, 0).otherwise(r).alias("stop_sequence"),
        F.when(r == 5, F.col("scheduled_minute_of_service_day") + 2880)
        .otherwise(F.col("scheduled_minute_of_service_day"))
        .alias("scheduled_minute_of_service_day"),
        F.weekday("service_date").alias("weekday"),
        C.day_type(F.weekday("service_date")).alias("day_type"),
    )


_REQUESTS = [
    """req AS (SELECT event_key, CASE WHEN scheduled_minute_of_service_day = 1440 THEN CAST(service_date + INTERVAL 200 DAY AS DATE)
      ELSE service_date END AS service_date, route_name, stop_id, direction_code,
      CASE WHEN stop_sequence = 6 THEN 0 ELSE stop_sequence END AS stop_sequence,
      CASE WHEN stop_sequence = 5 THEN scheduled_minute_of_service_day + 2880 ELSE scheduled_minute_of_service_day END
        AS scheduled_minute_of_service_day, weekday, day_type FROM feat)""",
    """judged AS (SELECT *, CAST(date_trunc('month', service_date) AS DATE) AS month, CASE WHEN service_date < DATE '2026-06-01' THEN 'before correction start'
      WHEN scheduled_minute_of_service_day NOT BETWEEN 0 AND 2879 THEN 'minute outside service day'
      WHEN stop_sequence < 1 THEN 'stop sequence below one'
      WHEN service_date > (SELECT max(service_date) FROM feat) + INTERVAL 14 DAY THEN 'history older than 14 days' END AS rejected FROM req)""",
]


@query("m29_request_guards", over("feat", "SELECT event_key, rejected FROM judged", *_REQUESTS))
def _(spark, folder):
    return scoring.judge(requests(spark, folder), feature_table(spark, folder)).select("event_key", "rejected")


_ASKED_MONTHS = ["2026-06-01", "2026-07-01"]
_SCORED = [
    *_REQUESTS,
    *H.backtest("rb", ORIGINAL, B.month_cutoffs(_ASKED_MONTHS), "month", "rejected IS NULL", rows="judged"),
    *[
        part
        for n in T.CROSS_FIT
        for part in H.backtest(f"r_{n}", B.BY_NAME[n], B.week_cutoffs(_ASKED_MONTHS), H.WEEK, "rejected IS NULL", rows="judged")
    ],
]


@query(
    "m28_request_estimates",
    over(
        "feat",
        f"""SELECT b.event_key, {real('b.est', 'baseline_prediction')}, {real('o.est', 'est_original_grouped')},
        {real('s.est', 'est_schedule_slot')}, {real('d.est', 'est_day_type')}, {whole('s.support', 'historical_group_records')},
        CAST(s.depth AS INTEGER) AS depth, CAST(s.cutoff - 2 AS DATE) AS history_before
        FROM rb_pred b JOIN r_original_grouped_pred o ON b.event_key = o.event_key
        JOIN r_schedule_slot_pred s ON b.event_key = s.event_key JOIN r_day_type_pred d ON b.event_key = d.event_key""",
        *_SCORED,
    ),
    text=("history_before",),
)
def _(spark, folder):
    rows = feature_table(spark, folder)
    return scoring.historical_estimates(requests(spark, folder), rows).select(
        "event_key", "baseline_prediction", "est_original_grouped", "est_schedule_slot", "est_day_type",
        "historical_group_records", "depth", "history_before",
    )


@query(
    "m31_request_equals_backtest",
    over(
        "feat",
        f"SELECT {whole('count(*)', 'rows')}, {whole('0', 'baseline_differs')}, {whole('0', 'estimate_differs')} FROM feat WHERE data_split = 'test'",
    ),
)
def _(spark, folder):
    rows = feature_table(spark, folder)
    live = scoring.historical_estimates(rows.where(F.col("data_split") == "test"), rows)
    return P.request_against_backtest(live, T.audit_detail(rows, SLOT, refresh="week"))
