"""Registered queries for trends, duration, keywords, statistics and forecast.

Values that come from inherently order-sensitive floating-point work (means of doubles,
medians, standard deviations, regressions) are rounded to a fixed number of decimals so
that two engines agree on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.operators import duration as D
from fundlens.operators import forecast as FC
from fundlens.operators import keywords as K
from fundlens.operators import stats as S
from fundlens.operators import trends as TR
from fundlens.plans.params import DRIVER_PARAMS as P
from fundlens.plans.registry import projects, query
from fundlens.sources import tables


def rounded(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- trends -----------------------------------------------------------------

@query("yearly_totals")
def q_yearly_totals(spark, sf):
    return TR.yearly_totals(projects(spark, sf))


@query("ministry_year_dense")
def q_ministry_year_dense(spark, sf):
    return TR.ministry_year_dense(projects(spark, sf))


@query("monthly_distribution")
def q_monthly_distribution(spark, sf):
    return TR.monthly_distribution(projects(spark, sf))


@query("decade_ministry_share")
def q_decade_ministry_share(spark, sf):
    return TR.decade_ministry_share(projects(spark, sf))


@query("yoy_growth")
def q_yoy_growth(spark, sf):
    return TR.yoy_growth(projects(spark, sf), P.yoy_from)


@query("entity_trends_state")
def q_entity_trends_state(spark, sf):
    return TR.entity_trends(projects(spark, sf), "state", 20)


@query("entity_trends_city")
def q_entity_trends_city(spark, sf):
    return TR.entity_trends(projects(spark, sf), "city", 30, modal="state")


@query("entity_trends_recipient")
def q_entity_trends_recipient(spark, sf):
    return TR.entity_trends(projects(spark, sf), "recipient", 50)


# --- duration ---------------------------------------------------------------

@query("duration_by_ministry")
def q_duration_by_ministry(spark, sf):
    return rounded(D.duration_by_ministry(projects(spark, sf)), ["mean_months", "median_months", "std_months"], 6)


@query("duration_overall")
def q_duration_overall(spark, sf):
    return rounded(D.duration_overall(projects(spark, sf)), ["mean_months", "median_months"], 6)


@query("duration_histogram")
def q_duration_histogram(spark, sf):
    return D.duration_histogram(projects(spark, sf))


# --- keywords ---------------------------------------------------------------

@query("keyword_top")
def q_keyword_top(spark, sf):
    return K.keyword_top(projects(spark, sf), 100)


@query("keyword_trends")
def q_keyword_trends(spark, sf):
    return K.keyword_trends(projects(spark, sf), 50)


@query("keyword_reconcile_all")
def q_keyword_reconcile_all(spark, sf):
    return K.keyword_reconcile_all(projects(spark, sf))


@query("keyword_reconcile")
def q_keyword_reconcile(spark, sf):
    return K.keyword_reconcile(projects(spark, sf), 50)


@query("keyword_cloud")
def q_keyword_cloud(spark, sf):
    return K.keyword_cloud(projects(spark, sf), 100, 50, 50)


@query("document_keyword_top")
def q_document_keyword_top(spark, sf):
    """The title tokenizer over every document's whole text."""
    return K.keyword_top(tables.table(spark, sf, "documents"), 100, text="text")


# --- statistics -------------------------------------------------------------

def _vol_changes(spark, sf):
    y = S.yearly_window(projects(spark, sf), P.volatility_from, P.current_year)
    return S.yoy_changes(y)


@query("volatility_changes")
def q_volatility_changes(spark, sf):
    return rounded(_vol_changes(spark, sf), ["yoy_change"], 6)


@query("volatility_metrics")
def q_volatility_metrics(spark, sf):
    return rounded(S.volatility_metrics(_vol_changes(spark, sf)), ["yoy_mean", "yoy_std", "max_gain", "max_loss"], 6)


@query("volatility_anomalies")
def q_volatility_anomalies(spark, sf):
    return rounded(S.volatility_anomalies(_vol_changes(spark, sf), 1.5), ["yoy_change", "threshold"], 6)


@query("linear_trend")
def q_linear_trend(spark, sf):
    y = S.yearly_window(projects(spark, sf), P.volatility_from, P.current_year)
    df = S.linear_trend(y)
    return df.select(F.round("slope", 0).alias("slope"), F.round("intercept", 0).alias("intercept"),
                     F.round("r_squared", 6).alias("r_squared"), "n_years")


@query("ministry_linear_trend")
def q_ministry_linear_trend(spark, sf):
    y = S.yearly_window(projects(spark, sf), P.volatility_from, P.current_year, ["ministry"])
    df = S.linear_trend(y, ["ministry"])
    return df.select("ministry", F.round("slope", 0).alias("slope"), F.round("intercept", 0).alias("intercept"),
                     F.round("r_squared", 6).alias("r_squared"), "n_years")


@query("coefficient_of_variation")
def q_coefficient_of_variation(spark, sf):
    y = S.yearly_window(projects(spark, sf), P.train_from, P.current_year)
    return rounded(S.coefficient_of_variation(y), ["volatility_pct"], 6)


@query("time_axis_split")
def q_time_axis_split(spark, sf):
    return S.time_axis_split(projects(spark, sf), P.current_year)


@query("recent_averages")
def q_recent_averages(spark, sf):
    return rounded(S.recent_averages(projects(spark, sf), P.current_year, P.recent_window),
                   ["avg_funding", "avg_projects"], 4)


@query("half_trend")
def q_half_trend(spark, sf):
    return rounded(S.half_trend(projects(spark, sf), P.current_year, P.recent_window),
                   ["first_half_mean", "second_half_mean"], 4)


# --- forecast ---------------------------------------------------------------

_MONEY = ["predicted_funding", "lower_bound", "upper_bound"]


@query("forecast_trend")
def q_forecast_trend(spark, sf):
    return rounded(FC.trend_forecast(projects(spark, sf), P), _MONEY, 2)


@query("forecast_by_ministry")
def q_forecast_by_ministry(spark, sf):
    return rounded(FC.trend_forecast(projects(spark, sf), P, ["ministry"]), _MONEY, 2)


@query("forecast_changepoints")
def q_forecast_changepoints(spark, sf):
    df = FC.changepoint_forecast(projects(spark, sf), P, ["ministry"])
    return rounded(df, ["predicted_funding", "lower_bound", "upper_bound"], 2)


@query("forecast_backtest")
def q_forecast_backtest(spark, sf):
    df = FC.backtest(projects(spark, sf), P)
    return rounded(rounded(df, ["predicted"], 2), ["error_pct", "average_error_pct"], 6)


@query("forecast_summary")
def q_forecast_summary(spark, sf):
    df = FC.forecast_summary(projects(spark, sf), P)
    return rounded(rounded(df, ["total_predicted_funding_next_5_years"], 2), ["forecast_vs_approved_ratio"], 6)


@query("history_forecast_series")
def q_history_forecast_series(spark, sf):
    return rounded(FC.history_forecast_series(projects(spark, sf), P), ["predicted", "lower_bound", "upper_bound"], 2)
