"""Trend forecast with a 95% interval, approved-future comparison and backtest.

The model is a straight line in calendar DAYS (the start of each year as x), fitted by
least squares with Spark's ``regr_*`` aggregates in one group-by per series; the
interval is the ordinary prediction interval of that fit. Predictions are clamped at 0.
Future years are generated from each series' fit row (``explode(sequence(...))``), so
no join with a year table is needed. Training years: ``train_from..current_year`` minus
the outlier years; the backtest trains on ``train_from..current_year-holdout`` without
removing outliers and scores the holdout years by mean absolute percent error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.operators import trends
from fundlens.plans.params import Params


def day_number(year: Column) -> Column:
    """Days since 1970-01-01 of January 1st of the year."""
    return F.datediff(F.make_date(year, F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("double")


ALL = "_series"


def _series_yearly(projects: DataFrame, series: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Yearly (series..., year) -> funding, projects. Without series columns the whole
    register is one series, keyed by a constant so every step below is per-series."""
    if series:
        return trends.yearly_series(projects, series), list(series)
    return trends.yearly_series(projects).withColumn(ALL, F.lit("all")), [ALL]


def _out(df: DataFrame, series: list[str]) -> DataFrame:
    return df.drop(ALL) if series == [ALL] else df


def fit(train: DataFrame, series: list[str]) -> DataFrame:
    """Per-series OLS of funding on day number: slope, intercept and interval terms."""
    x, y = day_number(F.col("year")), F.col("funding")
    f = train.groupBy(*series).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("xbar"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    sse = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    return f.withColumn("sigma", F.when(F.col("n") > 2, F.sqrt(sse / (F.col("n") - 2))))


def predict(year: Column, z: float) -> list[Column]:
    x = day_number(year)
    yhat = F.col("intercept") + F.col("slope") * x
    dx = x - F.col("xbar")
    se = F.col("sigma") * F.sqrt(1.0 + 1.0 / F.col("n") + dx * dx / F.col("sxx"))
    return [yhat.alias("_yhat"), (yhat - z * se).alias("_lo"), (yhat + z * se).alias("_hi")]


def trend_forecast(projects: DataFrame, p: Params, series: list[str] | None = None) -> DataFrame:
    """Forecast ``current_year+1 .. current_year+horizon`` with interval and approved actuals.

    Output: [series...], year, predicted_funding, lower_bound, upper_bound,
    approved_funding, approved_projects.
    """
    yearly, keys = _series_yearly(projects, series)
    train = yearly.where((F.col("year") >= p.train_from) & (F.col("year") <= p.current_year)
                         & ~F.col("year").isin(*p.outlier_years))
    f = fit(train, keys)
    years = F.sequence(F.lit(p.current_year + 1), F.lit(p.current_year + p.horizon))
    fut = f.select(*keys, "slope", "intercept", "n", "xbar", "sxx", "sigma", F.explode(years).alias("year"))
    pred = fut.select(*keys, "year", *predict(F.col("year"), p.interval_z))
    approved = yearly.where(F.col("year") > p.current_year).select(
        *keys, "year", F.col("funding").alias("approved_funding"), F.col("projects").alias("approved_projects"))

    def clamp(c):  # NULL (series too short for a fit or an interval) stays NULL
        return F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0)))

    out = (pred.join(approved, keys + ["year"], "left")
           .select(*keys, "year",
                   clamp("_yhat").alias("predicted_funding"),
                   clamp("_lo").alias("lower_bound"),
                   clamp("_hi").alias("upper_bound"),
                   "approved_funding", "approved_projects"))
    return _out(out, keys)


def backtest(projects: DataFrame, p: Params, series: list[str] | None = None) -> DataFrame:
    """Train up to ``current_year - holdout``, predict the holdout years, score them.

    Output: [series...], year, predicted, actual, error_pct, average_error_pct. Empty for a
    series with fewer than ``min_train_points`` training or ``min_test_points`` test years.
    """
    yearly, keys = _series_yearly(projects, series)
    cut = p.current_year - p.holdout_years
    train = yearly.where((F.col("year") >= p.train_from) & (F.col("year") <= cut))
    test = yearly.where((F.col("year") > cut) & (F.col("year") <= p.current_year))
    f = fit(train, keys).where(F.col("n") >= p.min_train_points)
    n_test = test.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nt")).where(F.col("_nt") >= p.min_test_points)
    usable = f.join(n_test, keys)
    # one fit row per series joined to that series' holdout years (at most `holdout` rows)
    scored = test.join(usable, keys).select(
        *keys, "year", F.col("funding").alias("actual"),
        (F.col("intercept") + F.col("slope") * day_number(F.col("year"))).alias("predicted"))
    err = F.when(F.col("actual") > 0, F.abs(F.col("predicted") - F.col("actual")) / F.col("actual") * 100.0) \
        .otherwise(F.lit(0.0))
    scored = scored.withColumn("error_pct", err)
    avg = scored.groupBy(*keys).agg(F.avg("error_pct").alias("average_error_pct"))
    return _out(scored.join(avg, keys), keys)


def forecast_summary(projects: DataFrame, p: Params) -> DataFrame:
    """Predicted total of the first 5 forecast years, approved total, their ratio, and the
    historical range (I9, I10)."""
    fc = trend_forecast(projects, p)
    first5 = F.when(F.col("year") <= p.current_year + 5, F.col("predicted_funding"))
    s = fc.agg(F.sum(first5).alias("total_predicted_funding_next_5_years"),
               F.coalesce(F.sum("approved_funding"), F.lit(0.0)).alias("total_approved_funding_future"),
               F.sum("predicted_funding").alias("_pred_all"))
    first_year = trends.yearly_series(projects).agg(F.min("year")).scalar()
    return s.select("total_predicted_funding_next_5_years", "total_approved_funding_future",
                    F.when(F.col("total_approved_funding_future") > 0,
                           F.col("_pred_all") / F.col("total_approved_funding_future")).alias("forecast_vs_approved_ratio"),
                    first_year.alias("history_start"), F.lit(p.current_year).alias("history_end"),
                    F.lit(p.horizon).alias("forecast_horizon_years"))


def history_forecast_series(projects: DataFrame, p: Params, span: int = 10) -> DataFrame:
    """Recent history and forecast on one year axis.

    Output: year, actual, predicted, lower_bound, upper_bound, approved_funding. History rows
    (``current_year - span`` to ``current_year``) carry ``actual``; forecast rows carry the
    prediction and what is approved already (NULL if nothing). The last historical year there
    is carries both, its prediction equal to the actual, so the two lines meet.
    """
    hist = trends.yearly_series(projects).where(
        (F.col("year") >= p.current_year - span) & (F.col("year") <= p.current_year)).select(
        "year", F.col("funding").alias("actual"))
    meets = F.when(F.col("year") == hist.agg(F.max("year")).scalar(), F.col("actual"))
    hist = hist.select("year", "actual", *[meets.alias(c) for c in ("predicted", "lower_bound", "upper_bound")])
    approved = F.when(F.col("approved_funding") != 0, F.col("approved_funding"))
    fc = trend_forecast(projects, p).select("year", F.col("predicted_funding").alias("predicted"),
                                            "lower_bound", "upper_bound", approved.alias("approved_funding"))
    return hist.unionByName(fc, allowMissingColumns=True)


# --- I6, the form with changepoints -------------------------------------------

def changepoint_years(p: Params, changepoints: int) -> list[int]:
    """Years at which the slope may change: evenly over the first four fifths of the training years."""
    span = 0.8 * (p.current_year - p.train_from)
    return sorted({p.train_from + round(span * k / (changepoints + 1)) for k in range(1, changepoints + 1)} - {p.train_from})


def lasso(gram, xy, penalty: float, sweeps: int = 20_000, tolerance: float = 1e-12):
    """Coefficients, for many series at once, that minimise half the squared error plus ``penalty`` times the
    sum of the absolute coefficients from the third on, given X'X (series x m x m) and X'y (series x m).

    Coordinate descent: intercept and slope (not penalised) are solved together, then one changepoint
    after the other by soft thresholding, until nothing moves."""
    import numpy as np
    n, m = xy.shape
    b = np.zeros((n, m))
    base = np.linalg.pinv(gram[:, :2, :2], hermitian=True)
    for _ in range(sweeps):
        before = b.copy()
        rest = xy[:, :2] - np.einsum("sij,sj->si", gram[:, :2, 2:], b[:, 2:])
        b[:, :2] = np.einsum("sij,sj->si", base, rest)
        for k in range(2, m):
            size = gram[:, k, k]
            r = xy[:, k] - np.einsum("sj,sj->s", gram[:, k], b) + size * b[:, k]
            b[:, k] = np.sign(r) * np.maximum(np.abs(r) - penalty, 0) / np.where(size > 0, size, 1)
        if m == 2 or np.abs(b - before).max(initial=0) < tolerance:
            break
    return b


def changepoint_forecast(projects: DataFrame, p: Params, series: list[str] | None = None, changepoints: int = 8,
                         penalty: float = 0.05) -> DataFrame:
    """Forecast by a piecewise-linear trend per series: [series...], year, predicted_funding, lower_bound,
    upper_bound, slope_changes (changepoints whose slope change is not 0).

    The features (1, time, and time since each changepoint) meet in one group-by per series as the sums
    of their products, so a series is one row of fixed size however many years or projects it has; the
    L1-penalised fit works on those rows. Time runs from 0 to 1 over the training years and funding is scaled by
    its largest value, so one ``penalty`` suits all series. With no changepoints the fit is that of
    ``trend_forecast``. The interval is the residual deviation's; it and the bounds are NULL where no
    degrees of freedom are left. A series without training years gives no rows; predictions are clamped at 0."""
    yearly, keys = _series_yearly(projects, series)
    train = yearly.where((F.col("year") >= p.train_from) & (F.col("year") <= p.current_year)
                         & ~F.col("year").isin(*p.outlier_years) & F.col("funding").isNotNull())
    first, length = (day_number(F.lit(p.train_from)), day_number(F.lit(p.current_year)) - day_number(F.lit(p.train_from)))
    time = lambda year: (day_number(year) - first) / length
    knots = changepoint_years(p, changepoints) if changepoints else []

    def features(year: Column) -> list[Column]:
        return [F.lit(1.0), time(year), *[F.greatest(time(year) - time(F.lit(k)), F.lit(0.0)) for k in knots]]

    x, y, m = features(F.col("year")), F.col("funding").cast("double"), 2 + len(knots)
    products = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m)]
    sums = train.groupBy(*keys).agg(*products, *[F.sum(c * y).alias(f"r{i}") for i, c in enumerate(x)],
                                    F.sum(y * y).alias("yy"), F.max(F.abs(y)).alias("top"), F.count("*").alias("n"))
    solve, z = lasso, p.interval_z

    def fitted(frames):
        import numpy as np
        for f in frames:
            gram = np.empty((len(f), m, m))
            for i in range(m):
                for j in range(i, m):
                    gram[:, i, j] = gram[:, j, i] = f[f"g{i}_{j}"]
            top = np.where(f["top"] > 0, f["top"], 1.0)
            xy = np.stack([f[f"r{i}"] for i in range(m)], axis=1) / top[:, None]
            b = solve(gram, xy, penalty)
            sse = f["yy"] / top ** 2 - 2 * (b * xy).sum(1) + np.einsum("si,sij,sj->s", b, gram, b)
            moved = (b[:, 2:] != 0).sum(1)
            free = f["n"] - 2 - moved
            out = f[keys].copy()
            out["coefficients"] = list(b * top[:, None])
            out["sigma"] = np.where(free > 0, np.sqrt(np.maximum(sse, 0) / np.where(free > 0, free, 1)) * top, np.nan)
            out["slope_changes"] = moved
            yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys).schema.fields)
    fit_rows = sums.mapInPandas(fitted, f"{kinds}, coefficients array<double>, sigma double, slope_changes long")
    years = F.explode(F.sequence(F.lit(p.current_year + 1), F.lit(p.current_year + p.horizon)))
    fut = fit_rows.select("*", years.alias("year"))
    yhat = sum((F.col("coefficients")[i] * c for i, c in enumerate(features(F.col("year")))), F.lit(0.0))
    sigma = F.when(~F.isnan("sigma"), F.col("sigma"))
    floor = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    return _out(fut.select(*keys, "year", floor(yhat).alias("predicted_funding"), floor(yhat - z * sigma).alias("lower_bound"),
                           floor(yhat + z * sigma).alias("upper_bound"), "slope_changes"), keys)
