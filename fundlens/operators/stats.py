"""Time-series statistics over yearly funding.

Inputs are yearly aggregates: one row per (series, year), so windows over a series run
on at most one row per year. ``series`` names optional grouping columns (e.g. ministry)
so the same plan computes statistics for many series at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.operators import trends


def _w(series):
    return Window.partitionBy(*series).orderBy("year") if series else Window.orderBy("year")


def yearly_window(projects: DataFrame, from_year: int, to_year: int | None,
                  series: list[str] | None = None) -> DataFrame:
    y = trends.yearly_series(projects, series).where(F.col("year") >= from_year)
    return y.where(F.col("year") <= to_year) if to_year is not None else y


def yoy_changes(yearly: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Percent change and absolute change against the previous year present.

    A previous value of 0 gives NULL, not infinity.
    """
    series = series or []
    prev = F.lag("funding").over(_w(series))
    return yearly.select(*series, "year", "funding",
                         (F.try_divide(F.col("funding") - prev, prev) * 100.0).alias("yoy_change"),
                         (F.col("funding") - prev).alias("yoy_abs_change"))


def volatility_metrics(changes: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Mean, sample std, max and min of the year-over-year changes."""
    series = series or []
    c = F.col("yoy_change")
    g = changes.where(c.isNotNull())
    g = g.groupBy(*series) if series else g.groupBy()
    return g.agg(F.avg(c).alias("yoy_mean"), F.stddev_samp(c).alias("yoy_std"),
                 F.max(c).alias("max_gain"), F.min(c).alias("max_loss"), F.count(c).alias("n_changes"))


def volatility_anomalies(changes: DataFrame, factor: float = 1.5) -> DataFrame:
    """Years whose |change| exceeds factor x the std of all changes (I4)."""
    std = changes.agg(F.stddev_samp("yoy_change")).scalar()
    return (changes.where(F.abs("yoy_change") > std * factor)
            .select("year", "yoy_change", (std * factor).alias("threshold")))


def linear_trend(yearly: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Least-squares slope and intercept of funding on year, and R^2."""
    series = series or []
    y, x = F.col("funding"), F.col("year").cast("double")
    g = yearly.groupBy(*series) if series else yearly.groupBy()
    return g.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                 F.pow(F.corr(x, y), 2).alias("r_squared"), F.count(y).alias("n_years"))


def coefficient_of_variation(yearly: DataFrame) -> DataFrame:
    """std / mean * 100 of yearly funding."""
    return yearly.agg((F.try_divide(F.stddev_samp("funding"), F.avg("funding")) * 100.0).alias("volatility_pct"))


def time_axis_split(projects: DataFrame, current_year: int) -> DataFrame:
    """Past / current / future years relative to ``current_year`` (E9), in one pass."""
    y = F.col("start_year")
    period = (F.when(y < current_year, F.lit("past"))
              .when(y == current_year, F.lit("current")).otherwise(F.lit("future")))
    return (projects.where(y.isNotNull()).groupBy(period.alias("period"))
            .agg(F.countDistinct(y).alias("n_years"), F.min(y).alias("first_year"), F.max(y).alias("last_year"),
                 F.sum("amount").cast("double").alias("funding"), F.count("amount").alias("projects")))


def recent_averages(projects: DataFrame, current_year: int, window: int = 10) -> DataFrame:
    """Average yearly funding and projects over the ``window`` years before the current."""
    y = trends.yearly_series(projects).where(
        (F.col("year") >= current_year - window) & (F.col("year") < current_year))
    return y.agg(F.avg("funding").alias("avg_funding"), F.avg("projects").alias("avg_projects"),
                 F.count(F.lit(1)).alias("n_years"))


def half_trend(projects: DataFrame, current_year: int, window: int = 10) -> DataFrame:
    """Mean of the first half vs the second half of the recent years.

    With n years, each half has n // 2 rows; the middle year of an odd n is in neither.
    """
    y = trends.yearly_series(projects).where(
        (F.col("year") >= current_year - window) & (F.col("year") < current_year))
    w = Window.orderBy("year")
    ranked = (y.withColumn("_i", F.row_number().over(w))
              .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())))
    half = F.floor(F.col("_n") / 2)
    r = ranked.agg(F.avg(F.when(F.col("_i") <= half, F.col("funding"))).alias("first_half_mean"),
                   F.avg(F.when(F.col("_i") > F.col("_n") - half, F.col("funding"))).alias("second_half_mean"),
                   F.max("_n").alias("n_years"))
    return r.withColumn("trend", F.when(F.col("n_years") < 2, F.lit(None).cast("string"))
                        .when(F.col("second_half_mean") > F.col("first_half_mean"), F.lit("increasing"))
                        .otherwise(F.lit("decreasing")))
