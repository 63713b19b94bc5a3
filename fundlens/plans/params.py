"""Run parameters: the years and limits the analyses take as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    current_year: int = 2025        # last year with (partial) actuals
    yoy_from: int = 2010            # first year of the year-over-year growth list
    volatility_from: int = 2005     # first year of the volatility / linear-trend window
    train_from: int = 2000          # first training year of the forecast
    outlier_years: tuple = (2020, 2021)  # excluded from the forecast fit (not the backtest)
    horizon: int = 10               # forecast years after current_year
    holdout_years: int = 5          # backtest: train ..current_year-holdout, test the rest
    min_train_points: int = 10
    min_test_points: int = 3
    recent_window: int = 10         # "recent years" averages and half-vs-half trend
    interval_z: float = 1.959963984540054  # two-sided 95% normal quantile


# The driver's tables span order dates 1995-01 .. 2001-08; 1999 as "current year" leaves
# past, current and two "already approved" future years.
DRIVER_PARAMS = Params(current_year=1999, yoy_from=1996, volatility_from=1995, train_from=1995,
                       outlier_years=(1997,), horizon=5, holdout_years=2, min_train_points=3,
                       min_test_points=2, recent_window=4)
