"""Oracle SQL for trends, duration, keywords, statistics and forecast."""

from __future__ import annotations

from fundlens import dims
from fundlens.plans.oracle import STATS, STATS_NO_AVG, STOPWORD_DIM, oracle, present, values_cte, with_projects
from fundlens.plans.params import DRIVER_PARAMS as P

MONTHS = "[" + ", ".join(f"'{m}'" for m in dims.MONTH_NAMES) + "]"
Z = repr(P.interval_z)


def cap(c: str) -> str:
    return f"(upper(substr({c}, 1, 1)) || lower(substr({c}, 2)))"


YEARLY = """yearly AS (
  SELECT start_year AS year, CAST(sum(amount) AS DOUBLE) AS funding, count(amount) AS projects
  FROM projects WHERE start_year IS NOT NULL GROUP BY start_year
)"""

# --- trends -------------------------------------------------------------------

oracle("yearly_totals", with_projects() + f"""
SELECT start_year AS year, {STATS} FROM projects WHERE start_year IS NOT NULL GROUP BY start_year
""")

oracle("ministry_year_dense", with_projects("""base AS (
  SELECT start_year AS year, ministry, amount FROM projects
  WHERE start_year IS NOT NULL AND ministry IS NOT NULL
)""") + """
SELECT ys.year, ms.ministry, CAST(coalesce(s.f, 0) AS DOUBLE) AS funding
FROM (SELECT DISTINCT year FROM base) ys
CROSS JOIN (SELECT DISTINCT ministry FROM base) ms
LEFT JOIN (SELECT year, ministry, sum(amount) AS f FROM base GROUP BY year, ministry) s
  ON s.year = ys.year AND s.ministry = ms.ministry
""")

oracle("monthly_distribution", with_projects() + f"""
SELECT start_month AS month, {MONTHS}[start_month] AS month_name, {STATS_NO_AVG}
FROM projects WHERE start_month IS NOT NULL GROUP BY start_month
""")

oracle("decade_ministry_share", with_projects("""a AS (
  SELECT decade, ministry, sum(amount) AS f FROM projects WHERE decade IS NOT NULL GROUP BY decade, ministry
)""", """t AS (SELECT decade, sum(f) AS tot FROM a GROUP BY decade)""") + """
SELECT a.decade, a.ministry, CAST(a.f AS DOUBLE) AS funding,
       CASE WHEN t.tot > 0 THEN CAST(a.f AS DOUBLE) / CAST(t.tot AS DOUBLE) * 100.0 ELSE 0.0 END AS share_pct
FROM a JOIN t ON a.decade = t.decade WHERE a.ministry IS NOT NULL
""")

oracle("yoy_growth", with_projects(YEARLY, f"""g AS (
  SELECT year, funding, lag(funding) OVER (ORDER BY year) AS prev FROM yearly WHERE year >= {P.yoy_from}
)""") + """
SELECT year, funding,
       CASE WHEN prev > 0 AND (funding - prev) / prev * 100.0 <> 0 THEN (funding - prev) / prev * 100.0 END AS growth_pct
FROM g
""")


def entity_sql(entity: str, k: int, modal: str | None = None) -> str:
    ctes = [f"""ey AS (
  SELECT {entity} AS name, start_year, sum(amount) AS f, count(amount) AS n
  FROM projects WHERE {entity} IS NOT NULL GROUP BY {entity}, start_year
)""", """tot AS (SELECT name, sum(f) AS tf, sum(n) AS tp FROM ey GROUP BY name)""",
            f"""top AS (
  SELECT * FROM (SELECT * FROM tot ORDER BY tf DESC, name LIMIT {k}) x WHERE {present('name')}
)"""]
    sel = """SELECT ey.name, ey.start_year AS year, CAST(ey.f AS DOUBLE) AS funding, ey.n AS projects,
       CAST(top.tf AS DOUBLE) AS total_funding, CAST(top.tp AS BIGINT) AS total_projects"""
    frm = "FROM ey JOIN top ON ey.name = top.name"
    if modal:
        ctes.append(f"""md AS (
  SELECT name, v FROM (
    SELECT {entity} AS name, {modal} AS v,
           row_number() OVER (PARTITION BY {entity} ORDER BY count(*) DESC, {modal}) AS rn
    FROM projects WHERE {entity} IN (SELECT name FROM top) AND {modal} IS NOT NULL
    GROUP BY {entity}, {modal}) z WHERE rn = 1
)""")
        sel += f", coalesce(md.v, '') AS {modal}"
        frm += " LEFT JOIN md ON md.name = ey.name"
    return with_projects(*ctes) + sel + "\n" + frm + "\nWHERE ey.start_year IS NOT NULL\n"


oracle("entity_trends_state", entity_sql("state", 20))
oracle("entity_trends_city", entity_sql("city", 30, "state"))
oracle("entity_trends_recipient", entity_sql("recipient", 50))

# --- duration -------------------------------------------------------------------

oracle("duration_by_ministry", with_projects() + """
SELECT ministry, round(avg(duration_months), 6) AS mean_months, round(median(duration_months), 6) AS median_months,
       round(stddev_samp(duration_months), 6) AS std_months, count(duration_months) AS project_count
FROM projects WHERE duration_months IS NOT NULL AND ministry IS NOT NULL GROUP BY ministry
""")

oracle("duration_overall", with_projects() + """
SELECT round(avg(duration_months), 6) AS mean_months, round(median(duration_months), 6) AS median_months,
       count(duration_months) AS total_analyzed
FROM projects WHERE duration_months IS NOT NULL
""")

_E = dims.DURATION_BIN_EDGES
_BINS = values_cte("bins", ["bin_id", "range"], [(i, dims.DURATION_BIN_LABELS[i]) for i in range(len(_E) - 1)])
_CASE = "CASE " + " ".join(f"WHEN duration_months > {float(_E[i])} AND duration_months <= {float(_E[i + 1])} THEN {i}"
                           for i in range(len(_E) - 1)) + " END"
oracle("duration_histogram", with_projects(_BINS, f"""c AS (
  SELECT bin_id, count(*) AS n FROM (SELECT {_CASE} AS bin_id FROM projects WHERE duration_months IS NOT NULL) q
  WHERE bin_id IS NOT NULL GROUP BY bin_id
)""") + """
SELECT CAST(b.bin_id AS INTEGER) AS bin_id, b.range, coalesce(c.n, 0) AS count FROM bins b LEFT JOIN c ON c.bin_id = b.bin_id
""")

# --- keywords ---------------------------------------------------------------------


def word_counts_cte(src: str, text: str) -> list[str]:
    return [STOPWORD_DIM, f"""toks AS (
  SELECT lower(w) AS word FROM (
    SELECT unnest(string_split_regex({text}, '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM {src} WHERE {text} IS NOT NULL
  ) s WHERE regexp_full_match(w, '[{dims.KEYWORD_LETTERS}]{{{dims.KEYWORD_MIN_RUN},}}')
)""", f"""wc AS (
  SELECT word, count(*) AS count FROM toks
  WHERE length(word) > {dims.KEYWORD_MIN_LEN_EXCLUSIVE} AND word NOT IN (SELECT word FROM stopword_dim)
  GROUP BY word
)"""]


oracle("keyword_top", with_projects(*word_counts_cte("projects", "title")) + f"""
SELECT {cap('word')} AS word, count FROM (SELECT word, count FROM wc ORDER BY count DESC, word LIMIT 100) t
""")

oracle("document_keyword_top", with_projects(*word_counts_cte("documents", "text")) + f"""
SELECT {cap('word')} AS word, count FROM (SELECT word, count FROM wc ORDER BY count DESC, word LIMIT 100) t
""")

KW50 = "kw AS (SELECT word, count FROM wc ORDER BY count DESC, word LIMIT 50)"
MATCH = """m AS (
  SELECT kw.word, p.start_year, p.amount FROM projects p JOIN kw ON contains(lower(p.title), kw.word)
  WHERE p.title IS NOT NULL
)"""

oracle("keyword_trends", with_projects(*word_counts_cte("projects", "title"), KW50, MATCH,
                                       "a AS (SELECT word, start_year, sum(amount) AS f, count(amount) AS n FROM m GROUP BY word, start_year)",
                                       "t AS (SELECT word, sum(f) AS tf, sum(n) AS tp FROM a GROUP BY word)") + f"""
SELECT {cap('a.word')} AS keyword, a.start_year AS year, CAST(a.f AS DOUBLE) AS funding, a.n AS projects,
       CAST(t.tf AS DOUBLE) AS total_funding, CAST(t.tp AS BIGINT) AS total_projects
FROM a JOIN t ON a.word = t.word WHERE a.start_year IS NOT NULL
""")

oracle("keyword_reconcile", with_projects(*word_counts_cte("projects", "title"), KW50, MATCH,
                                          "pm AS (SELECT word, count(*) AS n FROM m GROUP BY word)") + f"""
SELECT {cap('kw.word')} AS keyword, kw.count AS word_count, coalesce(pm.n, 0) AS project_matches,
       round(CAST(coalesce(pm.n, 0) AS DOUBLE) / nullif(CAST(kw.count AS DOUBLE), 0), 6) AS match_ratio
FROM kw LEFT JOIN pm ON pm.word = kw.word
""")

oracle("keyword_cloud", with_projects(*word_counts_cte("projects", "title"), KW50,
                                      "mx AS (SELECT max(count) AS m FROM kw)") + f"""
SELECT {cap('kw.word')} AS word, kw.count,
       CASE WHEN kw.count / mx.m > 0.7 THEN 'xl' WHEN kw.count / mx.m > 0.4 THEN 'lg'
            WHEN kw.count / mx.m > 0.2 THEN 'md' ELSE 'sm' END AS size_class,
       true AS has_trend
FROM kw, mx
""")

# --- statistics -----------------------------------------------------------------

VOL = f"""c AS (
  SELECT year, funding,
         (funding - lag(funding) OVER (ORDER BY year)) / nullif(lag(funding) OVER (ORDER BY year), 0) * 100.0 AS yoy_change,
         funding - lag(funding) OVER (ORDER BY year) AS yoy_abs_change
  FROM yearly WHERE year >= {P.volatility_from} AND year <= {P.current_year}
)"""

oracle("volatility_changes", with_projects(YEARLY, VOL) + """
SELECT year, funding, round(yoy_change, 6) AS yoy_change, yoy_abs_change FROM c
""")

oracle("volatility_metrics", with_projects(YEARLY, VOL) + """
SELECT round(avg(yoy_change), 6) AS yoy_mean, round(stddev_samp(yoy_change), 6) AS yoy_std,
       round(max(yoy_change), 6) AS max_gain, round(min(yoy_change), 6) AS max_loss, count(yoy_change) AS n_changes
FROM c WHERE yoy_change IS NOT NULL
""")

oracle("volatility_anomalies", with_projects(YEARLY, VOL, "s AS (SELECT stddev_samp(yoy_change) AS sd FROM c)") + """
SELECT year, round(yoy_change, 6) AS yoy_change, round(s.sd * 1.5, 6) AS threshold
FROM c, s WHERE abs(yoy_change) > s.sd * 1.5
""")

oracle("linear_trend", with_projects(YEARLY) + f"""
SELECT round(regr_slope(funding, CAST(year AS DOUBLE)), 0) AS slope,
       round(regr_intercept(funding, CAST(year AS DOUBLE)), 0) AS intercept,
       round(pow(corr(CAST(year AS DOUBLE), funding), 2), 6) AS r_squared, count(funding) AS n_years
FROM yearly WHERE year >= {P.volatility_from} AND year <= {P.current_year}
""")

oracle("ministry_linear_trend", with_projects(f"""my AS (
  SELECT ministry, start_year AS year, CAST(sum(amount) AS DOUBLE) AS funding FROM projects
  WHERE ministry IS NOT NULL AND start_year IS NOT NULL GROUP BY ministry, start_year
)""") + f"""
SELECT ministry, round(regr_slope(funding, CAST(year AS DOUBLE)), 0) AS slope,
       round(regr_intercept(funding, CAST(year AS DOUBLE)), 0) AS intercept,
       round(pow(corr(CAST(year AS DOUBLE), funding), 2), 6) AS r_squared, count(funding) AS n_years
FROM my WHERE year >= {P.volatility_from} AND year <= {P.current_year} GROUP BY ministry
""")

oracle("coefficient_of_variation", with_projects(YEARLY) + f"""
SELECT round(stddev_samp(funding) / avg(funding) * 100.0, 6) AS volatility_pct
FROM yearly WHERE year >= {P.train_from} AND year <= {P.current_year}
""")

oracle("time_axis_split", with_projects() + f"""
SELECT CASE WHEN start_year < {P.current_year} THEN 'past' WHEN start_year = {P.current_year} THEN 'current'
            ELSE 'future' END AS period,
       count(DISTINCT start_year) AS n_years, min(start_year) AS first_year, max(start_year) AS last_year,
       CAST(sum(amount) AS DOUBLE) AS funding, count(amount) AS projects
FROM projects WHERE start_year IS NOT NULL GROUP BY 1
""")

_RECENT = f"year >= {P.current_year - P.recent_window} AND year < {P.current_year}"
oracle("recent_averages", with_projects(YEARLY) + f"""
SELECT round(avg(funding), 4) AS avg_funding, round(avg(projects), 4) AS avg_projects, count(*) AS n_years
FROM yearly WHERE {_RECENT}
""")

oracle("half_trend", with_projects(YEARLY, f"""r AS (
  SELECT funding, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS n FROM yearly WHERE {_RECENT}
)""", """h AS (
  SELECT avg(CASE WHEN i <= floor(n / 2) THEN funding END) AS f1,
         avg(CASE WHEN i > n - floor(n / 2) THEN funding END) AS f2, max(n) AS n_years FROM r
)""") + """
SELECT round(f1, 4) AS first_half_mean, round(f2, 4) AS second_half_mean, n_years,
       CASE WHEN n_years < 2 THEN NULL WHEN f2 > f1 THEN 'increasing' ELSE 'decreasing' END AS trend
FROM h
""")

# --- forecast ---------------------------------------------------------------------


def xday(y: str) -> str:
    return f"CAST(date_diff('day', DATE '1970-01-01', make_date(CAST({y} AS BIGINT), 1, 1)) AS DOUBLE)"


def fit_ctes(series: str | None = None) -> list[str]:
    s = f"{series}, " if series else ""
    src = "sy" if series else "yearly"
    grp = f"GROUP BY {series}" if series else ""
    outl = ", ".join(str(y) for y in P.outlier_years)
    return [f"""train AS (
  SELECT {s}year, funding, {xday('year')} AS x FROM {src}
  WHERE year >= {P.train_from} AND year <= {P.current_year} AND year NOT IN ({outl})
)""", f"""f AS (
  SELECT {s}regr_slope(funding, x) AS slope, regr_intercept(funding, x) AS intercept,
         regr_count(funding, x) AS n, regr_avgx(funding, x) AS xbar, regr_sxx(funding, x) AS sxx,
         regr_syy(funding, x) AS syy, regr_sxy(funding, x) AS sxy
  FROM train {grp}
)""", """f2 AS (
  SELECT *, CASE WHEN n > 2 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0.0) / (n - 2)) END AS sigma FROM f
)""", f"""fut AS (
  SELECT f2.*, CAST(g.year AS INTEGER) AS year, {xday('g.year')} AS x
  FROM f2, (SELECT unnest(range({P.current_year + 1}, {P.current_year + P.horizon + 1})) AS year) g
)""", f"""pred AS (
  SELECT {s}year, intercept + slope * x AS yhat,
         sigma * sqrt(1.0 + 1.0 / n + (x - xbar) * (x - xbar) / sxx) AS se FROM fut
)"""]


FORECAST_SELECT = f"""CASE WHEN yhat IS NOT NULL THEN round(greatest(yhat, 0.0), 2) END AS predicted_funding,
       CASE WHEN se IS NOT NULL THEN round(greatest(yhat - {Z} * se, 0.0), 2) END AS lower_bound,
       CASE WHEN se IS NOT NULL THEN round(greatest(yhat + {Z} * se, 0.0), 2) END AS upper_bound"""

oracle("forecast_trend", with_projects(YEARLY, *fit_ctes()) + f"""
SELECT p.year, {FORECAST_SELECT}, a.funding AS approved_funding, a.projects AS approved_projects
FROM pred p LEFT JOIN yearly a ON a.year = p.year AND a.year > {P.current_year}
""")

oracle("forecast_by_ministry", with_projects(f"""sy AS (
  SELECT ministry, start_year AS year, CAST(sum(amount) AS DOUBLE) AS funding, count(amount) AS projects
  FROM projects WHERE ministry IS NOT NULL AND start_year IS NOT NULL GROUP BY ministry, start_year
)""", *fit_ctes("ministry")) + f"""
SELECT p.ministry, p.year, {FORECAST_SELECT}, a.funding AS approved_funding, a.projects AS approved_projects
FROM pred p LEFT JOIN sy a ON a.ministry = p.ministry AND a.year = p.year AND a.year > {P.current_year}
""")

_CUT = P.current_year - P.holdout_years
oracle("forecast_backtest", with_projects(YEARLY, f"""bt AS (
  SELECT regr_slope(funding, x) AS slope, regr_intercept(funding, x) AS intercept, regr_count(funding, x) AS n
  FROM (SELECT funding, {xday('year')} AS x FROM yearly WHERE year >= {P.train_from} AND year <= {_CUT}) q
)""", f"""test AS (SELECT year, funding AS actual, {xday('year')} AS x FROM yearly
  WHERE year > {_CUT} AND year <= {P.current_year})""",
    f"""ok AS (SELECT * FROM bt WHERE n >= {P.min_train_points} AND (SELECT count(*) FROM test) >= {P.min_test_points})""",
    """s AS (SELECT t.year, t.actual, ok.intercept + ok.slope * t.x AS predicted FROM test t, ok)""",
    """e AS (SELECT *, CASE WHEN actual > 0 THEN abs(predicted - actual) / actual * 100.0 ELSE 0.0 END AS err FROM s)""") + """
SELECT year, round(predicted, 2) AS predicted, actual, round(err, 6) AS error_pct,
       round((SELECT avg(err) FROM e), 6) AS average_error_pct
FROM e
""")

oracle("forecast_summary", with_projects(YEARLY, *fit_ctes(), f"""fc AS (
  SELECT p.year, greatest(yhat, 0.0) AS pf, a.funding AS af
  FROM pred p LEFT JOIN yearly a ON a.year = p.year AND a.year > {P.current_year}
)""") + f"""
SELECT round(sum(CASE WHEN year <= {P.current_year + 5} THEN pf END), 2) AS total_predicted_funding_next_5_years,
       coalesce(sum(af), 0.0) AS total_approved_funding_future,
       round(CASE WHEN coalesce(sum(af), 0.0) > 0 THEN sum(pf) / sum(af) END, 6) AS forecast_vs_approved_ratio,
       (SELECT min(year) FROM yearly) AS history_start, {P.current_year} AS history_end,
       {P.horizon} AS forecast_horizon_years
FROM fc
""")

oracle("history_forecast_series", with_projects(YEARLY, *fit_ctes(), f"""hist AS (
  SELECT year, funding FROM yearly WHERE year >= {P.current_year - 10} AND year <= {P.current_year}
)""") + f"""
SELECT year, funding AS actual,
       CASE WHEN year = (SELECT max(year) FROM hist) THEN round(funding, 2) END AS predicted,
       CASE WHEN year = (SELECT max(year) FROM hist) THEN round(funding, 2) END AS lower_bound,
       CASE WHEN year = (SELECT max(year) FROM hist) THEN round(funding, 2) END AS upper_bound,
       NULL::DOUBLE AS approved_funding
FROM hist
UNION ALL
SELECT p.year, NULL::DOUBLE, {FORECAST_SELECT.replace(' AS predicted_funding', '')}, nullif(a.funding, 0)
FROM pred p LEFT JOIN yearly a ON a.year = p.year AND a.year > {P.current_year}
""")
