"""Time trends and drill-down series.

The per-entity loops of a single-machine script (re-filter the whole table once per
top entity) become one aggregate keyed on (entity, year): the table is shuffled once,
entity totals and the top-k are derived from that small aggregate, and the series of
the top entities are kept by a broadcast join to the k-row top list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.functions import normalize as N
from fundlens.operators import aggregate as A


def yearly_totals(projects: DataFrame) -> DataFrame:
    """Start year -> total, mean, count."""
    return (A.funding_stats(projects, ["start_year"])
            .select(F.col("start_year").alias("year"), "total_funding", "avg_funding", "project_count"))


def yearly_series(projects: DataFrame, series: list[str] | None = None) -> DataFrame:
    """(series..., year) -> funding (DOUBLE), projects; NULL years dropped."""
    keys = (series or []) + ["start_year"]
    return (A.funding_stats(projects, keys, total="funding", avg=None, count="projects")
            .withColumnRenamed("start_year", "year"))


def ministry_year_dense(projects: DataFrame) -> DataFrame:
    """Year x ministry funding, dense: every (year, ministry) pair, 0 if none.

    The grid is made from the small (year, ministry) aggregate, not from ``projects``.
    """
    base = projects.where(F.col("start_year").isNotNull() & F.col("ministry").isNotNull())
    cells = base.groupBy(F.col("start_year").alias("year"), "ministry").agg(F.sum("amount").alias("_f"))
    return A.dense_pairs(cells, "year", "ministry").select(
        "year", "ministry", N.money(F.coalesce(F.col("_f"), F.lit(0).cast("decimal(28,2)"))).alias("funding"))


def monthly_distribution(projects: DataFrame) -> DataFrame:
    """Start month -> total, count, month name. Only months present appear."""
    stats = A.funding_stats(projects, ["start_month"], avg=None)
    return stats.select(F.col("start_month").alias("month"), N.month_name("start_month").alias("month_name"),
                        "total_funding", "project_count")


def decade_ministry_share(projects: DataFrame) -> DataFrame:
    """(decade, ministry) -> funding and share of the decade's total in percent.

    The decade total includes rows without a ministry, so the aggregate keeps the NULL
    ministry group until the window total is taken; the window runs over the small
    aggregate (one row per decade x ministry), not over projects.
    """
    agg = (projects.where(F.col("decade").isNotNull())
           .groupBy("decade", "ministry").agg(F.sum("amount").alias("_f")))
    total = F.sum("_f").over(Window.partitionBy("decade"))
    return (agg.withColumn("_t", total).where(F.col("ministry").isNotNull())
            .select("decade", "ministry", N.money("_f").alias("funding"),
                    F.when(F.col("_t") > 0, N.money("_f") / N.money("_t") * 100.0)
                     .otherwise(F.lit(0.0)).alias("share_pct")))


def yoy_growth(projects: DataFrame, from_year: int) -> DataFrame:
    """Year-over-year growth in percent from ``from_year`` on.

    NULL for the first year, when the previous year's total is <= 0, and when the growth
    is exactly 0. The window runs over the yearly aggregate (one row per year).
    """
    y = yearly_totals(projects).where(F.col("year") >= from_year)
    prev = F.lag("total_funding").over(Window.orderBy("year"))
    g = F.when(prev > 0, (F.col("total_funding") - prev) / prev * 100.0)
    return (y.select("year", F.col("total_funding").alias("funding"), g.alias("_g"))
            .select("year", "funding", F.when(F.col("_g") != 0, F.col("_g")).alias("growth_pct")))


def years_present(projects: DataFrame) -> DataFrame:
    return projects.where(F.col("start_year").isNotNull()).select(F.col("start_year").alias("year")).distinct()


def entity_trends(projects: DataFrame, entity: str, k: int, modal: str | None = None) -> DataFrame:
    """Yearly series for the top-k entities by total funding.

    Output: name, year, funding, projects, total_funding, total_projects [, modal].
    Totals include the entity's rows without a start year, as the series does not.
    Top-k ties go to the smaller name; blank names are dropped after the limit.
    """
    ey = (projects.where(F.col(entity).isNotNull())
          .groupBy(entity, "start_year")
          .agg(F.sum("amount").alias("_f"), F.count("amount").alias("_n")))
    tot = ey.groupBy(entity).agg(F.sum("_f").alias("_tf"), F.sum("_n").alias("total_projects"))
    top = A.suppress_blank(A.top_k(tot, k, "_tf", [entity]), entity)
    out = (ey.where(F.col("start_year").isNotNull())
           .join(F.broadcast(top), entity)
           .select(F.col(entity).alias("name"), F.col("start_year").alias("year"),
                   N.money("_f").alias("funding"), F.col("_n").alias("projects"),
                   N.money("_tf").alias("total_funding"), "total_projects"))
    if modal:
        scoped = projects.join(F.broadcast(top.select(entity)), entity, "left_semi")
        mode = A.modal_value(scoped, [entity], modal, out=modal).withColumnRenamed(entity, "name")
        out = (out.join(F.broadcast(mode), "name", "left")
               .withColumn(modal, F.coalesce(F.col(modal), F.lit(""))))
    return out
