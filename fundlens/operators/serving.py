"""Serving marts: the data shaping a dashboard does, done once on Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.functions import normalize as N
from fundlens.operators import aggregate as A
from fundlens.operators import marts as M
from fundlens.operators import trends as TR


def last_years(projects: DataFrame, current_year: int, span: int = 20) -> DataFrame:
    """Yearly totals from ``current_year - span`` on, approved future years included (K1)."""
    y = TR.yearly_totals(projects)
    return y.where(F.col("year") >= current_year - span)


def per_capita_ranking(projects: DataFrame, population: DataFrame | None = None, k: int = 16) -> DataFrame:
    """Top k states by funding, keep those with a per-capita value, rank by it (K2)."""
    top = A.top_k(M.state_funding(projects, population), k, "total_funding", ["name"])
    kept = top.where(F.col("per_capita_funding").isNotNull() & (F.col("per_capita_funding") != 0))
    w = Window.orderBy(F.col("per_capita_funding").desc(), F.col("name"))
    # window over at most k rows
    return kept.withColumn("rank", F.row_number().over(w)).select("rank", "name", "per_capita_funding",
                                                                   "total_funding", "population")


def decade_share_matrix(projects: DataFrame) -> DataFrame:
    """Decade x ministry share matrix, dense with 0 for absent pairs (K3)."""
    share = TR.decade_ministry_share(projects).select("decade", "ministry", "share_pct")
    return A.dense_pairs(share, "decade", "ministry").select(
        "decade", "ministry", F.coalesce("share_pct", F.lit(0.0)).alias("share_pct"))


def funding_type_share(projects: DataFrame) -> DataFrame:
    """Share of the grand total per funding type (K5)."""
    t = M.funding_types(projects)
    # re-sum the group totals exactly (DECIMAL), so the share does not depend on order
    total = t.agg(F.sum(F.col("total_funding").cast("decimal(38,2)")).cast("double")).scalar()
    return t.select("name", "total_funding", "project_count",
                    F.round(F.col("total_funding") / total * 100.0, 6).alias("share_pct"))


def adjusted_recipient_count(projects: DataFrame) -> DataFrame:
    """Distinct recipients minus one: anonymised recipients share one name (K6)."""
    return projects.agg((F.countDistinct("recipient") - 1).alias("min_distinct_recipients"))


def entity_drilldown(projects: DataFrame, k_states: int = 20, k_cities: int = 30, k_recipients: int = 50) -> DataFrame:
    """One long table of drill-down series keyed by (entity_type, name) (K7)."""
    parts = [("state", TR.entity_trends(projects, "state", k_states)),
             ("city", TR.entity_trends(projects, "city", k_cities)),
             ("recipient", TR.entity_trends(projects, "recipient", k_recipients))]
    return reduce(DataFrame.unionByName,
                  [df.select(F.lit(t).alias("entity_type"), "*") for t, df in parts])


def recipient_table(projects: DataFrame, sort_by: str = "funding", k: int = 20, k_trends: int = 50) -> DataFrame:
    """Top k recipients by funding or by count with rank, truncated name, average and whether
    the drill-down of the ``k_trends`` best funded holds a series of theirs (K9, C14)."""
    base = M.recipients_top_funding(projects, 50) if sort_by == "funding" else \
        M.recipients_top_count(projects, 50).withColumn("avg_funding", F.lit(None).cast("double"))
    order = "total_funding" if sort_by == "funding" else "project_count"
    top = A.top_k(base, k, order, ["name"])
    w = Window.orderBy(F.col(order).desc(), "name")  # over at most k rows
    avg = F.coalesce(F.col("avg_funding"), N.safe_ratio("total_funding", "project_count"))
    series = TR.entity_trends(projects, "recipient", k_trends).select(F.col("name").alias("_tn")).distinct()
    return (top.join(F.broadcast(series), F.col("name") == F.col("_tn"), "left")   # at most k_trends names
            .select(F.row_number().over(w).alias("rank"), N.truncate_label("name", 50).alias("label"),
                    "name", "total_funding", "project_count", avg.alias("avg_funding"),
                    F.col("_tn").isNotNull().alias("has_trend")))


def international_top(projects: DataFrame, k: int = 15) -> DataFrame:
    """Top k foreign countries by funding."""
    return A.top_k(M.country_international(projects), k, "total_funding", ["name"])


def display_formats(projects: DataFrame, k: int = 10) -> DataFrame:
    """Display strings for the top ministries: compact and German-locale amounts."""
    m = A.top_k(M.ministry_funding(projects), k, "total_funding", ["code"])
    return m.select("code", N.compact_currency("total_funding").alias("compact"),
                    N.german_number_text("total_funding").alias("german"),
                    N.german_number_text("project_count", 0).alias("projects_text"),
                    N.german_currency("total_funding").alias("currency"),
                    N.german_compact_number("project_count").alias("projects_compact"))
