"""Named queries over the driver's tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each query builds the normalised ``projects`` view from the whole input tables and
runs one analysis on it. Array-valued columns are emitted joined with ``|`` so that
results compare as plain strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.operators import marts as M
from fundlens.operators import aggregate as A
from fundlens.plans.params import DRIVER_PARAMS as P
from fundlens.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        _REGISTRY[name] = fn
        return fn
    return deco


def registry() -> dict[str, Query]:
    # import side-effect registrations of the later modules
    from fundlens.plans import registry_more, registry_quality  # noqa: F401
    return dict(_REGISTRY)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.projects(spark, sf_dir)


def driver_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population per state for the driver tables: 10,000 inhabitants per customer of the
    nation. Grows with the data, so it is joined without a broadcast hint."""
    c = tables.table(spark, sf_dir, "customer")
    n = tables.table(spark, sf_dir, "nation")
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
            .groupBy(F.col("n_name").alias("state"))
            .agg((F.count(F.lit(1)) * 10000).alias("population")))


def joined(col: str, sep: str = "|"):
    return F.array_join(F.col(col), sep).alias(col)


@query("ministry_funding")
def q_ministry_funding(spark, sf):
    return M.ministry_funding(projects(spark, sf))


@query("ministry_totals")
def q_ministry_totals(spark, sf):
    return M.ministry_totals(projects(spark, sf))


@query("state_funding_per_capita")
def q_state_funding(spark, sf):
    return M.state_funding(projects(spark, sf), driver_population(spark, sf))


@query("city_top")
def q_city_top(spark, sf):
    return M.city_top(projects(spark, sf), 30)


@query("country_international")
def q_country_international(spark, sf):
    return M.country_international(projects(spark, sf))


@query("international_totals")
def q_international_totals(spark, sf):
    return M.international_totals(projects(spark, sf))


@query("domestic_totals")
def q_domestic_totals(spark, sf):
    return M.domestic_totals(projects(spark, sf))


@query("recipients_top_funding")
def q_recipients_top_funding(spark, sf):
    return M.recipients_top_funding(projects(spark, sf), 50)


@query("recipients_top_count")
def q_recipients_top_count(spark, sf):
    return M.recipients_top_count(projects(spark, sf), 50)


@query("unique_recipients")
def q_unique_recipients(spark, sf):
    return M.unique_recipients(projects(spark, sf))


@query("classification_top")
def q_classification_top(spark, sf):
    return M.classification_top(projects(spark, sf), 50)


@query("funding_types")
def q_funding_types(spark, sf):
    return M.funding_types(projects(spark, sf))


@query("funding_profiles")
def q_funding_profiles(spark, sf):
    return M.funding_profiles(projects(spark, sf))


@query("sponsor_top")
def q_sponsor_top(spark, sf):
    df = M.sponsor_top(projects(spark, sf), 20, 3)
    return df.select(*[c for c in df.columns if c != "ministries"], joined("ministries"))


@query("sponsor_ministry_top")
def q_sponsor_ministry_top(spark, sf):
    return M.sponsor_ministry_top(projects(spark, sf), 30)


@query("sponsor_unique_count")
def q_sponsor_unique_count(spark, sf):
    return M.sponsor_unique_count(projects(spark, sf))


@query("joint_summary")
def q_joint_summary(spark, sf):
    return M.joint_summary(projects(spark, sf))


@query("joint_top")
def q_joint_top(spark, sf):
    df = M.joint_top(projects(spark, sf), 30, 5)
    return df.select(*[c for c in df.columns if c != "states_involved"], joined("states_involved"))


@query("summary_stats")
def q_summary_stats(spark, sf):
    df = M.summary_stats(projects(spark, sf), driver_population(spark, sf))
    return df.withColumn("median_project_funding", F.round("median_project_funding", 4))


@query("value_counts_pct")
def q_value_counts_pct(spark, sf):
    return A.value_counts(projects(spark, sf), "funding_type")


@query("recent_projects")
def q_recent_projects(spark, sf):
    return M.recent_projects(projects(spark, sf), 5)


@query("latest_starts")
def q_latest_starts(spark, sf):
    return M.latest_starts(projects(spark, sf), 5)
