"""The register's aggregate marts.

Each function takes the normalised ``projects`` DataFrame and returns a flat,
lazily-evaluated mart. Nesting into documents happens only in ``plans.publish``.
Dimension lookups have a fixed number of rows and are broadcast; top-k results are
bounded by k and are broadcast when joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens import dims
from fundlens.functions import normalize as N
from fundlens.operators import aggregate as A


# --- D1 / C1 ---------------------------------------------------------------

def ministry_funding(projects: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Ministry -> total, mean, count, with the ministry's full name (code if unknown)."""
    spark = projects.sparkSession
    names = names if names is not None else dims.ministry_names(spark)
    stats = A.funding_stats(projects, ["ministry"])
    return (stats.join(F.broadcast(names.withColumnRenamed("code", "ministry")), "ministry", "left")
            .select(F.col("ministry").alias("code"),
                    N.label_or_code("name", "ministry").alias("name"),
                    "total_funding", "avg_funding", "project_count"))


def ministry_totals(projects: DataFrame) -> DataFrame:
    """Grand totals shown next to the ministry list (all rows)."""
    return projects.agg(N.money(F.sum("amount")).alias("total_funding"),
                        F.count(F.lit(1)).alias("total_projects"))


# --- D2 / C2, D3, D4 --------------------------------------------------------

def domestic(projects: DataFrame) -> DataFrame:
    return projects.where(F.col("country") == dims.DOMESTIC_COUNTRY)


def international(projects: DataFrame) -> DataFrame:
    return projects.where(N.not_domestic("country"))


def state_funding(projects: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Domestic projects by state, with population and funding per inhabitant.

    ``population`` has columns (state, population); it defaults to the fixed table of the
    16 German states and is broadcast (bounded by the number of states).
    """
    spark = projects.sparkSession
    population = population if population is not None else dims.state_population(spark)
    stats = A.funding_stats(domestic(projects), ["state"])
    return (A.suppress_blank(stats, "state")
            .join(population, "state", "left")
            .select(F.col("state").alias("name"), "total_funding", "avg_funding", "project_count",
                    "population",
                    N.safe_ratio("total_funding", "population").alias("per_capita_funding")))


def city_top(projects: DataFrame, k: int = 30) -> DataFrame:
    """Domestic (city, state) -> total, count; top k by total. Not blank-suppressed."""
    stats = A.funding_stats(domestic(projects), ["city", "state"], avg=None)
    return A.top_k(stats, k, "total_funding", ["city", "state"])


def country_international(projects: DataFrame) -> DataFrame:
    """Countries other than the home country; blank/missing countries are not listed."""
    stats = A.funding_stats(international(projects), ["country"], avg=None)
    return (A.suppress_blank(stats.where(N.present_strict("country")), "country")
            .select(F.col("country").alias("name"), "total_funding", "project_count"))


def international_totals(projects: DataFrame) -> DataFrame:
    """Totals over all non-domestic rows, blank and missing countries included."""
    return international(projects).agg(N.money(F.sum("amount")).alias("total_funding"),
                                       F.count(F.lit(1)).alias("total_projects"))


def domestic_totals(projects: DataFrame) -> DataFrame:
    return domestic(projects).agg(N.money(F.sum("amount")).alias("total_domestic_funding"),
                                  F.count(F.lit(1)).alias("total_domestic_projects"))


# --- D9 ---------------------------------------------------------------------

def recipient_stats(projects: DataFrame) -> DataFrame:
    return A.funding_stats(projects, ["recipient"])


def recipients_top_funding(projects: DataFrame, k: int = 50) -> DataFrame:
    top = A.top_k(recipient_stats(projects), k, "total_funding", ["recipient"])
    return top.select(F.col("recipient").alias("name"), "total_funding", "avg_funding", "project_count")


def recipients_top_count(projects: DataFrame, k: int = 50) -> DataFrame:
    top = A.top_k(recipient_stats(projects), k, "project_count", ["recipient"])
    return top.select(F.col("recipient").alias("name"), "total_funding", "project_count")


def unique_recipients(projects: DataFrame) -> DataFrame:
    return A.distinct_count(projects, "recipient", "unique_recipients")


# --- D10 --------------------------------------------------------------------

def classification_top(projects: DataFrame, k: int = 50) -> DataFrame:
    """Classification code -> total, count, first non-null text in file order; top k.

    The aggregate carries the first row's number, which hashes; the k texts are fetched after.
    """
    with_text = F.when(F.col("class_text").isNotNull(), F.col("row_id"))
    stats = (projects.where(F.col("class_code").isNotNull())
             .groupBy("class_code")
             .agg(N.money(F.sum("amount")).alias("total_funding"),
                  F.count("amount").alias("project_count"),
                  F.min(with_text).alias("row_id")))
    top = A.suppress_blank(A.top_k(stats, k, "total_funding", ["class_code"]), "class_code")
    texts = (projects.select("row_id", "class_code", F.col("class_text").alias("first_text"))
             .join(F.broadcast(top.select("row_id", "class_code")), ["row_id", "class_code"]))
    return top.join(texts.drop("row_id"), "class_code", "left").select(F.col("class_code").alias("code"),
                      N.text_or_code("first_text", "class_code").alias("description"),
                      "total_funding", "project_count")


# --- D19, D20 ---------------------------------------------------------------

def funding_types(projects: DataFrame) -> DataFrame:
    stats = A.funding_stats(projects, ["funding_type"], avg=None)
    return A.suppress_blank(stats, "funding_type").select(
        F.col("funding_type").alias("name"), "total_funding", "project_count")


def funding_profiles(projects: DataFrame) -> DataFrame:
    stats = A.funding_stats(projects, ["profile"], avg=None)
    return A.suppress_blank(stats, "profile").select(
        F.col("profile").alias("name"), "total_funding", "project_count")


# --- D21, D22 / C3 ----------------------------------------------------------

def sponsor_top(projects: DataFrame, k: int = 20, n_ministries: int = 3,
                names: DataFrame | None = None) -> DataFrame:
    """Sponsor -> total, mean, count, first ministries in file order; top k by total."""
    spark = projects.sparkSession
    names = names if names is not None else dims.sponsor_names(spark)
    top = A.suppress_blank(A.top_k(A.funding_stats(projects, ["sponsor"]), k, "total_funding", ["sponsor"]),
                           "sponsor").where(N.present_strict("sponsor"))
    # First-ministries only for the k sponsors shown: semi join to the (k-bounded) top.
    scoped = projects.join(F.broadcast(top.select("sponsor")), "sponsor", "left_semi")
    firsts = A.first_k_distinct(scoped, ["sponsor"], "ministry", n_ministries, out="ministries")
    return (top.join(F.broadcast(names.withColumnRenamed("code", "sponsor")), "sponsor", "left")
            .join(firsts, "sponsor", "left")
            .select(F.col("sponsor").alias("code"), N.label_or_code("name", "sponsor").alias("name"),
                    "total_funding", "avg_funding", "project_count",
                    F.coalesce("ministries", F.array().cast("array<string>")).alias("ministries")))


def sponsor_ministry_top(projects: DataFrame, k: int = 30) -> DataFrame:
    stats = A.funding_stats(projects, ["sponsor", "ministry"], total="funding", avg=None, count="projects")
    top = A.top_k(stats, k, "funding", ["sponsor", "ministry"])
    return (A.suppress_blank(top, "sponsor").where(N.present_strict("sponsor"))
            .select(F.col("sponsor").alias("pt"), "ministry", "funding", "projects"))


def sponsor_unique_count(projects: DataFrame) -> DataFrame:
    return A.distinct_count(projects, "sponsor", "unique_count")


# --- D23, D24 ---------------------------------------------------------------

def joint_summary(projects: DataFrame) -> DataFrame:
    """Joint vs individual counts and sums in one pass; a missing side reads 0."""
    j = F.col("is_joint")
    zero = F.lit(0).cast("decimal(18,2)")
    return projects.agg(
        F.count_if(j).alias("joint_project_count"),
        F.count_if(~j).alias("individual_project_count"),
        N.money(F.coalesce(F.sum(F.when(j, F.col("amount"))), zero)).alias("joint_funding"),
        N.money(F.coalesce(F.sum(F.when(~j, F.col("amount"))), zero)).alias("individual_funding"))


def joint_top(projects: DataFrame, k: int = 30, n_states: int = 5) -> DataFrame:
    """Joint-project name -> total, sub-project count, first states in file order; top k."""
    joint = projects.where(F.col("is_joint"))
    stats = A.funding_stats(joint, ["joint_name"], avg=None, count="subproject_count")
    top = A.top_k(stats, k, "total_funding", ["joint_name"])
    scoped = joint.join(F.broadcast(top.select("joint_name")), "joint_name", "left_semi")
    firsts = A.first_k_distinct(scoped, ["joint_name"], "state", n_states, out="states_involved")
    return (top.join(firsts, "joint_name", "left")
            .select(F.col("joint_name").alias("name"), "total_funding", "subproject_count",
                    F.coalesce("states_involved", F.array().cast("array<string>")).alias("states_involved")))


# --- D25 --------------------------------------------------------------------

def summary_stats(projects: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """One row of headline figures; the three "top" names come from bounded top-1 marts.

    One global aggregate over ``projects`` plus scalar subqueries; the median is a distributed selection.
    """
    top_ministry = A.top_k(A.funding_stats(projects, ["ministry"], avg=None), 1, "total_funding",
                           ["ministry"]).select("ministry")
    states = state_funding(projects, population)
    top_state = A.top_k(states, 1, "total_funding", ["name"]).select("name")
    top_recipient = recipients_top_funding(projects, 1).select("name")
    state_count = states.agg(F.count(F.lit(1))).scalar()
    base = projects.agg(
        F.count(F.lit(1)).alias("total_projects"),
        N.money(F.sum("amount")).alias("total_funding"),
        F.countDistinct("recipient").alias("unique_recipients"),
        F.countDistinct("ministry").alias("unique_ministries"),
        N.iso_datetime(F.min("start_date")).alias("earliest_start"),
        N.iso_datetime(F.max("start_date")).alias("latest_start"),
        (N.money(F.sum("amount")) / F.count(F.lit(1))).alias("avg_project_funding"),
    )
    return base.select(
        "*",
        A.median(projects, "amount").scalar().alias("median_project_funding"),
        F.col("unique_ministries").alias("ministry_count"),
        state_count.alias("state_count"),
        top_ministry.scalar().alias("top_ministry"),
        top_state.scalar().alias("top_state"),
        top_recipient.scalar().alias("top_recipient"),
    )


# --- A15, F8, F9 ------------------------------------------------------------

def recent_projects(projects: DataFrame, k: int = 5) -> DataFrame:
    """Last k rows of the file, newest row first, in the published 19-field shape."""
    last = A.top_k(projects, k, "row_id", [])
    return last.select(
        "fkz", F.col("title").alias("thema"), "recipient", "ministry", F.col("unit").alias("referat"),
        F.col("sponsor").alias("projekttraeger"), N.money("amount").alias("funding"),
        N.german_date_text("start_date").alias("start_date"),
        N.german_date_text("end_date").alias("end_date"),
        # int(days / 30.44): truncation toward zero, not floor
        (F.datediff("end_date", "start_date") / F.lit(dims.DAYS_PER_MONTH)).cast("int")
        .alias("duration_months"),
        "state", "city", "country", F.col("executing_body").alias("executing_org"),
        F.col("class_code").alias("classification"), F.col("class_text").alias("classification_text"),
        "funding_type", F.col("profile").alias("funding_profile"),
        F.col("joint_name").alias("joint_project"))


def latest_starts(projects: DataFrame, k: int = 5) -> DataFrame:
    return A.top_k(projects.where(F.col("start_date").isNotNull()), k, "start_date", ["row_id"]) \
        .select("fkz", "start_date", "title")


def first_rows(projects: DataFrame, k: int = 5, last: bool = False) -> DataFrame:
    return A.top_k(projects, k, "row_id", [], ascending=not last).select("row_id", "fkz")
