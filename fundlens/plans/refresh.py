"""The refresh job: validate -> ingest -> analyse -> publish -> stamp.

Stage order follows the register's update routine; any failure aborts before anything is
published. The normalised table is written once to the run folder and read back, which
cuts the lineage (executor loss re-reads Parquet instead of re-parsing the CSV) and fixes
``row_id``. Every mart and document is then a separate, independent Spark job over it.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens import dims
from fundlens.operators import duration as D
from fundlens.operators import keywords as K
from fundlens.operators import marts as M
from fundlens.operators import quality as Q
from fundlens.operators import trends as TR
from fundlens.plans import publish as PB
from fundlens.plans.params import Params
from fundlens.sources import register_csv, tables


def marts(p: DataFrame, prm: Params, population: DataFrame | None = None,
          wc: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every flat mart of a refresh, lazily. ``wc`` = precomputed title word counts."""
    wc = wc if wc is not None else K.word_counts(p)
    return {
        "ministry_funding": M.ministry_funding(p),
        "state_funding": M.state_funding(p, population),
        "city_top": M.city_top(p),
        "country_international": M.country_international(p),
        "yearly_totals": TR.yearly_totals(p),
        "ministry_year_dense": TR.ministry_year_dense(p),
        "monthly_distribution": TR.monthly_distribution(p),
        "decade_ministry_share": TR.decade_ministry_share(p),
        "yoy_growth": TR.yoy_growth(p, prm.yoy_from),
        "recipients_top_funding": M.recipients_top_funding(p),
        "recipients_top_count": M.recipients_top_count(p),
        "classification_top": M.classification_top(p),
        "keyword_top": K.keyword_top(p, wc=wc),
        "keyword_trends": K.keyword_trends(p, wc=wc),
        "entity_trends_state": TR.entity_trends(p, "state", 20),
        "entity_trends_city": TR.entity_trends(p, "city", 30, modal="state"),
        "entity_trends_recipient": TR.entity_trends(p, "recipient", 50),
        "duration_by_ministry": D.duration_by_ministry(p),
        "duration_histogram": D.duration_histogram(p),
        "funding_types": M.funding_types(p),
        "funding_profiles": M.funding_profiles(p),
        "sponsor_top": M.sponsor_top(p),
        "sponsor_ministry_top": M.sponsor_ministry_top(p),
        "joint_top": M.joint_top(p),
        "summary_stats": M.summary_stats(p, population),
        "recent_projects": M.recent_projects(p),
    }


def _series_map(df: DataFrame, key: str, order, fields) -> DataFrame:
    """``{key: [ordered rows]}`` as one map column (e.g. ministry -> yearly series)."""
    per = df.groupBy(key).agg(PB.ordered_list(df, order, fields).alias("_l"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), "_l"))).alias("m"))


def documents(p: DataFrame, prm: Params, population: DataFrame | None = None,
              m: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The twelve nested result documents (FIXTURES 5), each one bounded row.

    ``m`` = the marts, normally read back from where this run wrote them, so a document
    only folds a small table instead of recomputing it from the projects.
    """
    m = m if m is not None else marts(p, prm, population)
    tot = M.ministry_totals(p)
    docs: dict[str, DataFrame] = {}
    docs["ministry_funding"] = PB.document(
        m["ministry_funding"], "ministries", [("total_funding", True), ("code", False)],
        ["code", "name", "total_funding", "avg_funding", "project_count"],
        {"total_funding": tot.select("total_funding").scalar(), "total_projects": tot.select("total_projects").scalar()})
    intl = M.international_totals(p)
    dom = M.domestic_totals(p)
    countries = PB.document(m["country_international"], "countries", [("total_funding", True), ("name", False)],
                            ["name", "total_funding", "project_count"])
    cities = PB.document(m["city_top"], "top_cities", [("total_funding", True), ("city", False), ("state", False)],
                         ["city", "state", "total_funding", "project_count"])
    docs["geographic_distribution"] = PB.document(
        m["state_funding"], "states", [("total_funding", True), ("name", False)],
        ["name", "total_funding", "avg_funding", "project_count", "population", "per_capita_funding"],
        {"top_cities": cities.scalar(),
         "total_domestic_funding": dom.select("total_domestic_funding").scalar(),
         "total_domestic_projects": dom.select("total_domestic_projects").scalar(),
         "international": F.struct(intl.select("total_funding").scalar().alias("total_funding"),
                                   intl.select("total_projects").scalar().alias("total_projects"),
                                   countries.scalar().alias("countries"))})
    yearly = m["yearly_totals"]
    docs["temporal_trends"] = PB.document(
        yearly, "yearly_totals", [("year", False)], ["year", "total_funding", "avg_funding", "project_count"],
        {"ministry_yearly": _series_map(m["ministry_year_dense"], "ministry", [("year", False)],
                                        ["year", "funding"]).scalar(),
         "monthly_distribution": PB.document(m["monthly_distribution"], "l", [("month", False)],
                                             ["month", "month_name", "total_funding", "project_count"]).scalar(),
         "decade_ministry_share": _series_map(m["decade_ministry_share"], "decade", [("funding", True)],
                                              ["ministry", "funding", "share_pct"]).scalar(),
         "year_over_year_growth": PB.document(m["yoy_growth"], "l", [("year", False)],
                                              ["year", "funding", "growth_pct"]).scalar(),
         "years": yearly.agg(F.sort_array(F.collect_list("year"))).scalar()})
    docs["top_recipients"] = PB.document(
        m["recipients_top_funding"], "top_by_funding", [("total_funding", True), ("name", False)],
        ["name", "total_funding", "avg_funding", "project_count"],
        {"top_by_count": PB.document(m["recipients_top_count"], "l", [("project_count", True), ("name", False)],
                                     ["name", "total_funding", "project_count"]).scalar(),
         "unique_recipients": M.unique_recipients(p).scalar()})
    docs["topic_analysis"] = PB.document(
        m["classification_top"], "classifications", [("total_funding", True), ("code", False)],
        ["code", "description", "total_funding", "project_count"],
        {"keywords": PB.document(m["keyword_top"], "l", [("count", True), ("word", False)], ["word", "count"]).scalar()})
    kt = m["keyword_trends"]
    docs["keyword_trends"] = kt.groupBy("keyword").agg(
        F.first("total_funding").alias("total_funding"), F.first("total_projects").alias("total_projects"),
        PB.ordered_list(kt, [("year", False)], ["year", "funding", "projects"]).alias("yearly")
    ).agg(F.map_from_entries(F.collect_list(F.struct("keyword", F.struct("total_funding", "total_projects", "yearly"))))
          .alias("keywords"))

    def entity_map(df, extra=()):
        g = df.groupBy("name").agg(*[F.first(c).alias(c) for c in ("total_funding", "total_projects", *extra)],
                                   PB.ordered_list(df, [("year", False)], ["year", "funding", "projects"]).alias("yearly"))
        return g.agg(F.map_from_entries(F.collect_list(F.struct(
            "name", F.struct(*extra, "total_funding", "total_projects", "yearly")))).alias("m"))
    docs["entity_trends"] = entity_map(m["entity_trends_state"]).select(F.col("m").alias("states")).select(
        "states", entity_map(m["entity_trends_city"], ("state",)).scalar().alias("cities"),
        entity_map(m["entity_trends_recipient"]).scalar().alias("recipients"))
    overall = D.duration_overall(p)
    docs["duration_analysis"] = PB.document(
        m["duration_by_ministry"], "by_ministry", [("ministry", False)],
        ["ministry", "mean_months", "median_months", "project_count"],
        {"distribution": PB.document(m["duration_histogram"], "l", [("bin_id", False)], ["range", "count"]).scalar(),
         "overall_stats": F.struct(overall.select("mean_months").scalar().alias("mean_months"),
                                   overall.select("median_months").scalar().alias("median_months"),
                                   overall.select("total_analyzed").scalar().alias("total_analyzed"))})
    docs["funding_types"] = PB.document(
        m["funding_types"], "funding_types", [("total_funding", True), ("name", False)],
        ["name", "total_funding", "project_count"],
        {"funding_profiles": PB.document(m["funding_profiles"], "l", [("total_funding", True), ("name", False)],
                                         ["name", "total_funding", "project_count"]).scalar()})
    docs["projekttraeger"] = PB.document(
        m["sponsor_top"], "projekttraeger", [("total_funding", True), ("code", False)],
        ["code", "name", "total_funding", "avg_funding", "project_count", "ministries"],
        {"unique_count": M.sponsor_unique_count(p).scalar(),
         "pt_ministry_breakdown": PB.document(m["sponsor_ministry_top"], "l",
                                              [("funding", True), ("pt", False), ("ministry", False)],
                                              ["pt", "ministry", "funding", "projects"]).scalar()})
    js = M.joint_summary(p)
    docs["joint_projects"] = PB.document(
        m["joint_top"], "top_joint_projects", [("total_funding", True), ("name", False)],
        ["name", "total_funding", "subproject_count", "states_involved"],
        {"summary": F.struct(*[js.select(c).scalar().alias(c) for c in js.columns])})
    docs["summary_stats"] = m["summary_stats"]
    return docs


def run_id_now() -> str:
    return uuid.uuid4().hex[:12]


def run_concurrently(jobs: dict, max_workers: int) -> dict:
    """Run independent Spark actions from a bounded thread pool.

    Each mart is its own small job; submitted together they fill the free task slots
    instead of waiting for each other's scheduling and stage barriers.
    """
    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        futures = {k: pool.submit(fn) for k, fn in jobs.items()}
        return {k: f.result() for k, f in futures.items()}


def publish_marts(spark: SparkSession, p: DataFrame, out: str, prm: Params, population: DataFrame | None = None,
                  names: tuple[str, ...] | None = None, max_concurrent: int = 8) -> dict[str, DataFrame]:
    """Write the marts (those of ``names`` only, if given) and read them back."""
    # title word counts feed two marts; written once (bounded by the vocabulary)
    wc = spark.read.parquet(PB.write_mart(K.word_counts(p), out, "word_counts"))
    todo = {n: df for n, df in marts(p, prm, population, wc).items() if names is None or n in names}
    paths = run_concurrently({n: (lambda n=n, df=df: PB.write_mart(df, out, n)) for n, df in todo.items()},
                             max_concurrent)
    return {n: spark.read.parquet(path) for n, path in paths.items()}


# what the published-vs-source checks read
CHECKED_MARTS = ("summary_stats", "ministry_funding", "state_funding", "recipients_top_funding", "monthly_distribution",
                 "sponsor_top", "decade_ministry_share", "keyword_trends", "entity_trends_state", "entity_trends_city",
                 "entity_trends_recipient")


def published_checks(spark: SparkSession, projects: DataFrame, out: str, prm: Params,
                     population: DataFrame | None = None) -> DataFrame:
    """A run's normalised table and checked marts, written and read back, held against each other."""
    path = f"{out}/projects"
    projects.write.mode("overwrite").parquet(path)
    p = spark.read.parquet(path)
    return Q.published_checks(p, publish_marts(spark, p, out, prm, population, CHECKED_MARTS), population)


def analyse_and_publish(spark: SparkSession, projects_path: str, out: str, prm: Params,
                        population: DataFrame | None = None, write_docs: bool = True,
                        max_concurrent: int = 8) -> list[str]:
    p = spark.read.parquet(projects_path)
    published = publish_marts(spark, p, out, prm, population, max_concurrent=max_concurrent)
    written = ["marts/word_counts", *(f"marts/{n}" for n in published)]
    jobs = {}
    if write_docs:
        for name, doc in documents(p, prm, population, published).items():
            jobs[f"docs/{name}"] = (lambda name=name, doc=doc: PB.write_document(doc, out, name))
    checks = Q.conservation_checks(p, m=published)
    jobs["reports/validation_report"] = lambda: PB.write_report(checks, out)
    analysis = Q.published_checks(p, published, population)
    jobs["reports/validation_analysis"] = lambda: PB.write_report(analysis, out, "validation_analysis")
    paths = run_concurrently(jobs, max_concurrent)
    # roll-up over the two written reports (small), not a recomputation of the checks
    both = spark.read.json(paths["reports/validation_report"]).unionByName(
        spark.read.json(paths["reports/validation_analysis"]))
    PB.write_report(Q.severity_rollup(both), out, "validation_summary")
    return written + list(jobs) + ["reports/validation_summary"]


def artifacts_missing(written: list[str]) -> list[str]:
    """Expected documents this run did not write."""
    have = {w.split("/", 1)[1] for w in written if w.startswith("docs/")}
    return [a for a in dims.EXPECTED_ARTIFACTS if a not in have]


def refresh(spark: SparkSession, src: str, out_root: str, prm: Params | None = None,
            validate: bool = True, run_id: str | None = None) -> dict:
    """CSV export -> normalised table -> marts, documents, report, manifest."""
    prm = prm or Params()
    run_id = run_id or run_id_now()
    out = f"{out_root.rstrip('/')}/{run_id}"
    if validate:
        register_csv.validate_header(spark, src)
    lay = register_csv.layout(register_csv.read_header(spark, src))
    raw = register_csv.raw_rows(spark, src, lay)
    projects = register_csv.with_row_id(register_csv.normalise(raw, lay))
    projects.write.mode("overwrite").parquet(f"{out}/projects")
    register_csv.rejects(raw, lay).write.mode("overwrite").parquet(f"{out}/rejects")
    written = ["projects", "rejects"] + analyse_and_publish(spark, f"{out}/projects", out, prm)
    missing = artifacts_missing(written)
    if missing:
        raise RuntimeError(f"refresh is missing artifacts: {missing}")
    PB.write_manifest(spark, out, run_id, written)
    return {"run_id": run_id, "out": out, "artifacts": written}


def refresh_tables(spark: SparkSession, sf_dir: str, out_root: str, prm: Params,
                   population: DataFrame | None = None, run_id: str | None = None,
                   write_docs: bool = True) -> dict:
    """The same job over the driver's tables instead of a CSV export."""
    run_id = run_id or run_id_now()
    out = f"{out_root.rstrip('/')}/{run_id}"
    tables.projects(spark, sf_dir).write.mode("overwrite").parquet(f"{out}/projects")
    written = ["projects"] + analyse_and_publish(spark, f"{out}/projects", out, prm, population, write_docs)
    PB.write_manifest(spark, out, run_id, written)
    return {"run_id": run_id, "out": out, "artifacts": written}
