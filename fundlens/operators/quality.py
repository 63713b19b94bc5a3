"""Data-quality, conservation and reconciliation checks.

Checks are DataFrames, not printouts: one row per check with ``name``, ``severity``,
``expected``, ``actual`` and ``passed``, so they can be unioned, rolled up by severity
and published as a report. Column audits are single-pass aggregates over all columns
followed by ``unpivot``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.functions import normalize as N
from fundlens.operators import aggregate as A
from fundlens.operators import duration as D
from fundlens.operators import marts as M
from fundlens.operators import trends as TR

AUDIT_COLUMNS = ["fkz", "ministry", "unit", "sponsor", "work_unit", "recipient", "municipality_code",
                 "municipality", "city", "state", "country", "executing_body", "title", "class_code",
                 "class_text", "profile", "joint_name", "funding_type"]


def _long(wide: DataFrame, cols: list[str], name: str, value: str) -> DataFrame:
    return wide.unpivot([], [F.col(c) for c in cols], name, value)


def completeness(projects: DataFrame) -> DataFrame:
    """Valid / missing shares of the derived fields, in one pass.

    Output: field, valid, total, pct_valid, pct_missing.
    """
    cm = N.calendar_months("start_date", "end_date")
    checks = {
        "start_year": F.col("start_year").isNotNull(),
        "start_month": F.col("start_month").isNotNull(),
        "end_year": F.col("end_year").isNotNull(),
        "duration_calendar_months": cm.isNotNull() & (cm > 0),
        "duration_months": F.col("duration_months").isNotNull(),
        "title": F.col("title").isNotNull(),
    }
    wide = projects.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(c).alias(k) for k, c in checks.items()])
    long = wide.unpivot(["_total"], list(checks), "field", "valid")
    pct = F.round(F.col("valid") * 100.0 / F.col("_total"), 4)
    return long.select("field", "valid", F.col("_total").alias("total"), pct.alias("pct_valid"),
                       F.round(F.lit(100.0) - F.col("valid") * 100.0 / F.col("_total"), 4).alias("pct_missing"))


def blank_audit(projects: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Blank (NULL, '' or whitespace) count per column, in one pass."""
    cols = cols or AUDIT_COLUMNS
    wide = projects.agg(*[F.count_if(N.blank(c)).alias(c) for c in cols])
    return _long(wide, cols, "column", "blank_count")


def blank_samples(projects: DataFrame, cols: list[str] | None = None, n: int = 10) -> DataFrame:
    """The first n blank rows (file order) of each column (J2 samples, B24).

    ``row_number() <= n`` per column is planned as a rank-limited window, so each task
    keeps only n candidates per column before the shuffle, whatever the blank share.
    """
    cols = cols or AUDIT_COLUMNS
    flags = projects.select("row_id", "fkz", F.explode(F.array(*[
        F.when(N.blank(c), F.lit(c)) for c in cols])).alias("column")).where(F.col("column").isNotNull())
    w = Window.partitionBy("column").orderBy("row_id")
    return flags.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def key_uniqueness(df: DataFrame, key: str = "fkz") -> DataFrame:
    """Distinct keys vs rows."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("distinct_keys")) \
        .withColumn("is_unique", F.col("rows") == F.col("distinct_keys"))


def date_outliers(projects: DataFrame, low: int = 1990, high: int = 2030) -> DataFrame:
    """Projects starting before ``low``, after ``high``, or without a start year."""
    y = F.col("start_year")
    cat = (F.when(y.isNull(), F.lit("missing")).when(y < low, F.lit("before_low"))
           .when(y > high, F.lit("after_high")))
    return (projects.select(cat.alias("category"), y, "row_id").where(F.col("category").isNotNull())
            .groupBy("category").agg(F.count(F.lit(1)).alias("projects"), F.min(y).alias("min_year"),
                                     F.max(y).alias("max_year"), F.min("row_id").alias("first_row")))


def recipient_lookup(projects: DataFrame, needle: str) -> DataFrame:
    """Yearly funding of recipients whose name contains ``needle`` (case-sensitive)."""
    hit = projects.where(F.coalesce(F.col("recipient").contains(needle), F.lit(False)))
    return (hit.where(F.col("start_year").isNotNull()).groupBy(F.col("start_year").alias("year"))
            .agg(N.money(F.sum("amount")).alias("funding"), F.count("fkz").alias("projects")))


def _scalar(df: DataFrame, agg: Column) -> Column:
    return df.agg(agg).scalar()


def check_table(one: DataFrame, checks: list[tuple]) -> DataFrame:
    """(name, severity, expected, actual, passed) rows from a one-row table of totals.

    ``checks``: (name, severity, expected, actual, rule), the rule a function of the two values.
    Values become columns first, so a subquery among them is evaluated once.
    """
    one = one.select(*[c.cast("double").alias(f"_{side}{i}") for i, (_, _, e, a, _) in enumerate(checks)
                       for side, c in (("e", e), ("a", a))])
    rows = [F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.col(f"_e{i}").alias("expected"),
                     F.col(f"_a{i}").alias("actual"), rule(F.col(f"_e{i}"), F.col(f"_a{i}")).alias("passed"))
            for i, (name, severity, _, _, rule) in enumerate(checks)]
    return one.select(F.inline(F.array(*rows)))


def equal(expected: Column, actual: Column) -> Column:
    return actual == expected


def at_most(expected: Column, actual: Column) -> Column:
    return actual <= expected


def within(pct: float):
    """Rule: the values differ by less than ``pct`` percent of the expected one."""
    return lambda e, a: F.coalesce(F.try_divide(F.abs(a - e), F.abs(e)) * 100.0 < pct, a == e)


# part -> its keys in one pass over the register
_PARTS = {"all": [], "ministry": ["ministry"], "state": ["domestic", "state"], "year": ["start_year"],
          "type": ["funding_type"], "profile": ["profile"], "joint": ["is_joint"], "sponsor": ["sponsor"],
          "bin": ["bin_id"]}


def one_pass_totals(projects: DataFrame, k_sponsors: int = 20, parts: list[str] | None = None) -> DataFrame:
    """One row: the register's totals and what each mart would show of them, from one scan.

    The marts' group-bys run as GROUPING SETS: a project becomes one short row per part, reduced
    by a partial aggregate before the shuffle. The sponsors' places are taken among the groups.
    """
    parts = parts or list(_PARTS)
    sets = [_PARTS[n] for n in parts]
    keys = list(dict.fromkeys(c for s in sets for c in s))
    base = projects.select(
        "ministry", "state", "start_year", "funding_type", "profile", "is_joint", "sponsor", "amount",
        (~N.not_domestic("country")).alias("domestic"), D.bin_id().alias("bin_id")).select(*keys, "amount")
    groups = base.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("part"), F.count(F.lit(1)).alias("projects"), F.count("amount").alias("n"),
        F.sum("amount").alias("funding"))
    ids = {n: sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in _PARTS[n]) for n in parts}
    if "sponsor" in parts:
        place = Window.partitionBy("part", F.col("sponsor").isNull()).orderBy(N.money("funding").desc(), "sponsor")
        groups = groups.withColumn("place", F.row_number().over(place))    # as many rows as a part has keys

    def total(part: str, what: str, where: Column | None = None) -> Column:
        if part not in parts:
            return F.lit(None).cast("double")
        cond = F.col("part") == ids[part]
        picked = F.sum(F.when(cond if where is None else cond & where, F.col(what)))
        return F.coalesce(picked, F.lit(0)).cast("double")

    known = {c: F.col(c).isNotNull() if c in keys else None for c in ("ministry", "start_year", "is_joint", "bin_id")}
    listed = (F.col("place") <= k_sponsors) & N.present("sponsor") & N.present_strict("sponsor") if "sponsor" in parts else None
    return groups.agg(
        total("all", "projects").alias("projects"), total("all", "funding").alias("funding"),
        total("ministry", "n", known["ministry"]).alias("ministry_n"),
        total("ministry", "funding", known["ministry"]).alias("ministry_f"),
        total("state", "n", F.col("domestic") & N.present("state")).alias("state_n"),
        total("state", "projects", ~F.col("domestic")).alias("abroad_n"),
        total("year", "n", known["start_year"]).alias("year_n"),
        total("year", "funding", known["start_year"]).alias("year_f"),
        total("type", "n", N.present("funding_type") if "type" in parts else None).alias("type_n"),
        total("profile", "n", N.present("profile") if "profile" in parts else None).alias("profile_n"),
        total("joint", "projects", known["is_joint"]).alias("joint_n"),
        total("sponsor", "n", listed).alias("sponsor_n"),
        total("bin", "projects", known["bin_id"]).alias("bin_n"))


# published mart -> (part it stands for, {total: measure of the mart})
_MART_TOTALS = {
    "ministry_funding": ("ministry", {"ministry_n": "project_count", "ministry_f": "total_funding"}),
    "state_funding": (None, {"state_n": "project_count"}),
    "yearly_totals": ("year", {"year_n": "project_count", "year_f": "total_funding"}),
    "funding_types": ("type", {"type_n": "project_count"}),
    "funding_profiles": ("profile", {"profile_n": "project_count"}),
    "sponsor_top": ("sponsor", {"sponsor_n": "project_count"}),
    "duration_histogram": ("bin", {"bin_n": "count"}),
}


def conservation_checks(projects: DataFrame, k_sponsors: int = 20, m: dict[str, DataFrame] | None = None) -> DataFrame:
    """Project counts of each mart add up to the row count.

    One scan of the register whatever the number of checks. ``m`` = published marts (read back
    from storage): their sums are read from them; the totals of missing ones come from the scan.
    Output: name, severity, expected, actual, passed.
    """
    m = {n: df for n, df in (m or {}).items() if n in _MART_TOTALS}
    read = {_MART_TOTALS[n][0] for n in m}
    t = one_pass_totals(projects, k_sponsors, [n for n in _PARTS if n not in read])
    for name, df in m.items():
        # exact re-sum of the published group totals
        for col, measure in _MART_TOTALS[name][1].items():
            t = t.withColumn(col, _scalar(df, F.coalesce(F.sum(F.col(measure).cast("decimal(38,2)")), F.lit(0)).cast("double")))
    c = F.col
    return check_table(t, [
        ("ministry_projects", "error", c("projects"), c("ministry_n"), equal),
        ("ministry_funding", "error", c("funding"), c("ministry_f"), within(0.01)),
        ("geographic_projects", "error", c("projects"), c("state_n") + c("abroad_n"), equal),
        ("yearly_projects", "error", c("projects"), c("year_n"), equal),
        ("yearly_funding", "error", c("funding"), c("year_f"), within(0.01)),
        ("funding_type_projects", "error", c("projects"), c("type_n"), equal),
        ("funding_profile_projects", "error", c("projects"), c("profile_n"), equal),
        ("joint_projects", "error", c("projects"), c("joint_n"), equal),
        ("sponsor_topk_projects", "error", c("projects"), c("sponsor_n"), at_most),
        ("duration_bins_projects", "error", c("projects"), c("bin_n"), at_most),
    ])


def reconcile_groups(published: DataFrame, source: DataFrame, key: str, measure: str,
                     tolerance_pct: float = 0.01) -> DataFrame:
    """Per-group reconciliation of a published mart against a source aggregate.

    Full outer join on the key, so groups missing on either side show up; a missing side
    reads 0. Output: key, published, source, diff_pct, passed.
    """
    p = published.select(F.col(key).alias("key"), F.col(measure).cast("double").alias("published"))
    s = source.select(F.col(key).alias("key"), F.col(measure).cast("double").alias("source"))
    j = p.join(s, "key", "full_outer").select(
        "key", F.coalesce("published", F.lit(0.0)).alias("published"), F.coalesce("source", F.lit(0.0)).alias("source"))
    diff = F.round(F.try_divide(F.abs(F.col("published") - F.col("source")), F.abs(F.col("source"))) * 100.0, 6)
    return j.select("key", "published", "source", diff.alias("diff_pct"),
                    F.coalesce(diff < tolerance_pct, F.col("published") == F.col("source")).alias("passed"))


def rank_aligned(a: DataFrame, b: DataFrame, order_a: str, order_b: str, key_a: str, key_b: str, k: int) -> DataFrame:
    """Compare the i-th entry of two top-k lists (J11, C12): rank, key_a, key_b, same."""
    ra = A.top_k(a, k, order_a, [key_a]).select(F.col(key_a).alias("key_a"), order_a)
    rb = A.top_k(b, k, order_b, [key_b]).select(F.col(key_b).alias("key_b"), order_b)
    wa = Window.orderBy(F.col(order_a).desc(), "key_a")
    wb = Window.orderBy(F.col(order_b).desc(), "key_b")
    ra = ra.withColumn("rank", F.row_number().over(wa)).select("rank", "key_a")
    rb = rb.withColumn("rank", F.row_number().over(wb)).select("rank", "key_b")
    return ra.join(rb, "rank", "full_outer").withColumn("same", F.coalesce(F.col("key_a") == F.col("key_b"), F.lit(False)))


def rank_amounts(published: DataFrame, source: DataFrame, measure_a: str, measure_b: str, key_a: str, key_b: str,
                 k: int, tolerance_pct: float = 0.01) -> DataFrame:
    """Compare the amounts at the i-th places of two top-k lists: rank, published, source, passed."""
    sides = []
    for df, m, key, name in ((published, measure_a, key_a, "published"), (source, measure_b, key_b, "source")):
        top = A.top_k(df.select(key, m), k, m, [key])
        w = Window.orderBy(F.col(m).desc(), key)    # over at most k rows
        sides.append(top.select(F.row_number().over(w).alias("rank"), F.col(m).cast("double").alias(name)))
    j = sides[0].join(sides[1], "rank", "full_outer")
    diff = F.try_divide(F.abs(F.col("published") - F.col("source")), F.abs(F.col("source"))) * 100.0
    ok = F.coalesce(diff < tolerance_pct, F.col("published") == F.col("source"), F.lit(False))
    return j.select("rank", "published", "source", ok.alias("passed"))


def unparsable_dates(raw: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The n smallest distinct texts without a year as third part, with their rows; a missing or
    blank text counts as ``''`` (B25, B2c, J20)."""
    bad = raw.where(N.year_of_date_text(col).isNull())
    text = F.when(N.blank(col), F.lit("")).otherwise(F.col(col))
    counts = bad.select(text.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    return A.top_k(counts, n, "value", [], ascending=True)


def topk_coverage(projects: DataFrame) -> DataFrame:
    """How much of the register each top-k list shows.

    Output: mart, shown, covered_projects, total_projects, coverage_pct, remaining.
    """
    total = projects.agg(F.count(F.lit(1))).scalar()
    parts = [
        ("sponsors_top20", M.sponsor_top(projects, 20), "project_count"),
        ("recipients_top50", M.recipients_top_funding(projects, 50), "project_count"),
        ("cities_top30", M.city_top(projects, 30), "project_count"),
        ("classifications_top50", M.classification_top(projects, 50), "project_count"),
        ("joint_top30", M.joint_top(projects, 30), "subproject_count"),
    ]
    out = [m.agg(F.lit(n).alias("mart"), F.count(F.lit(1)).alias("shown"),
                 F.coalesce(F.sum(c), F.lit(0)).alias("covered_projects")) for n, m, c in parts]
    u = reduce(DataFrame.unionByName, out)
    return u.select("mart", "shown", "covered_projects", total.alias("total_projects"),
                    F.round(F.col("covered_projects") * 100.0 / total, 4).alias("coverage_pct"),
                    (total - F.col("covered_projects")).alias("remaining"))


def severity_rollup(checks: DataFrame) -> DataFrame:
    """Checks passed / failed per severity."""
    return checks.groupBy("severity").agg(F.count_if(F.col("passed")).alias("passed"),
                                          F.count_if(~F.col("passed")).alias("failed"))


def schema_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: type, non-null count and exact distinct count, in one aggregate."""
    cols = cols or df.columns
    types = dict(df.dtypes)
    wide = df.agg(*[F.count(c).alias(f"n_{c}") for c in cols], *[F.countDistinct(c).alias(f"d_{c}") for c in cols])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                     F.col(f"n_{c}").alias("non_null"), F.col(f"d_{c}").alias("distinct")) for c in cols]
    return wide.select(F.inline(F.array(*rows)))


def published_checks(projects: DataFrame, m: dict[str, DataFrame], population: DataFrame | None = None,
                     reference_population: DataFrame | None = None) -> DataFrame:
    """Published marts against the normalised table (J5-J15, C17): one checks table.

    ``m`` holds the marts a run wrote (read back from storage). Output: name, severity,
    expected, actual, passed. Errors are totals that must agree; warnings are plausibility
    checks (January peak, top lists, decade shares, per-capita, coverage of the entity trends).
    """
    src = projects
    one = src.agg(F.count(F.lit(1)).alias("projects"), N.money(F.sum("amount")).alias("funding"),
                  F.countDistinct("recipient").alias("recipients"),
                  *[F.countDistinct(F.when(N.present(c), F.col(c))).alias(f"n_{c}") for c in ("state", "city", "recipient")])
    summ, none = m["summary_stats"], F.lit(0)

    def failed(df: DataFrame) -> Column:
        return _scalar(df, F.count_if(~F.col("passed")))

    def first(col: str) -> Column:
        return _scalar(summ, F.first(col))

    def sums(df: DataFrame, key: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("name")).agg(N.money(F.sum("amount")).alias("total_funding"))

    def top5(mart: str, source: DataFrame) -> Column:
        top = A.top_k(m[mart], 5, "total_funding", ["name"])
        return failed(reconcile_groups(top, source.join(F.broadcast(top.select("name")), "name", "left_semi"), "name", "total_funding"))

    ministries = reconcile_groups(m["ministry_funding"].select(F.col("code").alias("name"), "total_funding"),
                                  sums(src, "ministry"), "name", "total_funding")
    mon = m["monthly_distribution"]
    january = _scalar(mon, F.max(F.when(F.col("month") == 1, F.col("project_count"))))
    other = _scalar(mon, F.max(F.when(F.col("month") != 1, F.col("project_count"))))
    sponsors = rank_amounts(m["sponsor_top"], src.groupBy("sponsor").agg(N.money(F.sum("amount")).alias("funding")),
                            "total_funding", "funding", "code", "sponsor", 3)
    decades = m["decade_ministry_share"].groupBy("decade").agg(F.sum("share_pct").alias("s"))
    words = m["keyword_trends"].groupBy("keyword").agg(
        F.count_if(F.col("total_funding").isNull() | F.col("total_projects").isNull()).alias("missing"))
    bad_words = _scalar(words, F.when(F.count(F.lit(1)) == 0, 1).otherwise(F.count_if(F.col("missing") > 0)))
    geo = (m["entity_trends_state"].groupBy("name").agg(F.first("total_funding").alias("trend"))
           .join(m["state_funding"].select("name", F.col("total_funding").alias("geo")), "name"))
    far = F.try_divide(F.abs(F.col("trend") - F.col("geo")), F.col("geo")) * 100.0 > 20.0
    st = m["state_funding"].where(F.col("population").isNotNull())
    per_capita = F.abs(F.try_divide(F.col("total_funding"), F.col("population")) - F.col("per_capita_funding")) >= 0.01

    def but_one(expected: Column, actual: Column) -> Column:      # a blank label may take a place
        return (actual <= expected) & (actual >= expected - 1)

    checks = [
        ("summary_projects", "error", F.col("projects"), first("total_projects"), equal),                        # J6
        ("summary_funding", "error", F.col("funding"), first("total_funding"), within(0.01)),                    # J5
        ("ministry_groups", "error", none, failed(ministries), equal),                                           # J7
        ("recipients_top5", "warning", none, top5("recipients_top_funding", sums(src, "recipient")), equal),     # J7
        ("states_top5", "warning", none, top5("state_funding", sums(M.domestic(src), "state")), equal),          # J7
        ("unique_recipients", "error", F.col("recipients"), first("unique_recipients"), equal),                  # J8
        ("january_highest", "warning", other, january, lambda e, a: F.coalesce(a > e, F.lit(False))),            # J10
        ("sponsors_top3", "warning", none, failed(sponsors), equal),                                             # J11
        ("decade_shares_sum_100", "warning", none,
         _scalar(decades, F.count_if((F.col("s") <= 99.9) | (F.col("s") >= 100.1))), equal),                     # J12
        ("keyword_trends_structure", "error", none, bad_words, equal),                                           # J13
        ("state_trends_vs_geo", "warning", none, _scalar(geo, F.count_if(far)), equal),                          # J14, C17
        *[(f"trend_{many}", "warning", F.least(F.lit(k), F.col(f"n_{c}")),
           _scalar(m[f"entity_trends_{c}"], F.countDistinct("name")), but_one)                                   # J14
          for c, many, k in (("state", "states", 20), ("city", "cities", 30), ("recipient", "recipients", 50))],
        ("per_capita_formula", "warning", none, _scalar(st, F.count_if(per_capita)), equal),                     # J15
        ("states_with_population", "error", F.lit(16), _scalar(st, F.count(F.lit(1))), lambda e, a: a >= e),     # J15
    ]
    ref = reference_population if reference_population is not None else population
    if ref is not None:
        both = st.join(ref.select(F.col("state").alias("name"), F.col("population").alias("ref")), "name")
        checks.append(("population_matches_reference", "warning", none,
                       _scalar(both, F.count_if(F.col("population") != F.col("ref"))), equal))
    return check_table(one, checks)
