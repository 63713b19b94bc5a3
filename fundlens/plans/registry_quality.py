"""Registered queries for quality checks, snapshot diff, serving marts and locale parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.functions import normalize as N
from fundlens.operators import marts as M
from fundlens.operators import omissions as OM
from fundlens.operators import profile as PR
from fundlens.operators import quality as Q
from fundlens.operators import serving as SV
from fundlens.operators import snapshot as SN
from fundlens.operators import trends as TR
from fundlens.plans import refresh as R
from fundlens.plans.params import DRIVER_PARAMS as P
from fundlens.plans.registry import driver_population, projects, query
from fundlens.session import checkpoint_dir
from fundlens.sources import register_csv as RC
from fundlens.sources import tables

OUTLIER_LOW, OUTLIER_HIGH = 1996, 2000
CHANGE_COLUMNS = ["ministry", "sponsor", "recipient", "city", "state", "country", "class_code", "start_date", "end_date",
                  "amount", "profile", "joint_name", "funding_type"]
LOOKUP_NEEDLE = "Customer#0000001"


@query("completeness")
def q_completeness(spark, sf):
    return Q.completeness(projects(spark, sf))


@query("blank_audit")
def q_blank_audit(spark, sf):
    return Q.blank_audit(projects(spark, sf))


@query("blank_samples")
def q_blank_samples(spark, sf):
    return Q.blank_samples(projects(spark, sf), n=10)


@query("key_uniqueness")
def q_key_uniqueness(spark, sf):
    return Q.key_uniqueness(projects(spark, sf))


@query("date_outliers")
def q_date_outliers(spark, sf):
    return Q.date_outliers(projects(spark, sf), OUTLIER_LOW, OUTLIER_HIGH)


@query("recipient_lookup")
def q_recipient_lookup(spark, sf):
    return Q.recipient_lookup(projects(spark, sf), LOOKUP_NEEDLE)


def _reconcile(p: DataFrame) -> DataFrame:
    published = M.ministry_funding(p).select(F.col("code").alias("ministry"), "total_funding")
    source = (TR.ministry_year_dense(p).groupBy("ministry")
              .agg(F.sum(F.col("funding").cast("decimal(38,2)")).cast("double").alias("total_funding")))
    return Q.reconcile_groups(published, source, "ministry", "total_funding")


@query("reconcile_groups")
def q_reconcile_groups(spark, sf):
    return _reconcile(projects(spark, sf))


@query("conservation_checks")
def q_conservation_checks(spark, sf):
    return Q.conservation_checks(projects(spark, sf))


@query("validation_summary")
def q_validation_summary(spark, sf):
    p = projects(spark, sf)
    rec = _reconcile(p).select(F.concat(F.lit("reconcile_"), F.col("key")).alias("name"),
                               F.lit("warning").alias("severity"), F.col("published").alias("expected"),
                               F.col("source").alias("actual"), "passed")
    checks = Q.conservation_checks(p).unionByName(rec)
    return Q.severity_rollup(checks)


@query("topk_coverage")
def q_topk_coverage(spark, sf):
    return Q.topk_coverage(projects(spark, sf))


@query("omission_causes")
def q_omission_causes(spark, sf):
    return OM.causes(projects(spark, sf))


@query("published_checks")
def q_published_checks(spark, sf):
    """The checked marts written to the shared folder, read back and held against the table they came from."""
    out = f"{checkpoint_dir(spark)}/published-{R.run_id_now()}"
    return R.published_checks(spark, projects(spark, sf), out, P, driver_population(spark, sf))


@query("sponsor_rank_check")
def q_sponsor_rank_check(spark, sf):
    p = projects(spark, sf)
    source = p.groupBy("sponsor").agg(F.sum("amount").cast("double").alias("funding"))
    return Q.rank_aligned(M.sponsor_top(p, 20), source, "total_funding", "funding", "code", "sponsor", 3)


@query("sponsor_amount_check")
def q_sponsor_amount_check(spark, sf):
    p = projects(spark, sf)
    source = p.groupBy("sponsor").agg(F.sum("amount").cast("double").alias("funding"))
    return Q.rank_amounts(M.sponsor_top(p, 20), source, "total_funding", "funding", "code", "sponsor", 3)


@query("unparsable_dates")
def q_unparsable_dates(spark, sf):
    """Every order's date as text, those of some statuses and priorities written badly, audited."""
    o = tables.table(spark, sf, "orders")
    d = N.german_date_text("o_orderdate")
    raw = (F.when(F.col("o_orderstatus") == "P", F.substring(d, 4, 7))
           .when(F.col("o_orderpriority") == "5-LOW", F.lit("  ")).otherwise(d))
    return Q.unparsable_dates(o.select(raw.alias("raw_date")), "raw_date", 10)


@query("country_shares_text")
def q_country_shares_text(spark, sf):
    """Countries with grouped counts and percent text, names cut for a list."""
    p = projects(spark, sf)
    total = p.agg(F.count(F.lit(1))).scalar()
    c = p.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return c.select(N.cut_text("country", 5).alias("label"), "country", N.thousands_text("n").alias("projects_text"),
                    N.percent_text(F.col("n") * 100.0 / total).alias("share_text"))


@query("schema_profile")
def q_schema_profile(spark, sf):
    return Q.schema_profile(projects(spark, sf), Q.AUDIT_COLUMNS)


@query("value_profile")
def q_value_profile(spark, sf):
    return PR.frequent_values(projects(spark, sf), Q.AUDIT_COLUMNS)


# --- snapshot diff ---------------------------------------------------------------

def _pair(spark, sf):
    return tables.snapshot_old(spark, sf), tables.snapshot_new(spark, sf)


@query("snapshot_added")
def q_snapshot_added(spark, sf):
    o, n = _pair(spark, sf)
    return SN.added(o, n).select("fkz", "row_id", "start_date")


@query("snapshot_removed")
def q_snapshot_removed(spark, sf):
    o, n = _pair(spark, sf)
    return SN.removed(o, n).select("fkz", "row_id")


@query("snapshot_changed")
def q_snapshot_changed(spark, sf):
    cells = SN.changed(tables.snapshot_old(spark, sf), tables.snapshot_revised(spark, sf), CHANGE_COLUMNS)
    return cells.select("fkz", "change", F.array_join("columns", ",").alias("columns"))


@query("snapshot_positions")
def q_snapshot_positions(spark, sf):
    return SN.diff_summary(*_pair(spark, sf))


@query("snapshot_file_positions")
def q_snapshot_file_positions(spark, sf):
    return SN.positions(_pair(spark, sf)[1].select("fkz", "row_id")).select("fkz", "position")


@query("snapshot_key_order")
def q_snapshot_key_order(spark, sf):
    return SN.key_order(*_pair(spark, sf))


# --- serving marts -------------------------------------------------------------------

@query("last_years")
def q_last_years(spark, sf):
    return SV.last_years(projects(spark, sf), P.current_year, 3)


@query("per_capita_ranking")
def q_per_capita_ranking(spark, sf):
    return SV.per_capita_ranking(projects(spark, sf), driver_population(spark, sf), 16)


@query("decade_share_matrix")
def q_decade_share_matrix(spark, sf):
    return SV.decade_share_matrix(projects(spark, sf))


@query("funding_type_share")
def q_funding_type_share(spark, sf):
    return SV.funding_type_share(projects(spark, sf))


@query("adjusted_recipient_count")
def q_adjusted_recipient_count(spark, sf):
    return SV.adjusted_recipient_count(projects(spark, sf))


@query("entity_drilldown")
def q_entity_drilldown(spark, sf):
    return SV.entity_drilldown(projects(spark, sf))


@query("recipient_table")
def q_recipient_table(spark, sf):
    return SV.recipient_table(projects(spark, sf), "funding", 20)


@query("recipient_table_count")
def q_recipient_table_count(spark, sf):
    return SV.recipient_table(projects(spark, sf), "count", 20)


@query("international_top")
def q_international_top(spark, sf):
    return SV.international_top(projects(spark, sf), 15)


@query("display_formats")
def q_display_formats(spark, sf):
    return SV.display_formats(projects(spark, sf), 10)


# --- locale parsing round trip ------------------------------------------------------------

@query("locale_roundtrip")
def q_locale_roundtrip(spark, sf):
    """Every order's price and date written in the register's German format, wrapped like a
    spreadsheet cell, then parsed back by the ingest rules (B1, B2, A6)."""
    o = tables.table(spark, sf, "orders")
    raw_amount = F.concat(F.lit('="'), N.german_number_text("o_totalprice"), F.lit('"'))
    raw_date = N.german_date_text("o_orderdate")
    r = o.select(F.col("o_orderkey").cast("string").alias("fkz"), raw_amount.alias("raw_amount"),
                 raw_date.alias("raw_date"), F.col("o_totalprice"), F.to_date("o_orderdate").alias("_d"))
    amount = N.parse_amount("raw_amount")
    date = N.parse_date("raw_date")
    return r.select("fkz", "raw_amount", N.money(amount).alias("amount"), "raw_date", date.alias("start_date"),
                    (amount == F.col("o_totalprice").cast("decimal(18,2)")).alias("amount_ok"),
                    (date == F.col("_d")).alias("date_ok"))


@query("export_roundtrip")
def q_export_roundtrip(spark, sf):
    """Every project written as a line of the export and parsed by the ingest rules (A1-A6): the
    number of cells, whether the line was rejected, and a digest of all fields read back."""
    p = projects(spark, sf)
    lay = RC.layout(RC.EXPORT_HEADER)
    raw = RC.parse_lines(RC.export_lines(p), lay)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in tables.PROJECT_COLUMNS[1:22]]
    read = RC.with_row_id(RC.normalise(raw, lay)).select(
        "row_id", F.lit("read").alias("status"), N.money("amount").alias("amount"), "start_date", "end_date", "start_year",
        "is_joint", F.sha2(F.concat_ws("|", *fields), 256).alias("fields_sha256"))
    bad = RC.rejects(raw, lay).select(F.col("_pos").alias("row_id"), F.lit("rejected").alias("status"))
    return read.unionByName(bad, allowMissingColumns=True)
