"""Oracle SQL for quality checks, snapshot diff, serving marts and locale parsing."""

from __future__ import annotations

from fundlens.operators.quality import AUDIT_COLUMNS
from fundlens.plans.oracle import POPULATION, STATS, STATS_NO_AVG, oracle, present, with_projects
from fundlens.plans.oracle_more import entity_sql
from fundlens.plans.params import DRIVER_PARAMS as P
from fundlens.plans.registry_quality import CHANGE_COLUMNS, LOOKUP_NEEDLE, OUTLIER_HIGH, OUTLIER_LOW
from fundlens.sources.register_csv import UNMAPPED
from fundlens.sources.tables import REVISED_SQL, SNAPSHOT_SQL


def blank(c: str) -> str:
    return f"coalesce(trim({c}), '') = ''"


_CHECKS = {
    "start_year": "start_year IS NOT NULL",
    "start_month": "start_month IS NOT NULL",
    "end_year": "end_year IS NOT NULL",
    "duration_calendar_months": "((year(end_date) - year(start_date)) * 12 + (month(end_date) - month(start_date))) > 0",
    "duration_months": "duration_months IS NOT NULL",
    "title": "title IS NOT NULL",
}
oracle("completeness", with_projects("agg AS (SELECT count(*) AS t, " + ", ".join(
    f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _CHECKS.items()) + " FROM projects)") + "\nUNION ALL\n".join(
    f"SELECT '{k}' AS field, {k} AS valid, t AS total, round(CAST({k} AS DOUBLE) * 100.0 / t, 4) AS pct_valid, "
    f"round(100.0 - CAST({k} AS DOUBLE) * 100.0 / t, 4) AS pct_missing FROM agg" for k in _CHECKS))

oracle("blank_audit", with_projects() + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {blank(c)}) AS blank_count FROM projects" for c in AUDIT_COLUMNS))

oracle("blank_samples", with_projects("flags AS (" + "\nUNION ALL\n".join(
    f"SELECT row_id, fkz, '{c}' AS \"column\" FROM projects WHERE {blank(c)}" for c in AUDIT_COLUMNS) + ")") + """
SELECT row_id, fkz, "column" FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_id) AS rn FROM flags) t WHERE rn <= 10
""")

oracle("key_uniqueness", with_projects() + """
SELECT count(*) AS rows, count(DISTINCT fkz) AS distinct_keys, count(*) = count(DISTINCT fkz) AS is_unique FROM projects
""")

oracle("date_outliers", with_projects() + f"""
SELECT category, count(*) AS projects, min(start_year) AS min_year, max(start_year) AS max_year, min(row_id) AS first_row
FROM (SELECT CASE WHEN start_year IS NULL THEN 'missing' WHEN start_year < {OUTLIER_LOW} THEN 'before_low'
                  WHEN start_year > {OUTLIER_HIGH} THEN 'after_high' END AS category, start_year, row_id FROM projects) t
WHERE category IS NOT NULL GROUP BY category
""")

oracle("recipient_lookup", with_projects() + f"""
SELECT start_year AS year, CAST(sum(amount) AS DOUBLE) AS funding, count(fkz) AS projects
FROM projects WHERE contains(recipient, '{LOOKUP_NEEDLE}') AND start_year IS NOT NULL GROUP BY start_year
""")

_RECON = ["""pub AS (SELECT ministry AS key, CAST(sum(amount) AS DOUBLE) AS published FROM projects
          WHERE ministry IS NOT NULL GROUP BY ministry)""",
          """dense AS (
  SELECT ys.year, ms.ministry, CAST(coalesce(s.f, 0) AS DOUBLE) AS funding
  FROM (SELECT DISTINCT start_year AS year FROM projects WHERE start_year IS NOT NULL AND ministry IS NOT NULL) ys
  CROSS JOIN (SELECT DISTINCT ministry FROM projects WHERE start_year IS NOT NULL AND ministry IS NOT NULL) ms
  LEFT JOIN (SELECT start_year AS year, ministry, sum(amount) AS f FROM projects
             WHERE start_year IS NOT NULL AND ministry IS NOT NULL GROUP BY 1, 2) s
    ON s.year = ys.year AND s.ministry = ms.ministry
)""", """src AS (SELECT ministry AS key, CAST(sum(CAST(funding AS DECIMAL(38,2))) AS DOUBLE) AS source
          FROM dense GROUP BY ministry)""",
          """rec AS (
  SELECT coalesce(pub.key, src.key) AS key, coalesce(published, 0.0) AS published, coalesce(source, 0.0) AS source
  FROM pub FULL OUTER JOIN src ON pub.key = src.key
)""", """rec2 AS (
  SELECT key, published, source,
         round(abs(published - source) / nullif(abs(source), 0) * 100.0, 6) AS diff_pct FROM rec
)"""]
RECON_SELECT = "SELECT key, published, source, diff_pct, coalesce(diff_pct < 0.01, published = source) AS passed FROM rec2"
oracle("reconcile_groups", with_projects(*_RECON) + RECON_SELECT)

_CONS = [POPULATION, """base AS (SELECT count(*) AS n, CAST(sum(amount) AS DOUBLE) AS f FROM projects)""",
         f"""checks AS (
  SELECT 'ministry_projects' AS name, (SELECT count(amount) FROM projects WHERE ministry IS NOT NULL) AS actual, 'eq' AS op, 'n' AS kind
  UNION ALL SELECT 'ministry_funding', (SELECT CAST(sum(amount) AS DOUBLE) FROM projects WHERE ministry IS NOT NULL), 'pct', 'f'
  UNION ALL SELECT 'geographic_projects',
    (SELECT coalesce(sum(c), 0) FROM (SELECT state, count(amount) AS c FROM projects WHERE country = 'Deutschland'
       AND state IS NOT NULL GROUP BY state HAVING {present('state')}) s)
    + (SELECT count(*) FROM projects WHERE country IS DISTINCT FROM 'Deutschland'), 'eq', 'n'
  UNION ALL SELECT 'yearly_projects', (SELECT count(amount) FROM projects WHERE start_year IS NOT NULL), 'eq', 'n'
  UNION ALL SELECT 'yearly_funding', (SELECT CAST(sum(amount) AS DOUBLE) FROM projects WHERE start_year IS NOT NULL), 'pct', 'f'
  UNION ALL SELECT 'funding_type_projects', (SELECT count(amount) FROM projects WHERE {present('funding_type')}), 'eq', 'n'
  UNION ALL SELECT 'funding_profile_projects', (SELECT count(amount) FROM projects WHERE {present('profile')}), 'eq', 'n'
  UNION ALL SELECT 'joint_projects', (SELECT count(*) FILTER (WHERE is_joint) + count(*) FILTER (WHERE NOT is_joint) FROM projects), 'eq', 'n'
  UNION ALL SELECT 'sponsor_topk_projects', (SELECT coalesce(sum(c), 0) FROM (
      SELECT * FROM (SELECT sponsor, sum(amount) AS t, count(amount) AS c FROM projects WHERE sponsor IS NOT NULL
                     GROUP BY sponsor ORDER BY t DESC, sponsor LIMIT 20) x
      WHERE {present('sponsor')} AND trim(sponsor) <> '') y), 'le', 'n'
  UNION ALL SELECT 'duration_bins_projects', (SELECT count(*) FROM projects
      WHERE duration_months > 0 AND duration_months <= 360), 'le', 'n'
)""", """cons AS (
  SELECT name, 'error' AS severity,
         CAST(CASE WHEN kind = 'f' THEN base.f ELSE base.n END AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual,
         CASE WHEN op = 'eq' THEN actual = base.n WHEN op = 'le' THEN actual <= base.n
              ELSE abs(actual - base.f) / base.f * 100.0 < 0.01 END AS passed
  FROM checks, base
)"""]
oracle("conservation_checks", with_projects(*_CONS) + "SELECT name, severity, expected, actual, passed FROM cons")

oracle("validation_summary", with_projects(*_CONS, *_RECON) + f"""
SELECT severity, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed FROM (
  SELECT severity, passed FROM cons
  UNION ALL SELECT 'warning', passed FROM ({RECON_SELECT}) r
) u GROUP BY severity
""")

oracle("topk_coverage", with_projects(
    f"""sp AS (SELECT * FROM (SELECT sponsor, sum(amount) t, count(amount) c FROM projects WHERE sponsor IS NOT NULL
            GROUP BY sponsor ORDER BY t DESC, sponsor LIMIT 20) x WHERE {present('sponsor')} AND trim(sponsor) <> '')""",
    """rc AS (SELECT recipient, sum(amount) t, count(amount) c FROM projects WHERE recipient IS NOT NULL
            GROUP BY recipient ORDER BY t DESC, recipient LIMIT 50)""",
    """ct AS (SELECT city, state, sum(amount) t, count(amount) c FROM projects WHERE country = 'Deutschland'
            AND city IS NOT NULL AND state IS NOT NULL GROUP BY city, state ORDER BY t DESC, city, state LIMIT 30)""",
    f"""cl AS (SELECT * FROM (SELECT class_code, sum(amount) t, count(amount) c FROM projects WHERE class_code IS NOT NULL
            GROUP BY class_code ORDER BY t DESC, class_code LIMIT 50) x WHERE {present('class_code')})""",
    """jt AS (SELECT joint_name, sum(amount) t, count(amount) c FROM projects WHERE is_joint AND joint_name IS NOT NULL
            GROUP BY joint_name ORDER BY t DESC, joint_name LIMIT 30)""",
    """u AS (
  SELECT 'sponsors_top20' AS mart, count(*) AS shown, coalesce(sum(c), 0) AS covered_projects FROM sp
  UNION ALL SELECT 'recipients_top50', count(*), coalesce(sum(c), 0) FROM rc
  UNION ALL SELECT 'cities_top30', count(*), coalesce(sum(c), 0) FROM ct
  UNION ALL SELECT 'classifications_top50', count(*), coalesce(sum(c), 0) FROM cl
  UNION ALL SELECT 'joint_top30', count(*), coalesce(sum(c), 0) FROM jt
)""", "tot AS (SELECT count(*) AS n FROM projects)") + """
SELECT mart, shown, CAST(covered_projects AS BIGINT) AS covered_projects, tot.n AS total_projects,
       round(CAST(covered_projects AS DOUBLE) * 100.0 / tot.n, 4) AS coverage_pct,
       CAST(tot.n - covered_projects AS BIGINT) AS remaining
FROM u, tot
""")

_ABROAD = f"""CASE WHEN country IS DISTINCT FROM 'Deutschland'
                 THEN CASE WHEN {present('country')} AND trim(country) <> '' THEN 'foreign' ELSE 'blank_country' END END"""
_LISTS = [  # list, places, keys, cause that keeps a project off, label shown
    ("states", "NULL", ["state"], _ABROAD, present("state")),
    ("cities_top30", "30", ["city", "state"], _ABROAD, "true"),
    ("countries", "NULL", ["country"], "CASE WHEN country = 'Deutschland' THEN 'domestic' END",
     f"{present('country')} AND trim(country) <> ''"),
    ("sponsors_top20", "20", ["sponsor"], "NULL", f"{present('sponsor')} AND trim(sponsor) <> ''"),
    ("recipients_top50", "50", ["recipient"], "NULL", "true"),
    ("classifications_top50", "50", ["class_code"], "NULL", present("class_code")),
    ("joint_top30", "30", ["joint_name"], "CASE WHEN NOT is_joint THEN 'not_joint' END", "true"),
    ("funding_profiles", "NULL", ["profile"], "NULL", present("profile")),
]
oracle("omission_causes", with_projects("l AS (" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS list, CAST({k} AS INTEGER) AS k, {keys[0]} AS a, {keys[1] if len(keys) > 1 else chr(39) * 2} AS b, "
    f"coalesce({cause}, CASE WHEN {' OR '.join(f'{c} IS NULL' for c in keys)} THEN 'missing' END) AS cause, {ok} AS ok, amount FROM projects"
    for n, k, keys, cause, ok in _LISTS) + ")",
    "off AS (SELECT list, cause, count(*) AS n, sum(amount) AS f FROM l WHERE cause IS NOT NULL GROUP BY list, cause)",
    """ranked AS (
  SELECT list, k, bool_and(ok) AS ok, count(*) AS n, sum(amount) AS f,
         row_number() OVER (PARTITION BY list ORDER BY CAST(sum(amount) AS DOUBLE) DESC, a, b) AS place
  FROM l WHERE cause IS NULL GROUP BY list, k, a, b
)""", """parts AS (
  SELECT * FROM off UNION ALL
  SELECT list, CASE WHEN place > k THEN 'below_cut' WHEN NOT ok THEN 'blank' ELSE 'shown' END AS cause, n, f FROM ranked
)""") + """
SELECT list, cause, CAST(sum(n) AS BIGINT) AS projects, CAST(sum(f) AS DOUBLE) AS funding FROM parts GROUP BY list, cause
UNION ALL SELECT list, 'total', CAST(sum(n) AS BIGINT), CAST(sum(f) AS DOUBLE) FROM parts GROUP BY list
""")

# The checked marts hold what the projects hold: 0 groups differ wherever two builds are compared.
_PUBLISHED = [
    ("summary_projects", "error", "(SELECT count(*) FROM projects)", "(SELECT count(*) FROM projects)", "a = e"),
    ("summary_funding", "error", "(SELECT sum(amount) FROM projects)", "(SELECT sum(amount) FROM projects)", "a = e"),
    ("ministry_groups", "error", "0", "0", "a = e"),
    ("recipients_top5", "warning", "0", "0", "a = e"),
    ("states_top5", "warning", "0", "0", "a = e"),
    ("unique_recipients", "error", "(SELECT count(DISTINCT recipient) FROM projects)",
     "(SELECT count(DISTINCT recipient) FROM projects)", "a = e"),
    ("january_highest", "warning", "(SELECT max(n) FROM months WHERE m <> 1)", "(SELECT max(n) FROM months WHERE m = 1)",
     "coalesce(a > e, false)"),
    ("sponsors_top3", "warning", "0", "0", "a = e"),
    ("decade_shares_sum_100", "warning", "0", """(SELECT count(*) FROM (
       SELECT sum(amount) FILTER (WHERE ministry IS NOT NULL) / sum(amount) * 100.0 AS s FROM projects WHERE decade IS NOT NULL
       GROUP BY decade) d WHERE s <= 99.9 OR s >= 100.1)""", "a = e"),
    ("keyword_trends_structure", "error", "0", "0", "a = e"),
    ("state_trends_vs_geo", "warning", "0", f"""(SELECT count(*) FROM (
       SELECT state, sum(amount) AS trend, sum(amount) FILTER (WHERE country = 'Deutschland') AS geo FROM projects
       WHERE state IS NOT NULL GROUP BY state ORDER BY trend DESC, state LIMIT 20) s
       WHERE {present('state')} AND abs(trend - geo) / geo * 100.0 > 20.0)""", "a = e"),
    *[(f"trend_{many}", "warning", f"least({k}, (SELECT count(DISTINCT {c}) FROM projects WHERE {present(c)}))",
       f"(SELECT count(DISTINCT name) FROM ({entity_sql(c, k)}) t)", "a <= e AND a >= e - 1")
      for c, many, k in (("state", "states", 20), ("city", "cities", 30), ("recipient", "recipients", 50))],
    ("per_capita_formula", "warning", "0", "0", "a = e"),
    ("states_with_population", "error", "16", f"""(SELECT count(DISTINCT p.state) FROM projects p JOIN population USING (state)
       WHERE country = 'Deutschland' AND {present('p.state')})""", "a >= e"),
    ("population_matches_reference", "warning", "0", "0", "a = e"),
]
oracle("published_checks", with_projects(POPULATION, """months AS (
  SELECT start_month AS m, count(amount) AS n FROM projects WHERE start_month IS NOT NULL GROUP BY start_month
)""", "c AS (" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS name, '{sev}' AS severity, CAST({e} AS DOUBLE) AS expected, CAST({a} AS DOUBLE) AS actual" for n, sev, e, a, _ in _PUBLISHED) + ")")
    + "SELECT name, severity, expected, actual, CASE name " + " ".join(
    f"WHEN '{n}' THEN {rule.replace('a ', 'actual ').replace('(a ', '(actual ').replace(' e', ' expected')}" for n, _, _, _, rule in _PUBLISHED)
    + " END AS passed FROM c")

oracle("sponsor_rank_check", with_projects(
    f"""a AS (SELECT sponsor AS key_a, row_number() OVER (ORDER BY t DESC, sponsor) AS rank FROM (
  SELECT * FROM (SELECT sponsor, CAST(sum(amount) AS DOUBLE) t FROM projects WHERE sponsor IS NOT NULL
                 GROUP BY sponsor ORDER BY t DESC, sponsor LIMIT 20) x
  WHERE {present('sponsor')} AND trim(sponsor) <> '' ORDER BY t DESC, sponsor LIMIT 3) y)""",
    """b AS (SELECT sponsor AS key_b, row_number() OVER (ORDER BY t DESC, sponsor) AS rank FROM (
  SELECT sponsor, CAST(sum(amount) AS DOUBLE) t FROM projects GROUP BY sponsor ORDER BY t DESC, sponsor LIMIT 3) y)""") + """
SELECT coalesce(a.rank, b.rank) AS rank, key_a, key_b, coalesce(key_a = key_b, false) AS same
FROM a FULL OUTER JOIN b ON a.rank = b.rank
""")

oracle("sponsor_amount_check", with_projects("""s AS (
  SELECT CAST(sum(amount) AS DOUBLE) AS t, sponsor FROM projects GROUP BY sponsor
)""", f"""a AS (SELECT t AS published, row_number() OVER (ORDER BY t DESC, sponsor) AS rank FROM (
  SELECT * FROM (SELECT * FROM s WHERE sponsor IS NOT NULL ORDER BY t DESC, sponsor LIMIT 20) x
  WHERE {present('sponsor')} AND trim(sponsor) <> '' ORDER BY t DESC, sponsor LIMIT 3) y)""",
    """b AS (SELECT t AS source, row_number() OVER (ORDER BY t DESC, sponsor NULLS FIRST) AS rank
  FROM (SELECT * FROM s ORDER BY t DESC, sponsor NULLS FIRST LIMIT 3) y)""") + """
SELECT coalesce(a.rank, b.rank) AS rank, published, source,
       coalesce(CASE WHEN source = 0 THEN published = 0 ELSE abs(published - source) / abs(source) * 100.0 < 0.01 END, false) AS passed
FROM a FULL OUTER JOIN b ON a.rank = b.rank
""")

oracle("unparsable_dates", """
SELECT CASE WHEN trim(d) = '' THEN '' ELSE d END AS value, count(*) AS rows FROM (
  SELECT CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%m.%Y')
              WHEN o_orderpriority = '5-LOW' THEN '  ' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS d FROM orders) r
WHERE len(string_split(d, '.')) <> 3 GROUP BY 1 ORDER BY 1 LIMIT 10
""")

oracle("country_shares_text", with_projects() + """
SELECT CASE WHEN coalesce(country, '') = '' THEN 'N/A' ELSE substr(country, 1, 5) END AS label, country,
       format('{:,}', count(*)) AS projects_text,
       printf('%.2f%%', count(*) * 100.0 / (SELECT count(*) FROM projects)) AS share_text
FROM projects GROUP BY country
""")

oracle("schema_profile", with_projects() + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", 'string' AS dtype, count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\" FROM projects"
    for c in AUDIT_COLUMNS))

oracle("value_profile", with_projects(*[
    f"v_{c} AS (SELECT '{c}' AS \"column\", 'string' AS dtype, {c} AS \"value\", count(*) AS \"count\", "
    f"sum(count(*)) OVER () AS non_null FROM projects WHERE {c} IS NOT NULL GROUP BY {c})" for c in AUDIT_COLUMNS])
    + "\nUNION ALL\n".join(
    f"SELECT \"column\", dtype, CAST(non_null AS BIGINT) AS non_null, \"value\", \"count\", "
    f"round(\"count\" * 100.0 / CAST(non_null AS DOUBLE), 4) AS share_pct FROM v_{c} WHERE \"count\" * 100 >= non_null"
    for c in AUDIT_COLUMNS))

# --- snapshot diff -------------------------------------------------------------------

_SNAP = SNAPSHOT_SQL.strip()
ADDED = "added AS (SELECT * FROM snap_new n WHERE fkz IS NOT NULL AND fkz NOT IN (SELECT fkz FROM snap_old WHERE fkz IS NOT NULL))"
REMOVED = "removed AS (SELECT * FROM snap_old o WHERE fkz IS NOT NULL AND fkz NOT IN (SELECT fkz FROM snap_new WHERE fkz IS NOT NULL))"

oracle("snapshot_added", with_projects(_SNAP, ADDED) + "SELECT fkz, row_id, start_date FROM added")
oracle("snapshot_removed", with_projects(_SNAP, REMOVED) + "SELECT fkz, row_id FROM removed")
oracle("snapshot_changed", with_projects(_SNAP, REVISED_SQL.strip()) + f"""
SELECT * FROM (
  SELECT coalesce(o.fkz, n.fkz) AS fkz,
         CASE WHEN o.fkz IS NULL THEN 'added' WHEN n.fkz IS NULL THEN 'removed' ELSE 'changed' END AS change,
         CASE WHEN o.fkz IS NOT NULL AND n.fkz IS NOT NULL THEN concat_ws(',', {", ".join(
             f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{c}' END" for c in CHANGE_COLUMNS)}) END AS columns
  FROM snap_old o FULL JOIN snap_revised n ON o.fkz = n.fkz) t
WHERE columns IS NULL OR columns <> ''
""")
oracle("snapshot_positions", with_projects(_SNAP, ADDED, REMOVED) + """
SELECT o.old_rows, n.new_rows, o.old_unique, n.new_unique, a.added, r.removed, n.new_rows - o.old_rows AS net_change,
       CASE WHEN a.mn IS NOT NULL THEN (SELECT count(*) FROM snap_new WHERE row_id < a.mn) END AS added_min_pos,
       CASE WHEN a.mx IS NOT NULL THEN (SELECT count(*) FROM snap_new WHERE row_id < a.mx) END AS added_max_pos,
       CASE WHEN a.added = 0 THEN 'none' WHEN a.mx = n.last THEN 'appended' WHEN a.mn = n.first THEN 'prepended'
            ELSE 'scattered' END AS placement
FROM (SELECT count(*) AS old_rows, count(DISTINCT fkz) AS old_unique FROM snap_old) o,
     (SELECT count(*) AS new_rows, count(DISTINCT fkz) AS new_unique, min(row_id) AS first, max(row_id) AS last FROM snap_new) n,
     (SELECT count(*) AS added, min(row_id) AS mn, max(row_id) AS mx FROM added) a,
     (SELECT count(*) AS removed FROM removed) r
""")
oracle("snapshot_file_positions", with_projects(_SNAP) + """
SELECT fkz, row_number() OVER (ORDER BY row_id) - 1 AS position FROM snap_new
""")
oracle("snapshot_key_order", with_projects(_SNAP, ADDED) + """
SELECT * FROM (SELECT 'old_last' AS list, fkz FROM (SELECT DISTINCT fkz FROM snap_old WHERE fkz IS NOT NULL) k
               ORDER BY fkz DESC LIMIT 10) a
UNION ALL
SELECT * FROM (SELECT 'added_first' AS list, fkz FROM (SELECT DISTINCT fkz FROM added) k ORDER BY fkz LIMIT 10) b
""")

# --- serving marts ----------------------------------------------------------------------

oracle("last_years", with_projects() + f"""
SELECT start_year AS year, {STATS} FROM projects WHERE start_year IS NOT NULL
  AND start_year >= {P.current_year - 3} GROUP BY start_year
""")

oracle("per_capita_ranking", with_projects(POPULATION, f"""st AS (
  SELECT s.state AS name, total_funding, p.population, total_funding / nullif(CAST(p.population AS DOUBLE), 0) AS pc
  FROM (SELECT state, {STATS} FROM projects WHERE country = 'Deutschland' AND state IS NOT NULL GROUP BY state) s
  LEFT JOIN population p ON p.state = s.state WHERE {present('s.state')}
  ORDER BY total_funding DESC, name LIMIT 16
)""") + """
SELECT row_number() OVER (ORDER BY pc DESC, name) AS rank, name, pc AS per_capita_funding, total_funding, population
FROM st WHERE pc IS NOT NULL AND pc <> 0
""")

oracle("decade_share_matrix", with_projects("""a AS (
  SELECT decade, ministry, sum(amount) AS f FROM projects WHERE decade IS NOT NULL GROUP BY decade, ministry
)""", "t AS (SELECT decade, sum(f) AS tot FROM a GROUP BY decade)", """sh AS (
  SELECT a.decade, a.ministry,
         CASE WHEN t.tot > 0 THEN CAST(a.f AS DOUBLE) / CAST(t.tot AS DOUBLE) * 100.0 ELSE 0.0 END AS share_pct
  FROM a JOIN t ON a.decade = t.decade WHERE a.ministry IS NOT NULL
)""") + """
SELECT d.decade, m.ministry, coalesce(sh.share_pct, 0.0) AS share_pct
FROM (SELECT DISTINCT decade FROM sh) d CROSS JOIN (SELECT DISTINCT ministry FROM sh) m
LEFT JOIN sh ON sh.decade = d.decade AND sh.ministry = m.ministry
""")

oracle("funding_type_share", with_projects(f"""ft AS (
  SELECT funding_type AS name, {STATS_NO_AVG} FROM projects WHERE funding_type IS NOT NULL
  GROUP BY funding_type HAVING {present('funding_type')}
)""") + """
SELECT name, total_funding, project_count,
       round(total_funding / (SELECT CAST(sum(CAST(total_funding AS DECIMAL(38,2))) AS DOUBLE) FROM ft) * 100.0, 6) AS share_pct
FROM ft
""")

oracle("adjusted_recipient_count", with_projects() + """
SELECT count(DISTINCT recipient) - 1 AS min_distinct_recipients FROM projects
""")


oracle("entity_drilldown", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS entity_type, * FROM (\n{entity_sql(e, k)}) {t}_q"
    for t, e, k in [("state", "state", 20), ("city", "city", 30), ("recipient", "recipient", 50)]))

def _recipient_table(order: str) -> str:
    return with_projects(f"""r AS (
  SELECT recipient AS name, {STATS} FROM projects WHERE recipient IS NOT NULL
  GROUP BY recipient ORDER BY {order} DESC, recipient LIMIT 20
)""", """tr AS (
  SELECT recipient FROM (SELECT recipient, sum(amount) AS t, count(start_year) AS y FROM projects WHERE recipient IS NOT NULL
                         GROUP BY recipient ORDER BY t DESC, recipient LIMIT 50) q WHERE y > 0
)""") + f"""
SELECT row_number() OVER (ORDER BY {order} DESC, name) AS rank,
       CASE WHEN length(name) > 50 THEN substr(name, 1, 50) || '...' ELSE name END AS label,
       name, total_funding, project_count, coalesce(avg_funding, total_funding / nullif(CAST(project_count AS DOUBLE), 0)) AS avg_funding,
       name IN (SELECT recipient FROM tr) AS has_trend
FROM r
"""


oracle("recipient_table", _recipient_table("total_funding"))
oracle("recipient_table_count", _recipient_table("project_count"))

oracle("international_top", with_projects() + f"""
SELECT country AS name, {STATS_NO_AVG} FROM projects
WHERE country IS DISTINCT FROM 'Deutschland' AND country IS NOT NULL
GROUP BY country HAVING {present('country')} AND trim(country) <> ''
ORDER BY total_funding DESC, name LIMIT 15
""")


def _compact(v: str) -> str:
    return (f"CASE WHEN {v} >= 1e12 THEN printf('€%.1fT', {v} / 1e12) "
            f"WHEN {v} >= 1e9 THEN printf('€%.1fB', {v} / 1e9) "
            f"WHEN {v} >= 1e6 THEN printf('€%.1fM', {v} / 1e6) "
            f"WHEN {v} >= 1e3 THEN printf('€%.0fK', {v} / 1e3) ELSE printf('€%.0f', {v}) END")


oracle("display_formats", with_projects(f"""m AS (
  SELECT ministry AS code, {STATS} FROM projects WHERE ministry IS NOT NULL GROUP BY ministry
  ORDER BY total_funding DESC, code LIMIT 10
)""") + f"""
SELECT code, {_compact('total_funding')} AS compact,
       translate(format('{{:,.2f}}', total_funding), ',.', '.,') AS german,
       translate(format('{{:,.0f}}', CAST(project_count AS DOUBLE)), ',.', '.,') AS projects_text,
       translate(format('{{:,.0f}}', total_funding), ',.', '.,') || chr(160) || '€' AS currency,
       CASE WHEN project_count < 10000 THEN CAST(project_count AS VARCHAR)
            WHEN project_count < 999500 THEN translate(format('{{:,.0f}}', CAST(project_count AS DOUBLE)), ',.', '.,')
            ELSE translate(format('{{:.1f}}', project_count / 1e6), '.', ',') || chr(160) || 'Mio.' END AS projects_compact
FROM m
""")

# --- locale round trip -------------------------------------------------------------------

oracle("locale_roundtrip", """
WITH r AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS fkz,
         '="' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') || '"' AS raw_amount,
         strftime(o_orderdate, '%d.%m.%Y') AS raw_date, o_totalprice, CAST(o_orderdate AS DATE) AS d
  FROM orders
), p AS (
  SELECT *, coalesce(TRY_CAST(replace(replace(substr(raw_amount, 3, length(raw_amount) - 3), '.', ''), ',', '.')
                              AS DECIMAL(18,2)), 0) AS amt,
         CAST(try_strptime(raw_date, '%d.%m.%Y') AS DATE) AS sd
  FROM r
)
SELECT fkz, raw_amount, CAST(amt AS DOUBLE) AS amount, raw_date, sd AS start_date,
       amt = CAST(o_totalprice AS DECIMAL(18,2)) AS amount_ok, sd = d AS date_ok
FROM p
""")

# --- export round trip: what is read back, from the projects themselves ------------------------

_FIELDS = ["fkz", "ministry", "unit", "sponsor", "work_unit", "recipient", "municipality_code", "municipality", "city", "state",
           "country", "executing_body", "written", "class_code", "class_text", "start_date", "end_date", "amount", "profile",
           "joint_name", "funding_type"]
oracle("export_roundtrip", with_projects(r"""w AS (
  SELECT *, regexp_replace(regexp_replace(title, '[\r\n]+', ' ', 'g'), '""" + UNMAPPED + r"""', '?', 'g') AS written FROM projects
)""") + f"""
SELECT row_id, 'read' AS status, CAST(amount AS DOUBLE) AS amount, start_date, end_date, start_year, is_joint,
       sha256({" || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in _FIELDS)}) AS fields_sha256
FROM w WHERE NOT coalesce(contains(written, ';'), false)
UNION ALL SELECT row_id, 'rejected', NULL, NULL, NULL, NULL, NULL, NULL FROM w WHERE contains(written, ';')
""")
