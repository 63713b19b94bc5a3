"""DuckDB SQL twins of the registered queries (the correctness oracle).

Every string runs on DuckDB with the driver's tables registered as views. Each begins
from the same ``projects`` definition as ``sources.tables.projects`` and spells out the
same rules independently in SQL.
"""

from __future__ import annotations

from fundlens import dims
from fundlens.plans.params import DRIVER_PARAMS as P
from fundlens.sources.tables import PROJECTS_SQL

_ORACLES: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values_cte(name: str, cols: list[str], rows) -> str:
    body = ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES {body})"


MINISTRY_DIM = values_cte("ministry_dim", ["code", "name"], dims.MINISTRY_NAMES)
SPONSOR_DIM = values_cte("sponsor_dim", ["code", "name"], dims.SPONSOR_NAMES)
STOPWORD_DIM = values_cte("stopword_dim", ["word"], [(w,) for w in dims.STOPWORDS])
POPULATION = """population AS (
  SELECT n_name AS state, count(*) * 10000 AS population
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
)"""


def with_projects(*ctes: str) -> str:
    return "WITH " + ",\n".join([PROJECTS_SQL.strip()] + [c.strip() for c in ctes]) + "\n"


def oracle(name: str, sql: str) -> None:
    _ORACLES[name] = sql


def oracles() -> dict[str, str]:
    from fundlens.plans import oracle_more, oracle_quality  # noqa: F401
    return dict(_ORACLES)


# present(x): not NULL, not '', not 'nan'
def present(c: str) -> str:
    return f"({c} IS NOT NULL AND {c} <> '' AND {c} <> 'nan')"


STATS = "CAST(sum(amount) AS DOUBLE) AS total_funding, CAST(sum(amount) AS DOUBLE) / count(amount) AS avg_funding, count(amount) AS project_count"
STATS_NO_AVG = "CAST(sum(amount) AS DOUBLE) AS total_funding, count(amount) AS project_count"

oracle("ministry_funding", with_projects(MINISTRY_DIM) + f"""
SELECT s.ministry AS code, coalesce(d.name, s.ministry) AS name, total_funding, avg_funding, project_count
FROM (SELECT ministry, {STATS} FROM projects WHERE ministry IS NOT NULL GROUP BY ministry) s
LEFT JOIN ministry_dim d ON d.code = s.ministry
""")

oracle("ministry_totals", with_projects() + """
SELECT CAST(sum(amount) AS DOUBLE) AS total_funding, count(*) AS total_projects FROM projects
""")

oracle("state_funding_per_capita", with_projects(POPULATION) + f"""
SELECT s.state AS name, total_funding, avg_funding, project_count, p.population,
       total_funding / nullif(CAST(p.population AS DOUBLE), 0) AS per_capita_funding
FROM (SELECT state, {STATS} FROM projects WHERE country = 'Deutschland' AND state IS NOT NULL GROUP BY state) s
LEFT JOIN population p ON p.state = s.state
WHERE {present('s.state')}
""")

oracle("city_top", with_projects() + f"""
SELECT city, state, {STATS_NO_AVG} FROM projects
WHERE country = 'Deutschland' AND city IS NOT NULL AND state IS NOT NULL
GROUP BY city, state ORDER BY total_funding DESC, city, state LIMIT 30
""")

oracle("country_international", with_projects() + f"""
SELECT country AS name, {STATS_NO_AVG} FROM projects
WHERE country IS DISTINCT FROM 'Deutschland' AND country IS NOT NULL
GROUP BY country HAVING {present('country')} AND trim(country) <> ''
""")

oracle("international_totals", with_projects() + """
SELECT CAST(sum(amount) AS DOUBLE) AS total_funding, count(*) AS total_projects
FROM projects WHERE country IS DISTINCT FROM 'Deutschland'
""")

oracle("domestic_totals", with_projects() + """
SELECT CAST(sum(amount) AS DOUBLE) AS total_domestic_funding, count(*) AS total_domestic_projects
FROM projects WHERE country = 'Deutschland'
""")

oracle("recipients_top_funding", with_projects() + f"""
SELECT recipient AS name, {STATS} FROM projects WHERE recipient IS NOT NULL
GROUP BY recipient ORDER BY total_funding DESC, recipient LIMIT 50
""")

oracle("recipients_top_count", with_projects() + f"""
SELECT recipient AS name, {STATS_NO_AVG} FROM projects WHERE recipient IS NOT NULL
GROUP BY recipient ORDER BY project_count DESC, recipient LIMIT 50
""")

oracle("unique_recipients", with_projects() + """
SELECT count(DISTINCT recipient) AS unique_recipients FROM projects
""")

oracle("classification_top", with_projects() + f"""
SELECT code, CASE WHEN {present('first_text')} THEN first_text ELSE code END AS description,
       total_funding, project_count
FROM (
  SELECT class_code AS code, CAST(sum(amount) AS DOUBLE) AS total_funding, count(amount) AS project_count,
         arg_min(class_text, row_id) FILTER (WHERE class_text IS NOT NULL) AS first_text
  FROM projects WHERE class_code IS NOT NULL GROUP BY class_code
  ORDER BY total_funding DESC, code LIMIT 50
) t WHERE {present('code')}
""")

oracle("funding_types", with_projects() + f"""
SELECT funding_type AS name, {STATS_NO_AVG} FROM projects WHERE funding_type IS NOT NULL
GROUP BY funding_type HAVING {present('funding_type')}
""")

oracle("funding_profiles", with_projects() + f"""
SELECT profile AS name, {STATS_NO_AVG} FROM projects WHERE profile IS NOT NULL
GROUP BY profile HAVING {present('profile')}
""")


def first_k_distinct_sql(src: str, key: str, value: str, k: int, out: str) -> str:
    """First k distinct non-null values per key in row order, joined with '|'."""
    return f"""{out}_firsts AS (
  SELECT {key}, string_agg({value}, '|' ORDER BY pos, {value}) AS {out}
  FROM (
    SELECT {key}, {value}, pos, row_number() OVER (PARTITION BY {key} ORDER BY pos, {value}) AS rn
    FROM (SELECT {key}, {value}, min(row_id) AS pos FROM {src}
          WHERE {key} IS NOT NULL AND {value} IS NOT NULL GROUP BY {key}, {value}) a
  ) b WHERE rn <= {k} GROUP BY {key}
)"""


oracle("sponsor_top", with_projects(
    SPONSOR_DIM,
    f"""top AS (
  SELECT sponsor, {STATS} FROM projects WHERE sponsor IS NOT NULL GROUP BY sponsor
  ORDER BY total_funding DESC, sponsor LIMIT 20
)""",
    "shown AS (SELECT * FROM top WHERE " + present("sponsor") + " AND trim(sponsor) <> '')",
    first_k_distinct_sql("(SELECT * FROM projects WHERE sponsor IN (SELECT sponsor FROM shown))",
                         "sponsor", "ministry", 3, "ministries")) + """
SELECT s.sponsor AS code, coalesce(d.name, s.sponsor) AS name, total_funding, avg_funding, project_count,
       coalesce(f.ministries, '') AS ministries
FROM shown s LEFT JOIN sponsor_dim d ON d.code = s.sponsor LEFT JOIN ministries_firsts f ON f.sponsor = s.sponsor
""")

oracle("sponsor_ministry_top", with_projects() + f"""
SELECT pt, ministry, funding, projects FROM (
  SELECT sponsor AS pt, ministry, CAST(sum(amount) AS DOUBLE) AS funding, count(amount) AS projects
  FROM projects WHERE sponsor IS NOT NULL AND ministry IS NOT NULL GROUP BY sponsor, ministry
  ORDER BY funding DESC, pt, ministry LIMIT 30
) t WHERE {present('pt')} AND trim(pt) <> ''
""")

oracle("sponsor_unique_count", with_projects() + """
SELECT count(DISTINCT sponsor) AS unique_count FROM projects
""")

oracle("joint_summary", with_projects() + """
SELECT count(*) FILTER (WHERE is_joint) AS joint_project_count,
       count(*) FILTER (WHERE NOT is_joint) AS individual_project_count,
       CAST(coalesce(sum(amount) FILTER (WHERE is_joint), 0) AS DOUBLE) AS joint_funding,
       CAST(coalesce(sum(amount) FILTER (WHERE NOT is_joint), 0) AS DOUBLE) AS individual_funding
FROM projects
""")

oracle("joint_top", with_projects(
    """joint AS (SELECT * FROM projects WHERE is_joint)""",
    """top AS (
  SELECT joint_name, CAST(sum(amount) AS DOUBLE) AS total_funding, count(amount) AS subproject_count
  FROM joint WHERE joint_name IS NOT NULL GROUP BY joint_name
  ORDER BY total_funding DESC, joint_name LIMIT 30
)""",
    first_k_distinct_sql("(SELECT * FROM joint WHERE joint_name IN (SELECT joint_name FROM top))",
                         "joint_name", "state", 5, "states")) + """
SELECT t.joint_name AS name, total_funding, subproject_count, coalesce(f.states, '') AS states_involved
FROM top t LEFT JOIN states_firsts f ON f.joint_name = t.joint_name
""")

oracle("summary_stats", with_projects(POPULATION, f"""
states AS (
  SELECT state AS name, CAST(sum(amount) AS DOUBLE) AS total_funding FROM projects
  WHERE country = 'Deutschland' AND state IS NOT NULL GROUP BY state HAVING {present('state')}
)""") + """
SELECT count(*) AS total_projects,
       CAST(sum(amount) AS DOUBLE) AS total_funding,
       count(DISTINCT recipient) AS unique_recipients,
       count(DISTINCT ministry) AS unique_ministries,
       strftime(min(start_date), '%Y-%m-%dT%H:%M:%S') AS earliest_start,
       strftime(max(start_date), '%Y-%m-%dT%H:%M:%S') AS latest_start,
       CAST(sum(amount) AS DOUBLE) / count(*) AS avg_project_funding,
       round(median(CAST(amount AS DOUBLE)), 4) AS median_project_funding,
       count(DISTINCT ministry) AS ministry_count,
       (SELECT count(*) FROM states) AS state_count,
       (SELECT ministry FROM projects WHERE ministry IS NOT NULL GROUP BY ministry
        ORDER BY sum(amount) DESC, ministry LIMIT 1) AS top_ministry,
       (SELECT name FROM states ORDER BY total_funding DESC, name LIMIT 1) AS top_state,
       (SELECT recipient FROM projects WHERE recipient IS NOT NULL GROUP BY recipient
        ORDER BY sum(amount) DESC, recipient LIMIT 1) AS top_recipient
FROM projects
""")

oracle("value_counts_pct", with_projects() + """
SELECT value, count, round(CAST(count AS DOUBLE) * 100.0 / (SELECT count(*) FROM projects), 4) AS pct FROM (
  SELECT funding_type AS value, count(*) AS count FROM projects GROUP BY funding_type
) t WHERE value IS NOT NULL
""")

oracle("recent_projects", with_projects() + """
SELECT fkz, title AS thema, recipient, ministry, unit AS referat, sponsor AS projekttraeger,
       CAST(amount AS DOUBLE) AS funding,
       strftime(start_date, '%d.%m.%Y') AS start_date, strftime(end_date, '%d.%m.%Y') AS end_date,
       CAST(trunc(date_diff('day', start_date, end_date) / 30.44) AS INTEGER) AS duration_months,
       state, city, country, executing_body AS executing_org, class_code AS classification,
       class_text AS classification_text, funding_type, profile AS funding_profile, joint_name AS joint_project
FROM projects ORDER BY row_id DESC LIMIT 5
""")

oracle("latest_starts", with_projects() + """
SELECT fkz, start_date, title FROM projects WHERE start_date IS NOT NULL
ORDER BY start_date DESC, row_id LIMIT 5
""")
