"""Checks from one scan, omission causes and the written export on hand-made projects."""

from decimal import Decimal

import datetime as dt

from pyspark.sql import functions as F

from fundlens.functions import normalize as N
from fundlens.operators import duration as D
from fundlens.operators import marts as M
from fundlens.operators import omissions as OM
from fundlens.operators import quality as Q
from fundlens.operators import trends as TR
from fundlens.sources import register_csv as RC
from fundlens.sources.tables import PROJECT_COLUMNS

from test_operators import proj


def sample(spark):
    day = dt.date(2020, 1, 1)
    rows = [dict(fkz=str(i), ministry="A" if i % 2 else None, sponsor=["P", "Q", "", None][i % 4], recipient=f"r{i % 3}",
                 city="c", state=["x", "", None][i % 3], country=["Deutschland", "Frankreich", "", None][i % 4],
                 class_code=f"k{i % 2}", start_date=day if i % 5 else None, end_date=dt.date(2021, 1, 1),
                 amount=Decimal(10 + i), profile="p" if i % 2 else None, joint_name=["J", "", None][i % 3],
                 funding_type="t") for i in range(24)]
    return proj(spark, rows)


def test_conservation_checks_scan_equals_published_marts(spark):
    p = sample(spark)
    marts = {"ministry_funding": M.ministry_funding(p), "state_funding": M.state_funding(p), "yearly_totals": TR.yearly_totals(p),
             "funding_types": M.funding_types(p), "funding_profiles": M.funding_profiles(p), "sponsor_top": M.sponsor_top(p, 20),
             "duration_histogram": D.duration_histogram(p)}
    scan = sorted(map(tuple, Q.conservation_checks(p).collect()))
    assert scan == sorted(map(tuple, Q.conservation_checks(p, m=marts).collect()))
    by = {r[0]: r for r in scan}
    assert by["ministry_projects"][2:] == (24.0, 12.0, False) and by["joint_projects"][2:] == (24.0, 24.0, True)
    assert by["sponsor_topk_projects"][2:] == (24.0, 12.0, True)
    plan = Q.conservation_checks(p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and "scalar-subquery" not in plan


def test_conservation_checks_without_projects(spark):
    rows = Q.conservation_checks(sample(spark).limit(0)).collect()
    assert len(rows) == 10 and all(r["passed"] and r["expected"] == 0 for r in rows)


def test_sponsor_cut_in_the_scan(spark):
    rows = [dict(fkz=str(i), sponsor=f"s{i // 2:02d}", amount=Decimal(100 - i)) for i in range(10)]
    by = {r["name"]: r for r in Q.conservation_checks(proj(spark, rows), k_sponsors=3).collect()}
    assert by["sponsor_topk_projects"]["actual"] == 6


def test_omission_causes_add_up(spark):
    p = sample(spark)
    got = {(r["list"], r["cause"]): (r["projects"], r["funding"]) for r in OM.causes(p).collect()}
    for name in {n for n, _ in got}:
        parts = [v for (n, c), v in got.items() if n == name and c != "total"]
        assert sum(n for n, _ in parts) == got[name, "total"][0] == 24
        assert sum(f for _, f in parts) == got[name, "total"][1]
    assert got["states", "foreign"][0] == 6 and got["states", "blank_country"][0] == 12
    assert {c: v[0] for (n, c), v in got.items() if n == "states" and c in ("shown", "blank", "missing")} == {
        "shown": 2, "blank": 2, "missing": 2}
    assert got["sponsors_top20", "blank"][0] == 6 and got["sponsors_top20", "missing"][0] == 6
    assert OM.causes(p.limit(0)).count() == 0


def test_omission_causes_below_the_cut_and_ties(spark):
    rows = [dict(fkz=str(i), recipient=f"r{i}", amount=Decimal(5)) for i in range(6)]
    li = [OM.Listing("two", ["recipient"], F.lit(None).cast("string"), F.lit(True), 2)]
    got = {r["cause"]: r["projects"] for r in OM.causes(proj(spark, rows), li).collect()}
    assert got == {"shown": 2, "below_cut": 4, "total": 6}


def test_wide_amounts_are_read(spark):
    df = spark.createDataFrame([("12.345.678.901.234.567.890,12",), ("x",), (None,), ("9" * 27,)], "s string")
    got = [r[0] for r in df.select(N.parse_amount("s")).collect()]
    assert got == [Decimal("12345678901234567890.12"), Decimal("0.00"), Decimal("0.00"), Decimal("0.00")]


def test_export_lines_round_trip_and_rejects(spark):
    titles = ["plain", "a;b", "line\r\nbreak", "Ü€ \U0001F600 x", "", None, "nan", "  edge ", '="x"', "y" * 50_000, "NA"]
    p = proj(spark, [dict(fkz=str(i), title=t, amount=Decimal("1234567.89"), start_date=dt.date(2020, 2, 29))
                     for i, t in enumerate(titles)])
    p = p.select(*[F.col(c) if c in p.columns else F.lit("u").alias(c) for c in PROJECT_COLUMNS])
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    lay = RC.layout(RC.EXPORT_HEADER)
    raw = RC.parse_lines(RC.export_lines(p), lay)
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before
    back = {r["fkz"]: r for r in RC.normalise(raw, lay).collect()}
    assert {r["_pos"] for r in RC.rejects(raw, lay).collect()} == {r["row_id"] for r in p.where("title = 'a;b'").collect()}
    want = {str(i): t for i, t in enumerate(titles) if t != "a;b"} | {"2": "line break", "3": "Ü€ ? x"}
    assert {k: r["title"] for k, r in back.items()} == want
    assert all(r["amount"] == Decimal("1234567.89") and r["start_date"] == dt.date(2020, 2, 29) and r["end_date"] is None
               and r["unit"] == "u" for r in back.values())
    assert RC.normalise(RC.parse_lines(RC.export_lines(p.limit(0)), lay), lay).count() == 0
