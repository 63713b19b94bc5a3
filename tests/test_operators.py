"""Operators on small hand-made project tables (sequence, tie and blank rules)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fundlens.operators import aggregate as A
from fundlens.operators import duration as D
from fundlens.functions import normalize as N
from fundlens.operators import forecast as FC
from fundlens.operators import marts as M
from fundlens.operators import snapshot as SN
from fundlens.operators import stats as S
from fundlens.operators import trends as TR
from fundlens.plans.params import Params
from fundlens.sources.tables import derive

COLS = ["row_id", "fkz", "ministry", "sponsor", "recipient", "city", "state", "country", "title", "class_code",
        "class_text", "start_date", "end_date", "amount", "profile", "joint_name", "funding_type"]
SCHEMA = ("row_id long, fkz string, ministry string, sponsor string, recipient string, city string, state string, "
          "country string, title string, class_code string, class_text string, start_date date, end_date date, "
          "amount decimal(18,2), profile string, joint_name string, funding_type string")


def proj(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = {c: None for c in COLS}
        d.update(row_id=i, fkz=f"K{i}", amount=Decimal("0"))
        d.update(r)
        if isinstance(d["amount"], (int, float)):
            d["amount"] = Decimal(str(d["amount"]))
        full.append(tuple(d[c] for c in COLS))
    return derive(spark.createDataFrame(full, SCHEMA))


def year_rows(amounts, start=2010):
    return [{"start_date": dt.date(start + i, 1, 1), "amount": a, "ministry": "M"} for i, a in enumerate(amounts)]


def test_yoy_growth_rules(spark):
    p = proj(spark, year_rows([10, 5, 0, 0, 8]))
    g = [r.growth_pct for r in TR.yoy_growth(p, 2010).orderBy("year").collect()]
    assert g == [None, -50.0, -100.0, None, None]


def test_yoy_zero_growth_is_null(spark):
    p = proj(spark, year_rows([10, 10]))
    assert [r.growth_pct for r in TR.yoy_growth(p, 2010).orderBy("year").collect()] == [None, None]


def test_pct_change_zero_divisor(spark):
    p = proj(spark, year_rows([10, 0, 5]))
    ch = S.yoy_changes(S.yearly_window(p, 2010, None)).orderBy("year").collect()
    assert [r.yoy_change for r in ch] == [None, -100.0, None]


def test_first_k_distinct_in_file_order(spark):
    p = proj(spark, [{"sponsor": "S", "ministry": m} for m in ["b", "a", "b", "c", None, "d"]])
    r = A.first_k_distinct(p, ["sponsor"], "ministry", 3, out="m").first()
    assert r.m == ["b", "a", "c"]


def test_mode_tie_smallest(spark):
    p = proj(spark, [{"city": "C", "state": s} for s in ["b", "a", "b", "a"]])
    assert A.modal_value(p, ["city"], "state").first()["mode"] == "a"


def test_topk_tie_smaller_key(spark):
    p = proj(spark, [{"recipient": n, "amount": 5} for n in ["z", "y", "x"]])
    assert [r.name for r in M.recipients_top_funding(p, 2).collect()] == ["x", "y"]


def test_blank_groups_suppressed_after_limit(spark):
    rows = [{"funding_type": "", "amount": 100}, {"funding_type": "A", "amount": 10},
            {"funding_type": None, "amount": 1000}, {"funding_type": "nan", "amount": 5}]
    p = proj(spark, rows)
    assert [r.name for r in M.funding_types(p).collect()] == ["A"]
    top = M.sponsor_ministry_top(proj(spark, [{"sponsor": "", "ministry": "M", "amount": 9},
                                              {"sponsor": "P", "ministry": "M", "amount": 1}]), 1)
    assert top.count() == 0  # the only row of the top-1 is blank -> shown list is empty


def test_median_and_std(spark):
    p = proj(spark, [{"ministry": "M", "start_date": dt.date(2020, 1, 1),
                      "end_date": dt.date(2020, 1, 1) + dt.timedelta(days=round(m * 30.44))}
                     for m in [1, 2, 4, 9]] + [{"ministry": "N", "start_date": dt.date(2020, 1, 1),
                                                "end_date": dt.date(2020, 3, 1)}])
    r = {x.ministry: x for x in D.duration_by_ministry(p).collect()}
    assert abs(r["M"].median_months - 3.0) < 0.02
    assert r["N"].std_months is None


def test_duration_bins_right_closed(spark):
    def row(days):
        return {"start_date": dt.date(2000, 1, 1), "end_date": dt.date(2000, 1, 1) + dt.timedelta(days=days)}
    # 0 days -> no bin; 6.0 months exactly -> "<6 months"; > 360 months -> no bin
    days = [0, round(6 * 30.44, 2), 200, 11000]
    p = proj(spark, [row(d) for d in days])
    hist = {r.range: r["count"] for r in D.duration_histogram(p).collect()}
    assert len(hist) == 7 and sum(hist.values()) == 2
    assert hist["6-12 months"] == 1


def test_decade_share_includes_null_ministry_in_total(spark):
    p = proj(spark, [{"start_date": dt.date(2001, 1, 1), "ministry": "A", "amount": 50},
                     {"start_date": dt.date(2002, 1, 1), "ministry": None, "amount": 50}])
    r = TR.decade_ministry_share(p).collect()
    assert len(r) == 1 and r[0].share_pct == 50.0


def test_entity_trends_totals_include_null_year(spark):
    p = proj(spark, [{"state": "S", "start_date": dt.date(2001, 1, 1), "amount": 10},
                     {"state": "S", "start_date": None, "amount": 5}])
    r = TR.entity_trends(p, "state", 5).collect()
    assert len(r) == 1 and r[0].funding == 10.0 and r[0].total_funding == 15.0 and r[0].total_projects == 2


def test_half_trend_odd_length(spark):
    p = proj(spark, year_rows([1, 2, 100, 3, 4], start=2015))
    r = S.half_trend(p, 2020, 10).first()
    assert r.first_half_mean == 1.5 and r.second_half_mean == 3.5 and r.trend == "increasing"


def test_forecast_is_linear_in_days_and_clamped(spark):
    p = proj(spark, year_rows([100, 110, 120, 130, 140, 150], start=2000))
    prm = Params(current_year=2005, train_from=2000, outlier_years=(), horizon=3)
    rows = FC.trend_forecast(p, prm).orderBy("year").collect()
    assert [r.year for r in rows] == [2006, 2007, 2008]
    for r in rows:
        assert r.lower_bound <= r.predicted_funding <= r.upper_bound and r.lower_bound >= 0
    assert abs(rows[0].predicted_funding - 160) < 0.5


def test_snapshot_scattered(spark):
    old = proj(spark, [{"fkz": k} for k in ["a", "b", "c", "d", "e", "f"]])
    new = proj(spark, [{"fkz": k} for k in ["a", "b", "x", "c", "d", "e", "y"]])
    s = SN.diff_summary(old, new).first()
    assert (s.added, s.removed, s.net_change) == (2, 1, 1)
    assert s.placement == "appended"  # the last added row is the file's last row
    mid = proj(spark, [{"fkz": k} for k in ["a", "b", "x", "c", "d", "e", "y", "z"]]).where(F.col("fkz") != "z")
    mid = mid.where(F.col("fkz") != "y").unionByName(
        proj(spark, [{"fkz": k} for k in ["a", "b", "x", "c", "d", "e", "y", "q"]]).where(F.col("fkz") == "q"))
    s2 = SN.diff_summary(old, mid).first()
    assert s2.placement == "appended" and s2.added == 2
    scattered = proj(spark, [{"fkz": k} for k in ["a", "x", "b", "c", "d", "e", "f2"]])
    assert SN.diff_summary(old.where(F.col("fkz") != "f"), scattered.where(F.col("fkz") != "f2")).first().placement \
        == "scattered"


@pytest.mark.parametrize("k", [1, 3])
def test_first_k_bounds(spark, k):
    p = proj(spark, [{"joint_name": "J", "state": s} for s in "abcdef"])
    r = M.joint_top(p, 5, k).first()
    assert len(r.states_involved) == k


def test_dense_grid_takes_any_name(spark):
    from fundlens.operators import aggregate as A
    cells = spark.createDataFrame([(2000, "a`b", 1), (2001, "year", 2)], "year int, ministry string, n int")
    got = {(r.year, r.ministry, r.n) for r in A.dense_pairs(cells, "year", "ministry").collect()}
    assert got == {(2000, "a`b", 1), (2000, "year", None), (2001, "a`b", None), (2001, "year", 2)}
    assert A.dense_pairs(cells.limit(0), "year", "ministry").collect() == []


def test_compact_numbers_and_cut_text(spark):
    df = spark.createDataFrame([(999, "abc"), (1234, ""), (12345, None), (1250000, "abcdefgh"), (12500000000, "x")], "v long, t string")
    rows = df.select(N.german_compact_number("v"), N.german_currency("v"), N.cut_text("t", 3)).collect()
    assert [r[0] for r in rows][:3] == ["999", "1234", "12.345"]
    assert [r[0] for r in rows][4] == "12\u00a0Mrd." or [r[0] for r in rows][4] == "13\u00a0Mrd."
    assert rows[1][1] == "1.234\u00a0€" and [r[2] for r in rows] == ["abc", "N/A", "N/A", "abc", "x"]


def test_snapshot_without_keys_and_repeats(spark):
    old = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("b", 4)], "fkz string, row_id long")
    new = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("c", 4), ("c", 5)], "fkz string, row_id long")
    s = SN.diff_summary(old, new).first()
    assert (s.old_rows, s.new_rows, s.old_unique, s.new_unique) == (4, 5, 2, 2)
    assert (s.added, s.removed, s.added_min_pos, s.added_max_pos, s.placement) == (2, 2, 3, 4, "appended")
    none = SN.diff_summary(old.limit(0), new.limit(0)).first()
    assert (none.old_rows, none.new_rows, none.added, none.removed) == (0, 0, 0, 0)


def test_median_is_exact_without_one_buffer(spark):
    import random
    import statistics
    rng = random.Random(3)
    lists = [[], [5.0], [1.0, 2.0], [7.0] * 9, [-3.5, 0.0, 0.01, -0.01], [round(rng.lognormvariate(10, 4), 2) for _ in range(999)],
             [round(rng.uniform(-1e6, 1e6), 2) for _ in range(1000)], [0.0] * 500 + [1e12] * 500]
    for values in lists:
        df = spark.createDataFrame([(Decimal(str(v)),) for v in values] + [(None,)], "amount decimal(18,2)")
        got = A.median(df, "amount").first()["median"]
        assert got == (float(statistics.median(map(float, values))) if values else None)
    plan = A.median(df, "amount")._jdf.queryExecution().toString()
    assert "ObjectHashAggregate" not in plan


def brute_lasso(x, y, penalty):
    """Proximal gradient on the full problem, intercept and slope free."""
    import numpy as np
    b, step = np.zeros(x.shape[1]), 1 / np.linalg.norm(x, 2) ** 2
    v, t = b.copy(), 1.0
    for _ in range(200_000):
        new = v - step * (x.T @ (x @ v - y))
        new[2:] = np.sign(new[2:]) * np.maximum(np.abs(new[2:]) - step * penalty, 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, b = new + (last - 1) / t * (new - b), new
    return b


def test_changepoint_forecast(spark):
    import numpy as np
    p = Params(current_year=2024, train_from=2000, outlier_years=(2010,), horizon=3)
    rng = np.random.default_rng(8)
    rows = []
    for ministry, turn in (("BMBF", 2012), ("BMWK", 2006)):
        for y in range(2000, 2025):
            level = 100 + 3 * (y - 2000) + (25 * (y - turn) if y > turn else 0) + rng.integers(-20, 20)
            rows.append({"ministry": ministry, "start_date": dt.date(y, 3, 1), "amount": Decimal(int(level))})
    rows.append({"ministry": "BMG", "start_date": dt.date(2020, 1, 1), "amount": Decimal(7)})
    df = proj(spark, rows)
    got = {(r["ministry"], r["year"]): r for r in FC.changepoint_forecast(df, p, ["ministry"]).collect()}
    day = lambda y: (dt.date(y, 1, 1) - dt.date(1970, 1, 1)).days
    time = lambda y: (day(y) - day(2000)) / (day(2024) - day(2000))
    knots = FC.changepoint_years(p, 8)
    feat = lambda y: [1.0, time(y), *[max(time(y) - time(k), 0.0) for k in knots]]
    for m in ("BMBF", "BMWK"):
        at = [(r["start_date"].year, float(r["amount"])) for r in rows if r["ministry"] == m and r["start_date"].year != 2010]
        x, y = np.array([feat(a) for a, _ in at]), np.array([b for _, b in at])
        b = brute_lasso(x, y / y.max(), 0.05)
        assert got[m, 2025]["slope_changes"] > 0
        for year in (2025, 2026, 2027):
            want = float(np.dot(feat(year), b) * y.max())
            assert got[m, year]["predicted_funding"] == pytest.approx(want, rel=1e-4)
            assert got[m, year]["lower_bound"] < want < got[m, year]["upper_bound"]
    assert got["BMG", 2025]["lower_bound"] is None                # one point: no interval
    line = {(r["ministry"], r["year"]): r["predicted_funding"] for r in FC.trend_forecast(df, p, ["ministry"]).collect()}
    for r in FC.changepoint_forecast(df, p, ["ministry"], changepoints=0).collect():
        if r["ministry"] != "BMG":
            assert r["predicted_funding"] == pytest.approx(line[r["ministry"], r["year"]], rel=1e-9) and r["slope_changes"] == 0
    assert FC.changepoint_forecast(df.limit(0), p, ["ministry"]).count() == 0


def test_positions_are_dense_over_several_splits(spark, scratch):
    path = f"{scratch}/rows.csv"
    with open(path, "w") as f:
        f.writelines(f"k{i:05d}\n" for i in range(3000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = spark.read.schema("fkz string").csv(path).withColumn("row_id", F.monotonically_increasing_id())
        assert df.agg(F.countDistinct(F.shiftright("row_id", 33))).first()[0] > 3
        got = {r["position"]: r["fkz"] for r in SN.positions(df).collect()}
        assert got == {i: f"k{i:05d}" for i in range(3000)}
        old_file = df.where("fkz not in ('k01500', 'k02400')")
        s = SN.diff_summary(old_file, df).first()
        assert (s["added"], s["added_min_pos"], s["added_max_pos"], s["placement"]) == (2, 1500, 2400, "scattered")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert SN.positions(df.limit(0)).count() == 0
