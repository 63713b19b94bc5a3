"""Value profile from sketches, changed rows between exports and the keyword index, on hand-made rows."""

import datetime as dt
import glob
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fundlens.operators import keywords as K
from fundlens.operators import profile as PR
from fundlens.operators import snapshot as SN
from fundlens.plans import publish

from test_operators import proj

SCHEMA = "fkz string, a string, b int"


def frame(spark, lo, hi):
    rows = [(str(i), None if i % 7 == 0 else ["x", "y", "z"][i % 3] if i % 2 else f"rare{i}", i % 150) for i in range(lo, hi)]
    return spark.createDataFrame(rows, SCHEMA), rows


def expected(rows):
    out = set()
    for at, c in enumerate(["fkz", "a", "b"]):
        held = [r[at] for r in rows if r[at] is not None]
        out |= {(c, len(held), str(v), n) for v, n in Counter(held).items() if 100 * n >= len(held)}
    return out


def got(df):
    return {(r["column"], r["non_null"], r["value"], r["count"]) for r in df.collect()}


def test_frequent_values_are_exact_and_whole(spark):
    df, rows = frame(spark, 0, 6000)
    values = PR.frequent_values(df.repartition(7), ["fkz", "a", "b"])
    assert got(values) == expected(rows)
    assert {r["dtype"] for r in values.where("column = 'b'").collect()} <= {"int"}


def test_sketches_of_two_exports_merge(spark):
    cols = ["fkz", "a", "b"]
    one, two = frame(spark, 0, 4000), frame(spark, 3000, 9000)
    parts = PR.column_sketches(one[0], cols).unionByName(PR.column_sketches(two[0], cols))
    both = PR.merged(parts, cols)
    assert got(PR.frequent_values(one[0].unionByName(two[0]), cols, both)) == expected(one[1] + two[1])
    view = {r["column"]: r for r in PR.overview(both, cols, dict(one[0].dtypes)).collect()}
    assert view["fkz"]["rows"] == 10000 and abs(view["fkz"]["distinct_estimate"] - 9000) < 450
    assert abs(view["b"]["distinct_estimate"] - 150) <= 5 and view["a"]["non_null"] == sum(r[1] is not None for r in one[1] + two[1])


def test_profile_of_empty_and_null_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert PR.frequent_values(empty, ["fkz", "a"]).collect() == []
    view = PR.overview(PR.column_sketches(empty, ["a"]), ["a"], dict(empty.dtypes)).collect()
    assert [(r["rows"], r["non_null"], r["distinct_estimate"]) for r in view] == [(0, 0, 0)]
    nulls = spark.createDataFrame([("1", None, 5), ("2", None, 5)], SCHEMA)
    assert got(PR.frequent_values(nulls, ["a", "b"])) == {("b", 2, "5", 2)}


def test_profile_as_text(spark, scratch):
    df = spark.createDataFrame([("1", "x", 1), ("2", "x", 2), ("3", "y", 2)], SCHEMA)
    one = PR.column_sketches(df, ["a", "b"])
    lines = PR.report_lines(PR.overview(one, ["a", "b"], dict(df.dtypes)), PR.frequent_values(df, ["a", "b"], one))
    path = publish.write_text(lines, scratch, "profile")
    files = glob.glob(f"{path}/part-*")
    assert len(files) == 1
    with open(files[0], encoding="utf-8") as f:
        assert f.read().splitlines() == ["a (string): 3 of 3 rows, about 2 values", "    x: 2 (66.67 %)", "    y: 1 (33.33 %)",
                                         "b (int): 3 of 3 rows, about 2 values", "    2: 2 (66.67 %)", "    1: 1 (33.33 %)"]


def changes(old, new):
    return {(r["fkz"], r["change"], tuple(r["columns"]) if r["columns"] is not None else None)
            for r in SN.changed(old, new, ["a", "b"]).collect()}


def test_changed_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    old = make([("same", "x", 1), ("null", None, 1), ("both", "x", 1), ("gone", "x", 1), (None, "x", 1),
                ("twice", "x", 1), ("twice", "y", 2), ("fewer", "x", 1), ("fewer", "x", 1), ("cross", "x", 1), ("cross", "y", 2)])
    new = make([("same", "x", 1), ("null", "", 1), ("both", "y", None), ("fresh", "x", 1), (None, "z", 9),
                ("twice", "y", 2), ("twice", "x", 1), ("fewer", "x", 1), ("cross", "x", 2), ("cross", "y", 1)])
    assert changes(old, new) == {("null", "changed", ("a",)), ("both", "changed", ("a", "b")), ("gone", "removed", None),
                                 ("fresh", "added", None), ("fewer", "changed", ("a", "b")), ("cross", "changed", ())}
    assert changes(old, old) == set() and changes(make([]), make([])) == set()
    assert {c[1] for c in changes(make([]), new)} == {"added"} and {c[1] for c in changes(old, make([]))} == {"removed"}


def test_keyword_index_equals_contains(spark):
    titles = ["Sonne und Sonnenwende, Sonnen", "SONNE\tmond", "xSonnenkraft", "Mond schein mondscheinx", "", None, "abc de",
              "Straßenbau der Zukunft", "sonnen sonnen sonnen", "q" * 5000 + "sonnen" + "q" * 5000]
    p = proj(spark, [dict(title=t, amount=i + 1, start_date=dt.date(2000 + i, 1, 1)) for i, t in enumerate(titles)])
    words = ["sonne", "sonnen", "mondschein", "straße", "zukunft", "nirgends", "enwende"]
    kw = spark.createDataFrame([(w,) for w in [*words, "sonne"]], "word string")
    found = Counter(tuple(r) for r in K.keyword_matches_indexed(p.repartition(3), kw).collect())
    want = Counter((w, 2000 + i, Decimal(i + 1)) for i, t in enumerate(titles) for w in words if t is not None and w in t.lower())
    assert found == want
    plain = K.keyword_matches(p, kw.distinct()).select("word", "start_year", "amount")
    assert Counter(tuple(r) for r in plain.collect()) == want
    for bad in ("ab", "two words"):
        with pytest.raises(Exception, match="not an indexable keyword"):
            K.keyword_matches_indexed(p, spark.createDataFrame([(bad,)], "word string")).collect()


def test_keyword_index_has_no_nested_loop(spark):
    p = proj(spark, [dict(title="Sonne", amount=1)])
    plan = K.keyword_reconcile_all(p)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keyword_index_shuffles_only_what_keywords_have(spark):
    """Substrings that no keyword has, and runs that no title word can lie in, are let go before the shuffle."""
    runs = spark.createDataFrame([(f"{'abcdefgh' * 3}{i}",) for i in range(200)] + [("xsonnex",)], "run string")
    kw = spark.createDataFrame([("sonne",), ("nirgends",)], "word string")
    grams = runs.select("run", F.explode(K.run_grams(F.col("run"))).alias("gram"))
    left = K.maybe_in(grams, "gram", kw.select(K.keyword_gram(F.col("word")).alias("gram"))).select("run", "gram").collect()
    assert ("xsonnex", "sonne") in {tuple(r) for r in left} and len(left) < 20       # of several thousand
    assert [tuple(r) for r in K.keyword_index(runs, kw).collect()] == [("xsonnex", "sonne")]
    title = spark.createDataFrame([("sonne, (sonne) sonne1sonnen der straße\u00e9erz abc",)], "t string")
    assert sorted(title.select(K.letter_runs(F.col("t")).alias("r")).first()["r"]) == ["sonne", "sonnen", "straße"]


def test_keyword_reconcile_all_equals_contains(spark):
    titles = ["Sonne und Sonnenwende, Sonnen", "SONNE\tmond", "xSonnenkraft", "Mond-schein mondscheinx9", "", None, "abc de 12345",
              "Straßenbau der Zukunft", "sonnen sonnen sonnen", "İsonneİ Sonnené", "ZUKUNFT_bau zukunfts-sonne"]
    p = proj(spark, [dict(title=t, amount=i + 1, start_date=dt.date(2000 + i, 1, 1)) for i, t in enumerate(titles)])
    count = {r["word"]: r["count"] for r in K.word_counts(p).collect()}
    want = {}
    for w in count:
        hits = [i for i, t in enumerate(titles) if t is not None and w in t.lower()]
        want[w] = (count[w], len(hits), sum(i + 1 for i in hits))
    got = {r["word"]: (r["word_count"], r["project_matches"], r["funding"]) for r in K.keyword_reconcile_all(p).collect()}
    assert got == want and len(want) > 5


def test_title_words_are_counted_once(spark):
    """The index, its bitmap and the result share one shuffle of the counted words."""
    import __spark_entry__ as e
    got = e.queries()["keyword_reconcile_all"](spark, e.SMOKE_DIR)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    counted = [x for x in plan.splitlines() if "HashAggregate" in x and "keys=[word#" in x and "functions=[partial_count(1)]" in x]
    assert len(counted) == 1, plan


def test_texts_are_joined_last(spark):
    """No other join of the projects view shuffles the documents' texts."""
    import __spark_entry__ as e
    from fundlens.sources.tables import projects
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = projects(spark, e.SMOKE_DIR).select("row_id", "title", "city")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert "doc_id" in joins[0], plan


def test_keyword_index_tests_few_pairs(spark):
    stems = ["".join("xyz"[i // 3 ** k % 3] for k in range(5)) for i in range(243)]
    words = [f"abcd{t}" for t in stems] + [f"abcd{t}{t}{t}{t}" for t in stems[:40]] + ["abcd"]
    kw = spark.createDataFrame([(w,) for w in words], "word string")
    runs = spark.createDataFrame([(f"q{w}q",) for w in words], "run string")
    want = sorted((f"q{w}q", v) for w in words for v in words if v in w)
    assert sorted(tuple(r) for r in K.keyword_index(runs, kw).collect()) == want
    pairs = (runs.select("run", F.explode(K.run_grams(F.col("run"))).alias("gram"))
             .join(kw.select("word", K.keyword_gram(F.col("word")).alias("gram")), "gram").count())
    assert pairs < 5 * len(want)       # by 4-grams alone: every word in every run, 80,000 and more
