"""Edge cells of the register format (FIXTURES 3), one assertion per rule."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from fundlens.functions import normalize as N
from fundlens.functions import text as T


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_unwrap(spark):
    assert one(spark, N.unwrap, '="BMWE"') == "BMWE"
    assert one(spark, N.unwrap, ' ="x"  ') == "x"
    assert one(spark, N.unwrap, '=""') == ""
    assert one(spark, N.unwrap, None) is None
    assert one(spark, N.unwrap, "Straße – 5 €") == "Straße – 5 €"
    assert one(spark, N.unwrap, '="  inner "') == "  inner "


def test_missing_tokens(spark):
    assert one(spark, N.missing_token_to_null, "NA") is None
    assert one(spark, N.missing_token_to_null, "nan") is None
    assert one(spark, N.missing_token_to_null, '="NA"') == '="NA"'


def test_amounts(spark):
    assert one(spark, N.parse_amount, "1.234,56") == Decimal("1234.56")
    assert one(spark, N.parse_amount, '="241.967,00"') == Decimal("241967.00")
    assert one(spark, N.parse_amount, "1.727.667.356,00") == Decimal("1727667356.00")
    for bad in ["abc", "", None, "nan"]:
        assert one(spark, N.parse_amount, bad) == Decimal("0.00")


def test_dates(spark):
    assert one(spark, N.parse_date, "01.08.2025") == dt.date(2025, 8, 1)
    assert one(spark, N.parse_date, "1.8.2025") == dt.date(2025, 8, 1)
    for bad in ["31.02.2020", "01.01.85", "x", "", None]:
        assert one(spark, N.parse_date, bad) is None


def test_duration(spark):
    df = spark.createDataFrame(
        [(dt.date(2025, 10, 15), dt.date(2026, 6, 14)), (dt.date(2025, 1, 2), dt.date(2025, 1, 1)),
         (dt.date(2025, 1, 1), dt.date(2025, 1, 1)), (dt.date(2025, 1, 1), None)], "s date, e date")
    r = [x[0] for x in df.select(N.duration_months("s", "e")).collect()]
    assert abs(r[0] - 242 / 30.44) < 1e-12
    assert r[1] == 0.0 and r[2] == 0.0 and r[3] is None
    cm = df.select(N.calendar_months("s", "e")).first()[0]
    assert cm == 8


def test_decade_and_joint(spark):
    assert one(spark, N.decade, 1987, "int") == 1980
    assert one(spark, N.decade, 2000, "int") == 2000
    assert [one(spark, N.is_joint, v) for v in ["", "  ", "nan", "X", None]] == [False, False, False, True, True]


def test_country_rule(spark):
    df = spark.createDataFrame([("Deutschland",), ("Frankreich",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(N.not_domestic("c")).collect()] == [False, True, True, True]
    assert [r[0] for r in df.select(N.present_strict("c")).collect()] == [True, True, False, False]


def test_tokens(spark):
    df = spark.createDataFrame([("Überprüfung der Größe Café123 Caféhaus x_abcdef Straße-Bau ÄÖÜßx",)], "title string")
    got = sorted(r.word for r in T.keyword_tokens(df).collect())
    assert got == sorted(["überprüfung", "größe", "straße", "äöüßx"])
    by_split = sorted(r.word for r in T.keyword_tokens_by_split(df).collect())
    assert got == by_split


def test_stopwords_and_short_words(spark):
    df = spark.createDataFrame([("Teilprojekt Entwicklung einer neuen Kiste Haus Bauen",)], "title string")
    assert sorted(r.word for r in T.keyword_tokens(df).collect()) == ["bauen", "kiste", "neuen"]


def test_formats(spark):
    assert one(spark, N.german_number_text, 1234.56, "double") == "1.234,56"
    assert one(spark, lambda c: N.truncate_label(c, 5), "abcdefgh") == "abcde..."
    assert one(spark, N.month_name, 3, "int") == "Mar"
    assert one(spark, N.compact_currency, 2.5e9, "double") == "€2.5B"
    assert one(spark, N.capitalize, "größe") == "Größe"


def test_strip_equals_the_pattern(spark):
    import random
    rnd = random.Random(5)
    signs = "ab \t\n\x0b\f\r\x1c\x85   　﻿​="
    texts = [None, "", " ", "\x85", " a \x85", *("".join(rnd.choices(signs, k=rnd.randint(1, 9))) for _ in range(3000)),
             *(f"{chr(i)}a{chr(i)}" for i in [*range(1, 0x3100), 0xFEFF])]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select(N.py_strip("t").alias("a"), F.regexp_replace("t", N._EDGE_WS, "").alias("b"))
    assert got.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    assert "trim" in d.select(N.py_strip("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_export_lines_are_parsed_once(spark):
    from fundlens.sources import register_csv as RC
    lay = RC.layout(RC.EXPORT_HEADER)
    lines = spark.range(3).select(F.col("id").alias("row_id"), F.encode(F.concat(F.lit("a;b;"), F.col("id").cast("string")), "UTF-8").alias("line"))
    raw = RC.parse_lines(lines, lay)
    for df in (RC.normalise(raw, lay), RC.rejects(raw, lay)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_csv") == 1 and RC.normalise(raw, lay).count() == 3 and RC.rejects(raw, lay).count() == 0
    texts = [(chr(i),) for i in [*range(0x180), *range(0x2000, 0x2200), 0xFEFF, 0xFFFD, 0x1F600]]
    d = spark.createDataFrame(texts, "t string")
    two = d.select(F.regexp_replace("t", RC.UNMAPPED, "?").alias("a"), F.regexp_replace("t", RC._UNMAPPED, "?").alias("b"))
    assert two.where("a <> b").count() == 0 and two.where("a = '?'").count() > 400
