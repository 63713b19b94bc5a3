"""Value profile of a wide table from mergeable sketches.

One pass builds, per column, the row count, a distinct-count sketch and a frequent-items sketch, all
over 64-bit hashes, so their size depends neither on the rows nor on the length of the texts. The
sketches of two exports merge into those of both. A second pass counts exactly the values that the
first one proposes: the report holds no estimate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A frequent-items sketch of TRACKED values is off by at most 3.5 / TRACKED of the rows and reports every
# value above twice that: 0.35 % of the rows, well under the share from which a value is listed.
TRACKED = 2048
SHARE_PCT = 1
PROPOSED = 200       # at most 100 values can hold 1 % each; estimates may let a few more through


def _hash(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.xxhash64(c))


def column_sketches(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: ``rows`` and per column ``n_``, ``d_`` (distinct sketch) and ``f_`` (frequent items), in one aggregate."""
    hashed = df.select(*[_hash(c).alias(c) for c in cols])
    return hashed.agg(F.count(F.lit(1)).alias("rows"),
                      *[F.count(c).alias(f"n_{c}") for c in cols],
                      *[F.hll_sketch_agg(c).alias(f"d_{c}") for c in cols],
                      *[F.expr(f"approx_top_k_accumulate(`{c}`, {TRACKED})").alias(f"f_{c}") for c in cols])


def merged(sketches: DataFrame, cols: list[str]) -> DataFrame:
    """The sketches of several exports (one row each) as those of all of them together."""
    return sketches.agg(F.sum("rows").alias("rows"),
                        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in cols],
                        *[F.hll_union_agg(f"d_{c}").alias(f"d_{c}") for c in cols],
                        *[F.expr(f"approx_top_k_combine(`f_{c}`, {TRACKED})").alias(f"f_{c}") for c in cols])


def overview(sketches: DataFrame, cols: list[str], types: dict[str, str]) -> DataFrame:
    """Per column: dtype, rows, non_null, blank share and the estimated number of distinct values."""
    rows = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col("rows").alias("rows"),
                     F.col(f"n_{c}").alias("non_null"),
                     F.hll_sketch_estimate(f"d_{c}").alias("distinct_estimate")) for c in cols]
    return sketches.select(F.inline(F.array(*rows)))


def _proposed(sketches: DataFrame, cols: list[str]) -> DataFrame:
    """(column, h): hashes that may hold a listed share; at most PROPOSED a column."""
    return reduce(DataFrame.unionByName, [
        sketches.select(F.lit(c).alias("column"),
                        F.explode(F.expr(f"approx_top_k_estimate(`f_{c}`, {PROPOSED})")).alias("item"))
        .select("column", F.col("item.item").alias("h")) for c in cols])


def frequent_values(df: DataFrame, cols: list[str], sketches: DataFrame | None = None) -> DataFrame:
    """(column, dtype, non_null, value, count, share_pct) of every value that at least SHARE_PCT percent of a
    column's non-null rows hold, counted exactly (J22).

    A row gives one (column, value) per proposed value it holds, not one per column, and counts are combined
    before the shuffle. Different values with one hash are counted apart. Empty tables and columns of nulls give no rows.
    """
    types = dict(df.dtypes)
    one = sketches if sketches is not None else column_sketches(df, cols)
    at = F.array(*[F.struct(F.lit(c).alias("column"), _hash(c).alias("h"), F.col(c).cast("string").alias("value")) for c in cols])
    cells = df.select(F.explode(F.filter(at, lambda s: s["h"].isNotNull())).alias("cell")).select("cell.*")
    hits = cells.join(F.broadcast(_proposed(one, cols)), ["column", "h"])          # at most PROPOSED rows a column
    counts = hits.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                                                    F.col(f"n_{c}").alias("non_null")) for c in cols])))
    return (counts.join(F.broadcast(totals), "column")                            # one row a column
            .where(F.col("count") * 100 >= F.col("non_null") * SHARE_PCT)
            .select("column", "dtype", "non_null", "value", "count",
                    F.round(F.col("count") * 100.0 / F.col("non_null"), 4).alias("share_pct")))


def report_lines(overview: DataFrame, values: DataFrame) -> DataFrame:
    """The profile as text, one ``line`` a column and one a listed value, in reading order.

    Bounded: at most 101 lines a column."""
    head = overview.select("column", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("rank"), F.format_string(
        "%s (%s): %d of %d rows, about %d values", "column", "dtype", "non_null", "rows", "distinct_estimate").alias("line"))
    body = values.select("column", F.lit(1).alias("kind"), (-F.col("count")).alias("rank"), F.format_string(
        "    %s: %d (%.2f %%)", "value", "count", "share_pct").alias("line"))
    return head.unionByName(body).orderBy("column", "kind", "rank", "line").select("line")
