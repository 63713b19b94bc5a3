"""Building blocks shared by every mart.

Conventions
* A group-by drops rows whose key is NULL (the register's group-by semantics) but keeps
  ``''`` as a group; blank groups are hidden later, after ordering and limiting.
* Money is summed as DECIMAL (order-independent) and cast to DOUBLE at the edge; the
  average is that sum divided by the count, so it does not depend on summation order.
* Every ordering carries the group key as a tie-break, so top-k is deterministic.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.functions import normalize as N


def keys_not_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def funding_stats(df: DataFrame, keys: Sequence[str], *, amount: str = "amount",
                  total: str = "total_funding", avg: str | None = "avg_funding",
                  count: str = "project_count") -> DataFrame:
    """``keys -> sum, mean, count`` of the amount, NULL keys dropped.

    The shuffle is keyed on ``keys``; Spark runs a partial aggregate before it, so a
    key holding a third of all rows still ships one partial row per map task.
    """
    s = F.sum(amount)
    aggs = [N.money(s).alias(total)]
    if avg:
        aggs.append((N.money(s) / F.count(amount)).alias(avg))
    aggs.append(F.count(amount).alias(count))
    return df.where(keys_not_null(keys)).groupBy(*keys).agg(*aggs)


def top_k(df: DataFrame, k: int | None, by: str | Sequence[str], keys: Sequence[str],
          ascending: bool = False) -> DataFrame:
    """Order by measure(s) then key(s); keep the first k (TakeOrderedAndProject)."""
    by = [by] if isinstance(by, str) else list(by)
    order = [F.col(b).asc() if ascending else F.col(b).desc() for b in by] + [F.col(c).asc() for c in keys]
    out = df.orderBy(*order)
    return out.limit(k) if k else out


def suppress_blank(df: DataFrame, col: str) -> DataFrame:
    """Hide ``''`` / ``'nan'`` / NULL labels — apply AFTER ``top_k``."""
    return df.where(N.present(col))


def dense_pairs(cells: DataFrame, row: str, col: str) -> DataFrame:
    """``cells(row, col, ...)``, one row a pair, with the absent pairs of its values added (NULL
    elsewhere). The values of ``col`` travel as one array, as short as a row of the matrix."""
    every = cells.agg(F.collect_set(col)).scalar()
    grid = (cells.select(row).distinct().withColumn("_all", every)
            .select(row, F.explode("_all").alias(col)))
    return grid.join(cells, [row, col], "left")


def first_k_distinct(df: DataFrame, keys: Sequence[str], value: str, k: int,
                     order: str = "row_id", out: str = "values") -> DataFrame:
    """First k distinct non-null values per group, in order of first appearance.

    Two small shuffles: (keys, value) -> min(order) collapses repeats map-side, then a
    rank-limited window keeps at most k rows per group before they are collected, so no
    group ever gathers more than k values whatever its size.
    """
    firsts = (df.where(keys_not_null(keys) & F.col(value).isNotNull())
              .groupBy(*keys, value).agg(F.min(order).alias("_pos")))
    w = Window.partitionBy(*keys).orderBy(F.col("_pos"), F.col(value))
    ranked = firsts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return (ranked.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("_pos", value))).alias("_s"))
            .select(*keys, F.transform("_s", lambda s: s[value]).alias(out)))


def modal_value(df: DataFrame, keys: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value per group, smallest on ties.

    Counted per (keys, value) first, so the per-group state is one row per distinct
    value, never the group's rows.
    """
    counts = (df.where(keys_not_null(keys) & F.col(value).isNotNull())
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(*keys).orderBy(F.col("_n").desc(), F.col(value).asc())
    return (counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .select(*keys, F.col(value).alias(out)))


def value_counts(df: DataFrame, col: str, dropna: bool = True, out: str = "value") -> DataFrame:
    """``col -> count, pct of rows`` (D28, D29). With dropna the NULL group is dropped but
    still counts in the denominator, like a percentage of all rows."""
    counts = df.groupBy(F.col(col).alias(out)).agg(F.count(F.lit(1)).alias("count"))
    total = grand_total(df, F.count(F.lit(1)))
    res = counts.withColumn("pct", F.round(F.col("count") * 100.0 / total, 4))
    return res.where(F.col(out).isNotNull()) if dropna else res


def grand_total(df: DataFrame, agg: Column) -> Column:
    """A whole-table aggregate as a scalar subquery: Spark computes it as its own small
    job (partial aggregate per task, one final row) and inlines the value, so no window
    over all rows and no join is needed to divide by it."""
    return df.agg(agg).scalar()


def distinct_count(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.agg(F.countDistinct(col).alias(out))


def median(df: DataFrame, value: str) -> DataFrame:
    """(median): exact median of a numeric column as a double, NULL without values; one row.

    Selection in two distributed passes instead of one buffer of all values. The first counts values in
    buckets of equal width on a logarithmic scale (some 70,000 at most, whatever the data), whose prefix
    sums show the one or two buckets with the middle ranks; the second counts the distinct values of
    these alone (0.14 % of their magnitude apart at most: bounded by the cents between them)."""
    x = F.col(value).cast("double")
    bucket = (F.signum(x) * F.floor(F.log2(F.abs(x) + 1) * 512)).cast("long")
    values = df.where(F.col(value).isNotNull()).select(x.alias("x"), bucket.alias("bucket"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = values.groupBy("bucket").agg(F.count("*").alias("n"))
    counts = counts.select("bucket", "n", F.sum("n").over(upto).alias("upto"),
                           F.sum("n").over(Window.partitionBy()).alias("total"))      # at most some 70,000 rows
    low, high = F.floor((F.col("total") + 1) / 2), F.ceil((F.col("total") + 1) / 2)
    middle = counts.where((F.col("upto") >= low) & (F.col("upto") - F.col("n") < high)).select(
        "bucket", (F.col("upto") - F.col("n")).alias("before"), "total")              # one or two rows
    exact = values.join(F.broadcast(middle), "bucket").groupBy("bucket", "before", "total", "x").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    exact = exact.select("x", "n", "total", (F.col("before") + F.sum("n").over(upto)).alias("upto"))
    at = lambda rank: F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank), F.col("x")))
    return exact.agg(((at(low) + at(high)) / 2).alias("median"))
