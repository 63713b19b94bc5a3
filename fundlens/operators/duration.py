"""Project duration statistics and histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens import dims


def with_duration(projects: DataFrame) -> DataFrame:
    """Rows with both dates; ``duration_months`` is already clamped at 0."""
    return projects.where(F.col("duration_months").isNotNull())


def duration_by_ministry(projects: DataFrame) -> DataFrame:
    d = with_duration(projects).where(F.col("ministry").isNotNull())
    m = F.col("duration_months")
    return d.groupBy("ministry").agg(F.avg(m).alias("mean_months"), F.median(m).alias("median_months"),
                                     F.stddev_samp(m).alias("std_months"), F.count(m).alias("project_count"))


def duration_overall(projects: DataFrame) -> DataFrame:
    m = F.col("duration_months")
    return with_duration(projects).agg(F.avg(m).alias("mean_months"), F.median(m).alias("median_months"),
                                       F.count(m).alias("total_analyzed"))


def bin_id(col: str = "duration_months"):
    """Right-closed bins (lo, hi] from the fixed edges; 0 and > last edge fall out."""
    m = F.col(col)
    e = dims.DURATION_BIN_EDGES
    expr = None
    for i in range(len(e) - 1):
        cond = (m > F.lit(float(e[i]))) & (m <= F.lit(float(e[i + 1])))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def duration_histogram(projects: DataFrame) -> DataFrame:
    """Bin label -> count in bin order; empty bins are kept with 0."""
    counts = (with_duration(projects).select(bin_id().alias("bin_id"))
              .where(F.col("bin_id").isNotNull()).groupBy("bin_id").agg(F.count(F.lit(1)).alias("_n")))
    bins = dims.duration_bins(projects.sparkSession)
    return (bins.join(counts, "bin_id", "left")
            .select("bin_id", "range", F.coalesce("_n", F.lit(0)).cast("long").alias("count")))
