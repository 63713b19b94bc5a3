"""Snapshot-to-snapshot comparison on the project key.

Set differences are anti joins on the key (both sides shuffled by key, or the smaller one
broadcast by AQE), never driver-side sets. File positions come from the persisted
``row_id``, so "where were the new rows put" needs only min/max aggregates and two counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.operators import aggregate as A


def keys(df: DataFrame, key: str = "fkz") -> DataFrame:
    """Distinct non-null keys (G1)."""
    return df.where(F.col(key).isNotNull()).select(key).distinct()


def added(old: DataFrame, new: DataFrame, key: str = "fkz") -> DataFrame:
    """Rows of ``new`` whose key is not in ``old`` (C6), with their position in ``new``."""
    return new.where(F.col(key).isNotNull()).join(keys(old, key), key, "left_anti")


def removed(old: DataFrame, new: DataFrame, key: str = "fkz") -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``."""
    return old.where(F.col(key).isNotNull()).join(keys(new, key), key, "left_anti")


def rows_before(df: DataFrame, row_id: DataFrame) -> Column:
    """How many rows of ``df`` stand before the row whose row_id is the one value of ``row_id``: its position from
    0 in the file. (row_id itself grows in file order but jumps where the file was split for reading.)"""
    return df.where(F.col("row_id") < row_id.scalar()).agg(F.count("*")).scalar()


def positions(df: DataFrame) -> DataFrame:
    """``df`` with ``position``: 0..n-1 in order of row_id, in two passes. Rows are counted by blocks of 2^16
    consecutive row_ids; prefix sums over the blocks (one row for up to 65,536 rows) give each block's
    first position, to which a row adds its rank inside the block. No window goes over the whole file."""
    block = df.withColumn("_block", F.shiftright("row_id", 16))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = (block.groupBy("_block").agg(F.count("*").alias("_n"))
             .select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("row_id")) - 1
    return block.join(first, "_block").select(*df.columns, (F.col("_first") + rank).alias("position"))


def diff_summary(old: DataFrame, new: DataFrame, key: str = "fkz") -> DataFrame:
    """Row counts, key uniqueness, added/removed counts and where the added rows sit.

    placement: ``appended`` if the last added row is the file's last row, ``prepended`` if
    the first added row is the file's first row, else ``scattered``. Positions count from 0.
    """
    def by_key(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{side}_n"), F.min("row_id").alias(f"{side}_lo"),
                                   F.max("row_id").alias(f"{side}_hi"))

    # rows without a key form a group of their own, which joins nothing and is neither added nor removed
    j = by_key(old, "o").join(by_key(new, "n"), key, "full_outer")
    keyed, in_old, in_new = F.col(key).isNotNull(), F.col("o_n").isNotNull(), F.col("n_n").isNotNull()
    new_key, gone = keyed & in_new & ~in_old, keyed & in_old & ~in_new

    def rows(n, cond=F.lit(True)):
        return F.coalesce(F.sum(F.when(cond, F.col(n))), F.lit(0))

    s = j.agg(rows("o_n").alias("old_rows"), rows("n_n").alias("new_rows"),
              F.count_if(keyed & in_old).alias("old_unique"), F.count_if(keyed & in_new).alias("new_unique"),
              F.min("n_lo").alias("_first"), F.max("n_hi").alias("_last"),
              rows("n_n", new_key).alias("added"), F.min(F.when(new_key, F.col("n_lo"))).alias("added_min_pos"),
              F.max(F.when(new_key, F.col("n_hi"))).alias("added_max_pos"), rows("o_n", gone).alias("removed"))
    placement = (F.when(F.col("added") == 0, F.lit("none"))
                 .when(F.col("added_max_pos") == F.col("_last"), F.lit("appended"))
                 .when(F.col("added_min_pos") == F.col("_first"), F.lit("prepended"))
                 .otherwise(F.lit("scattered")))
    position = lambda c: F.when(F.col(c).isNotNull(), rows_before(new, s.select(c)))
    return s.select("old_rows", "new_rows", "old_unique", "new_unique", "added", "removed",
                    (F.col("new_rows") - F.col("old_rows")).alias("net_change"),
                    position("added_min_pos").alias("added_min_pos"), position("added_max_pos").alias("added_max_pos"),
                    placement.alias("placement"))


BUCKETS = 4096


def changed(old: DataFrame, new: DataFrame, cols: list[str], key: str = "fkz") -> DataFrame:
    """Keys whose rows differ between two exports (J4): key, change, columns.

    ``change`` is ``added``, ``removed`` or ``changed``; ``columns`` names the columns of ``cols`` that
    differ, in their order (null for added and removed keys). Rows without a key take no part. A key with
    several rows is compared as the multiset of its rows, column by column; where only the combination of the
    cells differs, ``columns`` is empty, and where their number does, it names every column.

    Rows are hashed once and summed into BUCKETS buckets of keys; only the rows of buckets that differ are
    joined, so two exports that agree cost two scans and BUCKETS rows. Buckets and keys are
    summed before the shuffle: a key with very many rows costs one row a task.
    """
    def hashed(df: DataFrame) -> DataFrame:
        cells = F.array(*[F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull()) for c in cols])
        rows = df.where(F.col(key).isNotNull()).select(key, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_b"), cells.alias("_c"))
        return rows.withColumn("_r", F.xxhash64(key, "_c"))

    total = lambda c: F.sum(c.cast("decimal(20,0)"))
    o, n = hashed(old), hashed(new)
    per_bucket = (o.select("_b", "_r", F.lit(-1).alias("_s")).unionByName(n.select("_b", "_r", F.lit(1).alias("_s")))
                  .groupBy("_b").agg(F.sum(F.col("_r").cast("decimal(20,0)") * F.col("_s")).alias("_t"), F.sum("_s").alias("_n"))
                  .where("_t <> 0 or _n <> 0").select("_b"))

    def by_key(df: DataFrame, side: str) -> DataFrame:
        at = df.join(F.broadcast(per_bucket), "_b", "left_semi")      # at most BUCKETS rows
        return at.groupBy(key).agg(F.struct(F.count(F.lit(1)).alias("n"), total(F.col("_r")).alias("r")).alias(f"{side}_row"),
                                   F.array(*[total(F.col("_c")[i]) for i in range(len(cols))]).alias(f"{side}_cells"))

    j = by_key(o, "o").join(by_key(n, "n"), key, "full_outer")
    differ = F.array_compact(F.array(*[F.when(F.col("o_cells")[i] != F.col("n_cells")[i], F.lit(c)) for i, c in enumerate(cols)]))
    kind = (F.when(F.col("o_row").isNull(), F.lit("added")).when(F.col("n_row").isNull(), F.lit("removed")).otherwise(F.lit("changed")))
    return (j.where(~F.col("o_row").eqNullSafe(F.col("n_row")))
            .select(key, kind.alias("change"), F.when(kind == "changed", differ).alias("columns")))


def key_order(old: DataFrame, new: DataFrame, key: str = "fkz", n: int = 10) -> DataFrame:
    """Last n keys of ``old`` and first n added keys, lexicographically."""
    last_old = A.top_k(keys(old, key), n, key, [], ascending=False).select(F.lit("old_last").alias("list"), key)
    first_new = A.top_k(keys(added(old, new, key), key), n, key, [], ascending=True) \
        .select(F.lit("added_first").alias("list"), key)
    return last_old.unionByName(first_new)
