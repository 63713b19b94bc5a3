"""Exact top-k search as a Voronoi join on integer inner products.

Component x becomes floor(256 * x). Pivots (a bounded sample of the vectors) cut queries and
data into Voronoi cells; query cells are split into blocks of at most ``QUERY_BLOCK``. Small
summaries give, for each query group, a score that every one of its queries is sure to reach k
times; a data vector goes to a group only if its bound can reach that score. Each (group, salt)
is solved locally by one matrix product and the partial lists are merged. All of it is exact:

* q = p + u, |u| <= r and x = c + w, |w| <= d give q.x >= p.c - r|c| - (|p| + r) d (lower) and
  q.x <= p.x + r|x| (upper).
* Of equal data vectors only the k + 1 smallest ids can be among a query's k best, so large
  groups of copies shrink to k + 1 rows before anything is replicated.

Cases: vectors null, empty, holding null or non-finite components, with a null id, or of
another length than the most frequent one (the longer among equals) take no part. Rows that
repeat a vec_id count once, with the smallest vector. Ties go to the smaller vec_id. Fewer than
k candidates: all of them. Scores that may pass 2^53 are computed on integers; where they may not
even fit a long (largest component squared, times the length, from 2^63) the query raises. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.llm.common import map_arrow, partitions, ship, written

K = 5
STEP = 50
QUERY_BLOCK = 256
DATA_BLOCK = 16_384
MAX_PIVOTS = 256


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): integer components as array<double>; unusable rows are gone."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = (embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("double")).alias("v")))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    cell = d.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def top_k(embeddings: DataFrame, k: int = K, step: int = STEP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose vec_id is divisible by ``step``."""
    spark = embeddings.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vecs = written(quantised(embeddings), "vectors")
    sizes = vecs.groupBy(F.size("v").alias("dim")).agg(
        F.count("*").alias("n"), F.count_if(F.col("vec_id") % step == 0).alias("q"),
        F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("top")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None or not sizes["q"]:
        return empty
    dim, n_q = sizes["dim"], sizes["q"]
    top = int(sizes["top"])
    if top * top * dim >= 1 << 63:
        raise ValueError("inner products of these components may not fit a long")
    number_type = np.dtype(float if top * top * dim < 1 << 53 else np.int64)     # sums of doubles are exact up to 2^53
    packed = np.dtype("<i4" if top < 1 << 31 else "<i8")
    vecs = vecs.where(F.size("v") == dim)
    n_pivots = max(1, min(MAX_PIVOTS, -(-n_q // QUERY_BLOCK)))
    pivots = np.array([r["v"] for r in vecs.select("v", F.xxhash64("v").alias("h")).orderBy("h", "vec_id")
                       .limit(8 * n_pivots).select("v").collect()])
    pivots = np.unique(pivots, axis=0)[:: max(1, len(np.unique(pivots, axis=0)) // n_pivots)][:n_pivots]

    def assign(batches):
        for b in batches:
            x = matrix(b.column("v"), dim)
            cell, d = nearest(x, pivots)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d)],
                                             names=[*b.schema.names, "cell", "dist"])

    # copies: of equal vectors the k + 1 smallest ids suffice for every query
    kept = vecs.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    data = written(map_arrow(kept.select("vec_id", "v"), assign, "vec_id long, v array<double>, cell int, dist double"), "cells")
    near = (data.select("cell", "dist", F.row_number().over(Window.partitionBy("cell").orderBy("dist", "vec_id")).alias("n"))
            .where(F.col("n") <= k + 1).collect())                       # pivots x (k + 1) rows
    total = data.count()

    asked = map_arrow(vecs.where(F.col("vec_id") % step == 0), assign, "vec_id long, v array<double>, cell int, dist double")
    by_cell = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = F.create_map(*[F.lit(x) for c, n in by_cell.items() for x in (c, -(-n // QUERY_BLOCK))])
    asked = written(asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, F.col("cell"))).cast("int")),
                    "queries")
    # one small row for each group of about QUERY_BLOCK queries
    groups = [(r["cell"], r["part"], r["r"]) for r in
              asked.groupBy("cell", "part").agg(F.max("dist").alias("r")).orderBy("cell", "part").collect()]
    norm = np.sqrt((pivots * pivots).sum(1))
    lower = []
    slack = 1e-6 * (1 + float(top) ** 2 * dim)
    for c, _, r in groups:
        bounds = sorted((float(pivots[c] @ pivots[n["cell"]]) - r * norm[n["cell"]] - (norm[c] + r) * n["dist"] for n in near),
                        reverse=True)
        lower.append((bounds[k] if len(bounds) > k else -np.inf) - slack)
    lower, cells = np.array(lower), np.array([c for c, _, _ in groups])
    radius = np.array([r for _, _, r in groups])
    salts = -(-total // DATA_BLOCK)

    def replicate(batches):
        for b in batches:
            x = matrix(b.column("v"), dim)
            size = np.sqrt((x * x).sum(1))
            row, group = np.nonzero((x @ pivots.T)[:, cells] + size[:, None] * radius >= lower)
            ids = b.column("vec_id").to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group.astype(np.int32)), pa.array((ids % salts).astype(np.int32)), pa.array(ids),
                 pa.array(x.astype(packed)[row].view(f"V{packed.itemsize * dim}").ravel().tolist(), pa.binary())], names=names)

    names = ["grp", "salt", "vec_id", "v"]
    sent = map_arrow(data.select("vec_id", "v"), replicate, "grp int, salt int, vec_id long, v binary")
    number = F.create_map(*[F.lit(x) for i, (c, p, _) in enumerate(groups) for x in (f"{c}.{p}", i)])
    queries = asked.select(F.element_at(number, F.concat_ws(".", "cell", "part")).alias("grp"),
                           F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "vec_id", "v")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            ids = right["vec_id"].to_numpy()
            x = np.frombuffer(b"".join(right["v"]), packed).reshape(-1, dim).astype(number_type)
            never = -np.inf if number_type.kind == "f" else np.iinfo(np.int64).min
            for i in range(0, len(left), 64):
                q = left.iloc[i:i + 64]
                scores = np.stack(q["v"].to_list()).astype(number_type) @ x.T
                for qid, s in zip(q["vec_id"].tolist(), scores, strict=True):
                    s[ids == qid] = never
                    if len(s) > k:   # all that reach the k-th score, so that ties are settled by id
                        pick = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                    else:
                        pick = np.arange(len(s))
                    pick = pick[s[pick] != never]
                    pick = pick[np.lexsort((ids[pick], -s[pick]))][:k]
                    out["query_id"] += [qid] * len(pick)
                    out["vec_id"] += ids[pick].tolist()
                    out["score"] += s[pick].astype(np.int64).tolist()
        return pd.DataFrame(out).astype("int64")

    ship(spark)
    n = partitions(spark)
    best = (queries.repartition(n, "grp", "salt").groupBy("grp", "salt").cogroup(sent.repartition(n, "grp", "salt").groupBy("grp", "salt"))
            .applyInPandas(solve, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {STEP} = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
