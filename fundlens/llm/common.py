"""Shared helpers: table access, written scratch tables, grouped streaming, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local[...] session without that setting gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) \
        or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors.

    The write's shuffle files are let go when it ends: what follows reads the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


PARTS_A_FILE = 8         # shuffle partitions that go to one file where Spark does not merge them


def in_few_files(df: DataFrame) -> DataFrame:
    """``df`` in at most a partition a core or one in PARTS_A_FILE shuffle partitions, for a table of :func:`written`:
    where AQE does not merge small partitions, each would be a file and a task of every stage that reads the table."""
    spark = df.sparkSession
    if all(spark.conf.get(f"spark.sql.adaptive.{c}") == "true" for c in ("enabled", "coalescePartitions.enabled")):
        return df
    return df.coalesce(max(spark.sparkContext.defaultParallelism, partitions(spark) // PARTS_A_FILE))


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code once a session, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="llm-code-")), f"{root.name}_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._llm_shipped = True


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later tasks, and
    their allocators would keep the peak of every task so far."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


KEPT: dict[str, dict] = {}   # by module: what a worker keeps between tasks of that module


def only_kept_by(owner: str) -> None:
    """Let go of what tasks of other modules left in this worker."""
    others = [m for m in KEPT if m != owner]
    for m in others:
        del KEPT[m]
    if others:
        release()


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package's code on the executors and workers left small."""
    ship(df.sparkSession)
    owner = fn.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_kept_by(owner)
        yield from fn(batches)
        release()

    return df.mapInArrow(task, schema)


FILTER_WORDS = 1 << 17   # 64-bit words: an 8-million-bit filter, 1 MB


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(64 * FILTER_WORDS))


def _bitmap(key: str, ids: DataFrame) -> DataFrame:
    """(w, b): the words of a fixed-size hash bitmap of the ids that are not zero, at most FILTER_WORDS rows."""
    return (ids.select(_place(key).alias("at"))
            .select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")))


def _marked(rows: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """The rows whose key's bit is set; the words are broadcast (at most FILTER_WORDS rows of 16 bytes)."""
    at = rows.withColumn("_at", _place(key))
    hit = at.join(F.broadcast(words), F.shiftright("_at", 6) == F.col("w"))
    return hit.where(F.getbit("b", (F.col("_at") % 64).cast("int")) == 1).select(*rows.columns)


def maybe_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` may be in that column of ``ids``, by the hash bitmap alone: for a join with ``ids`` that follows."""
    return _marked(rows, key, _bitmap(key, ids))


def only_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` is in the column of the same name of ``ids``, exactly.

    A hash bitmap of fixed size (1 MB, whatever the corpus) first lets go of most other rows,
    so their texts are not shuffled; the join with the distinct ids then decides (an inner one: the
    optimizer pushes a semi join below the bitmap's, and all rows are shuffled). With very many ids the bitmap
    only lets more rows through. No Python worker takes part and the driver keeps no bitmap between jobs.
    """
    return _marked(rows, key, _bitmap(key, ids)).join(ids.select(key).distinct(), key).select(*rows.columns)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def byte_chunks(col: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) runs of whole texts, about ``limit`` bytes each."""
    data, off = text_buffers(col)
    i, n = 0, len(col)
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys in batches sorted by them; a run may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        cols = [t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(t.num_rows, bool)
        change[0] = last is not None and tuple(c[0] for c in cols) != last
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        last = tuple(c[-1] for c in cols)
        start = 0
        for c in cuts.tolist():
            piece = t.slice(start, c - start)
            if held:
                piece = pa.concat_tables([*held, piece])
                held = []
            if piece.num_rows:
                yield piece
            start = c
        held.append(t.slice(start))
    if held:
        yield pa.concat_tables(held)


def star_forest(e: DataFrame) -> bool:
    """Whether every node of ``e(a, b)`` is either the smaller end of its edges or has one smaller neighbour only."""
    none = F.lit(None).cast(e.schema["b"].dataType)
    ends = e.select(F.col("a").alias("id"), "b").unionAll(e.select(F.col("b").alias("id"), none.alias("b")))
    ends = ends.groupBy("id").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count_if(F.col("b").isNull()).alias("below"))
    return not ends.where("lo <> hi or lo is not null and below > 0").limit(1).count()


def with_least(rows: DataFrame) -> DataFrame:
    """(a, b, m): the distinct ``rows(a, b)`` with the smallest b of their a, from one shuffle by a."""
    w = Window.partitionBy("a").orderBy("b")
    return (rows.select("a", "b", F.first("b").over(w).alias("m"), F.lag("b").over(w).alias("_last"))
            .where("_last is null or _last <> b").select("a", "b", "m"))


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)``: (id, component = smallest id reachable).

    Alternating large-star and small-star rounds, each two shuffles and written to the shared
    folder, until the edges are stars around their smallest node. A hub's edges are sorted in one
    task (two ids each, spilled if many). Empty edges give no rows; self loops are ignored.
    """
    e = written(in_few_files(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), tag)
    while not star_forest(e):
        sym = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(sym).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        small = with_least(large)
        e = written(in_few_files(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                              F.col("m").alias("b"))), tag)
    return (e.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("component")))
            .groupBy("id").agg(F.min("component").alias("component")))
