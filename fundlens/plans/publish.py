"""Sinks: flat marts, nested result documents, reports and the run manifest.

Marts are written as Parquet (the primary, flat form). A result document nests a mart
into one JSON object; the marts are aggregates bounded by their group count or by k, so
folding one into a single row is bounded too. Each run writes under its own folder and
publishes only what that run produced.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_list(df: DataFrame, order: Sequence[tuple[str, bool]], fields: Sequence[str]) -> Column:
    """Aggregate expression: the rows of ``df`` as an array of structs in the given order.

    ``order`` = [(column, descending)]. The sort happens on the collected (bounded) array,
    so no global ordering of the input is needed.
    """
    keys = [(F.col(c) * -1 if desc else F.col(c)).alias(f"_k{i}") for i, (c, desc) in enumerate(order)]
    packed = F.struct(*keys, F.struct(*[F.col(f) for f in fields]).alias("_v"))
    return F.transform(F.sort_array(F.collect_list(packed)), lambda s: s["_v"])


def document(df: DataFrame, list_name: str, order: Sequence[tuple[str, bool]], fields: Sequence[str],
             extras: dict[str, Column] | None = None) -> DataFrame:
    """One-row document ``{list_name: [...], **extras}`` from a mart."""
    cols = [ordered_list(df, order, fields).alias(list_name)]
    doc = df.agg(*cols)
    for k, v in (extras or {}).items():
        doc = doc.withColumn(k, v)
    return doc


def write_mart(df: DataFrame, root: str, name: str) -> str:
    path = f"{root.rstrip('/')}/marts/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_document(doc: DataFrame, root: str, name: str) -> str:
    """Nested document as JSON (UTF-8, non-ASCII kept). One bounded row -> one file."""
    path = f"{root.rstrip('/')}/docs/{name}"
    doc.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def write_report(checks: DataFrame, root: str, name: str = "validation_report") -> str:
    """Checks table as JSON lines."""
    path = f"{root.rstrip('/')}/reports/{name}"
    checks.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_text(lines: DataFrame, root: str, name: str) -> str:
    """A bounded one-column table of lines as one text file."""
    path = f"{root.rstrip('/')}/reports/{name}"
    lines.coalesce(1).write.mode("overwrite").text(path)
    return path


def write_manifest(spark, root: str, run_id: str, artifacts: Sequence[str]) -> str:
    """Run stamp: id, time and the artifacts this run wrote (A9, A10). Fails on none."""
    if not artifacts:
        raise RuntimeError("refresh produced no artifacts; nothing to publish")
    path = f"{root.rstrip('/')}/manifest"
    m = spark.createDataFrame([(run_id, a) for a in artifacts], "run_id string, artifact string")
    (m.groupBy("run_id").agg(F.sort_array(F.collect_list("artifact")).alias("artifacts"))
     .withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
     .coalesce(1).write.mode("overwrite").json(path))
    return path


def read_documents(spark, path: str) -> DataFrame:
    """Published JSON documents back as a DataFrame."""
    return spark.read.option("multiLine", False).json(path)
