"""Refresh on arrival: each new export dropped into a folder runs the refresh job.

The register is published as whole-file exports, so the stream's unit is one file:
Structured Streaming's file source picks up new files (``maxFilesPerTrigger=1``), and
``foreachBatch`` hands the rows of that export — already a distributed DataFrame — to the
same normalise -> persist -> analyse -> publish steps as the batch job. The header of each
export is checked before its cells are read by position. The stream's progress lives in
``checkpoint``, by default ``stream-<name>`` in the folder ``spark.checkpoint.dir`` names:
a restarted driver goes on after the last export it finished.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fundlens.plans import publish as PB
from fundlens.plans import refresh as R
from fundlens.plans.params import Params
from fundlens.session import checkpoint_dir
from fundlens.sources import register_csv as RC


def export_stream(spark: SparkSession, drop_dir: str, lay: RC.Layout) -> DataFrame:
    fields = [T.StructField(f"_c{i}", T.StringType()) for i in range(lay.n_fields)]
    schema = T.StructType(fields + [T.StructField(RC.CORRUPT, T.StringType())])
    RC._reader(spark)  # session settings the export encoding needs
    return (spark.readStream.schema(schema).option("sep", RC.SEP).option("encoding", RC.ENCODING)
            .option("quote", "").option("mode", "PERMISSIVE").option("header", "true")
            .option("columnNameOfCorruptRecord", RC.CORRUPT).option("maxFilesPerTrigger", 1)
            .csv(drop_dir))


def start(spark: SparkSession, drop_dir: str, sample_export: str, out_root: str, prm: Params | None = None,
          name: str = "register", available_now: bool = True, checkpoint: str | None = None) -> StreamingQuery:
    """Start the drop-folder refresh. ``sample_export`` fixes the column layout (validated
    like the batch job); an export with another layout, or without a required artifact, fails
    the batch before it publishes its manifest."""
    prm = prm or Params()
    lay = RC.layout(RC.validate_header(spark, sample_export))

    def per_export(batch: DataFrame, epoch: int) -> None:
        first = batch.select("_file").first()
        if first is None:
            return
        # the one file of this batch; Spark gives its path URL-encoded
        if RC.layout(RC.validate_header(batch.sparkSession, unquote(first["_file"]))) != lay:
            raise RC.IngestError(f"{first['_file']} has another column layout than {sample_export}")
        raw = batch.select("*", F.monotonically_increasing_id().alias("_pos"))
        out = f"{out_root.rstrip('/')}/epoch={epoch}"
        RC.with_row_id(RC.normalise(raw, lay)).write.mode("overwrite").parquet(f"{out}/projects")
        RC.rejects(raw, lay).write.mode("overwrite").parquet(f"{out}/rejects")
        written = ["projects", "rejects"] + R.analyse_and_publish(batch.sparkSession, f"{out}/projects", out, prm)
        missing = R.artifacts_missing(written)
        if missing:
            raise RuntimeError(f"refresh is missing artifacts: {missing}")
        PB.write_manifest(batch.sparkSession, out, f"epoch-{epoch}", written)

    stream = export_stream(spark, drop_dir, lay).select("*", F.col("_metadata.file_path").alias("_file"))
    w = (stream.writeStream.foreachBatch(per_export)
         .option("checkpointLocation", checkpoint or f"{checkpoint_dir(spark)}/stream-{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
