"""Ingest of the raw register export: ``;``-separated, Windows-1252, spreadsheet-wrapped
cells, locale numbers and dates (A1-A6, A11, B1, B2).

Plan
* The header line is read once (one row to the driver) to build a positional all-string
  schema; the body is then a splittable CSV scan with that schema, so a 100 GB export is
  read by thousands of tasks in parallel.
* Repeated header names keep their FIRST occurrence; blank names are dropped. The 21
  required columns are asserted before any work starts.
* ``row_id`` is the file position: ``monotonically_increasing_id`` grows with the split
  offset inside a file (one export = one file). It is written once into the normalised
  table and never recomputed.
* Rows with more cells than the header go to a rejects table; rows with fewer are padded
  with NULL (the spreadsheet reader's behaviour).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlens import dims
from fundlens.functions import normalize as N
from fundlens.sources.tables import derive

# Register header names -> engine column names, in file order.
REGISTER_COLUMNS = [
    ("FKZ", "fkz"),
    ("Ressort", "ministry"),
    ("Referat", "unit"),
    ("PT", "sponsor"),
    ("Arb.-Einh.", "work_unit"),
    ("Zuwendungsempfänger", "recipient"),
    ("Gemeindekennziffer", "municipality_code"),
    ("Stadt/Gemeinde", "municipality"),
    ("Ort", "city"),
    ("Bundesland", "state"),
    ("Staat", "country"),
    ("Ausführende Stelle", "executing_body"),
    ("Thema", "title"),
    ("Leistungsplansystematik", "class_code"),
    ("Klartext Leistungsplansystematik", "class_text"),
    ("Laufzeit von", "start_raw"),
    ("Laufzeit bis", "end_raw"),
    ("Fördersumme in EUR", "amount_raw"),
    ("Förderprofil", "profile"),
    ("Verbundprojekt", "joint_name"),
    ("Förderart", "funding_type"),
]

ENCODING = "windows-1252"
SEP = ";"
CORRUPT = "_corrupt_record"


class IngestError(ValueError):
    pass


def clean_header_name(raw: str | None) -> str:
    """Header cell -> name: strip, then unwrap ``="..."`` (A3)."""
    s = (raw or "").strip()
    if s.startswith('="') and s.endswith('"'):
        s = s[2:-1]
    return s


def _reader(spark: SparkSession):
    # Spark 4 only accepts Java charset names such as windows-1252 behind this flag.
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    # With pruning the parser tokenises only the referenced columns and cannot see that a
    # row has too many cells; the reject rule needs the full count.
    spark.conf.set("spark.sql.csv.parser.columnPruning.enabled", "false")
    return (spark.read.option("sep", SEP).option("encoding", ENCODING)
            .option("quote", "")  # wrapped cells start with '=', not a quote
            .option("mode", "PERMISSIVE"))


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Raw header cells of the (first) file — a one-row read."""
    rows = _reader(spark).option("header", "false").csv(path).limit(1).collect()
    if not rows:
        raise IngestError(f"no header line in {path}")
    # every cell of the header line counts, unnamed trailing ones included: data rows
    # carry the same number of cells
    return [c or "" for c in rows[0]]


MIN_EXPECTED_BYTES = 1_000_000


def export_size(spark: SparkSession, path: str) -> int:
    """Total bytes of the export(s): file metadata only, the content column is not read."""
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


def validate_header(spark: SparkSession, path: str) -> list[str]:
    """Header must carry the key marker and every required column (A2)."""
    size = export_size(spark, path)
    if size < MIN_EXPECTED_BYTES:
        warnings.warn(f"{path} is only {size} bytes; a full register export is far larger")
    raw = read_header(spark, path)
    if not any(c.strip() == dims.REQUIRED_HEADER_MARKER for c in raw):
        raise IngestError(f"header of {path} lacks {dims.REQUIRED_HEADER_MARKER}")
    names = {clean_header_name(c) for c in raw}
    missing = [h for h, _ in REGISTER_COLUMNS if h not in names]
    if missing:
        raise IngestError(f"missing required columns: {missing}")
    return raw


@dataclass
class Layout:
    n_fields: int
    positions: dict[str, int]  # engine column -> position in the file


def layout(raw_header: list[str]) -> Layout:
    """First position of each required column; duplicates and blanks are ignored (A4)."""
    first: dict[str, int] = {}
    for i, c in enumerate(raw_header):
        name = clean_header_name(c)
        if name and name not in first:
            first[name] = i
    return Layout(len(raw_header), {canon: first[h] for h, canon in REGISTER_COLUMNS})


def raw_rows(spark: SparkSession, path: str, lay: Layout) -> DataFrame:
    """All-string positional scan with corrupt-record capture and file position."""
    fields = [T.StructField(f"_c{i}", T.StringType()) for i in range(lay.n_fields)]
    schema = T.StructType(fields + [T.StructField(CORRUPT, T.StringType())])
    df = (_reader(spark).schema(schema).option("header", "true")
          .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    return df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.monotonically_increasing_id().alias("_pos"))


# Header line of a written export: every required column, one of them a second time, and an unnamed one.
EXPORT_HEADER = [f'="{name}"' for name, _ in REGISTER_COLUMNS] + [f'="{REGISTER_COLUMNS[0][0]}"', ""]
# Fixed value: everything that Windows-1252 cannot hold (and NUL).
UNMAPPED = r"[^\x01-\x7F\xA0-\xFF€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
# The same for Spark: most characters are settled by the two ranges, only others are held against the list.
_UNMAPPED = r"[^\x01-\x7F\xA0-\xFF](?<![€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ])"


def _java_charset(spark: SparkSession, build):
    """``build()`` with Java charset names allowed; the expressions it resolves keep the setting."""
    key = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return build()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def export_lines(projects: DataFrame) -> DataFrame:
    """(row_id, line): every project as one Windows-1252 line of an export, as ``EXPORT_HEADER`` has it.

    Cells are wrapped (``="..."``), a NULL is an empty cell, line breaks become a space and what the
    charset lacks becomes ``?``. The format knows no quoting: a separator inside a cell makes a line
    that the ingest rejects.
    """
    text = {"start_raw": N.german_date_text("start_date"), "end_raw": N.german_date_text("end_date"),
            "amount_raw": N.german_number_text("amount")}
    cells = [F.coalesce(F.concat(F.lit('="'), text[c] if c in text else F.col(c), F.lit('"')), F.lit(""))
             for _, c in REGISTER_COLUMNS]
    line = F.concat_ws(SEP, *cells, cells[0], F.lit(""))
    line = F.regexp_replace(F.regexp_replace(line, r"[\r\n]+", " "), _UNMAPPED, "?")
    return _java_charset(projects.sparkSession, lambda: projects.select("row_id", F.encode(line, ENCODING).alias("line")))


def parse_lines(lines: DataFrame, lay: Layout) -> DataFrame:
    """The rows that :func:`raw_rows` gives for a file, from (row_id, line) of encoded lines.

    A generator hands on the cells: a filter on them is not pushed below it, where it would
    render, encode and parse the whole line again for each cell it names.
    """
    schema = ", ".join([f"_c{i} string" for i in range(lay.n_fields)] + [f"{CORRUPT} string"])
    options = {"sep": SEP, "quote": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    text = _java_charset(lines.sparkSession, lambda: lines.select("row_id", F.decode("line", ENCODING).alias("line")))
    cells = text.select("row_id", F.inline(F.array(F.from_csv("line", schema, options))))
    return cells.select(*[c for c in cells.columns if c != "row_id"], F.lit("").alias("_file"), F.col("row_id").alias("_pos"))


def _too_long(lay: Layout):
    return F.col(CORRUPT).isNotNull() & (F.size(F.split(F.col(CORRUPT), SEP, -1)) > lay.n_fields)


def rejects(raw: DataFrame, lay: Layout) -> DataFrame:
    # a data column is selected too: Spark refuses scans that read only the corrupt column
    return raw.where(_too_long(lay)).select("_file", "_pos", F.col("_c0").alias("first_cell"),
                                            F.col(CORRUPT).alias("line"))


def normalise(raw: DataFrame, lay: Layout) -> DataFrame:
    """Raw positional rows -> the typed ``projects`` schema."""
    kept = raw.where(~_too_long(lay))
    cols = []
    for canon, pos in lay.positions.items():
        c = N.unwrap(N.missing_token_to_null(F.col(f"_c{pos}")))
        cols.append(c.alias(canon))
    base = kept.select("_file", "_pos", *cols)
    typed = base.select(
        "_file", "_pos",
        *[c for _, c in REGISTER_COLUMNS if not c.endswith("_raw")],
        N.parse_date("start_raw").alias("start_date"),
        N.parse_date("end_raw").alias("end_date"),
        N.parse_amount("amount_raw").alias("amount"),
    )
    return derive(typed)


def with_row_id(df: DataFrame) -> DataFrame:
    """File position as ``row_id`` (ordered, not dense).

    Inside one file the ids grow with the split offset, which is file order; an export is
    one file per snapshot. ``row_id`` must be persisted with the table (the refresh job
    writes it), because the ids depend on the scan's partitioning.
    """
    return df.withColumnRenamed("_pos", "row_id").drop("_file")


def ingest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Validate the header and return (projects, rejects), both lazy."""
    lay = layout(validate_header(spark, path))
    raw = raw_rows(spark, path, lay)
    return with_row_id(normalise(raw, lay)), rejects(raw, lay)
