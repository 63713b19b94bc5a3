"""In-code dimension tables.

These are small, fixed lookups. Each builder returns a DataFrame whose row count is
fixed by the literal below, so joining them with ``F.broadcast`` is size-safe at any
data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the published register's conventions exactly.
# ---------------------------------------------------------------------------

# Ministry code -> full name.
MINISTRY_NAMES = [
    ("BMFTR", "Bundesministerium für Forschung, Technologie und Raumfahrt"),
    ("BMWE", "Bundesministerium für Wirtschaft und Energie"),
    ("BMV", "Bundesministerium für Verkehr"),
    ("BMLEH", "Bundesministerium für Landwirtschaft, Ernährung und Heimat"),
    ("BMUKN", "Bundesministerium für Umwelt, Klimaschutz und Naturschutz"),
    ("BMJV", "Bundesministerium der Justiz und für Verbraucherschutz"),
    ("BMJV_BLE", "BMJV - Bundesanstalt für Landwirtschaft und Ernährung"),
]

# State -> population (31.12.2024, census-based).
STATE_POPULATION = [
    ("Baden-Württemberg", 11245898),
    ("Bayern", 13248928),
    ("Berlin", 3685265),
    ("Brandenburg", 2556747),
    ("Bremen", 704881),
    ("Hamburg", 1862565),
    ("Hessen", 6280793),
    ("Mecklenburg-Vorpommern", 1573597),
    ("Niedersachsen", 8004489),
    ("Nordrhein-Westfalen", 18034454),
    ("Rheinland-Pfalz", 4129569),
    ("Saarland", 1012141),
    ("Sachsen", 4042422),
    ("Sachsen-Anhalt", 2135597),
    ("Schleswig-Holstein", 2959517),
    ("Thüringen", 2100277),
]

# Project sponsor code -> name. Note the register writes "PT-J" where this map has "PTJ",
# so that sponsor shows its code (fallback rule B20).
SPONSOR_NAMES = [
    ("BF", "DLR Projektträger (ehem. Beratungsfirma)"),
    ("VDI/VDE", "VDI/VDE Innovation + Technik GmbH"),
    ("PT-DLR", "DLR Projektträger"),
    ("FZ-Jül", "Forschungszentrum Jülich"),
    ("GSI", "GSI Helmholtzzentrum für Schwerionenforschung"),
    ("PTJ", "Projektträger Jülich"),
    ("PTKA", "Karlsruher Institut für Technologie (KIT)"),
    ("TÜV", "TÜV Rheinland Consulting GmbH"),
    ("PT-SW", "DLR Projektträger Software"),
    ("LF", "Landwirtschaftliche Fakultät"),
    ("BLE", "Bundesanstalt für Landwirtschaft und Ernährung"),
    ("FNR", "Fachagentur Nachwachsende Rohstoffe e.V."),
]

# Title stopwords (lower case).
STOPWORDS = [
    "und", "der", "die", "das", "für", "zur", "zum", "von", "mit", "im", "in", "auf",
    "aus", "bei", "des", "ein", "eine", "einer", "einem", "einen", "als", "an", "nach",
    "über", "durch", "sowie", "wird", "werden", "wurde", "wurden", "ist", "sind",
    "hat", "haben", "kann", "können", "soll", "sollen", "muss", "müssen", "teil",
    "phase", "projekt", "verbundprojekt", "teilprojekt", "vorhaben", "entwicklung",
]

# Month number -> short name.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Duration histogram: right-closed bins (lo, hi] in months, with labels, in order.
DURATION_BIN_EDGES = [0, 6, 12, 24, 36, 60, 120, 360]
DURATION_BIN_LABELS = ["<6 months", "6-12 months", "1-2 years", "2-3 years", "3-5 years",
                       "5-10 years", ">10 years"]

# Word pattern for title keywords: letters of the German alphabet only, at least 4 of
# them, as a whole word; kept when longer than 4 after lower-casing.
KEYWORD_LETTERS = "A-ZÄÖÜa-zäöüß"
KEYWORD_MIN_RUN = 4
KEYWORD_MIN_LEN_EXCLUSIVE = 4

# Cell tokens a spreadsheet export means as "missing" when they are the whole cell.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Days per month used by the duration rule.
DAYS_PER_MONTH = 30.44

# Home country value of the register.
DOMESTIC_COUNTRY = "Deutschland"

# Header marker the refresh job requires in the first line.
REQUIRED_HEADER_MARKER = '="FKZ"'

# Result documents a complete refresh produces.
EXPECTED_ARTIFACTS = [
    "ministry_funding", "geographic_distribution", "temporal_trends", "top_recipients",
    "topic_analysis", "keyword_trends", "entity_trends", "duration_analysis",
    "funding_types", "projekttraeger", "joint_projects", "summary_stats",
]


def _df(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def ministry_names(spark: SparkSession) -> DataFrame:
    return _df(spark, MINISTRY_NAMES, "code string, name string")


def state_population(spark: SparkSession) -> DataFrame:
    return _df(spark, STATE_POPULATION, "state string, population long")


def sponsor_names(spark: SparkSession) -> DataFrame:
    return _df(spark, SPONSOR_NAMES, "code string, name string")


def stopwords(spark: SparkSession) -> DataFrame:
    return _df(spark, [(w,) for w in STOPWORDS], "word string")


def month_names(spark: SparkSession) -> DataFrame:
    return _df(spark, [(i + 1, n) for i, n in enumerate(MONTH_NAMES)], "month int, month_name string")


def duration_bins(spark: SparkSession) -> DataFrame:
    rows = [(i, float(DURATION_BIN_EDGES[i]), float(DURATION_BIN_EDGES[i + 1]), DURATION_BIN_LABELS[i])
            for i in range(len(DURATION_BIN_LABELS))]
    schema = T.StructType([
        T.StructField("bin_id", T.IntegerType(), False),
        T.StructField("lo", T.DoubleType(), False),
        T.StructField("hi", T.DoubleType(), False),
        T.StructField("range", T.StringType(), False),
    ])
    return spark.createDataFrame(rows, schema)
