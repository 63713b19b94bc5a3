"""Title tokenisation.

A keyword is a whole word made only of German-alphabet letters, at least four long;
after lower-casing it is kept when longer than four letters and not a stopword.
"Whole word" means a maximal run of Unicode letters, digits and underscores, so
``Café123`` or ``x_abcdef`` yield nothing and ``Straße-Bau`` yields ``Straße``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens import dims

WORD_SPLIT = r"[^\p{L}\p{N}_]+"
KEYWORD_RUN = rf"^[{dims.KEYWORD_LETTERS}]{{{dims.KEYWORD_MIN_RUN},}}$"
# One-pass form of "whole word, only these letters, longer than 4": a run of at least 5
# such letters with no word character (letter, digit, underscore) right before or after.
KEYWORD_MIN_KEPT = dims.KEYWORD_MIN_LEN_EXCLUSIVE + 1
KEYWORD_IN_TEXT = (rf"(?<![\p{{L}}\p{{N}}_])[{dims.KEYWORD_LETTERS}]"
                   rf"{{{max(dims.KEYWORD_MIN_RUN, KEYWORD_MIN_KEPT)},}}(?![\p{{L}}\p{{N}}_])")


def words(text) -> Column:
    """Array of word runs of a text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.split(t, WORD_SPLIT)


def keyword_tokens(df: DataFrame, text: str = "title", keep: list[str] | None = None) -> DataFrame:
    """One row per kept keyword occurrence: (keep..., word) with word lower-cased.

    A single regex pass per text extracts the qualifying words (no split into all words).
    """
    keep = keep or []
    w = (df.where(F.col(text).isNotNull())
         .select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(KEYWORD_IN_TEXT), 0)).alias("_w"))
         .select(*keep, F.lower("_w").alias("word")))
    return w.where(~F.col("word").isin(*dims.STOPWORDS))


def keyword_tokens_by_split(df: DataFrame, text: str = "title") -> DataFrame:
    """Reference form of ``keyword_tokens`` (split into word runs, test each run); used by
    the tests to check the one-pass pattern."""
    w = (df.where(F.col(text).isNotNull())
         .select(F.explode(words(text)).alias("_w"))
         .where(F.col("_w").rlike(KEYWORD_RUN))
         .select(F.lower("_w").alias("word")))
    return w.where((F.length("word") > dims.KEYWORD_MIN_LEN_EXCLUSIVE) & ~F.col("word").isin(*dims.STOPWORDS))
