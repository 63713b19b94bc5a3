"""Title keyword mining and per-keyword trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens import dims
from fundlens.functions import normalize as N
from fundlens.functions import text as T
from fundlens.operators import aggregate as A


def word_counts(df: DataFrame, text: str = "title") -> DataFrame:
    """word (lower case) -> occurrences over every text. Partial counts per task before the
    shuffle, so a very frequent word costs one row per task, not one per occurrence."""
    src = df.where(F.col(text).isNotNull()).select(text)
    return T.keyword_tokens(src, text).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def keyword_top(df: DataFrame, k: int = 100, text: str = "title", wc: DataFrame | None = None) -> DataFrame:
    """Top k words by occurrences (ties: word ascending), capitalised for display."""
    wc = wc if wc is not None else word_counts(df, text)
    top = A.top_k(wc, k, "count", ["word"])
    return top.select(N.capitalize("word").alias("word"), "count")


def top_words(df: DataFrame, k: int, text: str = "title", wc: DataFrame | None = None) -> DataFrame:
    """The k most frequent lower-case words; at most k rows, safe to broadcast."""
    wc = wc if wc is not None else word_counts(df, text)
    return A.top_k(wc, k, "count", ["word"]).select("word", "count")


def keyword_matches(projects: DataFrame, keywords: DataFrame) -> DataFrame:
    """Projects whose title contains the keyword, case-insensitively (C4).

    A non-equi join: the k-row keyword list is broadcast and each title is tested against
    it (BroadcastNestedLoopJoin), so the cost is linear in projects times k.
    """
    titles = (projects.where(F.col("title").isNotNull()).select("title", "start_year", "amount")
              .select(F.lower("title").alias("_lt"), "start_year", "amount"))
    return titles.join(F.broadcast(keywords.select("word")), F.col("_lt").contains(F.col("word")))


GRAM = 4
GRAMS = [GRAM, 5, 6, 7, 8, 10, 12, 16, 24, 32]      # lengths of the substrings of a run that are looked up


def run_grams(run: Column) -> Column:
    """The distinct substrings of the lengths GRAMS."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(run, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1) for n in GRAMS]))


def keyword_gram(kw: Column) -> Column:
    """A keyword's first characters, as many as the greatest length in GRAMS that it has."""
    size = F.greatest(*[F.when(F.length(kw) >= n, F.lit(n)) for n in GRAMS])
    return (F.when((F.length(kw) >= GRAM) & ~kw.rlike(r"\s"), F.substring(kw, F.lit(1), size))
            .otherwise(F.raise_error(F.concat(F.lit("not an indexable keyword: "), kw))))


BITMAP_WORDS = 1 << 18   # 64-bit words: a 16-million-bit filter, 2 MB


def maybe_in(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` may be in that column of ``ids``, by a hash bitmap of a fixed size: most others are
    let go before a join with ``ids`` shuffles them. The bitmap's words are broadcast (at most BITMAP_WORDS rows)."""
    at = F.pmod(F.xxhash64(key), F.lit(64 * BITMAP_WORDS))
    bits = (ids.select(at.alias("_at")).select(F.shiftright("_at", 6).alias("_w"), F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("_b"))
            .groupBy("_w").agg(F.bit_or("_b").alias("_b")))
    hit = rows.withColumn("_at", at).join(F.broadcast(bits), F.shiftright("_at", 6) == F.col("_w"))
    return hit.where(F.getbit("_b", (F.col("_at") % 64).cast("int")) == 1).select(*rows.columns)


def keyword_index(vocabulary: DataFrame, keywords: DataFrame) -> DataFrame:
    """(run, word): the keywords that each run of ``vocabulary(run)`` contains, each pair once.

    An equi-join on substrings instead of a test of every run against every keyword: a run gives its distinct
    substrings of the lengths GRAMS (one regex pass each, linear in its length), a keyword its first characters, as
    many as the greatest of these lengths that it has. Only pairs that share them are tested: a keyword of a
    length in GRAMS meets only runs that contain it, a longer one few others, however many keywords there are.
    Keywords have at least GRAM characters and no white space; another one fails the job. Substrings that no
    keyword has are let go before the shuffle.
    """
    firsts = keywords.select("word").distinct().select("word", keyword_gram(F.col("word")).alias("gram"))
    grams = vocabulary.select("run", F.explode(run_grams(F.col("run"))).alias("gram"))
    return (maybe_in(grams, "gram", firsts).join(firsts, "gram")
            .where(F.col("run").contains(F.col("word"))).select("run", "word"))


def space_runs(text: Column) -> Column:
    """The distinct runs of a text without white space: each keyword lies inside one."""
    return F.array_distinct(F.split(text, r"\s+"))


def letter_runs(text: Column) -> Column:
    """The distinct runs of keyword letters of a lower-case text that are long enough for a title word: each lies inside one."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"[{dims.KEYWORD_LETTERS}]{{{T.KEYWORD_MIN_KEPT},}}"), 0))


def word_id(word: str) -> Column:
    return F.xxhash64(word)


def keyword_matches_indexed(projects: DataFrame, keywords: DataFrame, runs_of=space_runs, key=F.col) -> DataFrame:
    """(word, start_year, amount) of :func:`keyword_matches` for any number of keywords (C4).

    A keyword lies inside a run of a title (``runs_of``: without white space), so the index is built on the distinct
    runs of all titles (combined before the shuffle) and joined back by run, all keywords of a run in one row; AQE splits
    a run that very many titles hold. A title that holds a keyword in several runs counts once, by its
    row_id, which is unique: its keywords meet in one row, bounded by its own length. They travel as ``key`` of the word.
    """
    own = ["row_id", "start_year", "amount"]
    runs = (projects.where(F.col("title").isNotNull())
            .select(*own, F.lower("title").alias("_lt"))
            .select(*own, F.explode(runs_of(F.col("_lt"))).alias("run"))
            .where(F.length("run") >= GRAM))
    hits = (keyword_index(runs.select("run").distinct(), keywords)
            .groupBy("run").agg(F.collect_list(key("word")).alias("words")))      # bounded by the run's own length
    return (runs.join(hits, "run").groupBy(*own).agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
            .select(F.explode("words").alias("word"), "start_year", "amount"))


def keyword_reconcile_all(projects: DataFrame) -> DataFrame:
    """:func:`keyword_reconcile` for every title word (lower case), with the matches' funding, through the index.

    Title words have letters only, so titles are cut into runs of letters. Matches are counted by a 64-bit hash of the
    word (a third of its bytes in the shuffles); two words with one hash fail the job.
    """
    words = word_counts(projects)
    # a value made of the count: no test of the index is pushed below the count, so every use is one shuffle
    counted = words.select(F.when(F.col("count") > 0, F.col("word")).alias("word"))
    matches = keyword_matches_indexed(projects, counted, letter_runs, word_id).groupBy(F.col("word").alias("_id")).agg(
        F.count(F.lit(1)).alias("project_matches"), N.money(F.sum("amount")).alias("funding"))
    pm = F.coalesce("project_matches", F.lit(0))
    same = Window.partitionBy("_id")
    one = F.when(F.col("_n") == 1, F.col("word")).otherwise(F.raise_error(F.concat(F.lit("two words with one hash: "), F.col("word"))))
    return (words.withColumn("_id", word_id("word")).withColumn("_n", F.count(F.lit(1)).over(same))
            .join(matches, "_id", "left")
            .select(one.alias("word"), F.col("count").alias("word_count"), pm.alias("project_matches"),
                    "funding", F.round(N.safe_ratio(pm, "count"), 6).alias("match_ratio")))


def keyword_trends(projects: DataFrame, k: int = 50, wc: DataFrame | None = None) -> DataFrame:
    """For the top-k title words: yearly funding and projects plus totals.

    Output: keyword, year, funding, projects, total_funding, total_projects. Totals count
    matches without a start year too.
    """
    kw = top_words(projects, k, wc=wc)
    agg = (keyword_matches(projects, kw)
           .groupBy("word", "start_year").agg(F.sum("amount").alias("_f"), F.count("amount").alias("_n")))
    w = Window.partitionBy("word")
    return (agg.withColumn("_tf", F.sum("_f").over(w)).withColumn("total_projects", F.sum("_n").over(w))
            .where(F.col("start_year").isNotNull())
            .select(N.capitalize("word").alias("keyword"), F.col("start_year").alias("year"),
                    N.money("_f").alias("funding"), F.col("_n").alias("projects"),
                    N.money("_tf").alias("total_funding"), "total_projects"))


def keyword_reconcile(projects: DataFrame, k: int = 50) -> DataFrame:
    """Word occurrences vs number of projects whose title contains the word."""
    kw = top_words(projects, k)
    matches = keyword_matches(projects, kw).groupBy("word").agg(F.count(F.lit(1)).alias("project_matches"))
    pm = F.coalesce("project_matches", F.lit(0))
    return (kw.join(matches, "word", "left")
            .select(N.capitalize("word").alias("keyword"), F.col("count").alias("word_count"),
                    pm.alias("project_matches"), F.round(N.safe_ratio(pm, "count"), 6).alias("match_ratio")))


def keyword_cloud(projects: DataFrame, k_words: int = 100, k_cloud: int = 50, k_trends: int = 50) -> DataFrame:
    """Top words with a size class by count / max count and a has-series flag."""
    top = A.top_k(word_counts(projects), k_words, "count", ["word"]).limit(k_cloud)
    mx = top.agg(F.max("count")).scalar()
    trends = keyword_trends(projects, k_trends).select(F.col("keyword").alias("_tw")).distinct()
    r = F.col("count") / mx
    size = (F.when(r > 0.7, F.lit("xl")).when(r > 0.4, F.lit("lg"))
            .when(r > 0.2, F.lit("md")).otherwise(F.lit("sm")))
    return (top.join(F.broadcast(trends), N.capitalize("word") == F.col("_tw"), "left")   # at most k_trends words
            .select(N.capitalize("word").alias("word"), "count", size.alias("size_class"),
                    F.col("_tw").isNotNull().alias("has_trend")))
