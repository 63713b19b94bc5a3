"""Why projects are missing from the published lists: root causes, not only coverage.

Every list names the causes that keep a project off it whatever its rank (``foreign``,
``blank_country``, ``domestic``, ``not_joint``, ``missing`` key). The rest are ranked as the
list ranks them: beyond its cut (``below_cut``), with a label that is hidden after the cut
(``blank``), or ``shown``. Each project has one cause per list, so the causes of a list add
up to the register.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.functions import normalize as N


@dataclass
class Listing:
    name: str
    keys: list[str]
    cause: Column            # why a project cannot be on the list, NULL if it can
    label_ok: Column         # whether its label is shown
    k: int | None = None     # places; None: no cut


def listings() -> list[Listing]:
    away = F.when(N.present_strict("country"), F.lit("foreign")).otherwise(F.lit("blank_country"))
    abroad = F.when(N.not_domestic("country"), away)
    yes = F.lit(True)
    return [
        Listing("states", ["state"], abroad, N.present("state")),
        Listing("cities_top30", ["city", "state"], abroad, yes, 30),
        Listing("countries", ["country"], F.when(~N.not_domestic("country"), F.lit("domestic")), N.present_strict("country")),
        Listing("sponsors_top20", ["sponsor"], F.lit(None).cast("string"), N.present_strict("sponsor"), 20),
        Listing("recipients_top50", ["recipient"], F.lit(None).cast("string"), yes, 50),
        Listing("classifications_top50", ["class_code"], F.lit(None).cast("string"), N.present("class_code"), 50),
        Listing("joint_top30", ["joint_name"], F.when(~F.col("is_joint"), F.lit("not_joint")), yes, 30),
        Listing("funding_profiles", ["profile"], F.lit(None).cast("string"), N.present("profile")),
    ]


def causes(projects: DataFrame, lists: list[Listing] | None = None) -> DataFrame:
    """Projects and funding of every list by cause, with the list's total.

    One scan: a row becomes one short row per list, reduced by a partial aggregate before the
    shuffle. The lists' first places (at most the sum of their cuts) are broadcast back to the
    groups; nothing ranks all groups in one task. Output: list, cause, projects, funding, where
    cause ``total`` is the sum of the list's others.
    """
    lists = lists or listings()
    entries = []
    for li in lists:
        cause = li.cause
        for key in li.keys:
            cause = F.coalesce(cause, F.when(F.col(key).isNull(), F.lit("missing")))
        keys = [*(F.col(c) for c in li.keys), F.lit("")][:2]
        entries.append(F.struct(
            F.lit(li.name).alias("list"), F.lit(li.k).cast("int").alias("k"), cause.alias("cause"),
            *[F.when(cause.isNull(), key).alias(f"key{i}") for i, key in enumerate(keys)],
            (cause.isNull() & li.label_ok).alias("label_ok")))
    groups = (projects.select("amount", F.inline(F.array(*entries)))
              .groupBy("list", "k", "cause", "key0", "key1", "label_ok")
              .agg(F.count(F.lit(1)).alias("projects"), F.sum("amount").alias("funding")))
    places = Window.partitionBy("list").orderBy(N.money("funding").desc(), "key0", "key1")
    widest = max([li.k for li in lists if li.k], default=0)
    top = (groups.where(F.col("cause").isNull() & F.col("k").isNotNull())
           .select("list", "key0", "key1", "k", F.row_number().over(places).alias("place"))
           .where(F.col("place") <= widest).where(F.col("place") <= F.col("k"))
           .select("list", "key0", "key1", F.lit(True).alias("in_top")))
    known = groups.join(F.broadcast(top), ["list", "key0", "key1"], "left")   # at most the sum of the cuts
    cause = (F.when(F.col("cause").isNotNull(), F.col("cause"))
             .when(F.col("k").isNotNull() & F.col("in_top").isNull(), F.lit("below_cut"))
             .when(~F.col("label_ok"), F.lit("blank")).otherwise(F.lit("shown")))
    parts = known.select("list", cause.alias("cause"), "projects", "funding")
    out = (parts.groupingSets([["list", "cause"], ["list"]], "list", "cause")
           .agg(F.sum("projects").alias("projects"), N.money(F.sum("funding")).alias("funding"),
                F.grouping("cause").alias("_all")))
    return out.select("list", F.when(F.col("_all") == 1, F.lit("total")).otherwise(F.col("cause")).alias("cause"),
                      "projects", "funding")
