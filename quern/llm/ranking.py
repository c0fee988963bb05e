"""One ranking from several differently-scaled scores: a random walk over ranks.

From an item the walk picks one of the scores and proposes an item of the group uniformly; it moves there if that item
ranks higher on the picked score and stays otherwise. With probability 1 - damping it restarts anywhere. Items are
ordered by the stationary distribution. An item leaves mass along every score on which others beat it, so one excellent
score cannot make up for a bad one, and only ranks count, so no score's range or extremes matter.

One step is a sum over lower-ranked items per score, that is a prefix sum over sorted items. Groups of up to ``bound``
items are walked in memory, one group a call. Larger ones are walked by Spark: items are cut into blocks of ranks, block
sums are added up first and then the items inside a block, so no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.chunks import number_rows
from quern.runtime import cut

DAMPING, STEPS, BOUND, BLOCK = 0.95, 100, 50_000, 10_000


def walk(scores: np.ndarray, damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """Stationary distribution of the walk over the rows of ``scores`` (items x scores, higher is better, ties are equal)."""
    n, k = scores.shape
    if n == 0:
        return np.zeros(0)
    orders, lower, stay = [], [], np.zeros(n)
    for c in range(k):
        order = np.argsort(scores[:, c], kind="stable")
        ranked = scores[order, c]
        first = np.searchsorted(ranked, ranked, "left")  # items strictly below
        higher = n - np.searchsorted(ranked, ranked, "right")
        orders.append(order)
        lower.append(first)
        stay[order] += 1 - higher / n
    pi = np.full(n, 1 / n)
    for _ in range(steps):
        moved = pi * stay / k
        for order, first in zip(orders, lower, strict=True):
            sums = np.concatenate(([0.0], np.cumsum(pi[order])))
            moved[order] += sums[first] / (n * k)
        after = (1 - damping) / n + damping * moved
        if np.abs(after - pi).sum() < 1e-12:
            return after
        pi = after
    return pi


def rank_walk(items: DataFrame, group: str, item: str, scores: Sequence[str], damping: float = DAMPING, steps: int = STEPS, bound: int = BOUND) -> DataFrame:
    """(group, item, ``stationary``, ``rank``): the combined ranking of each group, best first from rank 1.

    One row per (group, item): repeated rows and repeated items collapse to the best value of each score. A NULL or NaN
    score ranks below all values. Equal values tie; items with the same stationary value (to 12 digits) are ordered by item.
    NULL groups form one group, rows with a NULL item are left out. Other columns are not read. Empty in, empty out.
    """
    names = [f"s{i}" for i in range(len(scores))]
    low = F.lit(float("-inf"))
    value = [F.max(F.when(items[s].isNull() | F.isnan(items[s].cast("double")), low).otherwise(items[s].cast("double"))).alias(n) for s, n in zip(scores, names, strict=True)]
    flat = cut(items.where(items[item].isNotNull()).groupBy(items[group].alias("g"), items[item].alias("i")).agg(*value), "scores")
    sizes = flat.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > bound)
    schema = T.StructType([*[flat.schema[c] for c in ("g", "i")], T.StructField("p", T.DoubleType())])

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": pdf["g"], "i": pdf["i"], "p": walk(pdf[names].to_numpy(float), damping, steps)})

    big = large.limit(1).count() > 0
    # Groups over the bound are few: each holds more than `bound` of all rows.
    some = flat.join(F.broadcast(large), flat["g"].eqNullSafe(large["g"]), "left_anti") if big else flat
    out = some.groupBy("g").applyInPandas(small, schema)
    if big:
        many = flat.join(F.broadcast(large.withColumnRenamed("g", "lg")), F.col("g").eqNullSafe(F.col("lg"))).drop("lg")
        out = out.unionByName(_walk_large(many, names, damping, steps))
    order = Window.partitionBy("g").orderBy(F.round("p", 12).desc(), "i")
    if not big:
        ranked = out.withColumn("rank", F.row_number().over(order))
    else:
        keyed = number_rows(out.withColumn("d", -F.round("p", 12)), ["g", "d", "i"])
        first = keyed.groupBy("g").agg(F.min("_row").alias("_first")).withColumnRenamed("g", "fg")
        ranked = keyed.join(first, F.col("g").eqNullSafe(F.col("fg"))).withColumn("rank", F.col("_row") - F.col("_first") + 1)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("p").alias("stationary"), F.col("rank").cast("int").alias("rank"))


def _walk_large(flat: DataFrame, names: Sequence[str], damping: float, steps: int) -> DataFrame:
    """The walk for groups that no task could hold. ``flat`` has g, i, the scores, and the group's size n.

    Each score is ranked once by exact row numbers. A step adds ``p`` up by blocks of ranks, carries the block sums on as
    offsets, and adds up inside blocks; equal scores take the sum before the first of them.
    """
    k = len(names)
    ranks = []
    for c, s in enumerate(names):
        rows = number_rows(flat.select("g", "i", "n", s), ["g", s, "i"])
        start = rows.groupBy("g").agg(F.min("_row").alias("_start")).withColumnRenamed("g", "sg")
        ties = rows.groupBy("g", s).agg(F.min("_row").alias("_first"), F.max("_row").alias("_last")).withColumnsRenamed({"g": "tg", s: "ts"})
        placed = rows.join(F.broadcast(start), F.col("g").eqNullSafe(F.col("sg"))).join(ties, F.col("g").eqNullSafe(F.col("tg")) & (F.col(s) == F.col("ts")))
        at = F.col("_row") - F.col("_start")
        ranks.append(placed.select("g", "i", "n", F.lit(c).alias("c"), at.alias("at"), (F.col("_first") - F.col("_start")).alias("low"), (F.col("_last") - F.col("_start")).alias("high")))
    ranked = ranks[0]
    for r in ranks[1:]:
        ranked = ranked.unionByName(r)
    ranked = cut(ranked, "ranks")
    stay = ranked.groupBy("g", "i", "n").agg(F.sum(1 - (F.col("n") - 1 - F.col("high")) / F.col("n")).alias("stay"))
    state = cut(stay.withColumn("p", 1 / F.col("n")), "walk")
    for _ in range(steps):
        mass = ranked.join(state.select(F.col("g").alias("pg"), F.col("i").alias("pi"), "p"), F.col("g").eqNullSafe(F.col("pg")) & (F.col("i") == F.col("pi"))).withColumn("block", F.expr(f"at div {BLOCK}"))
        sums = mass.groupBy("g", "c", "block").agg(F.sum("p").alias("s"))
        before = Window.partitionBy("g", "c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(F.col("g").alias("og"), F.col("c").alias("oc"), F.col("block").alias("ob"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("offset"))
        inside = Window.partitionBy("g", "c", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        cum = mass.withColumn("inner", F.coalesce(F.sum("p").over(inside), F.lit(0.0))).join(offsets, F.col("g").eqNullSafe(F.col("og")) & (F.col("c") == F.col("oc")) & (F.col("block") == F.col("ob")))
        below = cum.select("g", "c", "i", "at", "low", (F.col("inner") + F.col("offset")).alias("sum"))
        heads = below.where("at = low").select(F.col("g").alias("hg"), F.col("c").alias("hc"), F.col("low").alias("hl"), F.col("sum").alias("head"))
        inflow = below.join(heads, F.col("g").eqNullSafe(F.col("hg")) & (F.col("c") == F.col("hc")) & (F.col("low") == F.col("hl"))).groupBy("g", "i").agg(F.sum("head").alias("in")).withColumnsRenamed({"g": "ig", "i": "ii"})
        moved = (F.col("p") * F.col("stay") + F.col("in") / F.col("n")) / k
        after = state.join(inflow, F.col("g").eqNullSafe(F.col("ig")) & (F.col("i") == F.col("ii"))).select("g", "i", "n", "stay", ((1 - damping) / F.col("n") + damping * moved).alias("p"), F.abs((1 - damping) / F.col("n") + damping * moved - F.col("p")).alias("change"))
        after = cut(after, "walk")
        state = after.drop("change")
        if after.groupBy("g").agg(F.sum("change").alias("c")).agg(F.max("c")).first()[0] < 1e-12:
            break
    return state.select("g", "i", "p")


def moment(epoch: str) -> Column:
    """Epoch seconds; values that can only be milliseconds are divided. 0 and NULL are unset."""
    t = F.col(epoch).cast("double")
    return F.when(F.abs(t) >= 1e11, t / 1000).when(t != 0, t)


def hit_ranking(hits: DataFrame, stored: DataFrame, damping: float = DAMPING, steps: int = STEPS, bound: int = BOUND) -> DataFrame:
    """(query_id, doc_id, stationary, rank) of hits by score, and page_rank and recency of the stored document.

    Of a hit that comes twice the better score holds. 0 and missing values are worst.
    """
    unset = lambda c: F.when(F.col(c) != 0, F.col(c).cast("double"))
    docs = stored.groupBy("doc_id").agg(F.max(unset("page_rank")).alias("page_rank"), F.max(moment("pubtime")).alias("recency"))
    best = hits.groupBy("query_id", "doc_id").agg(F.max(unset("score")).alias("score"))
    return rank_walk(best.join(docs, "doc_id", "left"), "query_id", "doc_id", ["score", "page_rank", "recency"], damping, steps, bound)
