"""How distinctive a term is of its record: probabilistic relevance weighting.

The weight is idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length)) with
idf = ln(1 + (N - df + 0.5) / (df + 0.5)): it saturates in tf, allows for the record's length, and is small for terms
that most records hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.ngrams import posting_entries
from quern.runtime import cut

K1, B = 1.2, 0.75
HOT_SHARE = 1 / 2000


def weight(tf: Column, length: Column, average: Column, df: Column, n: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return idf * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / average))


def term_weights(entries: DataFrame, k1: float = K1, b: float = B, hot_share: float = HOT_SHARE) -> DataFrame:
    """(``segment_id``, ``doc_id``, ``term``, ``tf``, ``doc_freq``, ``weight``) of entries (segment_id, doc_id, term, tf), one per key.

    The document frequencies of terms in more than ``hot_share`` of all entries are broadcast: there are at most
    1 / hot_share of them whatever the data. All other terms are joined by a shuffle, in which none is a hot spot.
    An empty input gives an empty result.
    """
    lengths = entries.groupBy("segment_id", "doc_id").agg(F.sum("tf").alias("length"))
    totals = lengths.agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("average"), F.sum("length").alias("rows")).alias("t"))
    total = totals.scalar()
    freqs = entries.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    n_entries = entries.agg(F.count(F.lit(1)).alias("c")).scalar()
    hot = freqs.where(F.col("doc_freq") > F.lit(hot_share) * n_entries).withColumnRenamed("doc_freq", "_hot")
    long = entries.join(lengths, ["segment_id", "doc_id"])
    tried = long.join(F.broadcast(hot), "term", "left")
    warm = tried.where("_hot is not null").withColumnRenamed("_hot", "doc_freq")
    cold = tried.where("_hot is null").drop("_hot").join(freqs.where(F.col("doc_freq") <= F.lit(hot_share) * n_entries).hint("shuffle_hash"), "term")
    both = warm.unionByName(cold)
    w = weight(F.col("tf").cast("double"), F.col("length").cast("double"), total["average"], F.col("doc_freq").cast("double"), total["n"], k1, b)
    return both.select("segment_id", "doc_id", "term", "tf", "doc_freq", w.alias("weight"))


def most_distinctive(weights: DataFrame) -> DataFrame:
    """(``segment_id``, ``doc_id``, ``term``): each record's term of the largest weight, of equals (to nine decimals) the first in order."""
    best = F.min(F.struct((-F.round("weight", 9)).alias("w"), "term"))
    return weights.groupBy("segment_id", "doc_id").agg(best.alias("b")).select("segment_id", "doc_id", F.col("b.term").alias("term"))


def body_entries(postings: DataFrame, field: str = "body") -> DataFrame:
    """The entries (segment_id, doc_id, term, tf) of one field, written once as every statistic reads them.

    NULL keys, NULL or empty terms, repeated keys and NULL tf are treated as in ``ngrams.posting_entries``.
    """
    return cut(posting_entries(postings.where(F.col("field") == field)).select("segment_id", "doc_id", "term", "tf"), "entries")
