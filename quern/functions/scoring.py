"""Relevance formulas as column expressions; all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
TF_CAP, LENGTH_CAP = 255, 65535


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)); 0 where no document holds the term."""
    return F.when(df > 0, F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))).otherwise(F.lit(0.0))


def tf_norm(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """The saturating part; an average of 0 leaves length out. tf and length are capped as stored."""
    t, dl = F.least(tf, F.lit(TF_CAP)).cast("double"), F.least(length, F.lit(LENGTH_CAP)).cast("double")
    factor = F.when(average > 0, F.lit(1 - b) + F.lit(b) * dl / average).otherwise(F.lit(1.0))
    return t * (k1 + 1) / (t + F.lit(k1) * factor)


def bm25(tf: Column, length: Column, average: Column, n: Column, df: Column, k1: float = K1, b: float = B) -> Column:
    return tf_norm(tf, length, average, k1, b) * idf(n, df)
