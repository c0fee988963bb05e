"""Frequencies of every term or n-gram by a suffix array with common-prefix intervals.

Every token position starts a suffix, kept to its first ``n`` tokens. In sorted order the occurrences of an n-gram are
neighbours: an interval of suffixes with a common prefix. Its size is the number of occurrences. The number of records
follows by subtraction: inside one record's own sorted suffixes, each pair of neighbours with a common prefix of p
tokens is one occurrence too many for each n-gram up to length p.

Equal suffixes are added up before they move, so a term that makes up a third of all rows travels as one row per task.
The suffixes are then spread over tasks by ranges of their order; an interval that crosses a range border yields a part
on each side, and the parts are added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.runtime import partitions, spread


def _neighbour_prefix(tokens: Sequence[str], n: int) -> list[tuple[tuple[str, ...], int]]:
    """The sorted suffixes of one record, each with the length of the prefix shared with the one before."""
    suffixes = sorted(tuple(tokens[i : i + n]) for i in range(len(tokens)))
    out, last = [], ()
    for s in suffixes:
        shared = 0
        while shared < min(len(s), len(last)) and s[shared] == last[shared]:
            shared += 1
        out.append((s, shared))
        last = s
    return out


def text_suffixes(docs: DataFrame, tokens: str, n: int) -> DataFrame:
    """The added-up suffixes of records with an array column of tokens: ``t1``..``tn``, ``occurrences``, ``extra1``..``extran``.

    NULL or empty arrays have no suffixes; NULL and empty tokens are left out before.
    """
    schema = T.StructType([T.StructField(f"t{i}", T.StringType()) for i in range(1, n + 1)] + [T.StructField("shared", T.IntegerType())])

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*s, *[None] * (n - len(s)), shared) for ts in batch["_tokens"] if ts is not None for s, shared in _neighbour_prefix([t for t in ts if t], n)]
            yield pd.DataFrame(rows, columns=schema.names)

    each = spread(docs.select(F.col(tokens).alias("_tokens"))).mapInPandas(suffixes, schema)
    terms = [f"t{i}" for i in range(1, n + 1)]
    extras = [F.count(F.when(F.col("shared") >= i, 1)).alias(f"extra{i}") for i in range(1, n + 1)]
    return each.groupBy(*terms).agg(F.count(F.lit(1)).alias("occurrences"), *extras)


def interval_counts(suffixes: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The common-prefix intervals of added-up suffixes: (*by, ``ngram`` array, ``n``, ``doc_freq``, ``total_term_freq``)."""
    terms = [f"t{i}" for i in range(1, n + 1)]
    order = [*by, *terms]
    schema = T.StructType(
        [suffixes.schema[c] for c in by]
        + [T.StructField(t, T.StringType()) for t in terms]
        + [T.StructField("n", T.IntegerType()), T.StructField("occurrences", T.LongType()), T.StructField("extra", T.LongType())]
    )

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            fresh = np.ones(len(batch), bool)  # where an interval begins: the prefix differs from the row before
            for c in by:
                fresh[1:] &= (batch[c].to_numpy()[1:] == batch[c].to_numpy()[:-1]).astype(bool)
            same = fresh.copy()
            same[0] = False
            for i, t in enumerate(terms, 1):
                values = batch[t].to_numpy(object)
                same[1:] &= values[1:] == values[:-1]
                full = ~pd.isna(batch[t]).to_numpy()
                starts = np.flatnonzero(~same & full)
                if not len(starts):
                    continue
                # rows shorter than i tokens sort before all longer ones with their prefix, so none lies inside an interval
                label = np.cumsum(~same & full)
                label = label[full] - 1
                part = batch.iloc[starts][[*by, *terms]].copy()
                for longer in terms[i:]:
                    part[longer] = None
                part["n"] = np.int32(i)
                part["occurrences"] = np.bincount(label, batch["occurrences"].to_numpy()[full], len(starts)).astype(np.int64)
                part["extra"] = np.bincount(label, batch[f"extra{i}"].to_numpy()[full], len(starts)).astype(np.int64)
                yield part[schema.names]

    ranged = suffixes.repartitionByRange(partitions(suffixes.sparkSession), *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    parts = ranged.mapInPandas(intervals, schema)
    return (
        parts.groupBy(*by, *terms, "n")
        .agg(F.sum("occurrences").alias("total_term_freq"), F.sum("extra").alias("_extra"))
        .select(*by, F.slice(F.array(*terms), 1, F.col("n")).alias("ngram"), "n", (F.col("total_term_freq") - F.col("_extra")).alias("doc_freq"), "total_term_freq")
    )


def ngram_counts(docs: DataFrame, tokens: str, n: int = 1) -> DataFrame:
    """(``ngram``, ``n``, ``doc_freq``, ``total_term_freq``) of every n-gram of 1 to ``n`` tokens over all records.

    ``tokens`` names an array<string> column; one row is one record, so repeated rows count as records of their own.
    """
    return interval_counts(text_suffixes(docs, tokens, n), n)


def posting_entries(postings: DataFrame) -> DataFrame:
    """One row per (field, term, segment_id, doc_id) with its ``tf``.

    Rows with a NULL or empty term, field, segment or document are left out. Of repeated keys the row indexed last holds,
    of equals the larger tf. A NULL tf counts 1.
    """
    sound = postings.where("term is not null and term <> '' and field is not null and segment_id is not null and doc_id is not null")
    return sound.groupBy("field", "term", "segment_id", "doc_id").agg(
        F.max(F.struct("indexed_at", F.coalesce("tf", F.lit(1)).cast("bigint").alias("tf"))).alias("_last")
    ).select("field", "term", "segment_id", "doc_id", F.col("_last.tf").alias("tf"))


def posting_counts(postings: DataFrame) -> DataFrame:
    """(``field``, ``term``, ``doc_freq``, ``total_term_freq``) from posting rows, whose texts are not kept.

    An entry of tf occurrences is tf suffixes of one token in one record, of which tf - 1 have an equal neighbour there.
    """
    entries = posting_entries(postings)
    tf = F.greatest("tf", F.lit(1))
    suffixes = entries.groupBy("field", F.col("term").alias("t1")).agg(F.sum(tf).alias("occurrences"), F.sum(tf - 1).alias("extra1"))
    counts = interval_counts(suffixes, 1, ["field"])
    return counts.select("field", F.element_at("ngram", 1).alias("term"), "doc_freq", "total_term_freq")


def record_count(postings: DataFrame) -> Column:
    """The number of records, (segment_id, doc_id), with any sound posting row."""
    sound = postings.where("term is not null and term <> '' and field is not null and segment_id is not null and doc_id is not null")
    return sound.select("segment_id", "doc_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()


def marked(postings: DataFrame, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """``posting_counts`` plus ``mark``: ``rare`` below ``rare_below`` records, ``common`` above a share of all records, else NULL.

    A term that is both is ``rare``.
    """
    mark = F.when(F.col("doc_freq") < rare_below, "rare").when(F.col("doc_freq") > F.lit(common_above) * record_count(postings), "common")
    return posting_counts(postings).withColumn("mark", mark)
