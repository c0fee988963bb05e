"""Per-key results without skew: exact offset chunking.

A key that holds most rows makes one task run far longer than all others when rows are grouped by key. Here rows are
brought into one order by (keys, item) and spread evenly by ranges of that order, so that a large key spans many
partitions. Rows are counted per partition, the counts become offsets by a prefix sum, every row gets its exact number,
and runs of ``chunk_rows`` numbers form chunks of equal size. Each chunk yields one state per key it touches; the states
of a key, which follow one another in the order, are merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import cut, partitions

CHUNK_ROWS = 100_000
_WITHIN = (1 << 33) - 1  # the low bits of monotonically_increasing_id: the row's place in its partition


def number_rows(df: DataFrame, order: Sequence[str], chunk_rows: int = CHUNK_ROWS, parts: bool = False) -> DataFrame:
    """``df`` plus ``_row`` (0-based place in the order of ``order``) and ``_chunk`` = ``_row`` div ``chunk_rows``.

    With ``parts`` also ``_part``, the number of the range that the row lies in.

    Rows that agree in all of ``order`` share a range partition; collapse copies beforehand (``key_states`` does).
    NULLs come first. An empty input gives an empty result. The names ``_row``, ``_chunk``, ``_part`` and ``_at`` are taken.
    """
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    runs = cut(
        df.repartitionByRange(partitions(df.sparkSession), *[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))}),
        "runs",
    )
    # One row per partition, whatever the number of rows.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = runs.join(F.broadcast(offsets), "_part").withColumn("_row", F.col("_offset") + F.col("_at"))
    return numbered.withColumn("_chunk", F.expr(f"_row div {int(chunk_rows)}")).select(*df.columns, "_row", "_chunk", *["_part"] * parts)


def key_states(df: DataFrame, keys: Sequence[str], item: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per chunk and key: ``rows`` (repeats included), ``items`` (distinct), ``first_item`` and ``last_item``.

    Repeats of (keys, item) collapse before any row moves, so a group of copies is no hot spot either.
    """
    pairs = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_copies"))
    chunked = number_rows(pairs, [*keys, item], chunk_rows)
    return chunked.groupBy("_chunk", *keys).agg(
        F.sum("_copies").alias("rows"),
        F.count(item).alias("items"),
        F.min(item).alias("first_item"),
        F.max(item).alias("last_item"),
    )


def per_key(df: DataFrame, keys: Sequence[str], item: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per key: ``rows``, ``items`` (distinct non-NULL values of ``item``), ``first_item``, ``last_item``, ``chunks``.

    NULL keys form a key of their own, as in GROUP BY; a NULL item counts in ``rows`` only. Columns of ``df`` other than
    ``keys`` and ``item`` are not read, so clashing names do no harm. An empty input gives an empty result.
    """
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    plain = df.select(*[df[k].alias(n) for k, n in names.items()], df[item].alias("_item"))
    states = key_states(plain, list(names.values()), "_item", chunk_rows)
    merged = states.groupBy(*names.values()).agg(
        F.sum("rows").alias("rows"),
        F.sum("items").alias("items"),
        F.min_by("first_item", _present("first_item")).alias("first_item"),
        F.max_by("last_item", _present("last_item")).alias("last_item"),
        F.count(F.lit(1)).alias("chunks"),
    )
    return merged.select(*[F.col(n).alias(k) for k, n in names.items()], "rows", "items", "first_item", "last_item", "chunks")


def _present(value: str) -> Column:
    """The chunk number where the state has a value; chunks without one lie before all others of their key."""
    return F.when(F.col(value).isNotNull(), F.col("_chunk"))


def true_doc_freq(postings: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(segment_id, field, term, doc_freq): distinct documents per posting list; rows with a NULL or empty term are left out."""
    sound = postings.where("term is not null and term <> '' and doc_id is not null")
    return per_key(sound, ["segment_id", "field", "term"], "doc_id", chunk_rows).select("segment_id", "field", "term", F.col("items").alias("doc_freq"))


def wrong_statistics(postings: DataFrame, term_dict: DataFrame, segment_stats: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(segment_id, field, term) of recorded statistics that differ from the postings.

    A term_dict row is wrong if its doc_freq is NULL or not the true number (0 for a key without postings). A
    segment_stats row is wrong likewise by max_pl_df against the segment's largest number, and comes out as field ``*``
    with its max_pl_term. Repeated rows come out once.
    """
    true = true_doc_freq(postings, chunk_rows)
    key = ["segment_id", "field", "term"]
    recorded = term_dict.select(*key, F.col("doc_freq").alias("_recorded"))
    terms = recorded.join(true, key, "left").where(~F.col("_recorded").eqNullSafe(F.coalesce("doc_freq", F.lit(0)))).select(*key)
    largest = true.groupBy("segment_id").agg(F.max("doc_freq").alias("_true"))
    segments = (
        segment_stats.select("segment_id", "max_pl_df", "max_pl_term")
        .join(largest, "segment_id", "left")
        .where(~F.col("max_pl_df").eqNullSafe(F.coalesce("_true", F.lit(0))))
        .select("segment_id", F.lit("*").alias("field"), F.col("max_pl_term").alias("term"))
    )
    return terms.unionByName(segments).distinct()


def place_in_key(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """``df`` plus ``_place``, the row's 0-based place in its key by ``item``, no key being brought into one task.

    A key's first row is known inside each range of the order; only keys that cross a border of ranges need more, and
    there are no more of them than borders. NULL keys form a key of their own.
    """
    rows = number_rows(df, [*keys, item], parts=True)
    here = F.min("_row").over(Window.partitionBy("_part", *keys))
    states = rows.groupBy("_part", *keys).agg(F.min("_row").alias("_first"))
    crossing = states.groupBy(*keys).agg(F.min("_first").alias("_begin"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    named = crossing.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], "_begin")
    same = [F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)]
    placed = rows.withColumn("_first", here).join(F.broadcast(named), same, "left")  # at most a row per border
    return placed.withColumn("_place", F.col("_row") - F.coalesce("_begin", "_first")).select(*df.columns, "_place")
