"""Deleting and merging: dense new document numbers over living documents, postings carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.chunks import number_rows


def remap(docs: DataFrame, deleted: DataFrame) -> DataFrame:
    """(``segment_id``, ``doc_id``, ``new_id``): numbers from 1 in the order of segment and document, the dead left out."""
    alive = docs.select("segment_id", "doc_id").join(deleted.select("segment_id", "doc_id").distinct(), ["segment_id", "doc_id"], "left_anti")
    return number_rows(alive, ["segment_id", "doc_id"]).select("segment_id", "doc_id", (F.col("_row") + 1).alias("new_id"))


def carry(rows: DataFrame, mapping: DataFrame, new_segment: int) -> DataFrame:
    """Rows with (segment_id, doc_id) under their new numbers in one segment."""
    moved = rows.join(mapping, ["segment_id", "doc_id"])
    return moved.select(F.lit(new_segment).alias("segment_id"), F.col("new_id").alias("doc_id"), *[c for c in rows.columns if c not in ("segment_id", "doc_id")])


def to_merge(policy: str, sizes: dict[int, int], most: int = 5) -> set[int]:
    """Which of the segments (number to documents) to merge into one.

    ``force`` takes all. ``tiered`` does nothing up to ``most`` segments; of more it takes the smallest, at least as many as
    leave ``most``, and on as long as the next is no larger than those taken together.
    """
    if policy == "force":
        return set(sizes)
    if policy != "tiered" or len(sizes) <= most:
        return set()
    order = sorted(sizes, key=lambda s: (sizes[s], s))
    taken = order[: max(2, len(sizes) - most + 1)]
    for s in order[len(taken) :]:
        if sizes[s] > sum(sizes[t] for t in taken):
            break
        taken.append(s)
    return set(taken)
