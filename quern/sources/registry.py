"""Which stores and batches a search reads: readers come and go while searches run."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import functions as F

from quern.operators import indexing
from quern.operators.indexing import Index
from quern.sources.store import Store


class Readers:
    """Named indexes of one schema, searched as one. A search sees those that were there when it began.

    Document ids must be unique over all readers.
    """

    def __init__(self) -> None:
        self._readers: dict[str, Store | Index] = {}
        self._lock = Lock()

    def add(self, name: str, reader: Store | Index) -> None:
        """Attach a store or an index, in place of one of the same name."""
        with self._lock:
            self._readers = {**self._readers, name: reader}

    def remove(self, name: str) -> bool:
        """Detach a reader; whether there was one."""
        with self._lock:
            known = name in self._readers
            self._readers = {k: v for k, v in self._readers.items() if k != name}
            return known

    def names(self) -> list[str]:
        return sorted(self._readers)

    def snapshot(self) -> Index:
        """One index over all readers, with statistics over all documents."""
        parts = [r.snapshot() if isinstance(r, Store) else r for _, r in sorted(self._readers.items())]
        if not parts:
            raise ValueError("no reader is attached")
        docs, posts, sums, dead = parts[0].docs, parts[0].postings, parts[0].stats, parts[0].deleted
        for p in parts[1:]:
            docs, posts = docs.unionByName(p.docs, allowMissingColumns=True), posts.unionByName(p.postings, allowMissingColumns=True)
            sums = sums.unionByName(p.stats)
            gone = p.deleted.select("doc_id") if p.deleted is not None else None
            dead = gone if dead is None else dead.select("doc_id").union(gone) if gone is not None else dead
        n = docs.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
        stats = sums.groupBy("field").agg(F.sum("sum_len").alias("sum_len")).select("field", n.alias("n_docs"), "sum_len", (F.col("sum_len") / n).alias("avgdl"))
        return Index(parts[0].schema, docs, posts, stats, indexing.term_dict(posts, stats), dead)
