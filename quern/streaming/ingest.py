"""Near-real-time ingest: every micro-batch becomes a segment of a store.

A document is visible once its batch is published, at the latest one trigger after its arrival. A batch that is run again
after a failure is recognised by its number and not added twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from time import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.sources.store import Store

QUEUED, FLUSHING, ON_DISK, MERGING, COMMITTED = "queued", "flushing", "on_disk", "merging", "committed"


@dataclass
class BatchStats:
    """The states a batch went through, with their times."""

    batch_id: int
    segment_id: int | None = None
    states: list[tuple[str, float]] = field(default_factory=list)

    def enter(self, state: str) -> None:
        self.states.append((state, time()))


class Ingest:
    """Writes a stream of documents into a store; ``most_segments`` bounds how many segments lie side by side."""

    def __init__(self, store: Store, checkpoint: str, most_segments: int = 5, trigger: dict | None = None, done: Callable[[BatchStats], None] | None = None) -> None:
        self.store, self.checkpoint, self.most = store, checkpoint, most_segments
        self.trigger, self.done = trigger or {"processingTime": "1 second"}, done
        self.stats: list[BatchStats] = []
        self.query: StreamingQuery | None = None

    def _batch(self, docs: DataFrame, number: int) -> None:
        stats = BatchStats(number)
        stats.enter(QUEUED)
        if number not in {b for s in self.store.manifest()["segments"] for b in s.get("batches", [])}:
            stats.enter(FLUSHING)
            stats.segment_id = self.store.add(docs, batches=[number])
            stats.enter(ON_DISK)
            if len(self.store.segment_ids()) > self.most:
                stats.enter(MERGING)
                stats.segment_id = self.store.merge("tiered", self.most)
        stats.enter(COMMITTED)
        self.stats.append(stats)
        if self.done:
            self.done(stats)

    def start(self, stream: DataFrame) -> StreamingQuery:
        self.query = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(**self.trigger).start()
        return self.query

    def stop(self) -> None:
        """Take in all that has arrived, then end."""
        if self.query:
            self.query.processAllAvailable()
            self.query.stop()
