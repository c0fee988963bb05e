"""Segments on shared storage: Parquet tables and a manifest that publishes them.

A segment is written completely and then named in a new manifest version, one small file; readers take the newest version
and never see half a segment. Tombstones are appended the same way. A writer creates exactly the version after the one it
has read, by a create that fails where the file exists; if another writer was first, it reads again, applies its change to
what it finds and tries the next number. Merging publishes a version that swaps segments for their union; the files of the
sources stay for readers of older versions until ``vacuum`` removes what no version of the last ``retain`` seconds names.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import compaction, indexing
from quern.operators.indexing import Index
from quern.schema import Schema


class Store:
    """An index in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, schema: Schema | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if schema is None:
            schema = Schema.from_json(self.manifest()["schema"])
        self.schema = schema

    def _versions(self) -> list[int]:
        place = self._Path(f"{self.path}/manifest")
        if not self._fs.exists(place):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(place) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or an empty one: ``segments`` (id, doc_count, tables, state), ``tombstones``, ``next_id``."""
        versions = self._versions()
        if not versions:
            return {"segments": [], "tombstones": [], "next_id": 0, "schema": None}
        return self._load(versions[-1] if version is None else version)

    def _load(self, version: int) -> dict:
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{version:012d}.json").first()[0]
        return json.loads(text) | {"version": version}

    def _publish(self, change: Callable[[dict], dict | None]) -> dict | None:
        """Apply ``change`` to the newest manifest and publish the result as the version after it; None if it declines.

        ``change`` is called again with a newer manifest whenever another writer was first.
        """
        while True:
            manifest = self.manifest()
            after = change(manifest)
            if after is None:
                return None
            number = manifest.get("version", -1) + 1
            text = json.dumps({k: v for k, v in after.items() if k != "version"} | {"schema": self.schema.to_json(), "published_at": time.time()})
            if self._create(f"{self.path}/manifest/{number:012d}.json", text):
                return after | {"version": number}

    def _create(self, path: str, text: str) -> bool:
        """Create a file with its whole text; False where it exists.

        On a local file system, where rename may overwrite, the draft is linked to its name; elsewhere rename fails.
        """
        final, draft = self._Path(path), self._Path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() != "file":
                return not self._fs.exists(final) and bool(self._fs.rename(draft, final))
            os.link(draft.toUri().getPath(), final.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            self._fs.delete(draft, False)

    def segment_ids(self) -> list[int]:
        return [s["id"] for s in self.manifest()["segments"]]

    def add(self, docs: DataFrame, batches: list[int] | None = None) -> int | None:
        """Index documents (``doc_id`` unique in the store) as a new segment; None where there are none.

        ``batches`` names the stream batches the segment holds.
        """
        where = f"{self.path}/segments/{uuid.uuid4().hex}"
        docs.write.parquet(f"{where}/docs")
        count = self._index(where)
        if not count:
            self._fs.delete(self._Path(where), True)
            return None
        return self._publish(lambda m: _with_segment(m, where, count, batches or []))["next_id"] - 1

    def _index(self, where: str) -> int:
        """Write the postings and lengths of the documents in ``where``; their number. Texts are analysed once."""
        written = self.spark.read.parquet(f"{where}/docs")
        posts = indexing.postings(indexing.tokens(written, self.schema), positions=any(f.index == "freqs_positions" for f in self.schema.indexed()))
        posts.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").write.parquet(f"{where}/postings")
        self._lengths(where)
        return written.count()

    def _lengths(self, where: str) -> None:
        kept = self.spark.read.parquet(f"{where}/postings")
        indexing.summed_lengths(kept).coalesce(1).write.parquet(f"{where}/lengths")

    def delete(self, ids: DataFrame) -> int:
        """Mark documents (segment_id, doc_id) dead; the number of living ones among them."""
        manifest = self.manifest()
        alive = ids.select("segment_id", "doc_id").distinct().join(self.docs(manifest).select("segment_id", "doc_id"), ["segment_id", "doc_id"], "left_semi")
        dead = self.tombstones(manifest)
        where = f"{self.path}/tombstones/{uuid.uuid4().hex}"
        (alive.join(dead, ["segment_id", "doc_id"], "left_anti") if dead is not None else alive).write.parquet(where)
        count = self.spark.read.parquet(where).count()
        named = {s["id"] for s in manifest["segments"]}
        lost = lambda m: named - {s["id"] for s in m["segments"]}
        done = self._publish(lambda m: None if lost(m) else {**m, "tombstones": [*m["tombstones"], where]})
        return count if done else self.delete(self._moved(ids))

    def _moved(self, ids: DataFrame) -> DataFrame:
        """(segment_id, doc_id) after a merge in the meantime: documents keep their ids and changed the segment."""
        return ids.select("doc_id").distinct().join(self.docs().select("doc_id", "segment_id"), "doc_id").select("segment_id", "doc_id")

    def _union(self, manifest: dict, table: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{s['at']}/{table}").withColumn("segment_id", F.lit(s["id"])) for s in manifest["segments"]]
        if not parts:
            raise ValueError("the store has no segment")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def docs(self, manifest: dict | None = None) -> DataFrame:
        return self._union(manifest or self.manifest(), "docs")

    def postings(self, manifest: dict | None = None) -> DataFrame:
        return self._union(manifest or self.manifest(), "postings")

    def tombstones(self, manifest: dict | None = None) -> DataFrame | None:
        places = (manifest or self.manifest())["tombstones"]
        return self.spark.read.parquet(*places) if places else None

    def snapshot(self) -> Index:
        """What a search reads: one manifest version. Dead documents count in statistics until they are merged away."""
        manifest = self.manifest()
        n = float(sum(s["doc_count"] for s in manifest["segments"]))
        stats = self._union(manifest, "lengths").groupBy("field").agg(F.sum("sum_len").alias("sum_len")).select("field", F.lit(n).alias("n_docs"), "sum_len", (F.col("sum_len") / F.lit(n)).alias("avgdl"))
        posts = self.postings(manifest)
        return Index(self.schema, self.docs(manifest), posts, stats, indexing.term_dict(posts, stats), self.tombstones(manifest))

    def merge(self, policy: str = "tiered", most: int = 5, renumber: bool = False) -> int | None:
        """Merge segments into one where the policy says so: its number, else None. The dead among them go.

        ``force`` merges all. ``tiered`` takes the smaller segments, where more than ``most`` lie side by side, so that a
        document is rewritten a logarithmic number of times. Ids are unique in the store and stay; ``renumber`` (all
        segments only) gives living documents the ids from 1 instead. A merge that finds one of its sources gone or a
        document of them deleted in the meantime begins again.
        """
        manifest = self.manifest()
        sizes = {s["id"]: s["doc_count"] for s in manifest["segments"]}
        chosen = compaction.to_merge(policy, sizes, most)
        if not chosen:
            return None
        old = [s for s in manifest["segments"] if s["id"] in chosen]
        dead, part = self.tombstones(manifest), {**manifest, "segments": old}
        docs = self.docs(part)
        mapping = compaction.remap(docs, dead if dead is not None else docs.select("segment_id", "doc_id").limit(0))
        if not renumber:
            mapping = mapping.withColumn("new_id", F.col("doc_id"))
        where = f"{self.path}/segments/{uuid.uuid4().hex}"
        compaction.carry(docs, mapping, 0).drop("segment_id").write.parquet(f"{where}/docs")
        compaction.carry(self.postings(part), mapping, 0).drop("segment_id").repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").write.parquet(f"{where}/postings")
        self._lengths(where)
        count, batches = self.spark.read.parquet(f"{where}/docs").count(), sorted({b for s in old for b in s.get("batches", [])})

        def swap(m: dict) -> dict | None:
            if m["tombstones"] != manifest["tombstones"] or not chosen <= {s["id"] for s in m["segments"]}:
                return None
            rest = [s for s in m["segments"] if s["id"] not in chosen]
            return _with_segment({**m, "segments": rest, "tombstones": m["tombstones"] if rest else []}, where, count, batches)

        done = self._publish(swap)
        return done["next_id"] - 1 if done else self.merge(policy, most, renumber)

    def vacuum(self, retain: float = 3600.0) -> int:
        """Remove manifest versions older than ``retain`` seconds but for the newest, and the folders that none left names."""
        versions = self._versions()
        kept = [m for m in map(self._load, versions) if m["version"] == versions[-1] or m["published_at"] >= time.time() - retain]
        named = {s["at"] for m in kept for s in m["segments"]} | {t for m in kept for t in m["tombstones"]}
        gone = 0
        for kind in ("segments", "tombstones"):
            place = self._Path(f"{self.path}/{kind}")
            for f in self._fs.listStatus(place) if self._fs.exists(place) else []:
                at = f"{self.path}/{kind}/{f.getPath().getName()}"
                if at not in named and f.getModificationTime() / 1000 < time.time() - retain:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        for v in set(versions) - {m["version"] for m in kept}:
            self._fs.delete(self._Path(f"{self.path}/manifest/{v:012d}.json"), False)
        return gone

    def verify(self) -> DataFrame:
        """Posting rows that do not follow from the documents, or are missing: (segment_id, field, term, doc_id).

        Frequencies, lengths and, where they are kept, positions are compared; the summed lengths of a segment that differ
        come out with a NULL term and document.
        """
        manifest = self.manifest()
        placed = any(f.index == "freqs_positions" for f in self.schema.indexed())
        again = None
        for s in manifest["segments"]:
            docs = self.spark.read.parquet(f"{s['at']}/docs")
            part = indexing.postings(indexing.tokens(docs, self.schema), positions=placed).withColumn("segment_id", F.lit(s["id"]))
            again = part if again is None else again.unionByName(part)
        kept, columns = self.postings(manifest), ["segment_id", "field", "term", "doc_id", "tf", "dl", *["positions"] * placed]
        sides = kept.select(*columns, F.lit(1).alias("side")).unionByName(again.select(*columns, F.lit(-1).alias("side")))
        wrong = sides.groupBy(*columns).agg(F.sum("side").alias("n")).where("n <> 0").select(*columns[:4])
        sums = kept.groupBy("segment_id", "field").agg(F.sum("tf").alias("true")).join(self._union(manifest, "lengths"), ["segment_id", "field"], "full")
        stale = sums.where(~F.col("true").eqNullSafe(F.col("sum_len"))).select("segment_id", "field", F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("doc_id"))
        return wrong.union(stale).distinct()


def _with_segment(manifest: dict, where: str, count: int, batches: list[int]) -> dict:
    segment = {"id": manifest["next_id"], "at": where, "doc_count": count, "batches": batches, "state": "committed", "created_at": time.time()}
    return {**manifest, "segments": [*manifest["segments"], segment], "next_id": manifest["next_id"] + 1}
