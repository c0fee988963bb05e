"""Evaluation texts inside a corpus: spaced-seed hashing.

A seed is a fixed mask over a window of SPAN words: some positions count, the others are ignored, so a window is still
found where a substitution falls on an ignored position. Every window of every test item and of every document is hashed
under each mask. The item hashes form a filter of fixed size, which the documents' windows meet where they are read;
what passes is joined with the item hashes by equality. Each hit fixes an alignment of a document with an item, along
which the overlap is verified word by word, with substitutions allowed inside it.

Words are the longest runs of ASCII letters and digits; case, punctuation, markup, spacing and invisible characters are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import cut, spread

SPAN = 13
MASKS = ("1110100001101", "1011000111001")
FILTER_BITS = 24  # 2 MB, whatever the number of items
MISMATCH = 3  # matching words that a substitution inside an overlap costs
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_TAG = re.compile(r"""</?[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z:-]+=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))*\s*/?>|&(?:[A-Za-z]{2,8}|#[0-9]{1,6}|#x[0-9A-Fa-f]{1,6});""")


def clean(text: str | None) -> str:
    """The text without invisible characters, tags and entities."""
    if not text:
        return ""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return text


def word_lists(texts: list[str | None]) -> pa.ListArray:
    """The words of each text, in lower case."""
    low = pc.ascii_lower(pa.array([clean(t) for t in texts], pa.string()))
    spaced = pc.replace_substring_regex(low, "[^a-z0-9]+", " ")
    return pc.split_pattern(pc.ascii_trim(spaced, " "), " ")


def windows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each window of SPAN words: its text's number, its first word's place, and its hash under each mask."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    unique = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(u) for u in unique], np.uint64)[coded.indices.to_numpy()]
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    last = len(text) - SPAN + 1
    if last < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in MASKS]
    inside = text[:last] == text[SPAN - 1 :]
    found = []
    for k, mask in enumerate(MASKS):
        h = np.full(last, k + 1, np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                h = h * np.uint64(0x100000001B3) + hashes[i : i + last]
                h ^= h >> np.uint64(32)
        found.append((h * np.uint64(0x9E3779B97F4A7C15))[inside])
    place = np.arange(last) - offsets[text[:last]]
    return text[:last][inside], place[inside], found


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << FILTER_BITS) - 1)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), ((h >> np.uint64(8)) & low).astype(np.int64)


def item_seeds(items: DataFrame) -> DataFrame:
    """(``h``, ``item_id``, ``ipos``) of items (item_id, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, place, hashes = windows(pc.split_pattern(b.column("words"), " "))
            ids = b.column("item_id").to_numpy(zero_copy_only=False)
            for h in hashes:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[text]), pa.array(place.astype(np.int32))], names=["h", "item_id", "ipos"])

    return items.mapInArrow(run, "h bigint, item_id bigint, ipos int")


def _filter(seeds: DataFrame) -> np.ndarray:
    """The bits set by all item hashes: built per task, joined by OR, 2 ** FILTER_BITS bits in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            for at in _bits(h):
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], names=["at", "bits"])

    filled = seeds.select("h").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    words[filled["at"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def _verify(doc: list[str], item: list[str], shift: int) -> tuple[int, int, int, int, int]:
    """Along doc[i + shift] ~ item[i]: longest exact run, then length, matches and both starts of the best overlap."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    run = best_run = score = best = start = matches = 0
    out = (0, 0, 0, 0)
    for i in range(lo, hi):
        same = doc[i + shift] == item[i]
        run = run + 1 if same else 0
        best_run = max(best_run, run)
        if score <= 0:
            score, start, matches = 0, i, 0
        score += 1 if same else -MISMATCH
        matches += same
        if score > best:
            best, out = score, (i - start + 1, matches, start + shift, start)
    return (best_run, *out)


def overlaps(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(doc_id, item_id, ``run``, ``words``, ``matched``, ``doc_pos``, ``item_pos``) of every document that shares a seed with an item.

    ``run`` is the longest run of equal consecutive words; ``words`` of which ``matched`` are equal is the best overlap with
    substitutions, which begins at the 0-based words ``doc_pos`` and ``item_pos``. Texts of fewer than SPAN words, NULL
    texts and NULL ids have no seeds. Repeated rows come out once; of rows with the same id and other texts the best
    overlap. Other columns are not read. Empty tables give an empty result.
    """
    normal = items.where(items[item_id].isNotNull()).select(items[item_id].cast("bigint").alias("item_id"), items[item_text].cast("string").alias("text")).distinct()

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = word_lists(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pc.binary_join(lists, " ")], names=["item_id", "words"])

    cleaned = cut(normal.mapInArrow(plain, "item_id bigint, words string").distinct(), "items")
    seeds = item_seeds(cleaned)
    passing = documents.sparkSession.sparkContext.broadcast(_filter(seeds))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = passing.value
        for b in batches:
            if not b.num_rows:
                continue
            lists = word_lists(b.column("text").to_pylist())
            at, place, hashes = windows(lists)
            hit_text, hit_place, hit_hash = [], [], []
            for h in hashes:
                one, two = _bits(h)
                hit = np.flatnonzero(allowed[one])
                hit = hit[allowed[two[hit]]]
                hit_text.append(at[hit])
                hit_place.append(place[hit])
                hit_hash.append(h[hit])
            t, p, h = np.concatenate(hit_text), np.concatenate(hit_place), np.concatenate(hit_hash)
            order = np.lexsort((p, t))
            t, p, h = t[order], p[order], h[order]
            which, counts = np.unique(t, return_counts=True)
            if not len(which):
                continue
            off = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(which)),
                    pc.binary_join(lists.take(pa.array(which)), " "),
                    pa.ListArray.from_arrays(off, pa.array(h.view(np.int64))),
                    pa.ListArray.from_arrays(off, pa.array(p.astype(np.int32))),
                ],
                names=["doc_id", "words", "h", "pos"],
            )

    docs = documents.where(documents[doc_id].isNotNull()).select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].cast("string").alias("text"))
    hits = cut(spread(docs).mapInArrow(read, "doc_id bigint, words string, h array<bigint>, pos array<int>"), "hits")
    each = hits.select("doc_id", F.explode(F.arrays_zip("h", "pos")).alias("s")).select("doc_id", F.col("s.h").alias("h"), F.col("s.pos").alias("pos"))
    aligned = each.join(seeds, "h").select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"))
    pairs = aligned.groupBy("doc_id", "item_id").agg(F.collect_set("shift").alias("shifts"))
    full = pairs.join(hits.select("doc_id", "words"), "doc_id").join(cleaned.withColumnRenamed("words", "item_words"), "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                d, i = r.words.split(" "), r.item_words.split(" ")
                found = [_verify(d, i, int(s)) for s in r.shifts]
                run = max(f[0] for f in found)
                best = max(found, key=lambda f: (f[2], -f[1], -f[3], -f[4]))
                rows.append((r.doc_id, r.item_id, run, *best[1:]))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run", "words", "matched", "doc_pos", "item_pos"])

    out = full.mapInPandas(verify, "doc_id bigint, item_id bigint, run int, words int, matched int, doc_pos int, item_pos int")
    best = F.max_by(F.struct("words", "matched", "doc_pos", "item_pos"), F.struct("matched", "run")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), best).select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "run", "b.*")
