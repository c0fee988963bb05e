"""Items into containers of fixed capacity: a configuration linear program over the length histogram.

Items are sized in tokens. Their lengths form a histogram of at most ``capacity`` entries, however many items there are;
everything up to the assignment itself works on it. A configuration is a multiset of lengths that fits a container. The
linear program, to cover every length's count by the fewest configurations, is solved by multiplicative weights: a
length's weight is itself, the dual of a perfect filling, times a factor that is larger for large lengths and falls with
every use, so that it grows against the others where coverage lags. A knapsack dynamic program over a part of the lengths, half of them those that lag
most, finds the configuration of most weight that the items still there can fill ``grain`` times, and it is used so often.
Where no such configuration fills a container, the grain is halved. Grains are whole numbers, so rounding the solution down
loses nothing. The program ends when it covers ``COVER`` of all tokens, before the lengths left are too few to fill well;
the rest is filled greedily, the largest length that fits first, each pattern as often as the counts allow. The items of
one length are interchangeable: they are numbered by exact offsets, and ranges of numbers are mapped to containers.

An item longer than a container fills whole containers by itself; only what remains of it is packed with others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import cut, spread

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
STEPS, RATE = 400, 0.004
# How much dearer per token the largest lengths are at the start, and how much of a container a configuration may leave
# free before the grain is halved. The second setting is tried where the first ends over GOOD times the bound.
SETTINGS = ((0.008, 1e-3), (2.0, 0.25))
GOOD = 1.005
COVER = 0.92  # of all tokens lie in the program's containers
PRICED = 96  # lengths that one knapsack chooses from
# The pre-tokenization pattern that belongs to the byte-level vocabulary files: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counter(path: str):
    """A function from text to its number of tokens, by the rank file at ``path``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def knapsack(lengths: np.ndarray, limits: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How often to take each of ``lengths`` (ascending, at most ``limits`` times) for the most worth that fits, and that worth.

    Of equal choices the one with the larger lengths.
    """
    best = np.zeros(capacity + 1)
    pieces, taken = [], []
    for i, (length, limit, value) in enumerate(zip(lengths.tolist(), limits.tolist(), worth.tolist(), strict=True)):
        limit, k = min(limit, capacity // length), 1
        while limit > 0:  # 1, 2, 4 .. copies and the remainder make every number up to the limit
            k = min(k, limit)
            tried = best[: capacity + 1 - k * length] + k * value
            better = tried >= best[k * length :]
            best[k * length :] = np.where(better, tried, best[k * length :])
            pieces.append((i, k))
            taken.append(better)
            limit -= k
            k *= 2
    config, room = np.zeros(len(lengths), np.int64), capacity
    for (i, k), better in zip(reversed(pieces), reversed(taken), strict=True):
        size = k * int(lengths[i])
        if room >= size and better[room - size]:
            config[i] += k
            room -= size
    return config, float(best[capacity])


def dual_bound(counts: np.ndarray, capacity: int) -> float:
    """A lower bound on the containers: the largest value of some feasible duals of the program.

    A dual gives each length a price such that no configuration costs more than 1. Tried are length / (fullest possible
    container), and for each t the prices 1 above capacity - t, length / capacity from t on and 0 below.
    """
    n = counts.astype(np.int64)
    lengths = np.flatnonzero(n[1:]) + 1
    if not len(lengths):
        return 0.0
    fullest = knapsack(lengths, n[lengths], lengths.astype(float), capacity)[1]
    count, tokens = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    t = np.arange(1, capacity // 2 + 1)
    stepped = (count[-1] - count[capacity - t]) + (tokens[capacity - t] - tokens[t - 1]) / capacity
    return float(max(tokens[-1] / fullest, stepped.max()))


def solve(counts: np.ndarray, capacity: int, steps: int = STEPS, dearer: float = SETTINGS[0][0], slack: float = SETTINGS[0][1], rate: float = RATE) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The program's solution: configurations as (lengths, copies of each, how often), which never cover more than ``counts``.

    ``counts`` by length, entry 0 unused. The first grain is 1 / ``steps`` of the containers needed at least; there are at
    most ten times as many steps.
    """
    lengths = np.flatnonzero(counts[1:]) + 1
    n = counts[lengths].astype(np.int64)
    total = int((lengths * n).sum())
    left, covered = n.copy(), 0
    grain = max(1, int(total / capacity / steps))
    rng = np.random.default_rng(0)  # breaks ties between lengths that lag alike
    taken: list[tuple[np.ndarray, np.ndarray, int]] = []
    while covered < COVER * total and len(taken) < 10 * steps:
        open_ = np.flatnonzero(left >= grain)
        config = np.zeros(0, np.int64)
        if len(open_):
            share = 1 - left[open_] / n[open_]
            order = np.lexsort((rng.random(len(open_)), np.round(share, 3)))
            pick = np.sort(open_[np.concatenate((order[: PRICED // 2], rng.permutation(order[PRICED // 2 :])[: PRICED // 2]))])
            used = 1 - left[pick] / n[pick]
            config, _ = knapsack(lengths[pick], left[pick] // grain, lengths[pick] * np.exp(rate * (used.mean() - used) + dearer * lengths[pick] / capacity), capacity)
        filled = int((config * lengths[pick]).sum()) if len(open_) else 0
        if filled < (1 - slack) * capacity and grain > 1:
            grain //= 2
            continue
        if not filled:
            break
        left[pick] -= grain * config
        covered += grain * filled
        some = config > 0
        taken.append((lengths[pick[some]], config[some], grain))
    return taken


@dataclass
class Plan:
    """Runs of items of one length: numbers ``start``.. go to containers ``base``.., ``per`` to each."""

    length: np.ndarray
    start: np.ndarray
    base: np.ndarray
    per: np.ndarray
    containers: int
    by_program: int  # the first so many containers
    bound: float


def plan(counts: np.ndarray, capacity: int, steps: int = STEPS) -> Plan:
    """Every item of the histogram in a container; the number of runs depends on lengths, not on items."""
    bound = dual_bound(counts, capacity)
    best: Plan | None = None
    for dearer, slack in SETTINGS:
        if best is None or best.containers > GOOD * bound + 1:
            tried = _filled(counts, capacity, solve(counts, capacity, steps, dearer, slack), bound)
            best = tried if best is None or tried.containers < best.containers else best
    return best


def _filled(counts: np.ndarray, capacity: int, solution: list[tuple[np.ndarray, np.ndarray, int]], bound: float) -> Plan:
    """The solution's containers, then the rest."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    runs: list[tuple[int, int, int, int]] = []
    placed = np.zeros(capacity + 1, np.int64)
    containers = 0

    def place(lengths: np.ndarray, copies: np.ndarray, times: int) -> None:
        nonlocal containers
        runs.extend((int(l), int(placed[l]), containers, int(c)) for l, c in zip(lengths, copies, strict=True))
        placed[lengths] += times * copies
        left[lengths] -= times * copies
        containers += times

    for config in solution:
        place(*config)
    by_program = containers
    while left.any():
        config, room = np.zeros(capacity + 1, np.int64), capacity
        lengths = np.flatnonzero(left)
        fit = len(lengths)
        while fit and room >= lengths[0]:
            fit = int(np.searchsorted(lengths[:fit], room, "right"))
            if fit:
                fit -= 1
                config[lengths[fit]] = min(room // lengths[fit], left[lengths[fit]])
                room -= int(config[lengths[fit]] * lengths[fit])
        some = np.flatnonzero(config)
        place(some, config[some], int((left[some] // config[some]).min()))
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Plan(*table.T, containers, by_program, bound)


def sizes(docs: DataFrame, doc_id: str, text: str, capacity: int, tokenizer: str) -> DataFrame:
    """Per row: ``id``, ``tokens``, ``full`` containers and ``rest`` to pack, with the row's numbers inside its task.

    ``at`` counts earlier rows of the task with the same rest, ``full_at`` the full containers of earlier rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        full_before = 0
        for b in batches:
            tokens = np.array([count(t) if t else 0 for t in b.column("text").to_pylist()], np.int64)
            full, rest = tokens // capacity, tokens % capacity
            order = np.argsort(rest, kind="stable")
            ranked = rest[order]
            at = np.empty(len(rest), np.int64)
            at[order] = np.arange(len(rest)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(rest, minlength=capacity + 1)
            before = full_before + np.cumsum(full) - full
            full_before += int(full.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(tokens), pa.array(full), pa.array(rest), pa.array(at), pa.array(before), pa.array(np.full(len(rest), task))],
                names=["id", "tokens", "full", "rest", "at", "full_at", "task"],
            )

    plain = docs.select(docs[doc_id].cast("bigint").alias("id"), docs[text].cast("string").alias("text"))
    return spread(plain).mapInArrow(run, "id bigint, tokens bigint, full bigint, rest bigint, at bigint, full_at bigint, task bigint")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, steps: int = STEPS) -> DataFrame:
    """(doc_id, ``piece``, ``container``, ``tokens``): where each item lies; items over the capacity come in several pieces.

    Pieces count from 1, containers from 0, none is left out. NULL and empty texts have no tokens: one piece 1 with container
    NULL. Each row is an item, repeated rows and repeated or NULL ids included. Other columns are not read. Empty in, empty out.
    """
    spark = docs.sparkSession
    rows = cut(sizes(docs, doc_id, text, capacity, tokenizer), "sizes")
    histogram = rows.groupBy("rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).toPandas()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[histogram["rest"].to_numpy(np.int64)] = histogram["n"].to_numpy(np.int64)
    done = plan(counts, capacity, steps)
    kept = spark.sparkContext.broadcast((done.length, done.start, done.base, done.per))
    containers = done.containers

    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("rest", "task").agg(F.count(F.lit(1)).alias("n")).select("rest", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    tasks = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    full_offsets = rows.groupBy("task").agg(F.sum("full").alias("f")).select("task", F.coalesce(F.sum("f").over(tasks), F.lit(0)).alias("full_offset"))
    numbered = rows.join(offsets, ["rest", "task"]).join(F.broadcast(full_offsets), "task").select(
        "id", "tokens", "full", "rest", (F.col("at") + F.col("offset")).alias("number"), (F.col("full_at") + F.col("full_offset")).alias("first_full")
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, start, base, per = kept.value
        shift = 1 << 44
        keys = length * shift + start
        for b in batches:
            rest = b["rest"].to_numpy(np.int64)
            number = b["number"].to_numpy(np.int64)
            run = np.searchsorted(keys, rest * shift + number, "right") - 1
            packed = rest > 0
            run = np.where(packed, run, 0)
            b["container"] = pd.array(np.where(packed, base[run] + (number - start[run]) // per[run], 0), "Int64") if len(keys) else pd.array(np.zeros(len(b), np.int64), "Int64")
            b.loc[~packed, "container"] = pd.NA
            b["first_full"] += containers
            yield b[["id", "tokens", "full", "rest", "container", "first_full"]]

    placed = numbered.mapInPandas(place, "id bigint, tokens bigint, full bigint, rest bigint, container bigint, first_full bigint")
    whole = F.transform(F.sequence(F.lit(1), F.col("full")), lambda i: F.struct(i.alias("piece"), (F.col("first_full") + i - 1).alias("container"), F.lit(capacity).cast("bigint").alias("tokens")))
    tail = F.array(F.struct((F.col("full") + 1).alias("piece"), F.col("container").alias("container"), F.col("rest").alias("tokens")))
    pieces = F.when(F.col("full") == 0, tail).when(F.col("rest") == 0, whole).otherwise(F.concat(whole, tail))
    return placed.select(F.col("id").alias(doc_id), F.explode(pieces).alias("p")).select(doc_id, F.col("p.piece").cast("int").alias("piece"), "p.container", "p.tokens")
