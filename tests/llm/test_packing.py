import itertools

import numpy as np
import pyarrow.parquet as pq
import pytest

from quern.llm import packing


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = np.sort(rng.choice(np.arange(1, 13), rng.integers(1, 6), replace=False))
        limits, worth = rng.integers(0, 4, len(lengths)), rng.random(len(lengths))
        config, value = packing.knapsack(lengths, limits, worth, 12)
        every = np.array(list(itertools.product(*[range(k + 1) for k in limits])))
        assert value == pytest.approx((every @ worth)[every @ lengths <= 12].max()) == pytest.approx(config @ worth)
        assert (config <= limits).all() and config @ lengths <= 12


def check_complete(counts, p, capacity):
    filled, placed = np.zeros(p.containers, np.int64), np.zeros(capacity + 1, np.int64)
    for length in np.flatnonzero(counts):
        mine = np.flatnonzero(p.length == length)
        for k, r in enumerate(mine):
            stop = p.start[mine[k + 1]] if k + 1 < len(mine) else counts[length]
            np.add.at(filled, p.base[r] + np.arange(stop - p.start[r]) // p.per[r], length)
            placed[length] += stop - p.start[r]
    assert (placed == counts).all() and filled.max() <= capacity and filled.min() > 0
    return filled


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_is_complete_and_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(129, np.int64)
    np.add.at(counts, rng.integers(1, 128, 3000) if seed < 3 else np.minimum(128, rng.geometric(1 / 30, 20_000)), 1)
    p = packing.plan(counts, 128, 200)
    filled = check_complete(counts, p, 128)
    assert p.bound <= p.containers <= p.bound * 1.03 + 2
    assert filled[: p.by_program].sum() >= (0.9 if seed == 3 else 0.5) * filled.sum()


def test_large_items_and_hard_mixes():
    counts = np.zeros(101, np.int64)
    counts[60] = 40  # no two fit: the dual of thresholds sees that
    p = packing.plan(counts, 100, 50)
    assert p.containers == 40 == p.bound
    counts[34], counts[33] = 20, 41
    check_complete(counts, p := packing.plan(counts, 100, 50), 100)
    assert p.containers == 47  # the least: 40 with a 60, and 21 of the others remain
    assert packing.plan(np.zeros(101, np.int64), 100).containers == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_documents_come_from_the_program(scale):
    """At least nine tenths of the tokens lie in the program's containers, and few containers are more than the bound."""
    count = packing.token_counter(packing.TOKENIZER)
    texts = pq.read_table(f"/root/testdata/{scale}/documents.parquet", columns=["text"])["text"].to_pylist()
    counts = np.bincount([count(t) % packing.CAPACITY if t else 0 for t in texts], minlength=packing.CAPACITY + 1)
    counts[0] = 0
    p = packing.plan(counts, packing.CAPACITY)
    filled = check_complete(counts, p, packing.CAPACITY)
    assert filled[: p.by_program].sum() >= 0.9 * filled.sum()
    assert p.bound <= p.containers <= p.bound * 1.01 + 2


def test_pack(spark):
    rng = np.random.default_rng(3)
    texts = [" word" * int(k) for k in rng.integers(0, 60, 150)] + [None, "", " word" * 250, " word" * 200, " word" * 100] + [" word" * 7] * 80
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], 1, 2)], "doc_id bigint, text string, container int, rest int")
    got = packing.pack(df, capacity=100, steps=30).toPandas()
    count = packing.token_counter(packing.TOKENIZER)
    sizes = [count(t) if t else 0 for t in [*texts, texts[3]]]
    assert got.tokens.sum() == sum(sizes) and got.doc_id.nunique() == len(texts)
    used = got[got.container.notna()].groupby("container").tokens.sum()
    assert used.max() <= 100 and sorted(used.index) == list(range(len(used)))
    assert len(used) <= np.ceil(sum(sizes) / 100) * 1.05 + 1
    pieces = got.groupby("doc_id").piece.max()
    assert pieces[152] == 3 and pieces[153] == 2 and pieces[154] == 1 and set(pieces[pieces > 1].index) == {152, 153}
    assert got[got.doc_id.isin([150, 151])].container.isna().all()
    assert packing.pack(df.limit(0), capacity=100, steps=5).count() == 0
