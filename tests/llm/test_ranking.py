import numpy as np
import pytest

from quern.llm import ranking


def brute(scores, damping, steps):
    n, k = scores.shape
    move = sum((scores[None, :, c] > scores[:, None, c]).astype(float) for c in range(k)) / (n * k)
    move += np.diag(1 - move.sum(1))
    pi = np.full(n, 1 / n)
    for _ in range(steps):
        pi = (1 - damping) / n + damping * pi @ move
    return pi


@pytest.mark.parametrize("n", [1, 2, 37])
def test_walk_is_the_chain(n):
    scores = np.random.default_rng(n).integers(0, 9, (n, 3)).astype(float)
    scores[0, 0] = -np.inf
    assert np.allclose(ranking.walk(scores, 0.9, 60), brute(scores, 0.9, 60), atol=1e-11)
    assert ranking.walk(scores[:0]).shape == (0,)


def frame(spark):
    rng = np.random.default_rng(5)
    rows = [(int(q), int(i), float(rng.exponential()), float(rng.pareto(1)) if i % 5 else None, float(rng.integers(0, 4)), "x") for q, n in ((1, 30), (2, 7), (3, 1)) for i in range(n)]
    return spark.createDataFrame(rows + rows[:9] + [(None, 4, 1.0, float("nan"), None, "x"), (None, 5, 2.0, 1.0, 0.0, "x"), (1, None, 1.0, 1.0, 1.0, "x")], "q bigint, i bigint, a double, b double, c double, g string")


def test_large_groups_walk_alike(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 4)
    df = frame(spark)
    small = sorted((r.q or 0, r["rank"], r.i, round(r.stationary, 9)) for r in ranking.rank_walk(df, "q", "i", ["a", "b", "c"], 0.8, 4).collect())
    large = sorted((r.q or 0, r["rank"], r.i, round(r.stationary, 9)) for r in ranking.rank_walk(df, "q", "i", ["a", "b", "c"], 0.8, 4, bound=10).collect())
    assert small == large and len(small) == 40
    assert [r[:2] for r in small[:2]] == [(0, 1), (0, 2)]
    assert ranking.rank_walk(df.limit(0), "q", "i", ["a"]).count() == 0


def test_found_are_good_in_all_three(spark):
    """The ten found are those of the best worst rank, which the data set apart."""
    import pandas as pd

    d = "/root/testdata/sf0.01"
    hits, docs = pd.read_parquet(f"{d}/hits.parquet"), pd.read_parquet(f"{d}/stored_docs.parquet").drop_duplicates("doc_id")
    best = hits.groupby(["query_id", "doc_id"], as_index=False).score.max().merge(docs, on="doc_id")
    t = best.pubtime.fillna(0).astype(float)
    best["t"] = np.where(t > 1e11, t / 1000, t)
    worst = pd.concat([best.groupby("query_id")[c].rank(pct=True) for c in ("score", "t")] + [best.assign(p=best.page_rank.fillna(0)).groupby("query_id").p.rank(pct=True)], axis=1).min(axis=1)
    want = set(map(tuple, best.assign(w=worst).sort_values("w", ascending=False).groupby("query_id").head(10)[["query_id", "doc_id"]].to_numpy().tolist()))
    from quern.llm.queries import QUERIES

    assert {tuple(r) for r in QUERIES["p4_found"](spark, d).collect()} == want
