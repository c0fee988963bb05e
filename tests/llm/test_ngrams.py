import random
from collections import Counter, defaultdict

import oracle
import pytest

from quern.llm import ngrams
from quern.llm.queries import ORACLE, QUERIES


def brute(docs, n):
    total, records = Counter(), defaultdict(set)
    for i, tokens in enumerate(docs):
        tokens = [t for t in tokens or [] if t]
        for k in range(1, n + 1):
            for a in range(len(tokens) - k + 1):
                g = tuple(tokens[a : a + k])
                total[g] += 1
                records[g].add(i)
    return {g: (len(records[g]), c) for g, c in total.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngrams_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = [[rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(40)] + [None, [], ["a"] * 50, ["", None, "b"]] + [["a", "b", "a", "b"]] * 20
    df = spark.createDataFrame([(d, 1) for d in docs], "words array<string>, t1 int")
    got = {tuple(r.ngram): (r.doc_freq, r.total_term_freq) for r in ngrams.ngram_counts(df, "words", 3).collect()}
    assert got == brute(docs, 3)
    assert ngrams.ngram_counts(df.limit(0), "words", 2).count() == 0


COLUMNS = "segment_id int, field string, term string, doc_id bigint, tf int, indexed_at timestamp, ngram string"


def test_postings_repeats_nulls_and_marks(spark):
    from datetime import datetime as dt

    a, b = dt(2026, 1, 1), dt(2026, 1, 2)
    rows = [(1, "body", "x", d, 2, a, "") for d in range(20)] + [(1, "body", "x", 0, 5, b, "")] * 3 + [(1, "body", "y", 1, None, a, ""), (1, "body", "", 2, 1, a, ""), (1, "body", None, 3, 1, a, ""), (1, "title", "x", 3, 1, a, ""), (None, "body", "x", 3, 1, a, "")]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r.field, r.term): (r.doc_freq, r.total_term_freq, r.mark) for r in ngrams.marked(df).collect()}
    assert got == {("body", "x"): (20, 43, "common"), ("body", "y"): (1, 1, "rare"), ("title", "x"): (1, 1, "rare")}
    assert ngrams.marked(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, sf, name):
    oracle.assert_same(oracle.connection(sf), QUERIES[name](spark, sf), ORACLE[name])
