import math
import random

import pytest

from quern.operators import indexing
from quern.plans import planner
from quern.plans.planner import NumericFilter, search
from quern.plans.query import AND, MUST, MUST_NOT, OR, SHOULD, Bool, Term, parse
from quern.schema import Field, Schema

S1 = Schema((Field("title", "text", "freqs_positions", True), Field("body", "text", "freqs_positions"), Field("category", "keyword", "none", True), Field("pubtime", "int64", fast=True), Field("uid", "int64", fast=True)))
COLUMNS = "doc_id bigint, ext_id bigint, title string, body string, pubtime bigint, uid bigint"


def build(spark, rows):
    return indexing.build(spark.createDataFrame([(i, 0, t, b, p, u) for i, t, b, p, u in rows], COLUMNS), S1, written=False)


def ids(df):
    return [r.doc_id for r in df.collect()]


GOLDEN = [
    ("python", ["body", "title"], OR, "(body:python title:python)"),
    ("+body:python -body:spam", ["body"], OR, "(+body:python -body:spam)"),
    ("+python -spam", ["body", "title"], OR, "(+(body:python title:python) -(body:spam title:spam))"),
    ("python machine", ["body", "title"], AND, "(+(body:python title:python) +(body:machine title:machine))"),
    ("body:python", ["body"], OR, "(body:python)"),
    ("body:python", ["body"], AND, "(+body:python)"),
    ("+python body:numpy -source:spam", ["body"], OR, "(+(body:python) body:numpy -source:spam)"),
    ("the and of", ["body"], AND, "()"),
    ("+ - field: :x a:b:c", ["body"], OR, "(body:field body:x a:b a:c)"),
]


@pytest.mark.parametrize("text,fields,mode,want", GOLDEN)
def test_parser(text, fields, mode, want):
    assert str(parse(text, fields, mode)) == want


def test_must_should_not(spark):
    rows = [(i, "", "python" + (" numpy" if i % 3 == 0 else "") + (" spam" if i % 5 == 0 else ""), 0, 0) for i in range(1, 31)]
    assert sorted(ids(search(build(spark, rows), "+body:python body:numpy -body:spam", 50, OR))) == [i for i in range(1, 31) if i % 5]


def test_bare_and_means_any_field(spark):
    rows = [(i, "deep" if i % 3 == 0 else "nothing", "python" if i % 2 == 0 else "other", 0, 0) for i in range(1, 61)]
    assert sorted(ids(search(build(spark, rows), "python deep", 100, AND))) == [i for i in range(1, 61) if i % 6 == 0]


def test_unsatisfiable_and_empty(spark):
    index = build(spark, [(1, "a", "python", 0, 0)])
    for text in ("", "the", "-python", "missing python"):
        assert ids(search(index, text, 10, AND)) == []
    assert ids(search(index, "python", 0, OR)) == []
    assert ids(search(index, "missing python", 10, OR)) == [1]
    empty = build(spark, [])
    assert ids(search(empty, "python", 10, OR)) == []


def test_top_k_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "other"]
    rows = [(i, "", " ".join(rng.choices(words, [5, 4, 2, 1, 9], k=rng.randrange(1, 25))), 0, 0) for i in range(1, 301)]
    index = build(spark, rows)
    n, lengths = len(rows), {r[0]: len(r[2].split()) for r in rows}
    avg = sum(lengths.values()) / n
    df = {w: sum(w in r[2].split() for r in rows) for w in words}

    def score(r, terms):
        out = 0.0
        for w in terms:
            tf = r[2].split().count(w)
            if tf:
                out += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[r[0]] / avg))
        return out

    terms = ["alpha", "gamma", "delta", "gamma"]
    want = sorted(((-score(r, terms), r[0]) for r in rows if score(r, terms) > 0))[:15]
    got = search(index, " ".join(terms), 15, OR, fields=["body"]).collect()
    assert [r.doc_id for r in got] == [i for _, i in want]
    assert all(abs(r.score + s) < 1e-9 for r, (s, _) in zip(got, want, strict=True))


def test_filters_recency_and_stored_columns(spark):
    rows = [(i, "fruit food", "fruit is good food", 20240100 + i if i < 5 else None, 10 * i) for i in range(1, 6)]
    index = build(spark, rows)
    assert sorted(ids(search(index, "fruit", 10, OR, NumericFilter(20240102, 20240104)))) == [2, 3, 4]
    assert ids(search(index, "fruit", 10, OR, NumericFilter(uid=30))) == [3]
    assert sorted(ids(search(index, "fruit", 10, OR, NumericFilter(pubtime_hi=10)))) == [5]
    got = search(index, "fruit", 3, OR, NumericFilter(sort_by_pubtime=True), stored=["title"]).collect()
    assert [(r.doc_id, r.title) for r in got] == [(3, "fruit food"), (2, "fruit food"), (1, "fruit food")]


def test_dedup_by_ext_id_and_deletion(spark):
    rows = [(1, 1, "", "dupterm", 0, 0), (2, 999, "", "dupterm", 0, 0), (3, 999, "", "dupterm dupterm", 0, 0), (4, 0, "", "dupterm", 0, 0), (5, 0, "", "dupterm", 0, 0), (6, None, "", "dupterm", 0, 0)]
    index = indexing.build(spark.createDataFrame(rows, COLUMNS), S1, written=False)
    assert sorted(ids(search(index, "dupterm", 10, OR, dedup=True))) == [1, 3, 4, 5, 6]
    index.deleted = spark.createDataFrame([(3,), (4,)], "doc_id bigint")
    assert sorted(ids(search(index, "dupterm", 10, OR, dedup=True))) == [1, 2, 5, 6]


def test_nested_tree(spark):
    rows = [(i, "", " ".join(w for w, k in (("aa", 2), ("bb", 3), ("cc", 5), ("dd", 7)) if i % k == 0), 0, 0) for i in range(1, 211)]
    tree = Bool([(MUST, Bool([(SHOULD, Term("body", "aa")), (SHOULD, Term("body", "bb"))])), (MUST_NOT, Bool([(MUST, Term("body", "cc")), (MUST, Term("body", "dd"))])), (SHOULD, Term("body", "dd"))])
    assert sorted(ids(planner.matches(build(spark, rows), tree))) == [i for i in range(1, 211) if (i % 2 == 0 or i % 3 == 0) and i % 35]


def test_a_search_is_one_scan_and_one_shuffle_of_postings(spark, tmp_path):
    index = build(spark, [(i, "x", "python code", 0, 0) for i in range(50)])
    index.postings.write.parquet(str(tmp_path / "p"))
    indexing.term_dict(index.postings, index.stats).write.parquet(str(tmp_path / "d"))
    index.postings, index.dictionary = spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "d"))
    index.stats = spark.createDataFrame(index.stats.collect(), index.stats.schema)
    plan = planner.matches(index, parse("+python -java code", ["body"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan or "PushedFilters: [IsNotNull" in plan
    assert plan.count("/p]") == 1 and plan.count("/d]") == 1
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 == plan.count("Exchange hashpartitioning")


def test_numeric_filters_reach_the_scan(spark, tmp_path):
    build(spark, [(i, "x", "python", i, i % 3) for i in range(20)]).docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for numeric, pushed in ((NumericFilter(5, 9), "GreaterThanOrEqual(pubtime,5), LessThanOrEqual(pubtime,9)"), (NumericFilter(uid=2), "EqualTo(uid,2)"), (NumericFilter(ranges=(("uid", None, 1),)), "Or(LessThanOrEqual(uid,1),IsNull(uid))")):
        assert pushed in docs.where(numeric.condition())._jdf.queryExecution().executedPlan().toString()


def test_pruned_search_equals_unpruned_and_adds_up_less(spark):
    rng = random.Random(8)
    rows = [(i, "", " ".join(["common"] * rng.randrange(1, 4) + ["often"] * (rng.random() < 0.6) + ["rare"] * (3 * (rng.random() < 0.1)) + ["filler"] * rng.randrange(9)), 0, 0) for i in range(1, 401)]
    index = build(spark, rows)
    for text, k in (("common often rare", 10), ("common rare rare", 5), ("often common", 400), ("rare missing", 3), ("common", 7)):
        tree = parse(text, ["body"], OR)
        full = {r.doc_id: r.score for r in planner.matches(index, tree).collect()}
        want = sorted(((-s, d) for d, s in full.items()))[:k]
        got = search(index, text, k, OR, fields=["body"]).collect()
        assert [r.doc_id for r in got] == [d for _, d in want] and all(abs(r.score + s) < 1e-9 for r, (s, _) in zip(got, want, strict=True))
    assert planner.pruned(index, list(parse("common often rare", ["body"], OR).terms()), 10).count() < 100
