import random

from pyspark.sql import functions as F

from quern.operators import chunks

POSTINGS = "segment_id int, field string, term string, doc_id bigint"


def test_rows_are_numbered_without_gaps_in_order(spark):
    data = [(random.Random(i).randrange(7), i) for i in range(500)]
    got = chunks.number_rows(spark.createDataFrame(data, "k int, v int"), ["k", "v"], 64).orderBy("_row").collect()
    assert [(r.k, r.v) for r in got] == sorted(data)
    assert [r._row for r in got] == list(range(500))
    assert [r._chunk for r in got] == [i // 64 for i in range(500)]


def test_a_key_with_most_rows_is_split_and_merged(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}", rng.randrange(400)) for _ in range(3000)]
    data += [("copies", 5)] * 1500
    got = {r.k: r for r in chunks.per_key(spark.createDataFrame(data, "k string, v int"), ["k"], "v", 50).collect()}
    for k in {k for k, _ in data}:
        mine = [v for key, v in data if key == k]
        assert (got[k].rows, got[k].items, got[k].first_item, got[k].last_item) == (len(mine), len(set(mine)), min(mine), max(mine))
    assert got["hot"].chunks > 5 and len(got) == len({k for k, _ in data})


def test_nulls_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, 1), (None, 3, 1), ("a", None, 1), ("a", None, 2)], "k string, v int, _row int")
    got = {r.k: (r.rows, r["items"], r.first_item) for r in chunks.per_key(df, ["k"], "v", 1).collect()}
    assert got == {None: (2, 1, 3), "a": (2, 0, None)}
    assert chunks.per_key(df.limit(0), ["k"], "v").collect() == []


def test_wrong_statistics(spark):
    posts = spark.createDataFrame([(1, "body", "x", 1), (1, "body", "x", 1), (1, "body", "x", 2), (1, "body", "y", 2), (1, "body", "", 2), (1, "body", None, 2)], POSTINGS)
    terms = spark.createDataFrame([(1, "body", "x", 2), (1, "body", "y", 3), (1, "body", "z", None), (1, "body", "z", None), (1, "body", "w", 0)], "segment_id int, field string, term string, doc_freq bigint")
    segs = spark.createDataFrame([(1, 2, "x"), (2, 5, "q"), (3, 0, None)], "segment_id int, max_pl_df bigint, max_pl_term string")
    got = {tuple(r) for r in chunks.wrong_statistics(posts, terms, segs, 2).collect()}
    assert got == {(1, "body", "y"), (1, "body", "z"), (2, "*", "q")}
    assert chunks.wrong_statistics(posts.limit(0), terms.limit(0), segs.limit(0)).count() == 0


def test_places_in_keys_of_which_one_holds_half(spark):
    rows = [("hot", i) for i in range(600)] + [(f"k{i % 40}", i) for i in range(599)] + [(None, 3), (None, 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    placed = chunks.place_in_key(df, ["k"], "v")
    want = {(k, v): sorted(x for y, x in rows if y == k).index(v) for k, v in rows}
    assert {(r.k, r.v): r._place for r in placed.collect()} == want
    sizes = [r[0] for r in placed.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 600
    assert chunks.place_in_key(df.limit(0), ["k"], "v").count() == 0
