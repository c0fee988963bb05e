import json
from concurrent.futures import ThreadPoolExecutor

from quern.operators import compaction
from quern.plans.planner import search
from quern.plans.query import OR
from quern.schema import Field, Schema
from quern.sources import jsonl
from quern.sources.store import Store
from quern.streaming.ingest import COMMITTED, Ingest

S5 = Schema((Field("title", "text", "freqs_positions", stored=True), Field("body", "text", "freqs_positions")))
COLUMNS = "doc_id bigint, ext_id bigint, title string, body string"


def docs(spark, ids, body="python tutorial data science machine learning"):
    return spark.createDataFrame([(i, i, f"Doc {i}", f"{body} {'' if i % 2 else 'extra'}") for i in ids], COLUMNS)


def hits(index, text, k=100):
    return sorted(r.doc_id for r in search(index, text, k, OR, fields=["body"]).collect())


def test_segments_delete_merge_verify(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", S5)
    assert store.segment_ids() == []
    first, second = store.add(docs(spark, range(1, 11))), store.add(docs(spark, range(11, 21)))
    assert store.add(docs(spark, [])) is None
    assert (first, second) == (0, 1) and hits(store.snapshot(), "python") == list(range(1, 21))
    dead = spark.createDataFrame([(0, 5), (0, 10), (1, 15), (1, 15), (1, 999)], "segment_id int, doc_id bigint")
    assert store.delete(dead) == 3 and store.delete(dead) == 0
    before = hits(store.snapshot(), "python")
    assert before == [i for i in range(1, 21) if i % 5 or i == 20]
    assert store.verify().count() == 0
    assert store.merge("tiered", 5) is None
    assert store.merge("force") == 2 and store.segment_ids() == [2]
    again = Store(spark, f"file://{tmp_path}/store")
    assert again.schema == S5 and hits(again.snapshot(), "python") == before
    assert again.snapshot().stats.first().n_docs == 17 and again.verify().count() == 0
    assert again.merge("force", renumber=True) == 3
    assert hits(again.snapshot(), "python") == list(range(1, 18))


def test_partition_of_the_build_does_not_matter(spark, tmp_path):
    one, many = Store(spark, f"file://{tmp_path}/one", S5), Store(spark, f"file://{tmp_path}/many", S5)
    one.add(docs(spark, range(1, 31)))
    for i in range(1, 31, 10):
        many.add(docs(spark, range(i, i + 10)))
    rows = lambda s: sorted(map(tuple, s.snapshot().dictionary.select("field", "term", "df", "ttf").collect()))
    assert rows(one) == rows(many)


def test_remap_is_dense(spark):
    rows = spark.createDataFrame([(s, d) for s in (2, 1) for d in range(5)], "segment_id int, doc_id bigint")
    got = compaction.remap(rows, rows.where("doc_id = 3")).orderBy("new_id").collect()
    assert [(r.segment_id, r.doc_id, r.new_id) for r in got] == [(s, d, 4 * (s - 1) + k + 1) for s in (1, 2) for k, d in enumerate((0, 1, 2, 4))]
    assert compaction.to_merge("force", {1: 5, 2: 7}) == {1, 2} and compaction.to_merge("tiered", {1: 5, 2: 7}) == set()
    assert compaction.to_merge("tiered", {0: 900, 1: 5, 2: 7, 3: 20}, 3) == {1, 2} and compaction.to_merge("tiered", {0: 11, 1: 5, 2: 7, 3: 20}, 3) == {0, 1, 2, 3}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Four writers add, delete and publish together; every segment and tombstone is there."""
    store = Store(spark, f"file://{tmp_path}/store", S5)
    store.add(docs(spark, range(1, 11)))

    def write(k):
        mine = Store(spark, f"file://{tmp_path}/store", S5)
        number = mine.add(docs(spark, range(100 * k, 100 * k + 10)))
        mine.delete(spark.createDataFrame([(0, k)], "segment_id int, doc_id bigint"))
        return number

    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(write, range(1, 5)))
    assert sorted([0, *numbers]) == store.segment_ids() == list(range(5))
    assert hits(store.snapshot(), "python") == sorted([*range(5, 11), *(100 * k + i for k in range(1, 5) for i in range(10))])


def test_a_merge_leaves_readers_and_the_newly_dead_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", S5)
    for i in range(4):
        store.add(docs(spark, range(10 * i, 10 * i + 10)))
    before = store.snapshot()
    real, calls = store._lengths, []

    def late(where):  # another writer deletes and adds while the merge runs
        real(where)
        if not calls:
            calls.append(1)
            other = Store(spark, f"file://{tmp_path}/store")
            other.delete(spark.createDataFrame([(1, 15)], "segment_id int, doc_id bigint"))
            other.add(docs(spark, [77]))

    store._lengths = late
    assert store.merge("force") is not None
    want = [i for i in range(40) if i != 15] + [77]
    assert hits(store.snapshot(), "python") == want and len(store.segment_ids()) == 1
    assert hits(before, "python") == list(range(40)) and store.vacuum() == 0
    assert store.vacuum(retain=-1) > 0 and hits(store.snapshot(), "python") == want and store.verify().count() == 0


def test_stream_equals_batch(spark, tmp_path):
    docs(spark, range(1, 31), "gapterm visibility content").repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/store", S5)
    ingest = Ingest(store, f"{tmp_path}/checkpoint", most_segments=3, trigger={"availableNow": True})
    ingest.start(stream).awaitTermination()
    assert hits(store.snapshot(), "gapterm") == list(range(1, 31))
    assert len(store.segment_ids()) <= 3 and all(s.states[-1][0] == COMMITTED for s in ingest.stats)
    count = len(ingest.stats)
    ingest._batch(docs(spark, [99]), ingest.stats[0].batch_id)  # the same batch again
    assert len(ingest.stats) == count + 1 and hits(store.snapshot(), "gapterm") == list(range(1, 31))


def test_jsonl(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    lines = [{"id": "12", "title": "T", "text": 'say "hi"\n', "url": "u", "pubtime": 5, "tags": ["x", "", "y"]}, {"id": "x", "title": "", "text": "", "pubtime": "7"}, {"title": "only", "pubtime": "bad"}]
    (tmp_path / "a" / "b" / "f.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    schema = Schema((Field("title", "text", "freqs_only"), Field("body", "text", "freqs_only"), Field("source", "keyword"), Field("pubtime", "int64"), Field("rank", "float32"), Field("tags", "keyword", multi=True)))
    got = jsonl.documents(jsonl.read_lines(spark, str(tmp_path)), schema)
    rows = sorted((r.ext_id, r.title, r.body, r.source, r.pubtime, r.rank, tuple(r.tags)) for r in got.collect())
    assert rows == [(0, "", "", "", 7, 0.0, ()), (0, "only", "", "", 0, 0.0, ()), (12, "T", 'say "hi"\n', "u", 5, 0.0, ("x", "", "y"))]
    assert jsonl.with_content(got, schema).count() == 2
    assert jsonl.synthetic(spark, 20).count() == 20
