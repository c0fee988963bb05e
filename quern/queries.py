"""The queries of the driver contract and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import analysis
from quern.operators import chunks, compaction, indexing, inspect, stats
from quern.operators.indexing import Index
from quern.plans import planner
from quern.plans.planner import NumericFilter, search
from quern.plans.query import AND, MUST, MUST_NOT, OR, SHOULD, Bool, Term
from quern.runtime import shared_dir
from quern.schema import Field, Schema
from quern.sources import jsonl
from quern.sources.registry import Readers
from quern.sources.store import Store
from quern.streaming.ingest import Ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_TRUE_DF = """
SELECT segment_id, field, term, count(DISTINCT doc_id) AS doc_freq
FROM postings WHERE term IS NOT NULL AND term <> '' GROUP BY 1, 2, 3"""


@query(f"""
WITH d AS ({_TRUE_DF}), m AS (SELECT segment_id, max(doc_freq) AS top FROM d GROUP BY 1)
SELECT DISTINCT t.segment_id, t.field, t.term FROM term_dict t
LEFT JOIN d ON t.segment_id = d.segment_id AND t.field = d.field AND t.term = d.term
WHERE t.doc_freq IS DISTINCT FROM coalesce(d.doc_freq, 0)
UNION
SELECT DISTINCT s.segment_id, '*', s.max_pl_term FROM segment_stats s LEFT JOIN m ON s.segment_id = m.segment_id
WHERE s.max_pl_df IS DISTINCT FROM coalesce(m.top, 0)""")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.wrong_statistics(table(spark, sf, "postings"), table(spark, sf, "term_dict"), table(spark, sf, "segment_stats"))


@query(_TRUE_DF)
def p3_doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.true_doc_freq(table(spark, sf, "postings"))


@query(f"SELECT segment_id, max(doc_freq) AS max_pl_df, min(term) FILTER (doc_freq = top) AS max_pl_term FROM (SELECT *, max(doc_freq) OVER (PARTITION BY segment_id) AS top FROM ({_TRUE_DF})) GROUP BY 1")
def p3_max_pl_df(spark: SparkSession, sf: str) -> DataFrame:
    """Ties go to the smallest term."""
    top = chunks.true_doc_freq(table(spark, sf, "postings")).groupBy("segment_id", "doc_freq").agg(F.min("term").alias("term"))
    return top.groupBy("segment_id").agg(F.max("doc_freq").alias("max_pl_df"), F.max_by("term", "doc_freq").alias("max_pl_term"))


# Search: documents are indexed by body alone, stored_docs by title, body, category and source.

BODY = Schema((Field("body", "text", "freqs_positions"),))
NEWS = Schema(
    (
        Field("title", "text", "freqs_positions", stored=True),
        Field("body", "text", "freqs_positions"),
        Field("category", "keyword", "freqs_only", stored=True),
        Field("source", "keyword", "docs_only", stored=True),
        Field("pubtime", "int64", fast=True),
        Field("uid", "int64", fast=True),
        Field("page_rank", "float32", fast=True),
    )
)
_built: dict[tuple[str, str, str], Index] = {}


def _body_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumnRenamed("text", "body")


def _news_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "stored_docs").distinct()


def _index(spark: SparkSession, sf: str, which: str) -> Index:
    """The index of a folder's documents, built once for a session and then searched."""
    at = (spark.sparkContext.applicationId, sf, which)
    if at not in _built:
        _built[at] = indexing.build(_body_docs(spark, sf), BODY) if which == "body" else indexing.build(_news_docs(spark, sf), NEWS)
    return _built[at]


def _ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


def _sql_tokens(source: str, fields: dict[str, tuple[str, bool]]) -> str:
    """CTEs d (documents), t (doc_id, field, term, pos, dl), p (postings), s (field statistics), v (dictionary)."""
    parts = []
    for name, (column, analysed) in fields.items():
        words = analysis.sql_kept_words(column) if analysed else f"CASE WHEN coalesce({column}, '') <> '' THEN [{column}] ELSE [] END"
        term = analysis.sql_stem("w") if analysed else "w"
        parts.append(f"SELECT doc_id, '{name}' AS field, {term} AS term, pos, dl FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos, len(ws) AS dl FROM (SELECT doc_id, {words} AS ws FROM d))")
    return f"""WITH d AS ({source}), t AS ({" UNION ALL ".join(parts)}),
p AS (SELECT field, term, doc_id, count(*) AS tf, max(dl) AS dl FROM t GROUP BY 1, 2, 3),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
s AS (SELECT field, n, CAST(count(*) AS DOUBLE) / n AS avgdl, count(*) AS sum_len FROM t, n GROUP BY field, n),
v AS (SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ttf, max({_sql_norm()}) AS bound FROM p JOIN s USING (field) GROUP BY 1, 2),
b AS (SELECT p.field, p.term, p.doc_id, {_sql_norm()} * {_sql_idf()} AS s, {_sql_norm(0.0)} * {_sql_idf()} AS s0 FROM p JOIN s USING (field) JOIN v ON p.field = v.field AND p.term = v.term)
"""


def _sql_norm(b: float = 0.75) -> str:
    t = "CAST(least(tf, 255) AS DOUBLE)"
    return f"{t} * 2.2::DOUBLE / ({t} + 1.2::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * least(dl, 65535) / avgdl))"


def _sql_idf() -> str:
    return "ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"


_BODY_SQL = _sql_tokens("SELECT doc_id, text AS body, source FROM documents", {"body": ("body", True)})
_NEWS_SQL = _sql_tokens("SELECT DISTINCT * FROM stored_docs", {"title": ("title", True), "body": ("body", True), "category": ("category", False), "source": ("source", False)})


def _sql_or(terms: list[tuple[str, str]], k: int, more: str = "", s: str = "s") -> str:
    """Sum over clauses, repeated ones counting again."""
    values = ", ".join(f"('{f}', '{t}')" for f, t in terms)
    return f"SELECT b.doc_id, round(sum({s}), 6) AS score FROM b JOIN (VALUES {values}) q(f, w) ON b.field = q.f AND b.term = q.w {more} GROUP BY 1 ORDER BY sum({s}) DESC, 1 LIMIT {k}"


@query(_BODY_SQL + "SELECT doc_id, term, CAST(pos AS INT) AS pos FROM t")
def analyze_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.tokens(_body_docs(spark, sf), BODY).select("doc_id", "term", "pos")


@query(f"""WITH w AS (SELECT unnest(string_split_regex(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')), ' +')) AS w FROM documents)
SELECT w AS word, count(*) AS n FROM w WHERE w IN ({", ".join(f"'{w}'" for w in analysis.STOP_WORDS)}) GROUP BY 1""")
def stop_filter_counts(spark: SparkSession, sf: str) -> DataFrame:
    words = F.explode(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z]", " ")), " +")).alias("word")
    return table(spark, sf, "documents").select(words).where(F.col("word").isin(analysis.STOP_WORDS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(_BODY_SQL + "SELECT length(term) AS term_length, count(*) AS n, count(DISTINCT term) AS terms FROM t GROUP BY 1")
def stem_distribution(spark: SparkSession, sf: str) -> DataFrame:
    counts = indexing.tokens(_body_docs(spark, sf), BODY).groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(F.length("term").cast("bigint").alias("term_length")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("terms"))


@query(_NEWS_SQL + "SELECT field, term, CAST(df AS BIGINT) AS df FROM v WHERE field IN ('category', 'source')")
def keyword_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf, "news").dictionary.where(F.col("field").isin("category", "source")).select("field", "term", "df")


_TAGS = "list_filter([lang, category, source], lambda x: x IS NOT NULL AND x <> '')"


@query(f"SELECT doc_id, unnest({_TAGS}) AS term, CAST(generate_subscripts({_TAGS}, 1) - 1 AS INT) AS pos FROM documents")
def multi_value_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.array("lang", "category", "source").alias("tags"))
    return indexing.tokens(docs, Schema((Field("tags", "keyword", "freqs_only", multi=True),))).select("doc_id", "term", "pos")


@query(_sql_tokens("SELECT DISTINCT * FROM stored_docs", {"all": ("coalesce(title, '') || ' ' || coalesce(body, '')", True)}) + "SELECT term, df, ttf FROM v")
def combined_field_terms(spark: SparkSession, sf: str) -> DataFrame:
    schema = Schema((Field("title"), Field("body"), Field("all", "combined", "freqs_only", sources=("title", "body"))))
    posts = indexing.postings(indexing.tokens(_news_docs(spark, sf), schema))
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))


@query(_BODY_SQL + "SELECT doc_id, term, tf, dl FROM p")
def postings_tf(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.postings(indexing.tokens(_body_docs(spark, sf), BODY)).select("doc_id", "term", "tf", F.col("dl").cast("bigint").alias("dl"))


@query(_BODY_SQL + "SELECT term, df, ttf FROM v")
def term_df_ttf(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf, "body").dictionary.select("term", "df", "ttf")


@query(_NEWS_SQL + "SELECT field, doc_id, CAST(max(dl) AS BIGINT) AS dl FROM t GROUP BY 1, 2")
def field_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.field_lengths(_news_docs(spark, sf), NEWS)


@query(_NEWS_SQL + "SELECT field, CAST(n AS BIGINT) AS n_docs, sum_len, round(avgdl, 6) AS avgdl FROM s")
def field_avgdl(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf, "news").stats.select("field", F.col("n_docs").cast("bigint").alias("n_docs"), "sum_len", F.round("avgdl", 6).alias("avgdl"))


@query(_NEWS_SQL + f"SELECT field, term, df, round({_sql_idf()}, 6) AS idf, round({_sql_idf()} * bound, 6) AS bound FROM v JOIN s USING (field)")
def idf_table(spark: SparkSession, sf: str) -> DataFrame:
    i = _index(spark, sf, "news")
    return stats.term_report(i.dictionary, i.stats).withColumns({"idf": F.round("idf", 6), "bound": F.round("bound", 6)})


@query(_BODY_SQL + _sql_or([("body", "engine")], 10))
def bm25_single_term(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_index(spark, sf, "body"), Term("body", "engine"), 10))


@query(_BODY_SQL + _sql_or([("body", analysis.stem_word(w)) for w in ("search", "index", "query", "ranker")], 10))
def bm25_or_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_index(spark, sf, "body"), "search index query ranker", 10, OR))


def _sql_all(terms: list[str], k: int, without: list[str] = []) -> str:  # noqa: B006
    names = ", ".join(f"'{t}'" for t in terms)
    exclude = f"AND doc_id NOT IN (SELECT doc_id FROM b WHERE field = 'body' AND term IN ({', '.join(repr(analysis.stem_word(w)) for w in without)}))" if without else ""
    return f"SELECT doc_id, round(sum(s), 6) AS score FROM b WHERE field = 'body' AND term IN ({names}) {exclude} GROUP BY 1 HAVING count(*) = {len(terms)} ORDER BY sum(s) DESC, 1 LIMIT {k}"


@query(_BODY_SQL + _sql_all(["query", "index"], 20))
def bm25_and(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_index(spark, sf, "body"), "query index", 20, AND))


@query(_BODY_SQL + _sql_all(["query"], 20, ["index"]))
def bm25_must_not(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_index(spark, sf, "body"), "+body:query -body:index", 20))


@query(_BODY_SQL + _sql_all(["query"], 20, ["index", "segment", "heap"]))
def bm25_multi_must_not(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_index(spark, sf, "body"), "+query -index -segment -heap", 20))


_NESTED = Bool([(MUST, Bool([(SHOULD, Term("body", "query")), (SHOULD, Term("body", "cache"))])), (MUST, Term("body", "index")), (MUST_NOT, Bool([(MUST, Term("body", "heap")), (MUST, Term("body", "label"))]))])


@query(_BODY_SQL + """, m AS (SELECT doc_id, max(s) FILTER (term = 'query') AS q, max(s) FILTER (term = 'cache') AS c, max(s) FILTER (term = 'index') AS i, max(s) FILTER (term = 'heap') AS h, max(s) FILTER (term = 'label') AS l FROM b GROUP BY 1)
SELECT doc_id, round(coalesce(q, 0) + coalesce(c, 0) + i, 6) AS score FROM m WHERE (q IS NOT NULL OR c IS NOT NULL) AND i IS NOT NULL AND NOT (h IS NOT NULL AND l IS NOT NULL)""")
def bm25_nested(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(planner.matches(_index(spark, sf, "body"), _NESTED))


@query(_NEWS_SQL + _sql_or([(f, t) for t in ("query", "index") for f in ("title", "body", "category", "source")], 15))
def bm25_multi_field_or(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_index(spark, sf, "news"), "query index", 15, OR))


@query(_NEWS_SQL + "SELECT doc_id, round(sum(s), 6) AS score FROM b WHERE field IN ('title', 'body') AND term IN ('query', 'index') GROUP BY 1 HAVING count(DISTINCT term) = 2 ORDER BY sum(s) DESC, 1 LIMIT 15")
def bm25_bare_and_any_field(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_index(spark, sf, "news"), "query index", 15, AND, fields=["title", "body"]))


@query(_BODY_SQL + _sql_or([("body", "query"), ("body", "query"), ("body", "index")], 10))
def bm25_duplicate_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_index(spark, sf, "body"), "query query index", 10, OR))


@query(_BODY_SQL + _sql_or([("body", "query"), ("body", "index")], 10, s="s0"))
def bm25_b0_legacy(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_index(spark, sf, "body"), "query index", 10, OR, b=0.0))


_RANGE = (1_650_000_000, 1_750_000_000)


@query(_NEWS_SQL + _sql_or([("body", "query"), ("body", "index")], 20, f"JOIN d ON d.doc_id = b.doc_id AND coalesce(d.pubtime, 0) BETWEEN {_RANGE[0]} AND {_RANGE[1]}"))
def filter_range(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_index(spark, sf, "news"), "query index", 20, OR, NumericFilter(*_RANGE), fields=["body"]))


@query(_NEWS_SQL + _sql_or([("body", "query"), ("body", "index")], 20, "JOIN d ON d.doc_id = b.doc_id AND coalesce(d.uid, 0) = 7"))
def filter_equality(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_index(spark, sf, "news"), "query index", 20, OR, NumericFilter(uid=7), fields=["body"]))


@query(_NEWS_SQL + f", top AS ({_sql_or([('body', 'query'), ('body', 'index')], 20)}) SELECT doc_id, score, pubtime, row_number() OVER (ORDER BY coalesce(pubtime, 0) DESC, score DESC, doc_id) AS place FROM top JOIN d USING (doc_id)")
def filter_recency_sort(spark: SparkSession, sf: str) -> DataFrame:
    top = search(_index(spark, sf, "news"), "query index", 20, OR, NumericFilter(sort_by_pubtime=True), fields=["body"])
    # k rows
    return _ranked(top).withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.coalesce("pubtime", F.lit(0))), F.desc("score"), "doc_id")).cast("bigint"))


_EXT = "CASE WHEN coalesce(ext_id, 0) = 0 THEN 0 ELSE ext_id % 97 END"


@query(_NEWS_SQL + f""", f AS (SELECT b.doc_id, sum(s) AS s, any_value({_EXT}) AS e FROM b JOIN d USING (doc_id) WHERE field = 'body' AND term IN ('query', 'index') GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY s DESC, doc_id) AS r FROM f)
SELECT doc_id, round(s, 6) AS score FROM r WHERE e = 0 OR r = 1 ORDER BY s DESC, 1 LIMIT 25""")
def dedup_ext_id(spark: SparkSession, sf: str) -> DataFrame:
    """ext_id is folded to 97 values here, so that equal ones exist."""
    i = _index(spark, sf, "news")
    folded = Index(i.schema, i.docs.withColumn("ext_id", F.expr(_EXT)), i.postings, i.stats, i.dictionary)
    return _ranked(search(folded, "query index", 25, OR, dedup=True, fields=["body"]))


_DEAD = "uid < 50"


@query(_NEWS_SQL + _sql_or([("body", "query"), ("body", "index")], 20, f"JOIN d ON d.doc_id = b.doc_id AND NOT coalesce(d.{_DEAD}, false)"))
def soft_delete_search(spark: SparkSession, sf: str) -> DataFrame:
    """Deleted documents count in the statistics until a merge."""
    i = _index(spark, sf, "news")
    return _ranked(search(Index(i.schema, i.docs, i.postings, i.stats, i.dictionary, i.docs.where(_DEAD)), "query index", 20, OR, fields=["body"]))


_SEGMENTED = "SELECT DISTINCT segment_id, doc_id FROM postings WHERE doc_id IS NOT NULL"


@query(f"SELECT segment_id, doc_id, row_number() OVER (ORDER BY segment_id, doc_id) AS new_id FROM ({_SEGMENTED}) WHERE NOT (segment_id = 1 AND doc_id < 200)")
def compact_remap(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "postings").where("doc_id is not null").select("segment_id", "doc_id").distinct()
    return compaction.remap(docs, docs.where("segment_id = 1 and doc_id < 200"))


@query(f"""WITH d AS ({_SEGMENTED}), p AS (SELECT DISTINCT segment_id, field, term, doc_id FROM postings WHERE term IS NOT NULL AND term <> '' AND doc_id IS NOT NULL),
l AS (SELECT segment_id, field, term, count(*) AS df FROM p GROUP BY 1, 2, 3), c AS (SELECT segment_id, count(*) AS doc_count FROM d GROUP BY 1)
SELECT segment_id, any_value(doc_count) AS doc_count, count(*) AS term_count, CAST(sum(df) AS BIGINT) AS total_pl_entries, round(avg(df), 6) AS avg_pl_df, max(df) AS max_pl_df, arg_min(term, (-df, term)) AS max_pl_term, CAST(sum((df + 127) // 128) AS BIGINT) AS skip_nodes FROM l JOIN c USING (segment_id) GROUP BY 1""")
def segment_union_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "postings").where("doc_id is not null")
    posts = rows.where("term is not null and term <> ''").select("segment_id", "field", "term", "doc_id").distinct()
    return stats.segment_stats(posts, rows.select("segment_id", "doc_id").distinct()).withColumn("avg_pl_df", F.round("avg_pl_df", 6))


@query(_BODY_SQL + "SELECT v.field, v.term, v.df, v.ttf, (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM p WHERE p.term = v.term ORDER BY doc_id LIMIT 15)) AS sample FROM v ORDER BY df DESC, field, term LIMIT 20")
def top_terms_by_df(spark: SparkSession, sf: str) -> DataFrame:
    i = _index(spark, sf, "body")
    return stats.top_terms(i.postings, i.dictionary, 20).withColumn("sample", F.concat_ws(",", F.col("sample").cast("array<string>")))


@query(_BODY_SQL + """, k AS (SELECT CASE WHEN df < 10 THEN '1-9' WHEN df < 100 THEN '10-99' WHEN df < 1000 THEN '100-999' ELSE '1000+' END AS bucket, field, term, df FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY df DESC, field, term) AS rank FROM k) SELECT bucket, CAST(rank AS INT) AS rank, field, term, df FROM r WHERE rank <= 10""")
def df_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return stats.df_buckets(_index(spark, sf, "body").dictionary, 10)


@query(_NEWS_SQL + "SELECT term, CAST(sum(ttf) AS BIGINT) AS ttf, max(df) AS df, round(max(bound), 6) AS max_tf_norm FROM v GROUP BY 1")
def cross_field_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cross_field(_index(spark, sf, "news").dictionary).withColumn("max_tf_norm", F.round("max_tf_norm", 6))


@query(_BODY_SQL + "SELECT term, round(bound, 6) AS max_tf_norm FROM v")
def term_upper_bound(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf, "body").dictionary.select("term", F.round("max_tf_norm", 6).alias("max_tf_norm"))


_BLOCKS = f", k AS (SELECT p.term, doc_id, {_sql_norm()} AS norm, (row_number() OVER (PARTITION BY p.term ORDER BY doc_id) - 1) // 128 AS block FROM p JOIN s USING (field)), g AS (SELECT term, CAST(block AS INT) AS block, max(doc_id) AS max_doc_id, max(norm) AS bound, count(*) AS docs FROM k GROUP BY 1, 2)"


@query(_BODY_SQL + _BLOCKS + " SELECT term, block, max_doc_id, round(bound, 6) AS max_tf_norm, docs FROM g")
def block_upper_bound(spark: SparkSession, sf: str) -> DataFrame:
    i = _index(spark, sf, "body")
    return indexing.block_bounds(i.postings, i.stats).select("term", "block", "max_doc_id", F.round("max_tf_norm", 6).alias("max_tf_norm"), "docs")


@query(_BODY_SQL + _BLOCKS + " SELECT term, count(*) AS blocks, CAST(sum(docs) AS BIGINT) AS docs, round(min(bound), 6) AS min_bound, round(avg(bound), 6) AS avg_bound, round(max(bound), 6) AS max_bound FROM g GROUP BY 1")
def skip_summary(spark: SparkSession, sf: str) -> DataFrame:
    i = _index(spark, sf, "body")
    out = stats.skip_summary(indexing.block_bounds(i.postings, i.stats))
    return out.select("term", "blocks", "docs", *[F.round(c, 6).alias(c) for c in ("min_bound", "avg_bound", "max_bound")])


@query(_BODY_SQL + _BLOCKS + " SELECT term, min(block) AS block FROM g WHERE max_doc_id >= 500 GROUP BY 1")
def skip_find(spark: SparkSession, sf: str) -> DataFrame:
    i = _index(spark, sf, "body")
    return stats.skip_find(indexing.block_bounds(i.postings, i.stats), 500).select("term", "block")


@query(_BODY_SQL + """, k AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS i FROM p)
SELECT term, CAST(i AS INT) AS i, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, i // 128 ORDER BY i), 0) AS delta FROM k""")
def delta_encode(spark: SparkSession, sf: str) -> DataFrame:
    return stats.deltas(_index(spark, sf, "body").postings).select("term", "i", "delta")


@query(_BODY_SQL + "SELECT term, doc_id FROM p")
def delta_encode_decode(spark: SparkSession, sf: str) -> DataFrame:
    return stats.undelta(stats.deltas(_index(spark, sf, "body").postings)).select("term", "doc_id")


@query(_BODY_SQL + "SELECT doc_id, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM t WHERE term = 'engine' GROUP BY 1")
def position_lists(spark: SparkSession, sf: str) -> DataFrame:
    mine = indexing.tokens(_body_docs(spark, sf), BODY).where("term = 'engine'")
    return indexing.postings(mine, positions=True).select("doc_id", "tf", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"))


@query(_NEWS_SQL + ", w AS (SELECT doc_id, max(dl) AS base FROM t WHERE field = 'title' GROUP BY 1) SELECT t.doc_id, count(*) AS tf, string_agg(pos + CASE WHEN field = 'title' THEN 0 ELSE coalesce(base, 0) END, ',' ORDER BY pos + CASE WHEN field = 'title' THEN 0 ELSE coalesce(base, 0) END) AS positions FROM t LEFT JOIN w USING (doc_id) WHERE term = 'index' AND field IN ('title', 'body') GROUP BY 1")
def position_merge_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Positions run on from title to body."""
    merged = inspect.merged_positions(indexing.tokens(_news_docs(spark, sf), NEWS, document_positions=True), "index", ["title", "body"])
    return merged.select("doc_id", "tf", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"))


@query(_BODY_SQL + "SELECT doc_id, tf FROM p WHERE term = 'index' AND doc_id >= 400")
def posting_range_seek(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.read_postings(_index(spark, sf, "body"), "index", "body", since=400).select("doc_id", "tf")


@query(_NEWS_SQL + "SELECT doc_id FROM p WHERE term = 'index' AND field = (SELECT CASE WHEN count(*) FILTER (field = 'title') > 0 THEN 'title' ELSE 'body' END FROM p WHERE term = 'index')")
def posting_full_read(spark: SparkSession, sf: str) -> DataFrame:
    """A bare term is read in the first field that has it."""
    return inspect.read_postings(_index(spark, sf, "news"), "index").select("doc_id")


@query(_NEWS_SQL + "SELECT field, term, df, ttf FROM v WHERE term = 'index'")
def term_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.lookup(_index(spark, sf, "news").dictionary, "index").select("field", "term", "df", "ttf")


@query(_NEWS_SQL + "SELECT field, term, df FROM v ORDER BY field, term LIMIT 40")
def first_terms(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.first_terms(_index(spark, sf, "news").dictionary, 40).select("field", "term", "df")


@query(_NEWS_SQL + "SELECT field, count(*) AS terms, CAST(sum(df) AS BIGINT) AS entries FROM v GROUP BY 1")
def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.term_counts(_index(spark, sf, "news").dictionary)


@query(_NEWS_SQL + "SELECT field, round(sum(s), 6) AS score FROM b WHERE doc_id = (SELECT min(doc_id) FROM p WHERE term = 'index' AND field = 'title') AND term IN ('index', 'query', 'cache') GROUP BY 1")
def document_field_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The first document with the term in its title, field by field."""
    i = _index(spark, sf, "news")
    # One row.
    first = inspect.read_postings(i, "index", "title").agg(F.min("doc_id")).first()[0]
    return inspect.document_scores(i, first, ["index", "query", "cache"]).withColumn("score", F.round("score", 6))


@query(_NEWS_SQL + f"SELECT field, term, round({_sql_norm().replace('tf', 'ttf').replace('least(dl', 'least(1')}, 6) AS bound FROM v JOIN s USING (field)")
def growing_term_bounds(spark: SparkSession, sf: str) -> DataFrame:
    i = _index(spark, sf, "news")
    return inspect.loose_bounds(i.dictionary, i.stats).withColumn("bound", F.round("bound", 6))


@query("""WITH p AS (SELECT segment_id, field, term, doc_id, max(coalesce(tf, 1)) AS tf FROM postings WHERE term IS NOT NULL AND term <> '' AND doc_id IS NOT NULL GROUP BY 1, 2, 3, 4),
l AS (SELECT segment_id, field, term, count(*) AS df, sum(tf) AS ttf FROM p GROUP BY 1, 2, 3)
SELECT segment_id, field, count(*) AS term_count, CAST(sum(df) AS BIGINT) AS entries, CAST(sum(ttf) AS BIGINT) AS occurrences, round(avg(df), 6) AS avg_df, max(df) AS max_df, arg_min(term, (-df, term)) AS max_term, CAST(sum((df + 127) // 128) AS BIGINT) AS skip_nodes FROM l GROUP BY 1, 2""")
def field_build_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "postings").where("term is not null and term <> '' and doc_id is not null")
    posts = rows.groupBy("segment_id", "field", "term", "doc_id").agg(F.max(F.coalesce("tf", F.lit(1))).alias("tf"))
    return inspect.field_build_stats(posts).withColumn("avg_df", F.round("avg_df", 6))


@query("SELECT DISTINCT doc_id FROM stored_docs WHERE coalesce(page_rank, 0) BETWEEN 0.25 AND 2.5")
def filter_fast_field(spark: SparkSession, sf: str) -> DataFrame:
    return planner.filter_docs(_index(spark, sf, "news"), "page_rank", 0.25, 2.5)


@query(_NEWS_SQL + _sql_or([("body", "query"), ("body", "index")], 20, "JOIN d ON d.doc_id = b.doc_id AND coalesce(d.page_rank, 0) <= 0.5 AND coalesce(d.uid, 0) >= 3"))
def filter_generic_ranges(spark: SparkSession, sf: str) -> DataFrame:
    ranges = (("page_rank", None, 0.5), ("uid", 3, None))
    return _ranked(search(_index(spark, sf, "news"), "query index", 20, OR, NumericFilter(ranges=ranges), fields=["body"]))


@query("SELECT v AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest([category, source]) AS v FROM stored_docs) WHERE v IS NOT NULL AND v <> '' GROUP BY 1")
def combined_keyword_terms(spark: SparkSession, sf: str) -> DataFrame:
    schema = Schema((Field("category", "keyword"), Field("source", "keyword"), Field("tags", "combined", "docs_only", sources=("category", "source"), verbatim=True)))
    return indexing.postings(indexing.tokens(_news_docs(spark, sf), schema)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("SELECT DISTINCT doc_id FROM (SELECT DISTINCT * FROM stored_docs ORDER BY doc_id LIMIT 300)")
def ingest_limit(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.first(_news_docs(spark, sf), 300, "doc_id").select("doc_id")


@query(_NEWS_SQL + f""", top AS ({_sql_or([('body', 'query')], 10)}) SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, coalesce(ext_id, 0) AS ext_id, printf('%.4f', score) AS score,
left(coalesce(title, ''), 30) AS title, left(coalesce(source, ''), 50) AS source FROM top JOIN d USING (doc_id)""")
def printed_results(spark: SparkSession, sf: str) -> DataFrame:
    i = _index(spark, sf, "news")
    return inspect.printed(_ranked(search(i, "body:query", 10)), i.docs)


@query(_NEWS_SQL + f", top AS ({_sql_or([('body', 'query')], 10)}) SELECT doc_id, score, ext_id, title, source FROM top JOIN d USING (doc_id)")
def stored_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_index(spark, sf, "news"), "body:query", 10, stored=["ext_id", "title", "source"]))


@query(_NEWS_SQL + "SELECT (SELECT count(*) FROM d) AS docs, count(*) AS terms, count(DISTINCT term) AS unique_terms, CAST(sum(ttf) AS BIGINT) AS total_terms FROM v")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    i = _index(spark, sf, "news")
    return stats.index_stats(i.docs, i.dictionary)


@query(f"SELECT segment_id, count(*) AS total, count(*) FILTER (doc_id % 7 <> 0) AS alive, count(*) FILTER (doc_id % 7 = 0) AS deleted FROM ({_SEGMENTED}) GROUP BY 1")
def segment_liveness(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "postings").where("doc_id is not null").select("segment_id", "doc_id").distinct()
    return stats.liveness(docs, docs.where("doc_id % 7 = 0"))


@query("""SELECT event_id AS ext_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CAST(coalesce(value, 0) AS FLOAT) AS value, CAST(0 AS FLOAT) AS absent, 0::BIGINT AS kind FROM events""")
def json_extract_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers from JSON: a quoted integer, a float, a key that is absent and one that holds no number."""
    lines = table(spark, sf, "events").select("props", F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), "value", F.col("event_type").alias("kind"))).alias("line"))
    return lines.select(jsonl.number("line", "id", "bigint").alias("ext_id"), jsonl.number("props", "k", "bigint").alias("k"), *[jsonl.number("line", c, t).alias(c) for c, t in (("value", "float"), ("absent", "float"), ("kind", "bigint"))])


_GATED = Schema((Field("category", "keyword", "freqs_only"), Field("title", "text", "freqs_only")))


@query("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN title END AS title, category FROM (SELECT DISTINCT * FROM stored_docs)) WHERE coalesce(title, '') <> '' OR coalesce(category, '') <> ''")
def content_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Titles are blanked for two thirds here, so that documents without content exist."""
    docs = _news_docs(spark, sf).withColumn("title", F.when(F.col("doc_id") % 3 == 0, F.col("title")))
    return jsonl.with_content(docs, _GATED).select("doc_id")


@query(f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]+'),
lambda w: CASE WHEN w SIMILAR TO '[A-Za-z]+' AND {analysis.sql_stem("lower(w)")} = 'engine' THEN '[' || w || ']' ELSE w END), '') AS text FROM documents""")
def highlight_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.coalesce(analysis.highlight(F.col("text"), ["engine"]), F.lit("")).alias("text"))


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


@query(_NEWS_SQL + _sql_or([("body", "query"), ("body", "index")], 10))
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """All stored documents through the streaming ingest into a store, then a search there."""
    base = _fresh(spark, "stream")
    _news_docs(spark, sf).repartition(4).write.parquet(f"{base}/in")
    store = Store(spark, f"{base}/store", NEWS)
    source = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    ingest = Ingest(store, f"{base}/checkpoint", trigger={"availableNow": True})
    ingest.start(source).awaitTermination()
    return _ranked(search(store.snapshot(), "query index", 10, OR, fields=["body"]))


@query(_NEWS_SQL + "SELECT field, term, df, ttf FROM v")
def parallel_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Four writers add a quarter of the documents each to one store at the same time; its dictionary."""
    where, docs = f"{_fresh(spark, 'parallel')}/store", _news_docs(spark, sf)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: Store(spark, where, NEWS).add(docs.where(F.pmod("doc_id", F.lit(4)) == k)), range(4)))
    return Store(spark, where).snapshot().dictionary.select("field", "term", "df", "ttf")


def _halves(spark: SparkSession, sf: str) -> Store:
    """A store of two segments, with tombstones for the documents of small uid."""
    store, docs = Store(spark, f"{_fresh(spark, 'halves')}/store", NEWS), _news_docs(spark, sf)
    for k in (0, 1):
        store.add(docs.where(F.pmod("doc_id", F.lit(2)) == k))
    store.delete(store.docs().where(_DEAD))
    return store


@query(_NEWS_SQL + _sql_or([("body", "query"), ("body", "index")], 20, f"JOIN d ON d.doc_id = b.doc_id AND NOT coalesce(d.{_DEAD}, false)"))
def store_tombstone_search(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search(_halves(spark, sf).snapshot(), "query index", 20, OR, fields=["body"]))


@query(_sql_tokens(f"SELECT DISTINCT * FROM stored_docs WHERE NOT coalesce({_DEAD}, false)", {"title": ("title", True), "body": ("body", True), "category": ("category", False), "source": ("source", False)}) + "SELECT field, term, df, ttf, round(bound, 6) AS max_tf_norm FROM v")
def store_delete_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary after a merge: the dead count no longer."""
    store = _halves(spark, sf)
    store.merge("force")
    return store.snapshot().dictionary.select("field", "term", "df", "ttf", F.round("max_tf_norm", 6).alias("max_tf_norm"))


@query("SELECT 0 AS wrong")
def store_verify(spark: SparkSession, sf: str) -> DataFrame:
    """A store after adds, deletions and a merge agrees with its documents."""
    store = _halves(spark, sf)
    store.merge("force")
    return store.verify().agg(F.count(F.lit(1)).cast("int").alias("wrong"))


@query(_NEWS_SQL + "SELECT field, term, df, ttf FROM v WHERE term IN ('query', 'index', 'tech')")
def readers_as_one(spark: SparkSession, sf: str) -> DataFrame:
    """Two readers attached to a registry, a third attached and detached again."""
    readers, docs = Readers(), _news_docs(spark, sf)
    for k in range(3):
        readers.add(f"part{k}", indexing.build(docs.where(F.pmod("doc_id", F.lit(2)) == k % 2), NEWS))
    readers.remove("part2")
    return readers.snapshot().dictionary.where(F.col("term").isin("query", "index", "tech")).select("field", "term", "df", "ttf")
