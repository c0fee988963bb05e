"""The queries of this subpackage's operators and the SQL they must agree with."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import dedup, leakage, ngrams, packing, privacy, ranking, relevance

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.SegmentIndex(table(spark, sf, "stored_docs")).feed(table(spark, sf, "incoming_docs"))


_SOUND = "postings WHERE term IS NOT NULL AND term <> '' AND field IS NOT NULL"


@query(f"""
WITH c AS (SELECT field, term, count(DISTINCT (segment_id, doc_id)) AS n FROM {_SOUND} GROUP BY 1, 2),
     a AS (SELECT count(DISTINCT (segment_id, doc_id)) AS n FROM {_SOUND})
SELECT field, term, CASE WHEN c.n < 3 THEN 'rare' ELSE 'common' END AS mark FROM c, a WHERE c.n < 3 OR c.n > 0.25 * a.n""")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.marked(table(spark, sf, "postings")).where("mark is not null").select("field", "term", "mark")


@query(f"""
WITH e AS (SELECT field, term, segment_id, doc_id, arg_max(coalesce(tf, 1), (indexed_at, coalesce(tf, 1))) AS tf FROM {_SOUND} GROUP BY 1, 2, 3, 4)
SELECT field, term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_term_freq FROM e GROUP BY 1, 2""")
def p2_term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.posting_counts(table(spark, sf, "postings"))


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM documents),
     p AS (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM w)
SELECT t[i] || ' ' || t[i + 1] AS ngram, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_term_freq FROM p GROUP BY 1""")
def p2_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    words = F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), 1), F.lower)
    counts = ngrams.ngram_counts(table(spark, sf, "documents").select(words.alias("words")), "words", 2)
    return counts.where("n = 2").select(F.array_join("ngram", " ").alias("ngram"), "doc_freq", "total_term_freq")


@query()
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_ranking(spark, sf).where("rank <= 10").select("query_id", "doc_id")


@query()
def p4_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.hit_ranking(table(spark, sf, "hits"), table(spark, sf, "stored_docs"))


_WEIGHTS = """
WITH e AS (SELECT segment_id, doc_id, term, CAST(arg_max(coalesce(tf, 1), (indexed_at, coalesce(tf, 1))) AS BIGINT) AS tf FROM postings
           WHERE field = 'body' AND term IS NOT NULL AND term <> '' GROUP BY 1, 2, 3),
     l AS (SELECT segment_id, doc_id, sum(tf) AS length FROM e GROUP BY 1, 2),
     t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(avg(length) AS DOUBLE) AS average FROM l),
     f AS (SELECT term, count(*) AS doc_freq FROM e GROUP BY 1),
     w AS (SELECT e.segment_id, e.doc_id, e.term, e.tf, f.doc_freq,
                  ln(1.0::DOUBLE + (n - doc_freq + 0.5::DOUBLE) / (doc_freq + 0.5::DOUBLE)) * e.tf * 2.2::DOUBLE
                  / (e.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average)) AS weight
           FROM e JOIN l USING (segment_id, doc_id) JOIN f USING (term) CROSS JOIN t)
"""


@query(_WEIGHTS + "SELECT segment_id, doc_id, arg_min(term, (round(-weight, 9), term)) AS term FROM w GROUP BY 1, 2")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return relevance.most_distinctive(relevance.term_weights(relevance.body_entries(table(spark, sf, "postings"))))


@query(_WEIGHTS + "SELECT segment_id, doc_id, term, tf, doc_freq, round(weight, 6) AS weight FROM w")
def p5_weights(spark: SparkSession, sf: str) -> DataFrame:
    return relevance.term_weights(relevance.body_entries(table(spark, sf, "postings"))).withColumn("weight", F.round("weight", 6))


@query()
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the packing had to split."""
    return p6_containers(spark, sf).where("piece = 2").select("doc_id")


@query()
def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query()
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_overlaps(spark, sf).where("run >= 13").select("doc_id", "item_id")


@query()
def p7_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.overlaps(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


@query()
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_mentions(spark, sf).select("doc_id", "kind", "start_pos")


def _key() -> str:
    """A secret for one call: these queries show positions and forms, which do not depend on it."""
    return secrets.token_hex(16)


@query()
def p8_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Every mention with its surrogate."""
    return privacy.replaced_mentions(table(spark, sf, "documents"), table(spark, sf, "person_names"), _key())


@query()
def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.replace(table(spark, sf, "documents"), table(spark, sf, "person_names"), _key(), style="placeholder")


@query()
def p8_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.replace(table(spark, sf, "documents"), table(spark, sf, "person_names"), _key())
