"""Reads of single terms, documents and columns, for programs and for people."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.operators.indexing import Index


def lookup(dictionary: DataFrame, term: str, field: str | None = None) -> DataFrame:
    """The dictionary rows of a term, in one field or all; none where it is unknown. Both keys reach the scan."""
    found = dictionary.where(F.col("term") == term)
    return found.where(F.col("field") == field) if field is not None else found


def first_terms(dictionary: DataFrame, n: int, field: str | None = None) -> DataFrame:
    """The first ``n`` rows of the dictionary in the order of field and term."""
    rows = dictionary.where(F.col("field") == field) if field is not None else dictionary
    return rows.orderBy("field", "term").limit(max(n, 0))


def term_counts(dictionary: DataFrame) -> DataFrame:
    """(``field``, ``terms``, ``entries``): how many terms and posting entries each field has."""
    return dictionary.groupBy("field").agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("entries"))


def read_postings(index: Index, term: str, field: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """The postings of a term from document ``since`` to ``until``; without a field, those of the first field of the schema that has it."""
    rows = index.postings.where(F.col("term") == term)
    if field is None:
        order = {f.name: i for i, f in enumerate(index.schema.indexed())}
        place = F.element_at(F.create_map(*[F.lit(x) for item in order.items() for x in item]), F.col("field")) if order else F.lit(0)
        first = lookup(index.dictionary, term).agg(F.min_by("field", place).alias("f")).scalar()
        rows = rows.where(F.col("field") == first)
    else:
        rows = rows.where(F.col("field") == field)
    if since is not None:
        rows = rows.where(F.col("doc_id") >= since)
    return rows.where(F.col("doc_id") <= until) if until is not None else rows


def merged_positions(tokens: DataFrame, term: str, fields: Sequence[str]) -> DataFrame:
    """(``doc_id``, ``tf``, ``positions``): the places of a term over several fields, from tokens with document positions."""
    mine = tokens.where((F.col("term") == term) & F.col("field").isin(list(fields)))
    return mine.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def document_scores(index: Index, doc_id: int, terms: Sequence[str], idfs: Mapping[str, float] | None = None, k1: float = scoring.K1, b: float = scoring.B) -> DataFrame:
    """(``field``, ``score``): what one document scores in each field for several terms.

    ``idfs`` may give a term's idf under ``field:term`` or, failing that, under the bare term; others follow from the dictionary.
    """
    mine = index.postings.where((F.col("doc_id") == doc_id) & F.col("term").isin(list(terms)))
    # As many rows as terms times fields.
    known = index.dictionary.where(F.col("term").isin(list(terms))).select("field", "term", "df").join(F.broadcast(index.stats.select("field", "n_docs", "avgdl")), "field")
    idf: Column = scoring.idf(F.col("n_docs"), F.col("df"))
    if idfs:
        given = F.create_map(*[F.lit(x) for item in idfs.items() for x in item])
        idf = F.coalesce(F.try_element_at(given, F.concat_ws(":", "field", "term")), F.try_element_at(given, F.col("term")), idf)
    score = scoring.tf_norm(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b) * idf
    return mine.join(F.broadcast(known), ["field", "term"]).groupBy("field").agg(F.sum(score).alias("score"))


def loose_bounds(dictionary: DataFrame, stats: DataFrame) -> DataFrame:
    """(``field``, ``term``, ``bound``): a bound known while a segment still grows: all occurrences in one document of one word."""
    norm = scoring.tf_norm(F.col("ttf"), F.lit(1), F.col("avgdl"))
    return dictionary.join(F.broadcast(stats.select("field", "avgdl")), "field").select("field", "term", norm.alias("bound"))  # a row per field


def field_build_stats(posts: DataFrame, skip_size: int = 128) -> DataFrame:
    """Per segment and field: terms, posting entries, occurrences, average and largest df with its first term, skip nodes."""
    lists = posts.groupBy("segment_id", "field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))
    best = F.min(F.struct((-F.col("df")).alias("d"), "term"))
    per = lists.groupBy("segment_id", "field").agg(F.count(F.lit(1)).alias("term_count"), F.sum("df").alias("entries"), F.sum("ttf").alias("occurrences"), F.avg("df").alias("avg_df"), best.alias("b"), F.sum(F.expr(f"(df + {skip_size - 1}) div {skip_size}")).alias("skip_nodes"))
    return per.select("segment_id", "field", "term_count", "entries", "occurrences", "avg_df", (-F.col("b.d")).alias("max_df"), F.col("b.term").alias("max_term"), "skip_nodes")


def printed(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked results for reading: ``rank``, ``doc_id``, ``ext_id``, ``score`` to four places, ``title`` and ``source`` cut short.

    ``found`` has the k rows of a search. Missing titles and sources are empty, a missing ext_id is 0.
    """
    rows = docs.select("doc_id", "ext_id", "title", "source").join(F.broadcast(found.select("doc_id", "score")), "doc_id")  # k rows
    order = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    text = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return rows.select(order.alias("rank"), "doc_id", F.coalesce("ext_id", F.lit(0)).alias("ext_id"), F.format_string("%.4f", F.col("score")).alias("score"), text("title", 30), text("source", 50)).orderBy("rank")
