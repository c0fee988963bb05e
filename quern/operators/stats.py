"""Statistics and inspection over index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.operators.indexing import blocked


def cross_field(dictionary: DataFrame) -> DataFrame:
    """(``term``, ``ttf``, ``df``, ``max_tf_norm``): sums of ttf, largest df and bound over fields."""
    return dictionary.groupBy("term").agg(F.sum("ttf").alias("ttf"), F.max("df").alias("df"), F.max("max_tf_norm").alias("max_tf_norm"))


def top_terms(posts: DataFrame, dictionary: DataFrame, n: int, sample: int = 15) -> DataFrame:
    """The ``n`` terms in most documents, each with its first ``sample`` document ids.

    Ids are taken smallest first inside each task before they travel, so no list is ever collected whole.
    """
    # n rows
    top = F.broadcast(dictionary.orderBy(F.desc("df"), "field", "term").limit(n).select("field", "term", "df", "ttf"))
    mine = posts.select("field", "term", "doc_id").join(top.select("field", "term"), ["field", "term"], "left_semi")
    spread = Window.partitionBy("field", "term", "_salt").orderBy("doc_id")
    few = mine.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("_r", F.row_number().over(spread)).where(F.col("_r") <= sample)
    first = few.groupBy("field", "term").agg(F.slice(F.sort_array(F.collect_list("doc_id")), 1, sample).alias("sample"))
    return top.join(first, ["field", "term"])


def df_buckets(dictionary: DataFrame, per_bucket: int) -> DataFrame:
    """The ``per_bucket`` most frequent terms of each band of df: 1-9, 10-99, 100-999, 1000 and more."""
    bucket = F.when(F.col("df") < 10, "1-9").when(F.col("df") < 100, "10-99").when(F.col("df") < 1000, "100-999").otherwise("1000+")
    banded = dictionary.withColumn("bucket", bucket)
    salted = Window.partitionBy("bucket", F.pmod(F.xxhash64("field", "term"), F.lit(64))).orderBy(F.desc("df"), "field", "term")
    final = Window.partitionBy("bucket").orderBy(F.desc("df"), "field", "term")
    few = banded.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= per_bucket)
    return few.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= per_bucket).select("bucket", "rank", "field", "term", "df")


def index_stats(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row: ``docs``, ``terms`` (field and term pairs), ``unique_terms``, ``total_terms``."""
    sizes = dictionary.agg(F.count(F.lit(1)).alias("terms"), F.sum("ttf").alias("total_terms"))
    unique = dictionary.select("term").distinct().agg(F.count(F.lit(1)).alias("u")).scalar()
    return sizes.select(docs.agg(F.count(F.lit(1)).alias("n")).scalar().alias("docs"), "terms", unique.alias("unique_terms"), "total_terms")


def segment_stats(posts: DataFrame, docs: DataFrame, skip_size: int = 128) -> DataFrame:
    """Per segment: documents, terms, posting entries, average and largest df with its first term, skip nodes."""
    lists = posts.groupBy("segment_id", "field", "term").agg(F.count(F.lit(1)).alias("df"))
    counts = docs.groupBy("segment_id").agg(F.count(F.lit(1)).alias("doc_count"))
    best = F.min(F.struct((-F.col("df")).alias("d"), "term"))
    per = lists.groupBy("segment_id").agg(F.count(F.lit(1)).alias("term_count"), F.sum("df").alias("total_pl_entries"), F.avg("df").alias("avg_pl_df"), best.alias("b"), F.sum(F.expr(f"(df + {skip_size - 1}) div {skip_size}")).alias("skip_nodes"))
    return counts.join(per, "segment_id").select("segment_id", "doc_count", "term_count", "total_pl_entries", "avg_pl_df", (-F.col("b.d")).alias("max_pl_df"), F.col("b.term").alias("max_pl_term"), "skip_nodes")


def liveness(docs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Per segment: ``total``, ``alive``, ``deleted`` documents."""
    dead = deleted.select("segment_id", "doc_id").distinct().withColumn("_dead", F.lit(1))
    marked = docs.select("segment_id", "doc_id").join(dead, ["segment_id", "doc_id"], "left")
    return marked.groupBy("segment_id").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("_dead").isNull(), 1)).alias("alive"), F.count("_dead").alias("deleted"))


def skip_summary(blocks: DataFrame) -> DataFrame:
    """Per list: ``blocks``, ``docs``, and least, mean and largest block bound."""
    return blocks.groupBy("field", "term").agg(F.count(F.lit(1)).alias("blocks"), F.sum("docs").alias("docs"), F.min("max_tf_norm").alias("min_bound"), F.avg("max_tf_norm").alias("avg_bound"), F.max("max_tf_norm").alias("max_bound"))


def skip_find(blocks: DataFrame, target: int) -> DataFrame:
    """The first block of each list that can hold a document >= ``target``; lists without one are left out."""
    return blocks.where(F.col("max_doc_id") >= target).groupBy("field", "term").agg(F.min("block").alias("block"))


def term_report(dictionary: DataFrame, stats: DataFrame) -> DataFrame:
    """(``field``, ``term``, ``df``, ``idf``, ``bound``): what a term can score at most."""
    idf = scoring.idf(F.col("n_docs"), F.col("df"))
    return dictionary.join(F.broadcast(stats), "field").select("field", "term", "df", idf.alias("idf"), (F.col("max_tf_norm") * idf).alias("bound"))


def deltas(posts: DataFrame, size: int = 128) -> DataFrame:
    """Doc ids of each list as differences inside blocks of ``size``, the first of a block absolute."""
    inside = Window.partitionBy("field", "term", "block").orderBy("i")
    placed = blocked(posts.select("field", "term", "doc_id"), size)
    return placed.withColumn("delta", F.col("doc_id") - F.lag("doc_id", 1, 0).over(inside)).drop("doc_id")


def undelta(encoded: DataFrame) -> DataFrame:
    """The inverse of ``deltas``: (``field``, ``term``, ``doc_id``)."""
    inside = Window.partitionBy("field", "term", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return encoded.select("field", "term", F.sum("delta").over(inside).alias("doc_id"))
