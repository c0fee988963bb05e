"""Inverted indexes as DataFrames: tokens, postings, dictionaries and field statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import analysis, scoring
from quern.operators.chunks import place_in_key
from quern.runtime import cut, spread
from quern.schema import Field, Schema


def _words(field: Field, schema: Schema) -> Column:
    """The array of a field's words before stemming (analysed fields) or of its verbatim values."""
    if field.type == "combined":
        single = [s for s in field.sources if (d := schema.find(s)) is None or not d.multi]
        part = analysis.kept_words if field.analysed else _value
        return F.concat(*[part(F.col(s)) for s in single]) if single else F.array().cast("array<string>")
    value = F.col(field.name)
    if field.multi:
        values = F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
        return F.flatten(F.transform(values, analysis.kept_words)) if field.analysed else values
    return analysis.kept_words(value) if field.analysed else _value(value)


def _value(value: Column) -> Column:
    """A verbatim value as an array of one; empty for NULL and the empty string."""
    return F.when(value.isNotNull() & (value != ""), F.array(value)).otherwise(F.array().cast("array<string>"))


def tokens(docs: DataFrame, schema: Schema, key: str = "doc_id", document_positions: bool = False) -> DataFrame:
    """(key, ``field``, ``term``, ``pos``, ``dl``): one row per kept word; ``dl`` is the number of kept words of the field.

    Positions count from 0 within the field or, with ``document_positions``, on through the fields in schema order. All
    fields come from one scan of ``docs``.
    """
    fields = schema.indexed()
    needed = [s for f in fields for s in (f.sources if f.type == "combined" else (f.name,))]
    arrays = spread(docs.select(*dict.fromkeys([key, *needed]))).select(F.col(key), *[_words(f, schema).alias(f"_w{i}") for i, f in enumerate(fields)])
    base, parts = F.lit(0), []
    for i, f in enumerate(fields):
        parts.append(F.struct(F.lit(f.name).alias("field"), F.lit(f.analysed).alias("analysed"), F.col(f"_w{i}").alias("words"), F.size(f"_w{i}").alias("dl"), base.alias("base")))
        if document_positions:
            base = base + F.size(f"_w{i}")
    per_field = arrays.select(key, F.explode(F.array(*parts)).alias("f")).select(key, "f.*")
    each = per_field.select(key, "field", "analysed", "base", "dl", F.posexplode("words").alias("at", "word"))
    return each.select(key, "field", F.when(F.col("analysed"), analysis.stem(F.col("word"))).otherwise(F.col("word")).alias("term"), (F.col("at") + F.col("base")).alias("pos"), "dl")


def postings(toks: DataFrame, key: str = "doc_id", positions: bool = False) -> DataFrame:
    """(``field``, ``term``, key, ``tf``, ``dl``[, ``positions``]). The grouping key holds the document, so no term is a hot spot."""
    extra = [F.sort_array(F.collect_list("pos")).alias("positions")] if positions else []
    return toks.groupBy("field", "term", key).agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"), *extra)


def field_lengths(docs: DataFrame, schema: Schema, key: str = "doc_id") -> DataFrame:
    """(``field``, key, ``dl``) of the fields that have words, without looking at single words."""
    parts = [F.struct(F.lit(f.name).alias("field"), F.size(_words(f, schema)).cast("bigint").alias("dl")) for f in schema.indexed()]
    return docs.select(key, F.explode(F.array(*parts)).alias("f")).select("f.field", key, "f.dl").where("dl > 0")


def summed_lengths(posts: DataFrame) -> DataFrame:
    """(``field``, ``sum_len``): a field's words are the occurrences in its postings, so texts need no second look."""
    return posts.groupBy("field").agg(F.sum("tf").alias("sum_len"))


def field_stats(lengths: DataFrame, n: Column) -> DataFrame:
    """(``field``, ``n_docs``, ``sum_len``, ``avgdl``); the average is over all documents, with the field or without."""
    sums = lengths.groupBy("field").agg(F.sum("dl").alias("sum_len"))
    return sums.select("field", n.alias("n_docs"), "sum_len", (F.col("sum_len").cast("double") / n).alias("avgdl"))


def term_dict(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(``field``, ``term``, ``df``, ``ttf``, ``max_tf_norm``): the dictionary; the bound is without idf."""
    norm = scoring.tf_norm(F.col("tf"), F.col("dl"), F.col("avgdl"))
    # One row per field of the schema.
    return posts.join(F.broadcast(stats.select("field", "avgdl")), "field").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"), F.max(norm).alias("max_tf_norm"))


def blocked(posts: DataFrame, size: int = 128, key: str = "doc_id") -> DataFrame:
    """``posts`` plus ``i`` (0-based place in its list, by document) and ``block`` = i div ``size``.

    Places follow from exact row numbers over all lists, so a long list is spread over many tasks and stays so.
    """
    at = place_in_key(posts, ["field", "term"], key).withColumn("i", F.col("_place").cast("int"))
    return at.withColumn("block", F.expr(f"cast(i div {int(size)} as int)")).select(*posts.columns, "i", "block")


def block_bounds(posts: DataFrame, stats: DataFrame, size: int = 128, key: str = "doc_id") -> DataFrame:
    """Per (field, term) and block of ``size`` documents in order: ``max_doc_id``, ``max_tf_norm``, ``docs``."""
    norm = scoring.tf_norm(F.col("tf"), F.col("dl"), F.col("avgdl"))
    normed = posts.join(F.broadcast(stats.select("field", "avgdl")), "field").select("field", "term", key, norm.alias("norm"))
    return blocked(normed, size, key).groupBy("field", "term", "block").agg(F.max(key).alias("max_doc_id"), F.max("norm").alias("max_tf_norm"), F.count(F.lit(1)).alias("docs"))


@dataclass
class Index:
    """The tables a search reads. ``docs`` holds one row per document with its stored and numeric columns."""

    schema: Schema
    docs: DataFrame
    postings: DataFrame
    stats: DataFrame
    dictionary: DataFrame
    deleted: DataFrame | None = None

    @property
    def default_fields(self) -> list[str]:
        return [f.name for f in self.schema.indexed()]


def build(docs: DataFrame, schema: Schema, positions: bool = False, written: bool = True) -> Index:
    """Index one row per document (``doc_id`` unique). Postings are written once, ordered so that a term's rows lie together."""
    posts = postings(tokens(docs, schema), positions=positions)
    if written:
        posts = cut(posts.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id"), "postings")
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    stats = summed_lengths(posts).select("field", n.alias("n_docs"), "sum_len", (F.col("sum_len").cast("double") / n).alias("avgdl"))
    if written:
        stats = cut(stats.coalesce(1), "stats")
    dictionary = term_dict(posts, stats)
    return Index(schema, docs, posts, stats, cut(dictionary, "dict") if written else dictionary)
