"""JSON lines into documents of a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.schema import Schema

RENAMED = {"body": "text", "source": "url"}  # keys of encyclopedia dumps; any other field is its own key


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every non-blank line of all files below ``path``, as ``line``."""
    return spark.read.option("recursiveFileLookup", True).text(path).where("trim(value) <> ''").withColumnRenamed("value", "line")


def number(line: str, key: str, kind: str) -> Column:
    """A numeric key of a JSON line, quoted or bare; 0 where it is absent or no number."""
    return F.coalesce(F.get_json_object(line, f"$.{key}").try_cast(kind), F.lit(0).cast(kind))


def documents(lines: DataFrame, schema: Schema, line: str = "line", renamed: dict[str, str] | None = None) -> DataFrame:
    """``ext_id`` (from the key ``id``) and the schema's fields; absent strings are empty, absent numbers 0."""
    keys = RENAMED if renamed is None else renamed
    columns = [number(line, "id", "bigint").alias("ext_id")]
    for f in schema.fields:
        key = keys.get(f.name, f.name)
        if f.type == "int64":
            columns.append(number(line, key, "bigint").alias(f.name))
        elif f.type == "float32":
            columns.append(number(line, key, "float").alias(f.name))
        elif f.type in ("text", "keyword"):
            raw = F.get_json_object(line, f"$.{key}")
            columns.append((F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>")) if f.multi else F.coalesce(raw, F.lit(""))).alias(f.name))
    return lines.select(*columns)


def with_content(docs: DataFrame, schema: Schema) -> DataFrame:
    """Documents with at least one non-empty indexed text or keyword field."""
    sizes = [F.size(f.name) if f.multi else F.length(F.coalesce(F.col(f.name), F.lit(""))) for f in schema.indexed() if f.type in ("text", "keyword")]
    return docs.where(F.greatest(*sizes, F.lit(0)) > 0) if sizes else docs.limit(0)


def first(docs: DataFrame, n: int | None, order: str = "ext_id") -> DataFrame:
    """The first ``n`` documents by ``order``, for a trial run; all where ``n`` is None or 0."""
    return docs.orderBy(order).limit(n) if n else docs


def synthetic(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """``n`` made-up documents: title, content, abstract, pubtime, uid, category."""
    nouns, kinds = ["engine", "index", "query", "segment", "vector", "corpus", "ranking", "storage"], ["tech", "news", "science", "sports", "travel"]
    pick = lambda words, s: F.element_at(F.array(*[F.lit(w) for w in words]), (F.rand(seed + s) * len(words)).cast("int") + 1)
    phrase = lambda k, s: F.concat_ws(" ", *[pick(nouns, s + i) for i in range(k)])
    return spark.range(1, n + 1).select(F.col("id").alias("doc_id"), phrase(4, 0).alias("title"), phrase(40, 10).alias("content"), phrase(12, 60).alias("abstract"), (F.lit(1_600_000_000) + (F.rand(seed + 80) * 1e8).cast("bigint")).alias("pubtime"), ((F.rand(seed + 81) * 10_000).cast("bigint") + 1).alias("uid"), pick(kinds, 82).alias("category"))
