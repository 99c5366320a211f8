"""Vector candidates within a tenant and block type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The inner product of unit vectors, held between 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b)))


def is_unit(v: Column, width: int, slack: float = 1e-3) -> Column:
    return (F.size(v) == width) & (F.abs(F.sqrt(dot(v, v)) - 1) <= slack)


def build_report(rows: DataFrame, width: int, model: str) -> DataFrame:
    """Per bucket (namespace, block_type): rows seen, without vector, of another model, malformed, indexed; the first that holds counts."""
    none, other, bad = F.col("embedding").isNull(), F.col("model") != model, ~is_unit(F.col("embedding"), width)
    state = F.when(none, 0).when(other, 1).when(bad, 2).otherwise(3)
    return rows.groupBy("namespace", "block_type").agg(
        F.count("*").alias("seen"), *[F.count_if(state == k).alias(n) for k, n in enumerate(("without_embedding", "model_mismatched", "malformed", "indexed"))]
    )


def top_candidates(queries: DataFrame, records: DataFrame, k: int = 5, others: bool = False, many_queries: bool = False) -> DataFrame:
    """Each query's k most similar records of its own bucket: query_id, rank, context_id, version, similarity. Ties to the smaller context and version.
    With others, a record named like the query is left out.

    Both are bucketed by (namespace, block_type, a salt): records of a large bucket spread over
    SALTS tasks, queries go to each, and each task keeps k only before the last ranking. With
    many_queries it is the queries that spread, and the records go to each of those tasks.
    """
    salts = 8
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    q = queries.select("namespace", "block_type", "query_id", F.col("embedding").alias("_q"))
    q = q.withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int") if many_queries else each)
    r = records.withColumn("_salt", each if many_queries else F.pmod(F.xxhash64("context_id", "version"), F.lit(salts)).cast("int"))
    scored = q.join(r, ["namespace", "block_type", "_salt"]).select("query_id", "_salt", "context_id", "version", cosine(F.col("_q"), F.col("embedding")).alias("similarity"))
    if others:
        scored = scored.where(F.col("query_id") != F.col("context_id"))
    order = [F.desc("similarity"), F.col("context_id"), F.col("version")]
    if not many_queries:  # else a query's pairs have one salt
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_salt").orderBy(*order))).where(F.col("rank") <= k)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).drop("_salt")
