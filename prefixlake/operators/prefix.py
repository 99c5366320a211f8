"""Chained block hashes of token sequences, and how far they are cached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.functions.hashing import token_bytes


def chained_hashes(tokens: Column, page: int = 16) -> Column:
    """SHA-256 of each full page behind the hex of the one before it, as an array; a last page that isn't full has none."""
    pages = F.floor(F.size(tokens) / page).cast("int")
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))

    def step(acc: Column, i: Column) -> Column:
        data = F.unhex(F.array_join(F.transform(F.slice(tokens, i * page + 1, page), lambda t: F.hex(token_bytes(t))), ""))
        h = F.sha2(F.concat(acc["last"].cast("binary"), data), 256)
        return F.struct(h.alias("last"), F.array_append(acc["all"], h).alias("all"))

    steps = F.when(pages > 0, F.sequence(F.lit(0), pages - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step)["all"]


def cached_prefix(probes: DataFrame, cached: DataFrame, request: str) -> DataFrame:
    """How many keys of each request (request, index from 0, key) are cached before the first that isn't, and how many in all."""
    hit = probes.join(cached.select("key", F.lit(True).alias("_h")).distinct(), "key", "left")
    miss = F.min(F.when(F.col("_h").isNull(), F.col("index")))
    return hit.groupBy(request).agg(F.coalesce(miss, F.count("*")).alias("prefix"), F.count("*").alias("n_keys"))


def trailing_prefix(exists: DataFrame, request: str, trailing: int) -> DataFrame:
    """The longest prefix whose last `trailing` keys all exist (exists: request, index, hit), 0 if none."""
    w = Window.partitionBy(request).orderBy("index").rowsBetween(-(max(1, trailing) - 1), 0)
    ok = exists.withColumn("_ok", F.min(F.col("hit").cast("int")).over(w) == 1)
    return ok.groupBy(request).agg(F.coalesce(F.max(F.when(F.col("_ok"), F.col("index") + 1)), F.lit(0)).alias("prefix"))


def written_and_read(written: DataFrame, read: DataFrame) -> DataFrame:
    return written.select("key").intersect(read.select("key"))


def multi_pool(exists: DataFrame, request: str, pools: dict[str, int], kv: str = "kv") -> DataFrame:
    """Pages of each request that all pools can serve. exists: request, index from 0, a boolean column a pool; pools: their trailing pages, 0 where all must exist.

    kv: pages before the first that is missing. Others: their first missing page below kv, or the
    longest prefix within kv whose last pages exist; 0 once a pool before has none. pages: the least.
    """
    whole = Window.partitionBy(request)
    x = exists.withColumn("_kv", F.coalesce(F.min(F.when(~F.col(kv), F.col("index"))).over(whole), F.count("*").over(whole)))
    inside, aggs = F.col("index") < F.col("_kv"), []
    for name, trailing in pools.items():
        if trailing:
            x = x.withColumn(f"_{name}", F.min(F.col(name).cast("int")).over(whole.orderBy("index").rowsBetween(1 - trailing, 0)) == 1)
            at = F.coalesce(F.max(F.when(inside & F.col(f"_{name}"), F.col("index") + 1)), F.lit(0))
        else:
            at = F.coalesce(F.min(F.when(inside & ~F.col(name), F.col("index"))), F.max("_kv"))
        aggs.append(at.cast("long").alias(f"_at_{name}"))
    out = x.groupBy(request).agg(F.max("_kv").cast("long").alias("kv_pages"), *aggs)
    final = F.col("kv_pages")
    for name in pools:
        out = out.withColumn(f"{name}_pages", F.when(final == 0, F.lit(0)).otherwise(F.col(f"_at_{name}")).cast("long")).drop(f"_at_{name}")
        final = F.least(final, F.col(f"{name}_pages"))
    return out.withColumn("pages", final)
