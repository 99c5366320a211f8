"""Mutation logs and the state that they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Operations of the log, the largest value that a scan returns with its key.
SET, DEL = 2, 3
INLINE = 4 * 1024 * 1024


def valid_prefix(log: DataFrame, ok: str | None = None, buckets: int = 1 << 16) -> DataFrame:
    """Records (sequence, ...) up to the first fault: not ok, or a gap; sequences begin at 1. Repeated ones are faults.

    A sequence number is right if it equals its rank; ranks come from counts per range of numbers,
    so no task sees the whole log.
    """
    rows = log.withColumn("_b", F.floor((F.col("sequence") - 1) / buckets))
    faults = rows.where(~F.col(ok)).agg(F.min("sequence").alias("x")) if ok else None
    seen = rows.groupBy("_b").agg(F.countDistinct("sequence").alias("n"), F.count("*").alias("m"), F.max("sequence").alias("top"), F.min("sequence").alias("low"))
    # The first range that is not full, gapless and free of repeats; only it is looked into.
    full = (F.col("low") == F.col("_b") * buckets + 1) & (F.col("n") == buckets) & (F.col("m") == buckets)
    order = Window.partitionBy(F.lit(0)).orderBy("_b")  # a row for each range of numbers
    first = seen.withColumn("_k", F.row_number().over(order) - 1).where(~full | (F.col("_b") != F.col("_k"))).agg(F.min("_b").alias("_b"), F.min("_k").alias("_k"))
    edge = rows.join(F.broadcast(first.where("_b = _k").select("_b")), "_b")
    w = Window.partitionBy("_b").orderBy("sequence")
    place = edge.withColumn("_p", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy("sequence")))
    good = F.col("sequence") == F.col("_b") * buckets + F.col("_p")
    bad = place.where(~good | (F.col("_m") > 1)).agg(F.min("sequence").alias("y"), F.min(F.col("_b") * buckets + F.col("_p")).alias("z"))
    cut = first.crossJoin(bad).select(F.least(F.col("y"), F.col("z"), F.when(F.col("_b") != F.col("_k"), F.col("_k") * buckets + 1)).alias("_cut"))  # one row each
    if faults is not None:
        cut = cut.crossJoin(faults).select(F.least("_cut", "x").alias("_cut"))
    return rows.crossJoin(F.broadcast(cut)).where(F.col("_cut").isNull() | (F.col("sequence") < F.col("_cut"))).drop("_b", "_cut")


def latest(log: DataFrame, key: str = "key") -> DataFrame:
    """Each key's last record, deletions left out. max_by combines before the shuffle, so hot keys do no harm."""
    cols = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*cols), "sequence").alias("_x"))
    return last.select(key, *[F.col("_x")[c].alias(c) for c in cols]).where(F.col("opcode") == SET)


def prefix_scan(state: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Keys with a prefix; values over INLINE bytes are left out and marked."""
    big = F.octet_length("value") > INLINE
    return state.where(F.col(key).startswith(prefix)).select(key, F.when(~big, F.col("value")).alias("value"), big.alias("value_omitted"))


def reads(requests: DataFrame, state: DataFrame, key: str = "key") -> DataFrame:
    """requests with found and value; an empty value is found."""
    x = state.select(key, "value", F.lit(True).alias("_f"))
    return requests.join(x, key, "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def reassembled(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks (key, index, total, data) as one value a key, and whether they are complete: indices 0 to total - 1, once each."""
    return chunks.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "data"))), lambda x: x["data"]), "").alias("value"),
        ((F.min("index") == 0) & (F.max("index") == F.max("total") - 1) & (F.count("*") == F.max("total")) & (F.countDistinct("index") == F.max("total")) & (F.min("total") == F.max("total"))).alias("complete"),
    )



def tier_usage(state: DataFrame, tier: str = "tier") -> DataFrame:
    """Keys and value bytes of each tier, and of all of them under `total`."""
    size = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
    out = state.rollup(tier).agg(F.count("*").alias("keys"), F.sum(size).alias("bytes"))
    return out.select(F.coalesce(F.col(tier), F.lit("total")).alias("tier"), "keys", "bytes")
