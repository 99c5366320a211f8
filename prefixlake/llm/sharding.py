"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source; the row of rank r among n gets the
fractional rank (r + 0.5) / n. Sorted by that, the sources interleave in proportion, so equal
contiguous cuts all hold the same mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.common import id_text, ranked

SEED = "shard-5"


def interleave(rows: DataFrame, shards: int, source: str = "source", key: str = "doc_id", ties: tuple[str, ...] = (), seed: str = SEED) -> DataFrame:
    """rows with `shard` (0 to shards - 1) and `slot` (from 0 within the shard).

    Shards' row counts differ by one at most, and so do each source's rows in them, up to rounding.
    A null source is a stratum of its own, null keys hash as the word null; repeated keys get
    places of their own in the order of `ties`; rows alike in those too are alike. Texts are not read, whatever their length. Columns with the new names are replaced. An empty table stays empty.
    """
    rows = rows.drop("shard", "slot")
    rows = rows.withColumn("_pl_h", F.md5(F.concat(F.lit(f"{seed}:"), id_text(F.col(key)))))
    rows = ranked(rows, [source], ["_pl_h", key, *ties], "strata")
    rows = rows.withColumn("_pl_f", (F.col("_pl_rank") + F.lit(0.5)) / F.col("_pl_group_rows")).drop("_pl_rank", "_pl_group_rows")
    rows = ranked(rows, [], ["_pl_f", source, "_pl_h", key, *ties], "interleaved")
    shard = F.expr(f"(_pl_rank * {shards}) div _pl_group_rows")
    first = F.expr(f"(shard * _pl_group_rows + {shards - 1}) div {shards}")
    return rows.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_pl_rank") - first).cast("long")).drop("_pl_h", "_pl_f", "_pl_rank", "_pl_group_rows")


def digest(documents: DataFrame, shards: int = 8) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleave(rows, shards, ties=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
