"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Makes Spark drop the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that Spark gathers, outside its heap, for a batch to Python; at most BATCH where rows hold whole texts or sets.
BATCH_ROWS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Paths of the tables that `written` has made, in order; None for those that are emptied.
_WRITTEN: list[str | None] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors must share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and fixes row order and partition numbers."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession, since: int = 0, until: int | None = None, but: DataFrame | None = None) -> None:
    """Empties the tables that `written` has made from number `since` on, up to `until`; for when no result that reads them is needed any more.

    Tables that `but` reads stay. The numbers of emptied ones stay taken.
    """
    read = {x.rsplit("/", 2)[-2] for x in but.inputFiles()} if but is not None else set()
    for k in range(since, len(_WRITTEN) if until is None else until):
        if _WRITTEN[k] and _WRITTEN[k].rsplit("/", 1)[-1] not in read:
            spark.createDataFrame([], "nothing int").coalesce(1).write.mode("overwrite").parquet(_WRITTEN[k])
            _WRITTEN[k] = None


def n_written() -> int:
    return len(_WRITTEN)


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has at most `limit` bytes in a column, or one row; nothing is copied."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, limit + (ends[at - 1] if at else 0), "right")))
            yield batch.slice(at, end - at)
            at = end


def in_small_batches(f: Callable) -> Callable:
    """f, which takes docs; while it runs, rows go to Python in batches of at most BATCH."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **named):
        spark = docs.sparkSession
        before = spark.conf.get(BATCH_ROWS)
        spark.conf.set(BATCH_ROWS, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
        try:
            return f(docs, *args, **named)
        finally:
            spark.conf.set(BATCH_ROWS, before)

    return run


def released(rows: Iterator) -> Iterator:
    """rows; after the last one the worker, which lives on, gives the memory that it has freed back to the system."""
    yield from rows
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text; of null, none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def id_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n."""
    return F.crc32(id_text(doc_id)) % n


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """df with `_pl_rank` (from 0, by `order` within each group) and `_pl_group_rows`, both long.

    Rows are range-partitioned by group and order, so one hot group spreads over many tasks; only
    a count for each group and partition is gathered. The sorted rows are written first, so that
    the numbers of a rerun task agree.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in [*groups, *order]]
    rows = written(
        df.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("_pl_at", F.monotonically_increasing_id()),
        name,
    ).withColumn("_pl_part", F.shiftright("_pl_at", 33))
    found = rows.groupBy("_pl_part", *groups).agg(F.min("_pl_at").alias("_pl_first"), F.count("*").alias("_n"))
    from pyspark.sql import Window

    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = over.orderBy("_pl_part").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(
        F.col("_pl_part").alias("_pl_p"),
        *[F.col(c).alias(f"_g_{c}") for c in groups],
        "_pl_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_pl_before"),
        F.sum("_n").over(over).alias("_pl_group_rows"),
    )
    on = F.col("_pl_part") == F.col("_pl_p")
    for c in groups:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return (
        rows.join(found, on)
        .withColumn("_pl_rank", F.col("_pl_at") - F.col("_pl_first") + F.col("_pl_before"))
        .drop("_pl_at", "_pl_part", "_pl_p", "_pl_first", "_pl_before", *[f"_g_{c}" for c in groups])
    )
