"""Cluster metrics from sampled views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a range.
RANGE = 4096


def leader_consensus(views: DataFrame) -> DataFrame:
    """Per sample: whether all reachable nodes (sample, node_id, leader, term, reachable) agree on leader and term."""
    up = F.col("reachable")
    return views.groupBy("sample").agg(F.count_if(up).alias("reachable"), (F.countDistinct(F.when(up, F.struct("leader", "term"))) == 1).alias("agree"))


def convergence(views: DataFrame) -> DataFrame:
    """Per sample (numbered): the highest generation seen so far and how many nodes (sample, node_id, generation) report it.

    The running maximum is taken within ranges of RANGE samples; only a row a range is ordered in one task.
    """
    top = views.groupBy("sample").agg(F.max("generation").alias("_t")).withColumn("_r", F.floor(F.col("sample") / RANGE))
    so_far = Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = top.groupBy("_r").agg(F.max("_t").alias("_m")).select("_r", F.max("_m").over(so_far).alias("_before"))
    within = F.max("_t").over(Window.partitionBy("_r").orderBy("sample"))
    top = top.join(before, "_r").select("sample", F.greatest(within, F.col("_before")).alias("highest"))
    return views.join(top, "sample").groupBy("sample", "highest").agg(F.count_if(F.col("generation") == F.col("highest")).alias("agreeing"), F.count("*").alias("nodes"))


def changes(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """How often a value changes from one row of a group to the next, and when last."""
    w = Window.partitionBy(group).orderBy(order)
    moved = F.lag(value).over(w).isNotNull() & ~F.lag(value).over(w).eqNullSafe(F.col(value))
    return rows.withColumn("_m", moved).groupBy(group).agg(F.count_if(F.col("_m")).alias("changes"), F.max(F.when(F.col("_m"), F.col(order))).alias("last_change"))


def latched(rows: DataFrame, group: str, order: str, ready: str) -> DataFrame:
    """rows with `latched`: true from the first ready row on."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("latched", F.max(F.col(ready).cast("int")).over(w) == 1)


def acknowledged(writes: DataFrame, acks: DataFrame, required: int, timeout: int) -> DataFrame:
    """writes (write_id, at) with the acks (write_id, node_id, at) that came in time, and whether they are enough."""
    a = acks.select("write_id", F.col("at").alias("_at"), "node_id")
    x = writes.join(a, "write_id", "left")
    n = F.countDistinct(F.when((F.col("_at") >= F.col("at")) & (F.col("_at") - F.col("at") <= timeout), F.col("node_id")))
    return x.groupBy("write_id").agg(n.alias("acks")).withColumn("accepted", F.col("acks") >= required)


def generations(rows: DataFrame, group: str, order: str, content: str) -> DataFrame:
    """rows with `generation`: 1 at first, one more whenever the content differs from the row before."""
    w = Window.partitionBy(group).orderBy(order)
    bump = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.lag(content).over(w).eqNullSafe(F.col(content))).cast("int"))
    return rows.withColumn("_b", bump).withColumn("generation", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def set_differences(before: DataFrame, after: DataFrame, group: str, member: str, gone: DataFrame | None = None) -> DataFrame:
    """Per group: members of before that after lacks and the other way round, and whether both sets are equal; members of `gone` count as not in before."""
    a = before.select(group, member).distinct()
    a = a if gone is None else a.join(gone.select(group, member).distinct(), [group, member], "left_anti")
    x = a.withColumn("_a", F.lit(True)).join(after.select(group, member).distinct().withColumn("_b", F.lit(True)), [group, member], "full_outer")
    return x.groupBy(group).agg(F.count_if(F.col("_b").isNull()).alias("absent"), F.count_if(F.col("_a").isNull()).alias("unexpected")).withColumn("equal", F.col("absent") + F.col("unexpected") == 0)
