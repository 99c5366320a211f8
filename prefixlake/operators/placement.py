"""Rendezvous placement of shards on nodes, and checks of its changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.functions.hashing import as_signed, fnv1a, hex64, rendezvous_weight, shard_of, sized, u32, unsigned_order


def weights(nodes: DataFrame, shards: int) -> DataFrame:
    """(shard, node_id, weight) for nodes (node_id) and shards 0 to shards - 1. Nodes are hashed once; nodes times shards is small."""
    seeds = nodes.select("node_id", as_signed(fnv1a(F.col("node_id"))).alias("seed"))
    each = seeds.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return each.select("shard", "node_id", rendezvous_weight("seed", "shard").alias("weight"))


def ranked_owners(nodes: DataFrame, shards: int, replicas: int = 0) -> DataFrame:
    """(shard, node_id, rank): rank 1 is the primary, the next ones replicas in order; fewer nodes than asked for give fewer. Ties to smaller ids."""
    order = Window.partitionBy("shard").orderBy(unsigned_order(F.col("weight")).desc(), "node_id")
    out = weights(nodes, shards).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= 1 + max(0, replicas)).select("shard", "node_id", "rank", hex64(F.col("weight")).alias("weight"))


def owner_lists(ranked: DataFrame) -> DataFrame:
    """(shard, primary, replicas) of ranked owners."""
    own = F.sort_array(F.collect_list(F.struct("rank", "node_id")))
    return ranked.groupBy("shard").agg(own.alias("x")).select("shard", F.col("x")[0]["node_id"].alias("primary"), F.transform(F.slice("x", 2, 1 << 20), lambda e: e["node_id"]).alias("replicas"))


def routed(keys: DataFrame, owners: DataFrame, nodes: DataFrame, key: str, shards: int) -> DataFrame:
    """keys with shard, node_id and address; a shard without an owner or a node without an address leaves nulls."""
    primary = owners.where("rank = 1").select("shard", "node_id")
    return keys.withColumn("shard", shard_of(F.col(key), shards)).join(primary, "shard", "left").join(nodes, "node_id", "left")


def map_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shards whose owner differs between two maps (shard, node_id): missing, unexpected or different."""
    a, b = before.select("shard", F.col("node_id").alias("before")), after.select("shard", F.col("node_id").alias("after"))
    kind = F.when(F.col("after").isNull(), "missing").when(F.col("before").isNull(), "unexpected").otherwise("different")
    return a.join(b, "shard", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select("shard", "before", "after", kind.alias("kind"))


def moves(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """One row on a node's removal or return: shards moved, stable, and those that moved though the target has no part in it."""
    pairs = before.select("shard", F.col("node_id").alias("a")).join(after.select("shard", F.col("node_id").alias("b")), "shard")
    moved = F.col("a") != F.col("b")
    wrong = moved & (F.col("a") != target) & (F.col("b") != target)
    return pairs.agg(F.count_if(moved).alias("moved"), F.count_if(~moved).alias("stable"), F.count_if(wrong).alias("violations"))


def promoted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shards whose owner changed, and whether the new one was the first replica. Both ranked (shard, node_id, rank)."""
    old = before.where("rank = 1").select("shard", F.col("node_id").alias("old"))
    heir = before.where("rank = 2").select("shard", F.col("node_id").alias("heir"))
    new = after.where("rank = 1").select("shard", F.col("node_id").alias("new"))
    return old.join(new, "shard").where("old <> new").join(heir, "shard", "left").select("shard", "old", "new", F.col("heir").eqNullSafe(F.col("new")).alias("as_promised"))


def gained(before: DataFrame, after: DataFrame) -> DataFrame:
    """(shard, node_id) held after and not before, in any rank."""
    return after.select("shard", "node_id").join(before.select("shard", "node_id"), ["shard", "node_id"], "left_anti")


def non_holders(owners: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each shard's least node that holds none of its copies."""
    every = owners.select("shard").distinct().join(F.broadcast(nodes.select("node_id")))  # nodes: a few dozen
    return every.join(owners, ["shard", "node_id"], "left_anti").groupBy("shard").agg(F.min("node_id").alias("node_id"))


def shares(owners: DataFrame) -> DataFrame:
    return owners.groupBy("node_id").agg(F.count_if(F.col("rank") == 1).alias("primaries"), F.count_if(F.col("rank") > 1).alias("replicas"))


def node_view(owners: DataFrame, node_id: str) -> DataFrame:
    """For each shard that a node holds: its role and the other holders, for the primary its replicas, for a replica its sources."""
    mine = owners.where(F.col("node_id") == node_id).select("shard", F.when(F.col("rank") == 1, "primary").otherwise("replica").alias("role"))
    others = owners.where(F.col("node_id") != node_id).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("rank", "node_id"))).alias("x"))
    return mine.join(others, "shard", "left").select("shard", "role", F.coalesce(F.array_join(F.transform("x", lambda e: e["node_id"]), ","), F.lit("")).alias("peers"))


def orphaned(owners: DataFrame, nodes: DataFrame) -> DataFrame:
    """Owners that are not among the nodes."""
    return owners.join(nodes.select("node_id"), "node_id", "left_anti")


def fingerprint(nodes: DataFrame, owners: DataFrame, shards: int, replicas: int, tag: str = "topology-v2\0") -> DataFrame:
    """SHA-256 of a topology: nodes (node_id, address) by id, then each shard's owner, then each shard's owner list. One row."""
    def joined(parts: Column) -> Column:
        return F.unhex(F.array_join(F.transform(F.sort_array(parts), lambda e: F.hex(e["bytes"])), ""))

    n = nodes.agg(F.count("*").alias("n"), F.collect_list(F.struct("node_id", F.concat(sized(F.col("node_id")), sized(F.col("address"))).alias("bytes"))).alias("x"))
    lists = owner_lists(owners)
    tail = F.unhex(F.array_join(F.transform("replicas", lambda r: F.hex(sized(r))), ""))
    s = lists.agg(
        F.count("*").alias("m"),
        F.collect_list(F.struct("shard", F.concat(u32(F.col("shard")), sized(F.col("primary"))).alias("bytes"))).alias("one"),
        F.collect_list(F.struct("shard", F.concat(u32(F.col("shard")), sized(F.col("primary")), u32(F.size("replicas")), tail).alias("bytes"))).alias("all"),
    )
    whole = F.concat(
        F.lit(tag).cast("binary"), u32(F.lit(shards)), u32(F.lit(replicas)), u32(F.col("n")), joined(F.col("x")), u32(F.col("m")), joined(F.col("one")), u32(F.col("m")), joined(F.col("all"))
    )
    return n.crossJoin(s).select(F.sha2(whole, 256).alias("fingerprint"))  # one row each


def incoherent(views: DataFrame) -> DataFrame:
    """Generations that replicas (generation, fingerprint) report with more than one fingerprint."""
    return views.groupBy("generation").agg(F.countDistinct("fingerprint").alias("fingerprints")).where("fingerprints > 1")
