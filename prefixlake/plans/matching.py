"""From requests' blocks to decisions: each tier sees only what the tiers before it left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.structured import canonical_json
from prefixlake.functions.textnorm import content_hash, nfc, tidied
from prefixlake.operators import guard, registry, vector

BLOCK = ["block_id", "namespace", "block_type", "text", "embedding"]


def described(blocks: DataFrame) -> DataFrame:
    """blocks with what the tiers compare in place of their text, so that texts are read once and never shuffled.

    content_hash of the normalised text, raw_hash of the text as it is, tool_hash of a tool
    schema's canonical JSON (null for other blocks), and the guard's facts: polarity, entities.
    """
    b = blocks.withColumn("_nfc", nfc(F.col("text")))
    tool = canonical_json(F.when(F.col("block_type") == "tool_schema", F.col("text")))
    b = b.withColumns({"content_hash": F.sha2(tidied(F.col("_nfc")), 256), "raw_hash": F.sha2("text", 256), "tool_hash": content_hash(tool)})
    return guard.with_facts(b, "_nfc", composed=True).drop("text", "_nfc")


def decisions(blocks: DataFrame, records: DataFrame, pointers: DataFrame, aliases: DataFrame, k: int = 5, tau: float = guard.TAU, facts: DataFrame | None = None) -> DataFrame:
    """One row a block: block_id, outcome, method (exact, alias, structural, semantic), reason, context_id, version, similarity.

    Exact: the hash of the normalised text among live records. Alias: the text, raw or normalised,
    as a current record's alias. Structural: the hash of a tool schema's canonical JSON among live
    records. Semantic: the guard's walk over the nearest current records of the block's tenant and
    type; null vectors have no candidates. A refusal names the candidate that decided it.

    blocks may be described already. facts (KEY, polarity, entities) are those of the current
    records; without them they are taken from the records' text. Texts of aliases are compared by
    their SHA-256, as those of records are.
    """
    b = described(blocks) if "text" in blocks.columns else blocks
    least = F.min(F.struct("tier", "context_id", "version")).alias("x")  # of a block's hits, so that each tier is evaluated once
    keys = F.array(F.struct(F.lit(0).alias("tier"), F.col("content_hash").alias("content_hash")), F.struct(F.lit(2).alias("tier"), F.col("tool_hash").alias("content_hash")))
    wanted = b.select("block_id", "namespace", F.explode(F.filter(keys, lambda x: x["content_hash"].isNotNull())).alias("x")).select("block_id", "namespace", "x.*")
    names = b.select("block_id", "namespace", F.explode(F.array_distinct(F.array("raw_hash", "content_hash"))).alias("alias"))
    alias = registry.by_alias(records, pointers, aliases.withColumn("alias", F.sha2("alias", 256)), names).withColumn("tier", F.lit(1))
    found = ["block_id", "tier", "context_id", "version"]
    hits = registry.by_hash(records, wanted).select(*found).unionByName(alias.select(*found)).groupBy("block_id").agg(least)
    left = b.where("embedding is not null").select("block_id", "namespace", "block_type", "embedding").join(hits, "block_id", "left_anti")
    now = registry.current(records, pointers).where("embedding is not null")
    near = vector.top_candidates(left.withColumnRenamed("block_id", "query_id"), now.select("namespace", "block_type", "context_id", "version", "embedding"), k, many_queries=True)
    near = near.withColumnRenamed("query_id", "block_id")
    own = b.select("block_id", "namespace", F.col("polarity").alias("pa"), F.col("entities").alias("ea"))
    facts = guard.with_facts(now.select(*registry.KEY, "text")) if facts is None else facts
    theirs = facts.select(*registry.KEY, F.col("polarity").alias("pb"), F.col("entities").alias("eb"))
    judged = near.join(own, "block_id").join(theirs, registry.KEY)
    reason = guard.verdict(F.lit(True), F.lit(True), (F.col("pa"), F.col("pb")), (F.col("ea"), F.col("eb")))
    semantic = guard.walk(judged.withColumn("reason", reason), "block_id", tau)

    hit = F.col("x").isNotNull()
    method = F.when(hit, F.element_at(F.array(*map(F.lit, ("exact", "alias", "structural"))), F.col("x.tier") + 1)).when(F.col("outcome") == "matched", "semantic")
    return b.select("block_id").join(hits, "block_id", "left").join(semantic, "block_id", "left").select(
        "block_id", F.when(hit, "matched").otherwise(F.coalesce("outcome", F.lit("rejected"))).alias("outcome"), method.alias("method"),
        F.when(~hit, F.when(F.col("outcome").isNull(), "no_candidate").otherwise(F.col("reason"))).alias("reason"),
        F.coalesce("x.context_id", "seen.context_id").alias("context_id"), F.coalesce("x.version", "seen.version").alias("version"), F.when(hit, 1.0).otherwise(F.col("seen.similarity")).alias("similarity"),
    )


def label(outcome: Column, method: Column, reason: Column) -> Column:
    """A decision in one word: the method of a match, no_candidate, else the outcome."""
    return F.when((outcome == "matched") & method.isNotNull(), method).when(reason == "no_candidate", "no_candidate").otherwise(outcome)


def decision_rows(decided: DataFrame) -> DataFrame:
    """decisions as they are logged: label; similarity only where vectors were compared; guard_outcome, null where the guard did not decide."""
    reason = F.col("reason")
    guarded = F.when(F.col("method") == "semantic", "passed").when((F.col("outcome") == "rejected") & ~reason.isin("no_candidate", "low_similarity"), F.when(reason == "guard_error", "error").when(reason == "guard_timeout", "timeout").otherwise("rejected"))
    by_vector = F.col("method").isNull() | (F.col("method") == "semantic")
    return decided.withColumn("label", label(F.col("outcome"), F.col("method"), reason)).withColumn("guard_outcome", guarded).withColumn("similarity", F.when(by_vector, F.col("similarity")))


def report(rows: DataFrame, right: Column) -> DataFrame:
    """Per label: decisions, how many are `right`, least and greatest similarity."""
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"), F.min("similarity").alias("least"), F.max("similarity").alias("greatest"))
