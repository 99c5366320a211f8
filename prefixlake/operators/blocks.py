"""Chat requests as ordered, typed blocks, and their assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.functions.structured import tool_text
from prefixlake.functions.textnorm import token_estimate

#: Block types by whether they may be matched.
ELIGIBLE = ("system_prompt", "tool_schema", "tool_policy", "org_policy", "agent_instruction", "rag_document")
DEFERRED = ("repository_context", "few_shot_examples")
INELIGIBLE = ("conversation_history", "user_query")
MIN_TOKENS = 512


def eligibility(block_type: Column) -> Column:
    return F.when(block_type.isin(*ELIGIBLE), "eligible").when(block_type.isin(*DEFERRED), "deferred").when(block_type.isin(*INELIGIBLE), "ineligible")


def decomposed(messages: DataFrame, request: str = "request_id", position: str = "position") -> DataFrame:
    """Blocks of messages (request, position, role, text): index (from 0, empty messages take none), block_type, text, token_estimate.

    System and developer messages are the system prompt, the last user message is the query, all
    else is history. Positions must differ within a request.
    """
    whole = Window.partitionBy(request)
    last = F.max(F.when(F.col("role") == "user", F.col(position))).over(whole)
    kind = F.when(F.col("role").isin("system", "developer"), "system_prompt").when(F.col(position) == F.col("_last"), "user_query").otherwise("conversation_history")
    rows = messages.withColumn("_last", last).where(F.coalesce(F.col("text"), F.lit("")) != "")
    index = F.row_number().over(whole.orderBy(position)) - 1
    return rows.select(request, index.alias("index"), kind.alias("block_type"), "text", token_estimate(F.col("text")).alias("token_estimate"))


def with_tools(blocks: DataFrame, tools: DataFrame, request: str = "request_id", position: str = "position") -> DataFrame:
    """decomposed blocks with a tool_schema block for each tool (request, position, tool as JSON) behind them; tools that are no JSON take none."""
    rows = tools.select(request, position, tool_text(F.col("tool")).alias("text")).where("text is not null")
    n = blocks.groupBy(request).agg(F.count("*").alias("_n"))
    index = F.row_number().over(Window.partitionBy(request).orderBy(position)) - 1 + F.coalesce("_n", F.lit(0))
    extra = rows.join(n, request, "left").select(request, index.cast("int").alias("index"), F.lit("tool_schema").alias("block_type"), "text", token_estimate(F.col("text")).alias("token_estimate"))
    return blocks.unionByName(extra)


def annotated(blocks: DataFrame, annotations: DataFrame, request: str = "request_id") -> DataFrame:
    """blocks with the types of annotations (request, index, block_type) in place of their own, and `known`: false where an annotation is no block type, which leaves the block as it is."""
    a = annotations.select(request, "index", F.col("block_type").alias("_type"))
    ok = F.col("_type").isin(*ELIGIBLE, *DEFERRED, *INELIGIBLE)
    x = blocks.join(a, [request, "index"], "left").withColumn("known", F.col("_type").isNull() | ok)
    return x.withColumn("block_type", F.when(ok, F.col("_type")).otherwise(F.col("block_type"))).drop("_type")


def with_bypass(blocks: DataFrame, threshold: int = MIN_TOKENS, request: str = "request_id") -> DataFrame:
    """blocks with eligible_tokens of the request and bypass_reason: below_min_tokens, ineligible_block_type or null."""
    fit = F.col("block_type").isin(*ELIGIBLE)
    total = F.sum(F.when(fit, F.col("token_estimate")).otherwise(0)).over(Window.partitionBy(request))
    reason = F.when(~fit, "ineligible_block_type").when(F.col("eligible_tokens") < threshold, "below_min_tokens")
    return blocks.withColumn("eligible_tokens", total).withColumn("bypass_reason", reason)


def assembled(blocks: DataFrame, substitutions: DataFrame, request: str = "request_id") -> DataFrame:
    """One row a request: its block texts in order, accepted ones replaced; n_replaced; unknown indices (none of its blocks)."""
    subs = substitutions.select(request, "index", F.col("text").alias("_new"))
    rows = blocks.select(request, "index", "text").join(subs, [request, "index"], "full_outer")
    known = F.col("text").isNotNull()
    parts = F.sort_array(F.collect_list(F.when(known, F.struct("index", F.coalesce("_new", "text").alias("t")))))
    return rows.groupBy(request).agg(
        F.array_join(F.transform(parts, lambda e: e["t"]), "\n").alias("body"),
        F.count_if(known & F.col("_new").isNotNull()).alias("n_replaced"),
        F.count_if(~known).alias("n_unknown"),
    )
