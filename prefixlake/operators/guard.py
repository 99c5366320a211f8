"""The guard: what a candidate's text must share with a block's before it may stand in for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.textnorm import SENTENCE_ENDS, entity, may_tell, nfc, polarity_family, stripped, thinned

TAU = 0.90


def found(text: Column) -> Column:
    """(family, entity) of each token of a text in NFC that has one or the other, line by line; null texts have none.

    Tokens that are only punctuation don't count. A sentence starts with a line and behind a token that ends with a sentence mark.
    """

    def in_line(line: Column) -> Column:
        raws = F.filter(F.split(line, r"(?U)\s+"), lambda x: stripped(x) != "")
        # In an array of its own, so that the tokens are made once and not for each look at the token before.
        return F.flatten(F.transform(F.array(raws), lambda own: F.filter(F.transform(own, lambda x, i: token_of(own, x, i)), lambda t: may_tell(t["token"]))))

    def token_of(own: Column, raw: Column, at: Column) -> Column:
        before = F.get(own, at - 1)
        start = before.isNull() | F.substring(before, -1, 1).isin(*SENTENCE_ENDS)
        return F.struct(stripped(raw).alias("token"), start.alias("start"))

    told = F.transform(F.flatten(F.transform(F.split(thinned(text), "\n"), in_line)), lambda t: F.struct(polarity_family(t["token"]).alias("family"), entity(t["token"], t["start"]).alias("entity")))
    return F.coalesce(told, F.array().cast("array<struct<family:string,entity:string>>"))


def with_facts(rows: DataFrame, text: str = "text", composed: bool = False) -> DataFrame:
    """rows with polarity (map) and entities (sorted) of their text, without any shuffle; composed: it is in NFC already."""
    x = rows.withColumn("_found", found(F.col(text) if composed else nfc(F.col(text))))
    return x.withColumns(_facts_of(F.col("_found"))).drop("_found")


def _facts_of(found: Column) -> dict[str, Column]:
    families = F.filter(F.transform(found, lambda t: t["family"]), lambda f: f.isNotNull())
    counts = F.transform(F.array_sort(F.array_distinct(families)), lambda f: F.struct(f, F.size(F.filter(families, lambda x: x == f)).cast("long")))
    entities = F.filter(F.transform(found, lambda t: t["entity"]), lambda e: e.isNotNull())
    return {"polarity": F.map_from_entries(counts), "entities": F.array_sort(F.array_distinct(entities))}


def facts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, polarity map, sorted entities) of each key's texts; texts without any have empty ones."""
    each = texts.select(key, found(nfc(F.col(text))).alias("_found")).groupBy(key).agg(F.flatten(F.collect_list("_found")).alias("_found"))
    return each.withColumns(_facts_of(F.col("_found"))).select(key, "polarity", "entities")


def same_map(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def verdict(same_type: Column, same_namespace: Column, polarity: tuple[Column, Column], entities: tuple[Column, Column]) -> Column:
    """null if a candidate passes, else the first reason: type_mismatch, namespace_error, negation_mismatch, entity_mismatch."""
    return (
        F.when(~same_type, "type_mismatch")
        .when(~same_namespace, "namespace_error")
        .when(~same_map(*polarity), "negation_mismatch")
        .when(entities[0] != entities[1], "entity_mismatch")
    )


def difference(a: Column, b: Column) -> Column:
    """What only one of two sorted sets has: -x and +y, at most five and how many more."""
    parts = F.concat(F.transform(F.array_except(a, b), lambda x: F.concat(F.lit("-"), x)), F.transform(F.array_except(b, a), lambda x: F.concat(F.lit("+"), x)))
    more = F.when(F.size(parts) > 5, F.concat(F.lit(" (+"), (F.size(parts) - 5).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(parts, 1, 5), " "), more)


def walk(candidates: DataFrame, key: str, tau: float = TAU) -> DataFrame:
    """The outcome of each key's ranked candidates (rank, reason, similarity, context_id, version).

    The first that passes with similarity >= tau matches; one that passes below it ends the walk
    with the first refusal before it, or low_similarity; if none passes, the first refusal stands.
    context_id, version and similarity are those of a match; `seen` has them of the candidate that decided.
    """
    passes = F.col("reason").isNull()
    x = candidates.groupBy(key).agg(
        F.min(F.when(passes, F.struct("rank", "similarity", "context_id", "version"))).alias("p"),
        F.min(F.when(~passes, F.struct("rank", "reason", "similarity", "context_id", "version"))).alias("r"),
    )
    hit = F.coalesce(F.col("p.similarity") >= tau, F.lit(False))
    refused = F.col("p").isNull() | (F.col("r.rank") < F.col("p.rank"))
    before = F.when(refused, F.col("r.reason"))
    seen = [F.when(hit | ~F.coalesce(refused, F.lit(False)), F.col(f"p.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in ("context_id", "version", "similarity")]
    return x.select(
        key,
        F.when(hit, "matched").otherwise("rejected").alias("outcome"),
        F.when(~hit, F.coalesce(before, F.lit("low_similarity"))).alias("reason"),
        F.when(hit, F.col("p.context_id")).alias("context_id"),
        F.when(hit, F.col("p.version")).alias("version"),
        F.when(hit, F.col("p.similarity")).alias("similarity"),
        F.struct(*seen).alias("seen"),
    )
