"""A registry of versioned, tenant-scoped texts as tables.

records: namespace, context_id, version, block_type, text, content_hash, deprecated_at (null while
live), ...; pointers: namespace, context_id, version; aliases: namespace, context_id, version,
alias, ordinal. The namespace is in every join key, never a later filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["namespace", "context_id", "version"]
#: Fixed value: what identifiers look like.
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"


def is_identifier(x: Column) -> Column:
    return x.rlike(IDENTIFIER) & (F.char_length(x) <= 128)


def live(records: DataFrame) -> DataFrame:
    return records.where(F.col("deprecated_at").isNull())


def scan(records: DataFrame, pointers: DataFrame, namespace: str, block_type: str | None = None, include_deprecated: bool = False, current_only: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A tenant's records in order of context and version."""
    out = records.where(F.col("namespace") == namespace)
    if block_type is not None:
        out = out.where(F.col("block_type") == block_type)
    if not include_deprecated:
        out = live(out)
    if current_only:
        out = out.join(pointers.select(*KEY), KEY, "left_semi")
    out = out.orderBy("context_id", "version").offset(offset)
    return out if limit is None else out.limit(limit)


def current(records: DataFrame, pointers: DataFrame) -> DataFrame:
    """Live records that their pointer names."""
    return live(records).join(pointers.select(*KEY), KEY, "left_semi")


def point_read(records: DataFrame, pointers: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (namespace, context_id, version or null) with its record; a null version means the current one. Deprecated records are found too."""
    at = pointers.select("namespace", "context_id", F.col("version").alias("_current"))
    keys = wanted.join(at, ["namespace", "context_id"], "left").withColumn("version", F.coalesce("version", "_current")).drop("_current")
    return keys.join(records, KEY)


def by_hash(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (namespace, content_hash, ...) with the live record of that hash, current or not."""
    return wanted.join(live(records).select(*KEY, "block_type", "content_hash"), ["namespace", "content_hash"])


def by_alias(records: DataFrame, pointers: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (namespace, alias, ...) with the live current record that has the alias."""
    bound = aliases.join(current(records, pointers).select(*KEY, "block_type"), KEY)
    return wanted.join(bound.select(*KEY, "alias", "block_type"), ["namespace", "alias"])


def with_aliases(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """records with their aliases by ordinal; none: an empty array."""
    lists = aliases.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("ordinal", "alias"))).alias("_a"))
    out = records.join(lists, KEY, "left")
    return out.withColumn("aliases", F.coalesce(F.transform("_a", lambda x: x["alias"]), F.array().cast("array<string>"))).drop("_a")


def max_versions(records: DataFrame) -> DataFrame:
    return records.groupBy("namespace", "context_id").agg(F.max("version").alias("version"))


def admitted(records: DataFrame, aliases: DataFrame, new: DataFrame, text_hash: Column) -> DataFrame:
    """new records (KEY, text, content_hash, first_alias) with `problem`, the first of: hash_mismatch, duplicate_version, not_advancing, live_hash_clash, alias_clash; null if admitted."""
    known = records.select(*KEY, F.lit(True).alias("_known"))
    top = max_versions(records).withColumnRenamed("version", "_top")
    hashes = live(records).select("namespace", "content_hash", F.lit(True).alias("_hash")).distinct()
    owners = aliases.select("namespace", F.col("alias").alias("first_alias"), F.col("context_id").alias("_owner")).distinct()
    x = new.join(known, KEY, "left").join(top, ["namespace", "context_id"], "left").join(hashes, ["namespace", "content_hash"], "left").join(owners, ["namespace", "first_alias"], "left")
    problem = (
        F.when(F.col("content_hash") != text_hash, "hash_mismatch")
        .when(F.col("_known"), "duplicate_version")
        .when(F.col("version") <= F.col("_top"), "not_advancing")
        .when(F.col("_hash"), "live_hash_clash")
        .when(F.col("_owner") != F.col("context_id"), "alias_clash")
    )
    return x.withColumn("problem", problem).drop("_known", "_top", "_hash", "_owner")


def registered(pointers: DataFrame, new: DataFrame) -> DataFrame:
    """Pointers after new records are registered: only contexts that are new get one, to their least new version; others are staged."""
    first = new.groupBy("namespace", "context_id").agg(F.min("version").alias("version"))
    return pointers.unionByName(first.join(pointers, ["namespace", "context_id"], "left_anti"))


def published(pointers: DataFrame, new: DataFrame) -> DataFrame:
    """Pointers after new versions are published: the highest new one replaces the old."""
    top = new.groupBy("namespace", "context_id").agg(F.max("version").alias("version"))
    return pointers.join(top, ["namespace", "context_id"], "left_anti").unionByName(top)


def deprecated(records: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """records with deprecated_at set for those of gone (KEY) that have none yet; pointers stay as they are."""
    x = records.join(gone.select(*KEY, F.lit(True).alias("_gone")), KEY, "left")
    return x.withColumn("deprecated_at", F.coalesce("deprecated_at", F.when(F.col("_gone"), at))).drop("_gone")


def added_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """aliases with those of new whose (namespace, alias) nobody owns."""
    return aliases.unionByName(new.join(aliases.select("namespace", "alias").distinct(), ["namespace", "alias"], "left_anti").select(aliases.columns))


def violations(records: DataFrame) -> DataFrame:
    """Records that break a rule, with the rule's name: duplicate_key, bad_version, empty_text, bad_hash, bad_identifier, two_live_hashes."""
    w = Window.partitionBy(*KEY)
    h = Window.partitionBy("namespace", "content_hash", F.col("deprecated_at").isNull())
    rules = {
        "duplicate_key": F.count("*").over(w) > 1,
        "bad_version": F.col("version") < 1,
        "empty_text": F.coalesce(F.col("text"), F.lit("")) == "",
        "bad_hash": F.length("content_hash") != 64,
        "bad_identifier": ~is_identifier(F.col("context_id")),
        "two_live_hashes": F.col("deprecated_at").isNull() & (F.count("*").over(h) > 1),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return records.select(*KEY, found.alias("_rules")).select(*KEY, F.explode("_rules").alias("rule"))
