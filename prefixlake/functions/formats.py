"""Key formats, labels and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of operations and states of the log and the wire.
OPCODES = {1: "GET", 2: "SET", 3: "DEL"}
REPAIRS = {0: "NONE", 1: "TRUNCATED", 2: "CORRUPT", 3: "SEQUENCE"}


def named(code: Column, names: dict[int, str], other: str = "UNKNOWN") -> Column:
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def pool_key(block_hash: Column, pool: Column) -> Column:
    """hash.pool; for the pool kv the hash alone."""
    return F.when(pool == "kv", block_hash).otherwise(F.concat_ws(".", block_hash, pool))


def layer_key(model: Column, layer: Column, block_hash: Column, tag: Column) -> Column:
    """kv:[model:]layer_N:hash[:tag]; null parts are left out."""
    return F.concat_ws(":", F.lit("kv"), model, F.concat(F.lit("layer_"), layer.cast("string")), block_hash, tag)


def parsed_layer_key(key: Column) -> Column:
    """(model, layer, hash, tag) of such a key; a model that begins with layer_ or holds a colon is not told apart."""
    parts = F.split(key, ":")
    bare = parts[1].startswith("layer_")
    at = F.when(bare, F.lit(1)).otherwise(F.lit(2))
    return F.struct(
        F.when(~bare, parts[1]).alias("model"),
        F.substring(F.get(parts, at), 7, 1 << 30).cast("int").alias("layer"),
        F.get(parts, at + 1).alias("hash"),
        F.get(parts, at + 2).alias("tag"),
    )


def escaped_label(x: Column) -> Column:
    r"""A label value with \, " and line ends escaped."""
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def metric_line(name: Column, labels: Column, value: Column) -> Column:
    """name{a="x",b="y"} value, labels (a map) in order of their names."""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), escaped_label(e["value"]), F.lit('"')))
    return F.concat(name, F.when(F.size(parts) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(F.lit("")), F.lit(" "), value)


def human_bytes(n: Column) -> Column:
    """Bytes in the largest binary unit with one decimal."""
    def unit(size: int, name: str) -> Column:
        return F.concat(F.format_string("%.1f", n / F.lit(size)), F.lit(" " + name))

    return F.when(n >= 1 << 30, unit(1 << 30, "GiB")).when(n >= 1 << 20, unit(1 << 20, "MiB")).when(n >= 1 << 10, unit(1 << 10, "KiB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def percent_change(new: Column, base: Column) -> Column:
    """100 * (new - base) / base, 0 where the base is 0."""
    return F.when(base == 0, F.lit(0.0)).otherwise((new - base) / base * 100)


def split_ranges(size: Column, blocks: Column) -> Column:
    """(offset, length) of each of n equal blocks; the last takes what is over."""
    each = F.floor(size / blocks)
    return F.transform(
        F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1),
        lambda i: F.struct((i * each).alias("offset"), F.when(i == blocks - 1, size - i * each).otherwise(each).alias("length")),
    )
