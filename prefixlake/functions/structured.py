"""Canonical JSON of tool schemas, and vectors as blobs. Spark's to_json neither sorts keys nor refuses repeated ones, so small Arrow functions do it."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key occurs twice")
    return out


def _refused(name: str):
    raise ValueError(f"{name} is no JSON")


def _rendered(text: str, strict: bool) -> str | None:
    how = {"sort_keys": True, "separators": (",", ":"), "allow_nan": False} if strict else {}
    try:
        value = json.loads(text, **({"object_pairs_hook": _once, "parse_constant": _refused} if strict else {}))
        out = json.dumps(value, ensure_ascii=False, **how)
        out.encode()  # half a surrogate pair has no UTF-8
    except (ValueError, TypeError, RecursionError):
        return None
    return out


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks, other characters as they are. Null for null, for no JSON, repeated keys, NaN, Infinity and too deep nesting."""
    return text.map(lambda x: _rendered(x, True), na_action="ignore")


@F.pandas_udf(StringType())
def tool_text(tool: pd.Series) -> pd.Series:
    """A tool's JSON with its own order of keys and a blank after commas and colons; null if it is no JSON."""
    return tool.map(lambda x: _rendered(x, False), na_action="ignore")


def registration_text(text: Column, block_type: Column) -> Column:
    """What a record must be registered as: tool schemas canonical (null if they can't be), other texts as they are."""
    return F.when(block_type == "tool_schema", canonical_json(F.when(block_type == "tool_schema", text))).otherwise(text)


@F.pandas_udf(BinaryType())
def vector_blob(vector: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats."""
    return vector.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")


@F.pandas_udf(ArrayType(FloatType()))
def _floats(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: np.frombuffer(b, "<f4"), na_action="ignore")


def blob_vector(blob: Column, width: int) -> Column:
    """The vector of a blob; null unless it holds `width` floats."""
    return _floats(F.when(F.octet_length(blob) == 4 * width, blob))


def mean_pooled(vectors: DataFrame, group: str, vector: str, mask: Column | None = None) -> DataFrame:
    """(group, pooled): the mean of a group's vectors whose mask holds, scaled to length 1. Partial means are combined before the shuffle; a zero mean stays zero."""
    rows = vectors if mask is None else vectors.where(mask)
    each = rows.select(group, F.posexplode(F.col(vector)).alias("_p", "_x")).groupBy(group, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    lists = each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda e: e["_m"]).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    return lists.withColumn("_n", norm).select(group, F.transform("_v", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)).alias("pooled"))
