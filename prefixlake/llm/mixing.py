"""Mixing sources to target weights by repetition rates.

Sizes are summed by source, targets follow from the weights, and a source's rate is its target
over its size. A document is taken floor(rate) times, and once more if its seeded hash falls below
the fraction. Only where the luck of that draw leaves a source off its target by more than SLACK,
as in small sources, is the point of comparison moved to where the words below it come nearest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.common import id_text, n_words, written

#: Parts of the hash range that are told apart; each source's histogram has so many entries at most.
BINS = 65536
#: Share of its target that a source may be off before the draw is corrected.
SLACK = 0.005
SEED = "mix-9"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """For sizes (source, source_size), one row a source: target double.

    Sources by code point, null last, take the weights in turn. Targets are weight * level up to
    cap * size, with the level at which they add up to share * all sizes. All of size 0: targets 0.
    """
    w = Window.partitionBy(F.lit(0))
    by_name = w.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    full = w.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_k", F.row_number().over(w.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())))
        .withColumn("_all", F.sum("source_size").over(w) * F.lit(float(share)))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(full), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(w) - F.coalesce(F.sum("_w").over(full), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_left"))
    )
    # The level of the first source that doesn't fill up; if all do, none is needed.
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_k", F.col("_level").alias("level")))).over(w)
    return rows.withColumn("target", F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level["level"] * F.col("_w")))).select(
        "source", "source_size", "target"
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """docs (doc_id, source, text, ...) with size, source_size, target and copies.

    Null texts have size 0, null sources are one source, null ids hash as the word null; rows with
    the same id share their draw. Reruns agree. Columns with the new names are replaced. An empty table stays empty.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_text(F.col("doc_id")))), 1, 4), 16, 10).cast("int")
    docs = docs.withColumn("size", n_words(F.col("text"))).withColumn("_pl_bin", draw)
    hist = written(docs.groupBy("source", "_pl_bin").agg(F.sum("size").alias("_n")), "sizes")  # read three times
    goal = targets(hist.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, cap)
    goal = goal.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goal = goal.withColumn("_pl_floor", F.floor("_rate").cast("long"))
    goal = goal.withColumn("_want", F.col("target") - F.col("_pl_floor") * F.col("source_size"))
    # The plain draw: probability of a copy equal to the fraction.
    goal = goal.withColumn("_plain", F.floor((F.col("_rate") - F.col("_pl_floor")) * BINS + F.lit(0.5)).cast("int"))
    # Words up to each bin: within spans of bins, behind the spans before, so that no task orders all bins of a large source.
    hist = hist.withColumn("_span", F.shiftright("_pl_bin", 8))
    before = Window.partitionBy("_s").orderBy("_sp").rowsBetween(Window.unboundedPreceding, -1)
    spans = hist.groupBy(F.col("source").alias("_s"), F.col("_span").alias("_sp")).agg(F.sum("_n").alias("_m"))
    spans = spans.select("_s", "_sp", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy("source", "_span").orderBy("_pl_bin"))
    sums = hist.withColumn("_in", within).join(spans, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_span") == F.col("_sp")))
    sums = sums.select("_s", "_pl_bin", "_n", (F.col("_in") + F.col("_before")).alias("_sum"))
    # Corrected, the cut goes after the bin where the words below come nearest to what is wanted; -1: before all.
    cut = (
        goal.join(sums, F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("source", "source_size", "target", "_pl_floor", "_want", "_plain")
        .agg(
            F.min(F.struct(F.abs(F.col("_sum") - F.col("_want")), F.col("_pl_bin"))).alias("_best"),
            F.coalesce(F.sum(F.when(F.col("_pl_bin") < F.col("_plain"), F.col("_n"))), F.lit(0)).alias("_drawn"),
        )
        .withColumn("_pl_cut", F.when(F.abs(F.col("_drawn") - F.col("_want")) <= SLACK * F.col("target"), F.col("_plain") - 1).when(F.col("_want") <= F.col("_best.col1"), F.lit(-1)).otherwise(F.col("_best._pl_bin")))
        .select(F.col("source").alias("_pl_src"), "source_size", "target", "_pl_floor", "_pl_cut")
    )
    return (
        docs.join(cut, F.col("source").eqNullSafe(F.col("_pl_src")))
        .withColumn("copies", (F.col("_pl_floor") + (F.col("_pl_bin") <= F.col("_pl_cut")).cast("long")).cast("int"))
        .drop("_pl_bin", "_pl_src", "_pl_floor", "_pl_cut")
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """Each row `copies` times."""
    return mixed.withColumn("_pl_copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>")))).drop("_pl_copy")


def digest(documents: DataFrame) -> DataFrame:
    return mix(documents.select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source"
    )
