"""A corpus pipeline: toxic documents go, similar ones and repeated passages too, the rest is mixed and packed."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.llm import jaccard, mixing, packing, suffixes, toxicity
from prefixlake.llm.common import cleared, n_written, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Which of the operators' tables the last stage made: from the first number up to the second.
_LAST = [0, 0]


def finish(spark: SparkSession, docs: DataFrame) -> None:
    """Empties what the last stage made besides its result, as docs has been written and reread; tables that docs still reads stay."""
    cleared(spark, *_LAST, but=docs)
    _LAST[1] = _LAST[0]


def in_turn(stage: Stage) -> Stage:
    """The stage, emptying first what the stage before it made besides its result, which has been written and reread by now."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        finish(spark, docs)
        _LAST[0] = n_written()
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _LAST[1] = n_written()

    return run_stage


def aside(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with its own columns of the names that an operator uses renamed, and the names to give back."""
    back = {f"_own_{c}": c for c in docs.columns if c in used}
    return docs.withColumnsRenamed({c: x for x, c in back.items()}), back


@in_turn
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier, trained on labels, rejects; null and empty texts are judged as no words."""
    return toxicity.filtered(docs, table(spark, sf_dir, "labels"))


@in_turn
def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones (five-word shingles, 0.8 or more): the least doc_id. Documents without words all stay."""
    return jaccard.representatives(docs, words=5, num=80, den=100)


@in_turn
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the bytes of passages that occur elsewhere; n_chars follows. No document goes, null texts stay null, columns of any name stay."""
    own, back = aside(docs, ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
    cut = suffixes.remove_repeats(own, keep_text=True).select(*own.columns).withColumnsRenamed(back)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


@in_turn
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate and its draw say: none, one or two times. Null and empty texts have no words and stay by the same draw; columns of any name stay."""
    own, back = aside(docs, ("size", "source_size", "target", "copies"))
    return mixing.emitted(mixing.mix(own)).select(*own.columns).withColumnsRenamed(back).select(*docs.columns)


@in_turn
def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of 2048 tokens; null and empty texts are one piece of their end id."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_similar),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: SQL can't express the classifier, the components or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again; what a stage wrote besides is emptied."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    finish(spark, docs)
    return docs
