"""Token ids in grammar-compressed files.

Documents are range-partitioned by doc_id and encoded; in each block of a shard, frequent pairs of
ids are replaced by new symbols, from the most frequent ones down to those that no longer pay. A file's row holds the block's rules, the
length each expands to, the symbols, and where each document starts, so that one document is
decoded without the rest. Pairs never cross documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm import encode
from prefixlake.llm.common import released, shared_dir, shuffle_partitions, sliced, written

#: Fixed values of the format: magic, and the first id that stands for a pair.
MAGIC, BASE = b"PLG1", 50257
HEAD = struct.Struct("<4sIIQQ")
#: Ids of a block, and bytes of text that are encoded at once.
BLOCK, CHUNK = 2_000_000, 4_000_000
#: Fewer occurrences of a pair than this would not pay for its rule (eight bytes against two each).
LEAST = 5
FILE = "shard int, block int, n_docs long, n_ids long, payload binary"


def compress(ids: np.ndarray, last: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, and where documents end, to symbols, the places of document ends among them, and rules (n x 2).

    Re-Pair by levels: a round replaces every pair that occurs at least an eighth as often as the
    most frequent one does, and rounds go on until no pair occurs `least` times or all 16-bit symbols
    are in use. Pairs are counted in buckets of a hash; a bucket counts one pair only, and those
    that share it wait for a round with another hash.
    """
    s, last, rules, n_rules = ids.astype(np.uint32), last.copy(), [np.zeros((0, 2), np.int64)], 0
    bits, dry = 20, 0
    while len(s) > 1 and n_rules < 65536 - BASE and dry < 3:
        mixed = s[:-1] * np.uint32(0x9E3779B1 + 2 * len(rules)) + s[1:] * np.uint32(0x85EBCA77)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        bucket = (mixed >> np.uint32(32 - bits)).astype(np.intp)
        bucket[last[:-1]] = 1 << bits  # pairs never cross documents
        count = np.bincount(bucket, minlength=(1 << bits) + 1)
        count[-1] = 0
        floor = max(least, int(count.max()) // 8)
        at = np.flatnonzero((count >= floor)[bucket])
        own = bucket[at]
        key = (s[at].astype(np.int64) << 17) | s[at + 1]
        held = np.zeros(1 << bits, np.int64)
        held[own] = key
        match = held[own] == key
        at, own = at[match], own[match]
        count = np.bincount(own, minlength=1 << bits)
        chosen = np.flatnonzero(count >= floor)
        if not len(chosen):
            if floor == least:
                break
            dry += 1  # pairs that met in one bucket; the next hash parts them
            rules.append(rules[0])
            continue
        dry = 0
        chosen = chosen[np.lexsort((held[chosen], -count[chosen]))][: 65536 - BASE - n_rules]
        rank = np.full(1 << bits, -1, np.int32)
        rank[chosen] = np.arange(len(chosen), dtype=np.int32)
        rank = rank[own]
        at, rank = at[rank >= 0], rank[rank >= 0]
        # Of neighbours that overlap, every other one is replaced, from the left.
        place = np.arange(len(at))
        run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))
        take = (place - run) % 2 == 0
        at, rank = at[take], rank[take]
        s[at] = (BASE + n_rules + rank).astype(np.uint32)
        last[at] |= last[at + 1]
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        s, last = s[stay], last[stay]
        pairs = held[chosen]
        rules.append(np.stack([pairs >> 17, pairs & 0x1FFFF], axis=1))
        n_rules += len(chosen)
    return s, np.flatnonzero(last), np.concatenate(rules)


def expansions(rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that the rules stand for, one rule after another, and how many each has. All are opened at once, level by level."""
    flat, of = rules.ravel(), np.repeat(np.arange(len(rules)), 2)
    while (inner := flat >= BASE).any():
        n = inner + 1
        at = (np.cumsum(n) - n)[inner]
        pair = rules[flat[inner] - BASE]
        flat, of = np.repeat(flat, n), np.repeat(of, n)
        flat[at], flat[at + 1] = pair[:, 0], pair[:, 1]
    return flat, np.bincount(of, minlength=len(rules))


def dump(doc_ids: list, docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs)
    n = np.array([len(d) for d in docs], np.int64)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(n) - 1] = True
    s, ends, rules = compress(ids, last)
    return b"".join(
        [
            HEAD.pack(MAGIC, len(docs), len(rules), len(ids), len(s)),
            np.array([d is None for d in doc_ids], "<u1").tobytes(),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            n.astype("<u4").tobytes(),
            (ends + 1).astype("<u4").tobytes(),
            rules.astype("<u2").tobytes(),
            expansions(rules)[1].astype("<u4").tobytes(),
            s.astype("<u2").tobytes(),
        ]
    )


class Block:
    """A block as read from its bytes."""

    def __init__(self, payload: bytes):
        magic, docs, rules, self.n_ids, symbols = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        at = HEAD.size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype, n, at)
            at += out.nbytes
            return out

        null = take("<u1", docs)
        self.doc_ids = [None if x else int(d) for x, d in zip(null, take("<i8", docs))]
        self.n = take("<u4", docs).astype(np.int64)
        self.stops = take("<u4", docs).astype(np.int64)
        self.rules = take("<u2", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.long = take("<u4", rules).astype(np.int64)
        self.symbols = take("<u2", symbols)
        self.starts = np.cumsum(self.long) - self.long
        self.flat = expansions(self.rules)[0]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= BASE
        if not rule.any():
            return symbols.astype("<u4")
        of = symbols[rule].astype(np.int64) - BASE
        n = np.ones(len(symbols), np.int64)
        n[rule] = self.long[of]
        out = np.repeat(symbols, n).astype("<u4")
        starts = (np.cumsum(n) - n)[rule]
        inner = np.arange(int(n[rule].sum())) - np.repeat(np.cumsum(n[rule]) - n[rule], n[rule])
        out[np.repeat(starts, n[rule]) + inner] = self.flat[np.repeat(self.starts[of], n[rule]) + inner]
        return out

    def decode(self, k: int) -> np.ndarray:
        """The ids of the k-th document alone."""
        return self.expand(self.symbols[self.stops[k - 1] if k else 0 : self.stops[k]])


def write(docs: DataFrame, path: str, tokenizer: str = encode.BYTE_BPE, end: int = 0, tokenizer_path: str | None = None) -> None:
    """Writes docs (doc_id, text) as blocks in ascending doc_id order under path.

    Shards follow each other in id order, null ids first, ties in any order; a block has BLOCK ids
    or one document. Null and empty texts hold the end id alone. An empty table writes no blocks.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        ids, held, size, block = [], [], 0, 0

        def row() -> pa.RecordBatch:
            nonlocal ids, held, size, block
            out = pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "n_docs": [len(ids)], "n_ids": [size], "payload": pa.array([dump(ids, held)], pa.binary())}
            )
            ids, held, size, block = [], [], 0, block + 1
            return out

        for part in sliced(batches, "text", CHUNK):
            for doc, got in zip(part.column("doc_id").to_pylist(), encode.encode(part.column("text"), tokenizer, end, tokenizer_path)):
                ids.append(doc)
                held.append(got)
                size += len(got)
                if size >= BLOCK:
                    yield row()
        if ids:
            yield row()

    key = F.col("doc_id").asc_nulls_first()
    rows = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(docs.sparkSession), key).sortWithinPartitions(key)
    rows.mapInArrow(lambda x: released(blocks(x)), FILE).write.parquet(path)


def read(spark, path: str, end: int = 0) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and where it lies (shard, block)."""
    files = spark.read.schema(FILE).parquet(path)
    order = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = files.groupBy("shard").agg(F.sum("n_ids").alias("_n")).select("shard", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_block_start")).join(per_shard, "shard")
    starts = written(starts.select("shard", "block", (F.col("_shard_start") + F.col("_block_start")).alias("first")), "starts")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, payload in zip(*[batch.column(c).to_pylist() for c in ("shard", "block", "payload")]):
                block = Block(payload)
                ids = block.expand(block.symbols).tobytes()
                stops = np.cumsum(block.n)
                starts = stops - block.n
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard] * len(crc), pa.int32()),
                        "block": pa.array([number] * len(crc), pa.int32()),
                        "doc_id": pa.array(block.doc_ids, pa.int64()),
                        "within": starts,
                        "n_tokens": block.n,
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    docs = files.select("shard", "block", "payload").mapInArrow(decoded, "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def digest(documents: DataFrame) -> DataFrame:
    import uuid

    spark = documents.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(documents, path)
    return read(spark, path)
