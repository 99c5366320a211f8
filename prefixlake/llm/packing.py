"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows. A document's full windows go out at once; its
tail goes to the open window that it fits best. When none fits, the fullest is topped up with the
tail's first ids (unless its gap is below LEAST_PIECE) and emitted, and the rest is placed again.
What the partitions leave open is merged last, in groups of partitions, end to end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm import encode
from prefixlake.llm.common import released, sliced, written

LENGTH, OPEN, LEAST_PIECE = 2048, 16, 16
#: Bytes of text that are encoded at once.
CHUNK = 4_000_000
#: Partitions whose leftovers are merged with each other.
MERGED = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long, open_window int"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def placed(docs: Iterator[tuple[int | None, np.ndarray]], length: int = LENGTH, n_open: int = OPEN, least: int = LEAST_PIECE) -> Iterator[tuple]:
    """Pieces (doc, start, ids, doc tokens, sequence, offset); sequence None for what stays open, with the window's number last."""
    windows: list[list] = []  # [used, pieces]
    n_out = 0

    def emit(pieces: list) -> Iterator[tuple]:
        nonlocal n_out
        for doc, start, ids, total, offset in pieces:
            yield doc, start, ids, total, n_out, offset, None
        n_out += 1

    for doc, ids in docs:
        total, at = len(ids), 0
        while total - at >= length:
            yield from emit([(doc, at, ids[at : at + length], total, 0)])
            at += length
        while at < total:
            rest = total - at
            fits = [w for w in windows if length - w[0] >= rest]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(windows) < n_open:
                best = [0, []]
                windows.append(best)
            else:
                best = max(windows, key=lambda w: w[0])
                gap = length - best[0]
                if gap >= least:
                    best[1].append((doc, at, ids[at : at + gap], total, best[0]))
                    at += gap
                windows.remove(best)
                yield from emit(best[1])
                continue
            best[1].append((doc, at, ids[at:], total, best[0]))
            best[0] += rest
            at = total
            if best[0] == length:
                windows.remove(best)
                yield from emit(best[1])
    for k, (_, pieces) in enumerate(windows):
        for doc, start, ids, total, offset in pieces:
            yield doc, start, ids, total, None, offset, k


def _batch(rows: list[tuple], part: int, keep_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(cols[0], pa.int64()),
            pa.array(cols[1], pa.int64()),
            pa.array([len(x) for x in cols[2]], pa.int64()),
            pa.array([_crc(x) for x in cols[2]], pa.int64()),
            pa.array(cols[3], pa.int64()),
            pa.array([None if x is None else (part << 32) | x for x in cols[4]], pa.int64()),
            pa.array(cols[5], pa.int64()),
            pa.array([x.tobytes() if keep_ids or s is None else None for x, s in zip(cols[2], cols[4])], pa.binary()),
            pa.array([part] * len(rows), pa.int64()),
            pa.array(cols[6], pa.int32()),
        ],
        names=[c.split()[0] for c in PIECES.split(", ")],
    )


def pack(docs: DataFrame, tokenizer: str = encode.WORD_BPE, end: int = 1, length: int = LENGTH, keep_ids: bool = False, tokenizer_path: str | None = None) -> DataFrame:
    """One row a piece of docs (doc_id, text): its document, place there, crc, sequence and offset.

    With keep_ids, `ids` holds the piece's ids as little-endian unsigned 16-bit integers. Every
    document has its end id, so null and empty texts make one piece of one id. Rows with the same
    id are packed each on their own. An empty table gives no rows.
    """

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def docs_of() -> Iterator[tuple[int | None, np.ndarray]]:
            for some in sliced(batches, "text", CHUNK):
                yield from zip(some.column("doc_id").to_pylist(), encode.encode(some.column("text"), tokenizer, end, tokenizer_path))

        held = []
        for row in placed(docs_of(), length):
            held.append(row)
            if len(held) == 4096:
                yield _batch(held, part, keep_ids)
                held = []
        if held:
            yield _batch(held, part, keep_ids)

    pieces = written(docs.select("doc_id", "text").mapInArrow(lambda x: released(partition(x)), PIECES), "pieces")
    done = pieces.where("sequence_id is not null")
    left = pieces.where("sequence_id is null").withColumn("group", F.expr(f"part div {MERGED}"))
    before = Window.partitionBy("group").orderBy("part", "open_window", "offset").rowsBetween(Window.unboundedPreceding, -1)
    left = left.withColumn("at", F.coalesce(F.sum("length").over(before), F.lit(0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids, k = np.frombuffer(r["ids"], "<u2"), 0
                while k < len(ids):
                    spot = r["at"] + k
                    n = min(len(ids) - k, length - spot % length)
                    rows.append((r["doc_id"], r["start"] + k, ids[k : k + n], r["doc_tokens"], (1 << 30 | r["group"]) << 32 | spot // length, spot % length, None))
                    k += n
            if rows:
                yield _batch(rows, 0, keep_ids)

    merged = left.select("doc_id", "start", "doc_tokens", "ids", "group", "at").mapInArrow(cut, PIECES)
    return done.unionByName(merged).drop("part", "open_window", *([] if keep_ids else ["ids"]))


def digest(documents: DataFrame) -> DataFrame:
    return pack(documents)
