"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Texts are turned into chunks of word numbers once. Exact word counts come from all training
chunks and go back to each chunk for its own vocabulary. Bigram counts are summed by ranges of
their hash, quantised on a log scale, and level by level set in a Bloom filter: an n-gram of level q
is a member at every level up to q. Every bigram counts: there is a segment for each range, each
with bits for all its entries, and the number of ranges grows with the training tokens. A filter of
the whole corpus is thus too large to be broadcast; the probes of all chunks go to the range's task
together with the counts, in one shuffle. A count is read back by probing levels upward until one is
missing, and only levels go back to the chunks.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.common import id_fold, released, sliced, written

#: Bits an entry, probes a level, levels a doubling.
PER_ENTRY, PROBES, STEPS = 10, 4, 2
#: Bytes of text of a chunk, training tokens of a range of hashes.
CHUNK, RANGE = 24_000_000, 2_000_000
#: Share of the bigram estimate in a probability.
MIX = 0.2
CHUNKS = "chunk long, n_train long, doc_ids binary, flags binary, lens binary, stream binary, hashes binary, counts binary"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pairs(hashes: np.ndarray, stream: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A hash for each token and the one before it in its document; the end stands before the first."""
    own = hashes[stream]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum(lens) - lens] = hashes[0]
    return mix(before * np.uint64(3) + own)


def chunk_of(rows: list[tuple[int | None, bytes | None, bool]], chunk: int) -> dict:
    index: defaultdict = defaultdict(itertools.count().__next__)  # not its own length: a table that refers to itself stays long after
    index[b""]  # the end: number 0
    get, parts = index.__getitem__, []
    end = np.zeros(1, np.int32)
    for _, text, _held in rows:
        words = (text or b"").lower().split()
        parts += [np.fromiter(map(get, words), np.int32, len(words)), end]
    stream = np.concatenate(parts)
    lens = np.array([len(parts[k]) + 1 for k in range(0, len(parts), 2)], np.int32)
    held = np.array([x[2] for x in rows], bool)
    counts = np.bincount(stream[np.repeat(~held, lens)], minlength=len(index)).astype(np.int32)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
    ids = [x[0] for x in rows]
    return {
        "chunk": chunk,
        "n_train": int(counts.sum()),
        "doc_ids": np.array([0 if x is None else x for x in ids], np.int64).tobytes(),
        "flags": (held + 2 * np.array([x is None for x in ids], bool)).astype(np.uint8).tobytes(),
        "lens": lens.tobytes(),
        "stream": stream.tobytes(),
        "hashes": hashes.tobytes(),
        "counts": counts.tobytes(),
    }


def chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) as a written table of chunks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size, rows = TaskContext.get().partitionId(), 0, 0, []
        for batch in sliced(batches, "text", CHUNK // 8):
            for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "held_out")]):
                rows.append(row)
                size += len(row[1] or b"") + 16
                if size >= CHUNK:
                    yield pa.RecordBatch.from_pylist([chunk_of(rows, part << 32 | n)])
                    n, size, rows = n + 1, 0, []
        if rows:
            yield pa.RecordBatch.from_pylist([chunk_of(rows, part << 32 | n)])

    return written(docs.select("doc_id", F.col("text").cast("binary").alias("text"), "held_out").mapInArrow(lambda x: released(make(x)), CHUNKS), "chunks")


def word_counts(table: DataFrame) -> DataFrame:
    """For each chunk and range of words: places in its vocabulary, their counts in all training texts, and how many training words the range has."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, counts in zip(*[batch.column(c).to_pylist() for c in ("chunk", "hashes", "counts")]):
                h, c = np.frombuffer(hashes, np.int64), np.frombuffer(counts, np.int32)
                for at in range(0, len(h), 100_000):
                    n = len(h[at : at + 100_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[at : at + n]), pa.array(np.full(n, chunk)), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(c[at : at + n])], names=["h", "chunk", "place", "c"]
                    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk, place, c, new = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(chunk, kind="stable")
            chunk, place, c, new = chunk[order], place[order], c[order], new[order]
            cuts = np.flatnonzero(np.diff(chunk)) + 1
            for k, p, x, w in zip(np.split(chunk, cuts), np.split(place, cuts), np.split(c, cuts), np.split(new, cuts)):
                yield pa.RecordBatch.from_pylist(
                    [{"chunk": int(k[0]), "places": p.astype(np.int32).tobytes(), "totals": x.astype(np.int64).tobytes(), "n_words": int(w.sum())}]
                )

        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "place", "total", "new")])
            n += batch.num_rows
            if n >= 2_000_000:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    rows = table.select("chunk", "hashes", "counts").mapInArrow(entries, "h long, chunk long, place int, c int")
    w = Window.partitionBy("h")
    rows = rows.select(
        "chunk", "place", F.sum("c").over(w).alias("total"), ((F.row_number().over(w.orderBy("chunk")) == 1) & (F.sum("c").over(w) > 0)).cast("long").alias("new")
    )
    return written(rows.mapInArrow(packed, "chunk long, places binary, totals binary, n_words long"), "counts")


def levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64)


def spots(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """The bits of a level, one probe after another."""
    a = mix(keys + np.uint64(level * 2654435761 + 1))
    b = mix(a) | np.uint64(1)
    for _ in range(PROBES):
        yield (a % np.uint64(bits)).astype(np.int64)
        a = a + b


def segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The bits of a range's n-grams, in number by their entries: one for each n-gram and level."""
    q = levels(counts)
    bits = -(-int((q + 1).sum()) * PER_ENTRY // 64) * 64
    out = np.zeros(bits, bool)
    for level in range(int(q.max(initial=-1)) + 1):
        for spot in spots(keys[q >= level], level, bits):
            out[spot] = True
    return np.packbits(out).tobytes()


def found(keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Levels reached by probing a segment, counted from 1; 0 for what isn't held."""
    out, bits = np.zeros(len(keys), np.uint8), np.uint64(8 * len(segment))
    alive, level = np.arange(len(keys) if bits else 0), 0
    while len(alive) and level < 64 * STEPS:
        for k in range(PROBES):
            a = mix(keys[alive] + np.uint64(level * 2654435761 + 1))
            at = ((a + np.uint64(k) * (mix(a) | np.uint64(1))) % bits).astype(np.int64)
            alive = alive[(segment[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
        level += 1
        out[alive] = level
    return out


def count_of(reached: np.ndarray) -> np.ndarray:
    """Counts from levels: none, one, or the middle of the highest level reached."""
    return np.where(reached > 1, 2 ** ((reached - 0.5) / STEPS), reached.astype(float))


def located(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each key, and 40 bits below those of the range that tell keys apart."""
    bits = np.uint64(ranges.bit_length() - 1)
    part = (keys >> (np.uint64(64) - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    return part, (keys << bits) >> np.uint64(24)


def five_bytes(rest: np.ndarray) -> bytes:
    return rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_five(held: bytes) -> np.ndarray:
    out = np.zeros((len(held) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(held, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def probed_levels(table: DataFrame, ranges: int) -> DataFrame:
    """For each chunk and range: the levels of the chunk's distinct bigrams in order.

    A range's task gets each bigram once a chunk, with its training count there (0: held out only),
    builds the segment of the filter and probes it chunk by chunk.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, flags, lens, stream, hashes in zip(*[batch.column(c).to_pylist() for c in ("chunk", "flags", "lens", "stream", "hashes")]):
                train, lens = np.frombuffer(flags, np.uint8) & 1 == 0, np.frombuffer(lens, np.int32)
                key, at = np.unique(pairs(np.frombuffer(hashes, np.uint64), np.frombuffer(stream, np.int32), lens), return_inverse=True)
                n = np.bincount(at[np.repeat(train, lens)], minlength=len(key))
                part, rest = located(key, ranges)
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                spans = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[cuts[:-1]], pa.int64()),
                        pa.array([chunk] * len(spans), pa.int64()),
                        pa.array([five_bytes(rest[a:b]) for a, b in spans], pa.binary()),
                        pa.array([n[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
                    ],
                    names=["range", "chunk", "keys", "counts"],
                )

    def probed(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]])
        keys, at = np.unique(from_five(b"".join(pdf["keys"]))[n > 0], return_inverse=True)
        bits = np.frombuffer(segment(keys, np.bincount(at, weights=n[n > 0])), np.uint8)
        return pd.DataFrame({"chunk": pdf["chunk"], "range": pdf["range"], "levels": [found(from_five(x), bits).tobytes() for x in pdf["keys"]]})

    rows = table.select("chunk", "flags", "lens", "stream", "hashes").mapInArrow(lambda x: released(cut(x)), "range long, chunk long, keys binary, counts binary")
    return rows.groupBy("range").applyInPandas(probed, "chunk long, range long, levels binary")


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) to one row each: n_tokens, n_known, train_tokens, base_score, score.

    Words are split at ASCII blanks and lower-cased A-Z; an end follows each text, so null and
    empty texts have one token. Rows with the same id are scored each on their own. If every text
    is held out all words are unknown; an empty table gives no rows.
    """
    spark = docs.sparkSession
    table = chunks(docs)
    n_train = table.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n")).first()["n"]
    ranges = 1 << max(0, (max(1, n_train) // RANGE).bit_length())
    counts = word_counts(table)
    n_distinct = counts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    none = F.lit(None).cast("binary")
    sides = counts.select("chunk", "places", "totals", F.lit(None).cast("long").alias("range"), none.alias("levels")).unionByName(
        probed_levels(table, ranges).select("chunk", none.alias("places"), none.alias("totals"), "range", "levels")
    )
    below = np.log10(n_train + 0.5 * (n_distinct + 1))

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.to_dict("records"):
            stream, lens = np.frombuffer(row["stream"], np.int32), np.frombuffer(row["lens"], np.int32)
            hashes, flags = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["flags"], np.uint8)
            total = np.zeros(len(hashes), np.int64)
            known = right[right["places"].notna()]
            for places, totals in zip(known["places"], known["totals"]):
                total[np.frombuffer(places, np.int32)] = np.frombuffer(totals, np.int64)
            log_base = np.log10(total + 0.5) - below
            starts = np.cumsum(lens) - lens
            logs = np.empty(len(stream))
            distinct = np.unique(pairs(hashes, stream, lens))
            reached = np.frombuffer(b"".join(right[right["levels"].notna()].sort_values("range")["levels"]), np.uint8)
            # Documents in runs of about 500,000 tokens, to bound memory.
            runs = np.flatnonzero(np.diff(starts // 500_000, prepend=-1))
            for a, b in zip(runs, [*runs[1:], len(lens)]):
                lo, hi = starts[a], starts[b - 1] + lens[b - 1]
                key = pairs(hashes, stream[lo:hi], lens[a:b])
                seen = count_of(reached[np.searchsorted(distinct, key)])
                before = np.empty(hi - lo, np.int64)
                before[1:] = total[stream[lo : hi - 1]]
                before[starts[a:b] - lo] = total[0]
                single = 10 ** log_base[stream[lo:hi]]
                share = np.minimum(1.0, seen / np.maximum(before, 1))
                logs[lo:hi] = np.log10((1 - MIX) * single + MIX * np.where(before > 0, share, single))
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(np.frombuffer(row["doc_ids"], np.int64), dtype="Int64").copy(),
                        "_null": flags & 2 > 0,
                        "held_out": flags & 1 > 0,
                        "n_tokens": lens.astype(np.int64),
                        "n_known": np.add.reduceat((total > 0)[stream].astype(np.int64), starts),
                        "train_tokens": np.int64(n_train),
                        "base_score": np.add.reduceat(log_base[stream], starts),
                        "score": np.add.reduceat(logs, starts),
                    }
                )
            )
        return pd.concat(out)

    schema = "doc_id long, _null boolean, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = table.groupBy("chunk").cogroup(sides.groupBy("chunk")).applyInPandas(scored, schema)
    return rows.withColumn("doc_id", F.when(~F.col("_null"), F.col("doc_id"))).drop("_null")


def digest(documents: DataFrame) -> DataFrame:
    return score(documents.select("doc_id", "text", (id_fold(F.col("doc_id"), 5) == 1).alias("held_out")))
