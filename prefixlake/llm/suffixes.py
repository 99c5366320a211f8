"""Removal of repeated byte strings by a sparse suffix array.

Of the suffixes of all texts only those at anchors are sorted: every window of LENGTH bytes has
one, its least K-gram by hash, so equal windows have equal anchors at equal places. Windows with
the same anchor form a run. Runs of a chunk with equal bytes are one entry, compared byte by byte.
Hashes serve as a filter: anchors that occur once, nearly all, end there. Of the rest each entry is
a suffix with what precedes its anchor: sampled splitters range-partition them by their leading
bytes, blocks of a bucket are sorted by multikey quicksort, the parts before the anchors (reversed)
too, and the common prefixes of neighbours in both orders tell which windows are repeats. Blocks
carry the last leading bytes over to the next one.
An anchor with too many entries (a phrase in a third of all texts) would make one hot bucket; its
windows are spread by two 64-bit hashes of their own instead.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from prefixlake.llm.common import released, shuffle_partitions, sliced, written

#: Bytes of a repeated string.
LENGTH = 200
#: Bytes of a chunk of documents and of a segment that is hashed at once; entries of a bucket.
CHUNK, SEGMENT, BUCKET = 4_000_000, 1 << 19, 200_000
#: Entries of an anchor within a chunk, and in all, beyond which its windows are spread.
LOCAL_HOT, HOT = 64, 1000
#: Suffixes of a block that is sorted at once.
BLOCK = 16384
FULL, SHIP, SPREAD = 1, 2, 4

_U = np.uint64
_BASE, _PLACE = 0x9E3779B97F4A7C15, _U((1 << 22) - 1)
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables() -> dict[str, np.ndarray]:
    """Random numbers of bytes (two sets), and powers of an odd base and of its inverse, modulo 2^64."""
    if not _TABLES:
        n = 2 * SEGMENT + 4096
        _TABLES["byte"] = mix(np.arange(1, 257, dtype=_U))
        _TABLES["other"] = mix(np.arange(1001, 1257, dtype=_U))
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
    return _TABLES


def segment_runs(data: np.ndarray, stops: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of joined documents that end at stops: each run's first window, windows, place of the anchor after the first, hash of the anchor and of the bytes."""
    t, n, w = _tables(), len(data), length - k + 1
    if n < length:
        return tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, _U, _U))
    sums = np.zeros(n + 1, _U)
    np.cumsum(t["byte"][data] * t["pow"][:n], out=sums[1:])
    gram = mix((sums[k:] - sums[:-k]) * t["inv"][: n - k + 1])
    value = (gram & ~_PLACE) | np.arange(len(gram), dtype=_U)
    padded = np.full(-(-len(value) // w) * w, ~_U(0))
    padded[: len(value)] = value
    block = padded.reshape(-1, w)
    windows = n - length + 1
    ahead = np.minimum.accumulate(block, axis=1).ravel()[w - 1 : w - 1 + windows]
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()[:windows]
    anchor = (np.minimum(ahead, behind) & _PLACE).astype(np.int64)
    good = np.ones(windows, bool)
    for stop in stops:
        good[max(0, stop - length + 1) : stop] = False
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])) + 1
    first = np.concatenate([[0], new])
    count = np.diff(np.append(first, windows))
    own = good[first]
    first, count = first[own], count[own]
    at = anchor[first]
    off = at - first
    whole = (sums[first + count - 1 + length] - sums[first]) * t["inv"][first]
    return first, count, off, gram[at], mix(whole ^ ((off * 256 + count).astype(_U) * _U(_BASE)))


def chunk_runs(data: np.ndarray, lens: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """The same for a chunk: documents are joined up to SEGMENT bytes, longer ones cut into pieces that overlap."""
    stops, out, at = np.cumsum(lens), [], 0
    d = 0
    while d < len(lens):
        if lens[d] > SEGMENT:
            for p in range(0, int(lens[d]), SEGMENT):
                end = min(int(lens[d]), p + SEGMENT + length - 1)
                got = segment_runs(data[at + p : at + end], np.array([end - p]), length, k)
                out.append((got[0] + at + p, *got[1:]))
            at, d = int(stops[d]), d + 1
            continue
        e = max(d + 1, int(np.searchsorted(stops, at + SEGMENT, "right")))
        while e > d + 1 and lens[e - 1] > SEGMENT:
            e -= 1
        got = segment_runs(data[at : stops[e - 1]], stops[d:e] - at, length, k)
        out.append((got[0] + at, *got[1:]))
        at, d = int(stops[e - 1]), e
    return tuple(np.concatenate(x) for x in zip(*out))


def entries_of(data: np.ndarray, first: np.ndarray, count: np.ndarray, anchors: np.ndarray, contents: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a chunk's distinct runs in order, how often each run occurs (2: more than once), and each run's place among them; 255 marks an anchor with too many, once."""
    if not len(anchors):
        return anchors, np.zeros(0, np.uint8), np.zeros(0, np.int32)
    while True:
        order = np.lexsort((contents, anchors))
        a, c = anchors[order], contents[order]
        new_a = np.append(True, a[1:] != a[:-1])
        new = new_a | np.append(True, c[1:] != c[:-1])
        group = np.cumsum(new_a) - 1
        hot = np.bincount(group, weights=new)[group] > LOCAL_HOT
        # Runs that hashes call equal are compared; one that differs from the first goes under a hash of its own.
        like = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        check = np.flatnonzero(~new & ~hot)
        odd = []
        for at in range(0, len(check), 4096):
            x, y = order[check[at : at + 4096]], like[check[at : at + 4096]]
            n = count[x] + length - 1
            step = np.arange(int(n.max()))
            same = data[np.minimum(first[x][:, None] + step, len(data) - 1)] == data[np.minimum(first[y][:, None] + step, len(data) - 1)]
            odd.append(x[(count[x] != count[y]) | ~(same | (step >= n[:, None])).all(axis=1)])
        odd = np.concatenate([*odd, np.zeros(0, np.int64)])
        if not len(odd):
            break
        contents = contents.copy()
        contents[odd] = mix(contents[odd] + odd.astype(_U) + _U(1))
    new &= ~hot | new_a
    place = np.cumsum(new) - 1
    times = np.minimum(np.bincount(place), 2).astype(np.uint8)
    times[place[hot]] = 255
    back = np.empty(len(a), np.int32)
    back[order] = place
    return a[new], times, back


def window_hashes(data: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes for each window of some runs, one run after another."""
    t, out = _tables(), ([], [])
    for at in range(0, len(first), 4096):
        f, c = first[at : at + 4096], count[at : at + 4096]
        width = int(c.max()) - 1 + length
        index = np.minimum(f[:, None] + np.arange(width), len(data) - 1)
        keep = np.arange(int(c.max())) < c[:, None]
        for to, name in zip(out, ("byte", "other")):
            sums = np.zeros((len(f), width + 1), _U)
            np.cumsum(t[name][data[index]] * t["pow"][:width], axis=1, out=sums[:, 1:])
            to.append(mix((sums[:, length:] - sums[:, : -length]) * t["inv"][: width - length + 1])[keep])
    return tuple(np.concatenate(x) if x else np.zeros(0, _U) for x in out)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of big-endian words, all segments of a round at once.

    A segment's rows agree up to its depth. They are parted by the word there into those below, at
    and above a pivot, the median of three; those at the pivot go one word deeper. Returns the order
    and how many leading bytes each row in that order shares with the one before it.
    """
    n, deep = words.shape
    order, shared = np.arange(n), np.full(n, deep)
    shared[:1] = 0
    start, size, depth = np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n), np.zeros(min(n, 1), np.int64)
    while len(start):
        offset = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(start)), size)
        pos = np.arange(len(seg)) + (start - offset)[seg]
        rows = order[pos]
        key = words[rows, depth[seg]]
        a, b, c = key[offset], key[offset + size // 2], key[offset + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[seg]
        part = 3 * seg + (key >= pivot) + (key > pivot)
        found = np.bincount(part, minlength=3 * len(start))
        by = np.argsort(part.astype(np.uint16) if len(found) < 65536 else part, kind="stable")
        order[pos] = rows[by]
        first = pos[np.minimum(np.cumsum(found) - found, len(pos) - 1)]
        of, side = np.divmod(np.arange(len(found)), 3)
        edge = (found > 0) & (first > start[of])
        shared[first[edge]] = depth[of[edge]]
        deeper = depth[of] + (side == 1)
        on = (found > 1) & (deeper < deep)
        start, size, depth = first[on], found[on], deeper[on]
    lcp = shared * 8
    if n > 1:
        i = np.flatnonzero((np.arange(n) > 0) & (shared < deep))
        x = words[order[i], shared[i]] ^ words[order[i - 1], shared[i]]
        same = np.zeros(len(i), np.int64)
        for b in range(1, 8):
            same += (x >> _U(64 - 8 * b)) == 0
        lcp[i] += same
    return order, lcp


def _words(data: np.ndarray, at: np.ndarray, n: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of big-endian words: the n bytes from each place on, forward or (step -1) backward, then zeros up to the width."""
    out = np.zeros((len(at), -(-width // 8) * 8), np.uint8)
    ahead = np.arange(width)
    for k in range(0, len(at), 4096):
        spots = at[k : k + 4096, None] + step * ahead
        out[k : k + 4096, :width] = np.where(ahead < n[k : k + 4096, None], data[np.clip(spots, 0, max(0, len(data) - 1))], 0)
    return out.view(">u8").astype(_U)


def repeated_windows(data: np.ndarray, ends: np.ndarray, off: np.ndarray, count: np.ndarray, length: int, k: int) -> np.ndarray:
    """For runs (joined bytes that end at `ends`, place of the anchor, windows): which windows equal one of another run with the same anchor, as booleans (runs x the most windows)."""
    n, w = len(ends), length - k + 1
    starts = np.append(0, ends[:-1])
    order, lcp = multikey_sort(_words(data, starts + off, np.minimum(ends - starts - off, length), length, 1))
    back_order, back_lcp = multikey_sort(_words(data, starts + off - 1, off, max(1, w - 1), -1))
    out = np.zeros((n, w), bool)
    low, high = off - count + 1, off
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(w):
        # The window that begins j bytes before the anchor: rows alike in length - j bytes from there on and in j bytes before.
        rows = np.flatnonzero((low <= j) & (j <= high))
        if len(rows) < 2:
            continue
        right[order] = np.cumsum(lcp < length - j)
        left[back_order] = np.cumsum(back_lcp < j)
        key = right[rows] * (n + 1) + left[rows]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        dup = rows[by[np.append(same, False) | np.append(False, same)]]
        out[dup, off[dup] - j] = True
    return out


def _blocks(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(data, dtype)


def _by_chunk(chunks: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(chunk, its parts of the arrays); chunks need not be sorted."""
    order = np.argsort(chunks, kind="stable")
    chunks = chunks[order]
    cuts = np.flatnonzero(np.diff(chunks)) + 1
    for part in np.split(np.arange(len(chunks)), cuts):
        if len(part):
            yield int(chunks[part[0]]), *[a[order[part]] for a in arrays]


class _Chunk:
    """A chunk as read from its row."""

    def __init__(self, row: dict, length: int):
        self.data = _blocks(zstandard.decompress(row["blob"]) if row["blob"] else b"", np.uint8)
        self.lens = _blocks(row["lens"], np.int64)
        self.count = _blocks(row["counts"], np.uint8).astype(np.int64)
        self.off = _blocks(row["offs"], np.uint8).astype(np.int64)
        self.place = _blocks(row["places"], np.int32)
        stops = np.cumsum(self.lens)
        per_doc = np.maximum(self.lens - length + 1, 0)
        starts = np.cumsum(self.count) - self.count  # among all windows, of which a document's follow one another
        doc = np.searchsorted(np.cumsum(per_doc), starts, "right")
        self.first = starts + ((stops - self.lens) - (np.cumsum(per_doc) - per_doc))[doc] if len(starts) else starts
        self.codes = np.zeros(len(self.place), np.uint8)


TABLE = "chunk long, rest binary, lens binary, blob binary, counts binary, offs binary, places binary, anchors binary, times binary"
PAIRS = "bucket long, chunk long, first int, anchors binary, times binary"
FOUND = "chunk long, kind int, places binary, codes binary"
MOVED = "kind int, bucket long, chunk long, place int, off int, count int, lead binary, payload binary, other binary"


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, the text without what is removed.

    A byte goes if a string of `length` bytes covers it that also starts anywhere else, in the same
    text or another; all is judged on the input. Null texts are empty; texts shorter than `length`
    stay as they are; very long texts are cut into pieces that overlap; repeated rows remove each other;
    columns of docs with these names are replaced, all others stay; an empty table stays empty. With keep_text, a null text stays null, and a character
    of which a cut leaves a part goes wholly.
    """
    spark = docs.sparkSession
    if not 16 <= length <= 400:
        raise ValueError("length must be from 16 to 400")  # places within a run are single bytes
    k = max(8, length * 2 // 5)
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    names = [c for c in docs.columns if c != text and c not in new]
    rest_schema = StructType([docs.schema[c] for c in names])
    rest_arrow = to_arrow_schema(rest_schema)
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    bits = max(0, (total * 3 // length // BUCKET).bit_length())  # an entry each length / 3 bytes

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId() << 32, 0
        texts, rest, size = [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal number, texts, rest, size
            lens = np.array([len(x) if x is not None else 0 for x in texts], np.int64)
            blob = b"".join(x for x in texts if x)
            data = np.frombuffer(blob, np.uint8)
            first, count, off, anchors, contents = chunk_runs(data, lens, length, k)
            anchors, times, places = entries_of(data, first, count, anchors, contents, length)
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, rest_arrow.append(pa.field("_null", pa.bool_()))) as to:
                nulls, at = [x is None for x in texts], 0
                for b in rest:
                    to.write_batch(pa.RecordBatch.from_arrays([*b.columns, pa.array(nulls[at : at + b.num_rows])], schema=rest_arrow.append(pa.field("_null", pa.bool_()))))
                    at += b.num_rows
            out = {
                "chunk": part | number,
                "rest": zstandard.compress(sink.getvalue()),
                "lens": lens.tobytes(),
                "blob": zstandard.compress(blob),
                "counts": count.astype(np.uint8).tobytes(),
                "offs": off.astype(np.uint8).tobytes(),
                "places": places.tobytes(),
                "anchors": anchors.tobytes(),
                "times": times.tobytes(),
            }
            number, texts, rest, size = number + 1, [], [], 0
            return pa.RecordBatch.from_pylist([out])

        for some in sliced(batches, "_pl_text", CHUNK // 4):
            mine = some.column("_pl_text").to_pylist()
            texts += mine
            rest.append(pa.RecordBatch.from_arrays([some.column(c).cast(rest_arrow.field(c).type) for c in names], schema=rest_arrow) if names else pa.RecordBatch.from_arrays([], schema=rest_arrow))
            size += sum(len(x) for x in mine if x)
            if size >= CHUNK:
                yield row()
        if texts:
            yield row()

    table = written(docs.select(*names, F.col(text).cast("binary").alias("_pl_text")).mapInArrow(lambda x: released(make(x)), TABLE), "chunks")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                number, a, times = (batch.column(c)[at].as_py() for c in ("chunk", "anchors", "times"))
                a, times = _blocks(a, _U), _blocks(times, np.uint8)
                bucket = (a >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(a)] if len(a) else [0]
                parts = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cuts[:-1]], pa.int64()),
                        pa.array([number] * len(parts), pa.int64()),
                        pa.array(cuts[:-1], pa.int32()),
                        pa.array([a[x:y].tobytes() for x, y in parts], pa.binary()),
                        pa.array([times[x:y].tobytes() for x, y in parts], pa.binary()),
                    ],
                    names=["bucket", "chunk", "first", "anchors", "times"],
                )

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.array([len(x) for x in pdf["times"]])
        a = np.concatenate([_blocks(x, _U) for x in pdf["anchors"]])
        order = np.argsort(a)
        a = a[order]
        group = np.cumsum(np.append(True, a[1:] != a[:-1])) - 1
        times = np.concatenate([_blocks(x, np.uint8) for x in pdf["times"]])[order]
        entries = np.bincount(group)
        hot = (np.bincount(group, weights=times == 255) > 0) | (entries > HOT)
        many = np.bincount(group, weights=times) > 1
        code = np.where(hot[group], SPREAD, np.where(times == 2, FULL, 0) | np.where((entries > 1)[group], SHIP, 0)).astype(np.uint8)
        order = order[(code > 0) & many[group]]
        code = code[(code > 0) & many[group]]
        row = np.searchsorted(np.cumsum(n), order, "right")
        place = (order - (np.cumsum(n) - n)[row] + pdf["first"].to_numpy()[row]).astype(np.int32)
        return pd.DataFrame(
            [{"chunk": ch, "kind": 0, "places": p.tobytes(), "codes": x.tobytes()} for ch, p, x in _by_chunk(pdf["chunk"].to_numpy()[row], place, code)],
            columns=["chunk", "kind", "places", "codes"],
        )

    codes = table.select("chunk", "anchors", "times").mapInArrow(lambda x: released(pairs(x)), PAIRS)
    codes = written(codes.groupBy("bucket").applyInPandas(judge, FOUND), "codes")

    def spread_of(chunk: _Chunk) -> tuple[np.ndarray, ...]:
        """Hashes of the windows to spread, and of the distinct ones the order and each window's place there."""
        runs = np.flatnonzero(chunk.codes & SPREAD)
        one, two = window_hashes(chunk.data, chunk.first[runs], chunk.count[runs], length)
        order = np.lexsort((two, one))
        new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))[: len(one)]
        back = np.empty(len(one), np.int64)
        back[order] = np.cumsum(new) - 1
        starts = np.repeat(chunk.first[runs], chunk.count[runs]) + np.arange(len(one)) - np.repeat(np.cumsum(chunk.count[runs]) - chunk.count[runs], chunk.count[runs])
        return one[order][new], two[order][new], back, starts

    def coded(row: dict, found: pd.DataFrame) -> _Chunk:
        chunk = _Chunk(row, length)
        by_place = np.zeros(int(chunk.place.max(initial=-1)) + 1, np.uint8)
        for places, got in zip(found["places"][found["kind"] == 0], found["codes"][found["kind"] == 0]):
            by_place[_blocks(places, np.int32)] = _blocks(got, np.uint8)
        chunk.codes = by_place[chunk.place]
        return chunk

    def ship(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.to_dict("records"):
            chunk = coded(row, right)
            data = chunk.data.tobytes()
            sent = np.flatnonzero(chunk.codes & SHIP)
            sent = sent[np.unique(chunk.place[sent], return_index=True)[1]]
            for i in sent.tolist():
                f, n, o = int(chunk.first[i]), int(chunk.count[i]), int(chunk.off[i])
                out.append((0, None, row["chunk"], int(chunk.place[i]), o, n, data[f + o : f + o + k], data[f : f + n - 1 + length], None))
            one, two, back, _ = spread_of(chunk)
            if len(one):
                times = np.minimum(np.bincount(back), 2).astype(np.uint8)
                bucket = (one >> _U(64 - bits - 3)).astype(np.int64)
                for part in np.split(np.arange(len(one)), np.flatnonzero(np.diff(bucket)) + 1):
                    out.append((1, int(bucket[part[0]]), row["chunk"], int(part[0]), None, None, times[part].tobytes(), one[part].tobytes(), two[part].tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MOVED.split(", ")])

    moved = written(table.drop("rest", "anchors", "times").groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInPandas(ship, MOVED), "suffixes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: pa.RecordBatch) -> pa.RecordBatch:
            off, count, place, chunk = (rows.column(c).to_numpy() for c in ("off", "count", "place", "chunk"))
            payload = rows.column("payload").to_pylist()
            ends = np.cumsum([len(x) for x in payload])
            masks = np.packbits(repeated_windows(_blocks(b"".join(payload), np.uint8), ends, off.astype(np.int64), count.astype(np.int64), length, k), axis=1)
            keep = masks.any(axis=1)
            got = [{"chunk": c, "kind": 1, "places": p.tobytes(), "codes": m.tobytes()} for c, p, m in _by_chunk(chunk[keep], place[keep], masks[keep])]
            return pa.RecordBatch.from_pylist(got, schema=pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("places", pa.binary()), ("codes", pa.binary())]))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BLOCK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            # What begins like the last suffix may go on in the next block.
            lead, cut = rows.column("lead"), rows.num_rows
            while cut and lead[cut - 1].as_py() == lead[rows.num_rows - 1].as_py():
                cut -= 1
            if cut:
                yield solved(rows.slice(0, cut))
            held = [rows.slice(cut)]
        for rows in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
            yield solved(rows)

    suffixes = moved.where("kind = 0").select("lead", "payload", "off", "count", "chunk", "place")
    suffixes = suffixes.repartitionByRange(shuffle_partitions(spark), "lead").sortWithinPartitions("lead")
    masks = suffixes.mapInArrow(lambda x: released(compare(x)), FOUND)

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        one = np.concatenate([_blocks(x, _U) for x in pdf["payload"]])
        two = np.concatenate([_blocks(x, _U) for x in pdf["other"]])
        times = np.concatenate([_blocks(x, np.uint8) for x in pdf["lead"]]).astype(np.int64)
        n = np.array([len(x) for x in pdf["lead"]])
        chunk = np.repeat(pdf["chunk"].to_numpy(), n)
        place = np.concatenate([np.arange(f, f + m, dtype=np.int32) for f, m in zip(pdf["place"], n)])
        order = np.lexsort((two, one))
        group = np.cumsum(np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))) - 1
        keep = order[np.bincount(group, weights=times[order])[group] > 1]
        return pd.DataFrame([{"chunk": c, "kind": 2, "places": p.tobytes(), "codes": None} for c, p in _by_chunk(chunk[keep], place[keep])], columns=["chunk", "kind", "places", "codes"])

    spread = moved.where("kind = 1").select("bucket", "chunk", "place", "lead", "payload", "other").groupBy("bucket").applyInPandas(met, FOUND)
    found = written(codes.unionByName(masks).unionByName(spread), "found")

    added = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), *([(text, "string")] if keep_text else [])]
    schema = StructType(rest_schema.fields[:])
    for name, kind in added:
        schema = schema.add(name, kind)
    arrow_out = to_arrow_schema(schema)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found, parts = right.to_pandas(), []
        for row in left.to_pylist():
            chunk = coded(row, found)
            change = np.zeros(len(chunk.data) + 1, np.int32)
            runs = np.flatnonzero(chunk.codes & FULL)
            np.add.at(change, chunk.first[runs], 1)
            np.add.at(change, chunk.first[runs] + chunk.count[runs] - 1 + length, -1)
            for places, got in zip(found["places"][found["kind"] == 1], found["codes"][found["kind"] == 1]):
                places = _blocks(places, np.int32)
                mask = np.unpackbits(_blocks(got, np.uint8).reshape(len(places), -1), axis=1)
                to = np.full(int(chunk.place.max()) + 1, -1)
                to[places] = np.arange(len(places))
                runs = np.flatnonzero(to[chunk.place] >= 0)
                r, w = np.nonzero(mask[to[chunk.place[runs]]])
                np.add.at(change, chunk.first[runs[r]] + w, 1)
                np.add.at(change, chunk.first[runs[r]] + w + length, -1)
            if (found["kind"] == 2).any():
                one, _, back, starts = spread_of(chunk)
                hit = np.zeros(len(one), bool)
                for places in found["places"][found["kind"] == 2]:
                    hit[_blocks(places, np.int32)] = True
                np.add.at(change, starts[hit[back]], 1)
                np.add.at(change, starts[hit[back]] + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            data, at, cols = chunk.data.tobytes(), 0, {name: [] for name, _ in added}
            rest = pa.ipc.open_stream(zstandard.decompress(row["rest"])).read_all()
            nulls = rest.column("_null").to_pylist()
            for n, null in zip(chunk.lens.tolist(), nulls):
                g = gone[at : at + n]
                m = int(g.sum())
                kept = data[at : at + n] if not m else chunk.data[at : at + n][~g].tobytes()
                cols["n_bytes"].append(n)
                cols["n_removed"].append(m)
                cols["n_spans"].append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if m else 0)
                cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    cols[text].append(None if null else kept.decode(errors="ignore"))
                at += n
            parts.append(pa.Table.from_arrays([*rest.drop_columns(["_null"]).columns, *[pa.array(cols[n], arrow_out.field(n).type) for n, _ in added]], schema=arrow_out))
        return pa.concat_tables(parts) if parts else arrow_out.empty_table()

    return table.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, schema)


def digest(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents.select("doc_id", "text"))
