"""Components of texts whose sets of word shingles have a Jaccard similarity of num/den or more.

Equal sets are one set. Shingles are ordered from rare to common; two similar sets share one of
their first shingles, so an index of those finds all pairs. The list of a shingle is sorted by
size, and blocks of it that differ too much in size, or whose places leave too few shingles after
it, are skipped. Within blocks, parity signatures bound the sets' differences from below.

Answers are shared between similar sets. First each set is compared with its nearest in the index
only, which links most groups to few hubs. Later rounds skip what those answers settle: pairs that
are already connected, and for a set at a known distance of its hub, all that the hub's own
bounds exclude by the triangle inequality of set differences.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from prefixlake.llm.common import cleared, in_small_batches, n_written, released, shuffle_partitions, sliced, written

#: Words of a shingle and similarity as a fraction, as op6 has them: the defaults of `linked` and `representatives`.
WORDS, NUM, DEN = 3, 90, 100
#: Bytes of text that are split at once; at most so many common shingles are told apart by how common they are.
CHUNK, HEAVY = 4_000_000, 1 << 16
#: Members of a list that meet in one task; longer lists are cut into blocks, and pairs of blocks dealt out.
LIST = 4096
#: Bits of a signature in the lists and, at least, of that of a set, and of the filter of sets that may have partners (8 MB, whatever the corpus).
SIG, LARGE, FILTER, SEGMENT = 256, 2048, 1 << 26, 1 << 18
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[bytes | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted hashes; fewer words than a shingle has are one, none are none."""
    # Numbers come from a count, not from the table's own length: a table that refers to itself stays until the collector's last generation runs.
    index: defaultdict = defaultdict(itertools.count().__next__)
    parts = []
    for text in texts:
        words = text.lower().split() if text else []
        parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
    words = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, index), _U, len(index)))
    del index
    stream = words[np.concatenate(parts)] if parts else words[:0]
    parts = [len(p) for p in parts]
    rolled = stream.copy()
    for step in range(1, n):
        if len(stream) > step:
            rolled[:-step] = mix(rolled[:-step] * _U(0x9E3779B97F4A7C15) + stream[step:])
    at = 0
    for p in parts:
        if p >= n:
            yield np.unique(rolled[at : at + p - n + 1])
        elif p:
            short = np.full(1, p, _U)
            for w in stream[at : at + p]:
                short = mix(short * _U(0x9E3779B97F4A7C15) + w)
            yield short
        else:
            yield stream[:0]
        at += p


def parity(tokens: np.ndarray, bits: int) -> bytes:
    """For each of `bits` classes of shingles whether the set has an odd number of them: sets differ at least as much as these do."""
    return np.packbits((np.bincount((tokens % _U(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide(size: int) -> int:
    """Bits of a set's larger signature: with fewer than shingles, any two long sets would seem to differ little."""
    return max(LARGE, 1 << (size - 1).bit_length()) if size else LARGE


def apart(a: bytes, b: bytes) -> int:
    """In how many classes two signatures differ; the wider one is folded, which adds up the parities of classes."""
    x, y = sorted((np.frombuffer(a, _U), np.frombuffer(b, _U)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def least_overlap(size: np.ndarray | int, num: int = NUM, den: int = DEN):
    """The least number of shingles that a set of this size shares with any similar one."""
    return -(-size * num // den)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches of at most CHUNK bytes of text (or one row) with their texts."""
    for part in sliced(batches, "_pl_text", CHUNK):
        yield part, part.column("_pl_text").to_pylist()


def common_shingles(texts: DataFrame, limit: int = HEAVY, words: int = WORDS) -> np.ndarray:
    """Hashes of common shingles, at most `limit`, from less to more common; they only set an order."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _texts(batches):
            found, n = np.unique(np.concatenate([*shingle_sets(part, words), np.zeros(0, _U)]), return_counts=True)
            keep = n >= max(4, len(part) // 500)
            yield pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

    counts = texts.mapInArrow(lambda x: released(local(x)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "token").limit(limit).collect()
    return np.array([r["token"] for r in reversed(rows)], np.int64).view(_U)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of all ids in edges (a, b long): the least id that each is connected to."""
    spark = edges.sparkSession
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    mark = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == mark or not state["n"]:
            break
        mark = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u").select("u", "v", "m")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pairs.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), name)
    own = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own) if mark else spark.createDataFrame([], "id long, component long")


def list_pairs(p: dict[str, np.ndarray], mode: str, cross: bool, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of one list: places of both, and a lower bound of their difference.

    p: sid, size, pos, sig (rows x 8 words), comp, hub, dist, half (which of two blocks, if cross).
    mode "nearest": each member's best; "each": each member's best of every other component; "all".
    """
    order = np.lexsort((p["pos"], p["size"]))
    size, pos, sig, comp, half = (p[c][order] for c in ("size", "pos", "sig", "comp", "half"))
    left = size - pos - 1
    n, out = len(order), []
    hub_rows = {}
    if mode != "nearest" and n > 64:
        where = {int(s): i for i, s in enumerate(p["sid"][order])}
        hubs = p["hub"][order]
        for h in np.unique(hubs):
            if int(h) in where:
                hub_rows[int(h)] = np.bitwise_count(sig ^ sig[where[int(h)]]).sum(axis=1, dtype=np.int64)
    dist = p["dist"][order]
    for at in range(0, n, 256):
        # Blocks of rows against the part of the list whose sizes can match; smaller sizes have been met before.
        rows = np.arange(at, min(n, at + 256))
        stop = int(np.searchsorted(size, size[rows[-1]] * den // num, "right"))
        for c0 in range(at, stop, 2048):
            cols = np.arange(c0, min(stop, c0 + 2048))
            if (1 + np.minimum(left[rows].max(), left[cols].max())) * (num + den) < num * (size[rows].min() + size[cols].min()):
                continue
            sums = size[rows][:, None] + size[cols][None, :]
            can = (cols[None, :] > rows[:, None]) & (comp[rows][:, None] != comp[cols][None, :])
            can &= (1 + np.minimum(left[rows][:, None], left[cols][None, :])) * (num + den) >= num * sums
            if cross:
                can &= half[rows][:, None] != half[cols][None, :]
            most = sums * (den - num) // (num + den)
            for i, r in enumerate(rows):
                bound = hub_rows.get(int(p["hub"][order[r]]))
                if bound is not None:
                    can[i] &= bound[cols] - dist[r] <= most[i]
            i, j = np.nonzero(can)
            if not len(i):
                continue
            low = np.bitwise_count(sig[rows[i]] ^ sig[cols[j]]).sum(axis=1, dtype=np.int64)
            keep = low <= most[i, j]
            out.append((rows[i[keep]], cols[j[keep]], low[keep]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    a, b, low = (np.concatenate(x) for x in zip(*out))
    if mode != "all":
        x, y, low = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([low, low])
        sids = p["sid"][order]
        group = comp[y] if mode == "each" else np.zeros(len(y), np.int64)
        by = np.lexsort((sids[y], low, group, x))
        first = np.append(True, (x[by][1:] != x[by][:-1]) | (group[by][1:] != group[by][:-1]))[: len(x)]
        a, b, low = x[by[first]], y[by[first]], low[by[first]]
    return order[a], order[b], low


def candidates(posts: DataFrame, mode: str, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b, low): pairs of sets that the lists of posts (token, n, sid, size, pos, sig, comp, hub, dist) can't exclude."""
    spark = posts.sparkSession
    blocks = F.expr(f"cast((n + {LIST} - 1) div {LIST} as int)")
    own = F.pmod(F.xxhash64("sid"), F.col("_blocks")).cast("int")
    dealt = posts.withColumn("_blocks", blocks).withColumn("half", own)
    # A list of k blocks makes a task of each pair of blocks, so its members go to k of them.
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select(
        "token", F.least("half", "_other").alias("b0"), F.greatest("half", "_other").alias("b1"), "half", "sid", "size", "pos", "sig", "comp", "hub", "dist"
    )
    keys = ["token", "b0", "b1"]
    dealt = dealt.repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            col = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("token", "b0", "b1", "half", "sid", "size", "pos", "comp", "hub", "dist")}
            col = {k: v.astype(np.int64) for k, v in col.items()}
            col["sig"] = np.frombuffer(b"".join(table.column("sig").to_pylist()), _U).reshape(-1, SIG // 64)
            cuts = np.flatnonzero((np.diff(col["token"]) != 0) | (np.diff(col["b0"]) != 0) | (np.diff(col["b1"]) != 0)) + 1
            edges = [0, *cuts.tolist(), table.num_rows]
            sizes = np.diff(edges)
            got = []
            # Lists of two, most of them, all at once.
            two = np.array(edges[:-1])[sizes == 2]
            if len(two):
                x, y = two, two + 1
                swap = col["size"][x] > col["size"][y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                sums = col["size"][x] + col["size"][y]
                shared = 1 + np.minimum(col["size"][x] - col["pos"][x], col["size"][y] - col["pos"][y]) - 1
                low = np.bitwise_count(col["sig"][x] ^ col["sig"][y]).sum(axis=1, dtype=np.int64)
                ok = (col["comp"][x] != col["comp"][y]) & (shared * (num + den) >= num * sums) & (low <= sums * (den - num) // (num + den))
                ok &= (col["b0"][x] == col["b1"][x]) | (col["half"][x] != col["half"][y])
                if mode == "all":
                    got.append((col["sid"][x[ok]], col["sid"][y[ok]], low[ok]))
                else:
                    got += [(col["sid"][x[ok]], col["sid"][y[ok]], low[ok]), (col["sid"][y[ok]], col["sid"][x[ok]], low[ok])]
            for k in np.flatnonzero(sizes > 2).tolist():
                part = {c: v[edges[k] : edges[k + 1]] for c, v in col.items()}
                a, b, low = list_pairs(part, mode, bool(part["b0"][0] != part["b1"][0]), num, den)
                got.append((part["sid"][a], part["sid"][b], low))
            if got:
                a, b, low = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(low)], names=["a", "b", "low"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 40_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            token = table.column("token").to_numpy()
            cut = int(np.searchsorted(token, token[-1], "left"))
            if cut:
                yield from solved(table.slice(0, cut))
                held = [table.slice(cut)]
            else:
                held = [table]
        if held:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()
            if table:
                yield from solved(table[0])

    found = dealt.mapInArrow(lambda x: released(meet(x)), "a long, b long, low long")
    if mode == "nearest":
        return found.groupBy("a").agg(F.min(F.struct("low", "b")).alias("x")).select("a", "x.b", "x.low")
    return found.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("low").alias("low")).select(F.col("x").alias("a"), F.col("y").alias("b"), "low")


def plausible(pairs: DataFrame, bounds: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Those of pairs (a, b) that larger signatures, bounds (sid, size, large), can't exclude either."""
    x = bounds.select(F.col("sid").alias("a"), F.col("size").alias("sa"), F.col("large").alias("la"))
    y = bounds.select(F.col("sid").alias("b"), F.col("size").alias("sb"), F.col("large").alias("lb"))
    rows = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "sa", "sb", "la", "lb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "la", CHUNK):
            low = np.fromiter(map(apart, batch.column("la").to_pylist(), batch.column("lb").to_pylist()), np.int64, batch.num_rows)
            most = (batch.column("sa").to_numpy() + batch.column("sb").to_numpy()) * (den - num) // (num + den)
            yield batch.select(["a", "b"]).filter(pa.array(low <= most))

    return rows.mapInArrow(lambda x: released(keep(x)), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b, dist) of the pairs that are similar, from sets (sid, tokens): dist is the size of their difference."""
    x = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    rows = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "ta", "tb")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "ta", CHUNK):
            out = []
            for a, b, ta, tb in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")]):
                both = np.concatenate([np.frombuffer(ta, _U), np.frombuffer(tb, _U)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if den * shared >= num * (len(both) - shared):
                    out.append((a, b, len(both) - 2 * shared))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b", "dist"])

    return rows.mapInArrow(lambda x: released(count(x)), "a long, b long, dist long")


def rows_of(table: DataFrame, rid: str, ids: DataFrame, name: str) -> DataFrame:
    """The rows of table whose number, column rid, is in that column of ids.

    Numbers go as masks of 64, about a quarter of a byte for each row of a dense range, so that Spark can
    broadcast those of many more rows before it shuffles the rows of table with their texts.
    """
    block, bit = F.shiftright(rid, 6).alias("_pl_block"), f"cast({rid} & 63 as int)"
    masks = written(ids.groupBy(block).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("_pl_mask")), name)
    found = table.withColumn("_pl_block", block).join(masks, "_pl_block")
    return found.where(f"(shiftright(_pl_mask, {bit}) & 1L) = 1L").drop("_pl_block", "_pl_mask")


def text_hash(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(text or b"") - (1 << 63)


def member_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size of the ids (sid): three bits each, made segment by segment."""
    n = FILTER // SEGMENT

    def segment(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SEGMENT, np.uint8)
        for x in _spots(pdf["sid"].to_numpy().astype(np.int64)):
            bits[x] = 1
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros((n, SEGMENT // 8), np.uint8)
    
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("sid").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array((mix(x.view(_U) + _U(5)) % _U(n)).astype(np.int64))], names=["sid", "segment"])

    ids = ids.mapInArrow(named, "sid long, segment long")
    for r in ids.groupBy("segment").applyInPandas(segment, "segment long, bits binary").toLocalIterator():  # FILTER bits in all
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _spots(ids: np.ndarray) -> list[np.ndarray]:
    h = mix(ids.view(_U) + _U(77))
    return [((h >> _U(s)) % _U(SEGMENT)).astype(np.int64) for s in (0, 20, 40)]


@in_small_batches
def grouped(docs: DataFrame, text: str = "text", keep_text: bool = False, words: int = WORDS, num: int = NUM, den: int = DEN) -> tuple[DataFrame, list[str], DataFrame]:
    """What `linked` joins: rows of docs with _pl_rid, _pl_size and _pl_fp (a hash of the set), the columns that they keep, and (_pl_fp, component_id, _pl_group)."""
    spark: SparkSession = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_shingles", "component_id") and (keep_text or c != text)]
    source = docs.select(*names, F.col(text).cast("binary").alias("_pl_text"))
    heavy = common_shingles(source.select("_pl_text"), words=words)
    by_hash = np.argsort(heavy)
    sent = spark.sparkContext.broadcast((heavy[by_hash], by_hash))  # HEAVY entries at most
    schema = StructType([docs.schema[c] for c in names])
    for c, kind in (("rid", "long"), ("fp", "binary"), ("size", "long"), ("first", "binary"), ("sig", "binary"), ("large", "binary"), ("hash", "long")):
        schema = schema.add(f"_pl_{c}", kind)
    arrow = to_arrow_schema(schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, rank = sent.value
        rid = TaskContext.get().partitionId() << 33
        for batch, texts in _texts(batches):
            cols: list[list] = [[] for _ in range(7)]
            sets = list(shingle_sets(texts, words))
            joined = np.concatenate([*sets, np.zeros(0, _U)])
            at = np.minimum(np.searchsorted(known, joined), max(0, len(known) - 1))
            grade = np.where(known[at] == joined, rank[at] + 1, 0) if len(known) else np.zeros(len(joined), np.int64)
            start = 0
            for s, text in zip(sets, texts):
                g = grade[start : start + len(s)]
                start += len(s)
                own = s[np.argsort(g, kind="stable")] if g.any() else s
                row = (rid, xxhash.xxh3_128_digest(s.tobytes()), len(s), own[: len(s) - least_overlap(len(s), num, den) + 1].tobytes(), parity(s, SIG), parity(s, wide(len(s))), text_hash(text))
                for c, x in zip(cols, row):
                    c.append(x)
                rid += 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).cast(arrow.field(c).type) for c in names], *[pa.array(c, arrow.field(len(names) + k).type) for k, c in enumerate(cols)]], schema=arrow
            )

    table = written(source.mapInArrow(lambda x: released(make(x)), schema), "sets")
    filled = table.where("_pl_size > 0")
    reps = filled.groupBy("_pl_fp").agg(F.min(F.struct("_pl_rid", "_pl_hash")).alias("x"), F.min("doc_id").alias("_pl_id"))
    reps = reps.select("_pl_fp", F.col("x._pl_rid").alias("sid"), F.col("x._pl_hash").alias("text_hash"), "_pl_id")
    reps = written(reps, "reps")
    heads = filled.select(F.col("_pl_rid").alias("sid"), F.col("_pl_size").alias("size"), F.col("_pl_first").alias("first"), F.col("_pl_sig").alias("sig"))
    firsts = rows_of(heads.select("sid", "first"), "sid", reps, "named")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [np.frombuffer(x, np.int64) for x in batch.column("first").to_pylist()]
            n = np.array([len(x) for x in first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*first, np.zeros(0, np.int64)])),
                    pa.array(np.repeat(batch.column("sid").to_numpy(), n)),
                    pa.array((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)),
                ],
                names=["token", "sid", "pos"],
            )

    made = n_written()
    light = written(firsts.mapInArrow(explode, "token long, sid long, pos int"), "firsts")
    counts = light.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    own = light.join(counts, "token").groupBy("sid").agg(F.collect_list(F.struct("token", "pos", "n")).alias("own"))  # of one set's first shingles
    # Sets with a first shingle that another has too.
    lists = written(heads.select("sid", "size", "sig").join(own, "sid"), "lists")
    cleared(spark, made, made + 1)  # the list of first shingles is read no more
    keys = ["sid", "size", "sig", "comp", "hub", "dist"]

    def posts(state: DataFrame) -> DataFrame:
        return state.select(*keys, F.explode("own").alias("x")).select("x.token", "x.n", "x.pos", *keys)

    bounds = filled.select(F.col("_pl_rid").alias("sid"), F.col("_pl_size").alias("size"), F.col("_pl_large").alias("large"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        """(sid, tokens) of the sets in pairs, made again from the texts: whole sets of all texts are never kept."""
        ids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        wanted = written(reps.join(ids, "sid").select("_pl_fp", "sid", "text_hash"), "wanted")
        members = spark.sparkContext.broadcast(member_filter(wanted.select(F.col("text_hash").alias("sid")).distinct()))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, texts in _texts(batches):
                hashes = np.array([text_hash(x) for x in texts], np.int64)
                keep = np.zeros(len(hashes), bool)
                keep[np.unique(hashes, return_index=True)[1]] = True
                seg = (mix(hashes.view(_U) + _U(5)) % _U(FILTER // SEGMENT)).astype(np.int64)
                for x in _spots(hashes):
                    keep &= (members.value[seg, x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1
                sets = list(shingle_sets([t for t, k in zip(texts, keep) if k], words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["_pl_fp", "tokens"]
                )

        made = source.select("_pl_text").mapInArrow(lambda x: released(whole(x)), "_pl_fp binary, tokens binary").groupBy("_pl_fp").agg(F.first("tokens").alias("tokens"))
        return written(made.join(wanted.select("_pl_fp", "sid"), "_pl_fp").select("sid", "tokens"), "members")

    near = groups = None
    todo = lists
    for mode in ("nearest", "each", "all"):
        if groups is None:
            state = todo.withColumns({"comp": F.col("sid"), "hub": F.lit(-1).cast("long"), "dist": F.lit(0).cast("long")})
        else:
            state = todo.join(groups.select(F.col("id").alias("sid"), "component"), "sid", "left").join(near, "sid", "left")
            state = state.withColumns({"comp": F.coalesce("component", "sid"), "hub": F.coalesce("hub", F.lit(-1)), "dist": F.coalesce("dist", F.lit(0))})
        made = n_written()
        pairs = written(candidates(posts(state), mode, num, den), "pairs")
        likely = written(plausible(pairs, bounds, num, den), "likely")
        links = written(verified(likely, sets_of(likely), num, den), "links")
        cleared(spark, made + 1, n_written() - 1)  # all that led from the pairs to the links
        if groups is None:
            near = links.select(F.col("a").alias("sid"), F.col("b").alias("hub"), "dist")
            groups = components(links, "groups")
            # Sets without any candidate have none later.
            todo = lists.join(pairs.select(F.col("a").alias("sid")), "sid", "left_semi")
            continue
        if not links.isEmpty():
            groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b")), "groups")
        # What may still be linked: the components of pairs that are not, unless each pair has been looked at.
        named = groups.select("id", "component")
        ends = pairs.join(named.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(named.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        ends = ends.select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
        open_ = ends.select(F.explode(F.array("ca", "cb")).alias("component")).distinct()
        own = lists.join(named.select(F.col("id").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        todo = own.join(open_, "component", "left_semi").drop("component")
    ids = reps.join(groups.select(F.col("id").alias("sid"), "component"), "sid", "left").select("_pl_fp", "_pl_id", F.coalesce("component", "sid").alias("component"))
    least = ids.groupBy("component").agg(F.min("_pl_id").alias("component_id"))
    ids = ids.join(least, "component").select("_pl_fp", "component_id", F.col("component").alias("_pl_group"))
    return table, names, ids


def linked(docs: DataFrame, text: str = "text", keep_text: bool = False, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs (doc_id, text, ...) with n_shingles and component_id, the least doc_id that links lead to.

    Linked are texts whose sets of shingles of `words` words have a Jaccard similarity of num/den or more.

    Null texts and those without words have no shingles and are their own component. Rows with the
    same text or the same set are linked, also those with the same doc_id; null ids count as no id.
    The text goes unless keep_text; _pl_rid numbers the rows, _pl_group the components. Columns of docs with the new names are replaced; an empty table
    stays empty. Shingles are told apart by 64-bit hashes, sets by 128-bit ones.
    """
    table, names, ids = grouped(docs, text, keep_text, words, num, den)
    out = table.select(*names, "_pl_fp", F.col("_pl_size").alias("n_shingles"), "_pl_rid")
    out = out.join(ids, "_pl_fp", "left")
    found = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(*names, "n_shingles", found.alias("component_id"), "_pl_rid", F.coalesce("_pl_group", -1 - F.col("_pl_rid")).alias("_pl_group"))


def representatives(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (a null id first), of repeated ids any one."""
    clash = {c: f"_pl_own_{c}" for c in docs.columns if c in ("n_shingles", "component_id")}
    table, _, ids = grouped(docs.withColumnsRenamed(clash), keep_text=True, words=words, num=num, den=den)
    # Rows are chosen by their numbers, so that texts are joined once and not written again.
    first = table.where("_pl_size > 0").select("_pl_fp", "doc_id", "_pl_rid").join(ids.select("_pl_fp", "_pl_group"), "_pl_fp")
    first = first.groupBy("_pl_group").agg(F.min(F.struct("doc_id", "_pl_rid")).alias("x")).select(F.col("x._pl_rid").alias("_pl_rid"))
    kept = first.unionByName(table.where("_pl_size = 0").select("_pl_rid"))
    return rows_of(table, "_pl_rid", kept, "kept").withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def digest(documents: DataFrame) -> DataFrame:
    return linked(documents.select("doc_id", "text"), words=WORDS, num=NUM, den=DEN).select("doc_id", "n_shingles", "component_id")
