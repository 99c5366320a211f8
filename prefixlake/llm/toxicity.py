"""Toxicity by a convolutional text classifier.

Words are embedded as the sum of hashed rows of the word and of its beginnings; filters of several
widths run over the whole text, each is max-pooled, and a logistic unit reads the pools. It is
trained in numpy on a bounded sample of labelled rows and sent to the workers. Scores read the
text alone; the decision compares them with a threshold calibrated for each language.
"""

from __future__ import annotations

import itertools
import pickle
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.common import id_fold, released, sliced, table

#: Rows of the table of embeddings and their width; filter widths and filters of each.
ROWS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 12
#: At most so many labelled rows of either class are fitted on, none with more characters.
SAMPLE, MAX_CHARS = 5000, 20_000
STEPS, BATCH, RATE, DECAY, ODDS = 500, 48, 0.005, 0.001, 0.25
#: Texts in which a row of the table must occur to be learned, and parts of the rows that are left out in turn for calibration.
SEEN, FOLDS = 3, 2
#: The threshold of languages with too few labels.
DEFAULT = 0.3
STRIP = ".,;:!?\"'()[]{}«»"
#: Bytes of text that are scored at once; words whose rows a worker keeps, about 40 MB.
CHUNK, KEPT = 1_000_000, 200_000
_CACHE: dict[str, bytes] = {}


def rows_of(word: str) -> tuple[int, ...]:
    """Rows of the table for a word (row 0 is blank): of itself and of its first 3, 4 and 5 characters."""
    return tuple(1 + xxhash.xxh32_intdigest(x.encode()) % (ROWS - 1) for x in ("=" + word, *(word[:n] if len(word) > n else "=" + word for n in (3, 4, 5))))


def indexed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as places in a list of words (0: padding; two before, two behind), each text's start, and the words' rows."""
    places: defaultdict = defaultdict(itertools.count(1).__next__)  # not its own length: a table that refers to itself stays long after
    get, pad = places.__getitem__, np.zeros(2, np.int32)
    parts, lens = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []
        lens[i] = len(words) + 4
        parts += [pad, np.fromiter(map(get, words), np.int32, len(words)), pad]
    if len(_CACHE) > KEPT:
        _CACHE.clear()
    for w in places:
        if w not in _CACHE:
            _CACHE[w] = struct.pack("<4i", *rows_of(w.strip(STRIP)))
    rows = np.frombuffer(b"".join([bytes(16), *map(_CACHE.__getitem__, places)]), "<i4").reshape(-1, 4)
    return np.concatenate(parts) if parts else pad[:0], np.cumsum(lens) - lens, rows


class Model:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.1, (ROWS, DIM)).astype(np.float32)
        self.table[0] = 0
        self.seen = np.zeros(ROWS, bool)
        self.filters = [r.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = np.abs(r.normal(0, 0.3, (len(WIDTHS), FILTERS))).astype(np.float32)
        self.base = np.full(1, -2, np.float32)
        self.scale = (1.0, 0.0)

    def _conv(self, e: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """Filter responses of the k-th width wherever it fits; x must end with padding."""
        n = len(x) - 2
        out = (e @ self.filters[k][0])[x[:n]]
        for step in range(1, WIDTHS[k]):
            out += (e @ self.filters[k][step])[x[step : step + n]]
        return out

    def logits(self, texts: list[str | None]) -> np.ndarray:
        x, starts, rows = indexed(texts)
        if not len(starts):
            return np.zeros(0)
        e = self.table[np.where(self.seen[rows], rows, 0)].sum(axis=1)
        out = np.full(len(starts), float(self.base[0]))
        x = np.append(x, np.zeros(2, np.int32))
        for k in range(len(WIDTHS)):
            pool = np.maximum.reduceat(self._conv(e, x, k), starts, axis=0)
            out += np.maximum(pool + self.bias[k], 0) @ self.out[k]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts) + b, -30, 30)))


def fit(sample: tuple[np.ndarray, np.ndarray, np.ndarray], own: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 3, steps: int = STEPS) -> Model:
    """A model of the texts `own` (places) of an indexed sample: Adam on the weighted log loss; gradients pass through the places of the maxima only.

    What one or two texts alone have is not learned: rows of the table in fewer than SEEN texts stay
    blank. The others start with the log-odds of their texts' classes in the first dimension; all
    share one step size, so that rare ones move little.
    """
    m, r = Model(seed), np.random.default_rng(seed)
    x, starts, rows = sample
    stops = np.append(starts[1:], len(x))
    n = np.array([(y[own] == c).sum() for c in (0, 1)])
    found = np.zeros((2, ROWS), np.int64)
    for i in own.tolist():
        found[int(y[i]), np.unique(rows[np.unique(x[starts[i] : stops[i]])])] += 1
    m.seen = found.sum(axis=0) >= SEEN
    m.seen[0] = False
    odds = np.log((found[1] + 1) / (n[1] + 2)) - np.log((found[0] + 1) / (n[0] + 2))
    m.table[:, 0] = np.where(m.seen, ODDS * odds, 0)
    m.filters[0][0, :, 0] = np.eye(DIM)[0]
    m.bias[0, 0], m.out[0, 0] = -2 * ODDS * 4, 1 / ODDS / 4
    rows = np.where(m.seen[rows], rows, 0)
    params = [*m.filters, m.bias, m.out, m.base]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    size, step = 1e-8, 0
    for _ in range(max(2, min(40, steps * BATCH // max(1, len(own))))):
        order = r.permutation(own)
        for at in range(0, len(order), BATCH):
            b = order[at : at + BATCH]
            words, xs = np.unique(np.concatenate([*[x[starts[i] : stops[i]] for i in b], x[:2] * 0]), return_inverse=True)
            at_, to_ = np.cumsum(stops[b] - starts[b]) - (stops[b] - starts[b]), np.cumsum(stops[b] - starts[b])
            own_rows = rows[words]
            e = m.table[own_rows].sum(axis=1)
            spots, pools = [], []
            logit = np.full(len(b), m.base[0])
            for k in range(len(WIDTHS)):
                conv = m._conv(e, xs, k)
                spot = np.stack([s + conv[s:t].argmax(axis=0) for s, t in zip(at_, to_)])
                pool = np.maximum(np.take_along_axis(conv, spot, axis=0) + m.bias[k], 0)
                logit = logit + pool @ m.out[k]
                spots.append(spot)
                pools.append(pool)
            g = ((1 / (1 + np.exp(-logit)) - y[b]) * weight[b] / len(b)).astype(np.float32)
            grads = [np.zeros_like(p) for p in params]
            d_e = np.zeros_like(e)
            for k, w in enumerate(WIDTHS):
                grads[-2][k] = g @ pools[k]
                d = g[:, None] * m.out[k] * (pools[k] > 0)
                grads[-3][k] = d.sum(axis=0)
                column = np.broadcast_to(np.arange(FILTERS), d.shape)
                for s in range(w):
                    d_p = np.zeros((len(e), FILTERS), np.float32)
                    np.add.at(d_p, (xs[spots[k] + s], column), d)
                    grads[k][s] = e.T @ d_p
                    d_e += d_p @ m.filters[k][s].T
            grads[-1][0] = g.sum()
            step += 1
            used = np.flatnonzero(d_e.any(axis=1))
            size += 0.05 * (float((d_e[used] ** 2).mean()) - size) if len(used) else 0
            np.add.at(m.table, own_rows[used], (-RATE / 4 / np.sqrt(size)) * d_e[used][:, None, :])
            m.table[0] = 0
            for k, (p, d, (a, v)) in enumerate(zip(params, grads, moments)):
                a += 0.1 * (d - a)
                v += 0.01 * (d * d - v)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                if k < len(WIDTHS):
                    p *= 1 - DECAY
    return m


def calibrated(m: Model, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Sets scale so that scores are probabilities (Platt, with a mild prior); z: logits of rows by models not fitted on them."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p) + 1e-9
        ga, gb = (g * z).sum() + (a - 1), g.sum() + 0.1 * b
        haa, hab, hbb = (h * z * z).sum() + 1, (h * z).sum(), h.sum() + 0.1
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(0.05, a - 0.5 * da), b - 0.5 * db
    m.scale = (float(a), float(b))


def thresholds(scores: np.ndarray, y: np.ndarray, weight: np.ndarray, langs: list[str | None], least: int = 20) -> dict[str | None, float]:
    """For each language with enough labels of both classes, the cut with the best F1: the one nearest to DEFAULT of those as good."""
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        s, t, w = scores[own], y[own] == 1, weight[own]
        if min(t.sum(), (~t).sum()) < least:
            continue
        cuts = np.unique(np.append(np.round(s, 4), DEFAULT))
        cuts = np.unique(np.append((cuts[1:] + cuts[:-1]) / 2, DEFAULT))
        f1 = [2 * w[t & (s >= c)].sum() / max(1e-9, w[t].sum() + w[s >= c].sum()) for c in cuts]
        good = cuts[np.array(f1) >= max(f1) - 1e-12]
        out[lang] = float(good[np.abs(good - DEFAULT).argmin()])
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> tuple[Model, dict[str | None, float]]:
    """A model and thresholds from docs (doc_id, text, lang) and labels (doc_id, toxic), labels of the held-out fold not among them.

    The sample holds at most `sample` rows of either class, those of the least hashes among texts of
    up to max_chars, weighted back to the classes' counts. Null labels, and labels other than 0 and
    1, teach nothing. Without labels of both classes all scores are alike.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.where(id_fold(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    short = docs.where(F.length(F.coalesce("text", F.lit(""))) <= max_chars)
    hashed = known.join(short.select("doc_id"), "doc_id", "left_semi").withColumn("_pl_h", F.xxhash64("doc_id"))
    parts = [hashed.where(F.col("toxic") == y).orderBy("_pl_h", "doc_id").limit(sample) for y in (0, 1)]
    few = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * sample ids at most
    rows = short.select("doc_id", "text", "lang").join(few, "doc_id")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["_pl_h"], r["text"] or ""))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(_learned(got, counts))], pa.binary())})

    one = rows.repartition(1)  # the bounded sample: one task fits it
    got = one.mapInArrow(lambda x: released(train(x)), "model binary").first()  # None if there are no rows at all
    return pickle.loads(got["model"]) if got else (Model(), {})


def _learned(got: list[dict], counts: dict[int, int]) -> tuple[Model, dict[str | None, float]]:
    y = np.array([r["toxic"] for r in got], np.float64)
    if len(got) < 20 or y.min() == y.max():
        return Model(), {}
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.array([counts[0] / n[0], counts[1] / n[1]])[y.astype(int)]
    weight /= weight.mean()
    texts = [r["text"] or "" for r in got]
    sample = indexed(texts)
    z, fold = np.zeros(len(got)), np.arange(len(got)) % FOLDS
    for k in range(FOLDS):
        own = np.flatnonzero(fold == k)
        z[own] = _in_parts(fit(sample, np.flatnonzero(fold != k), y, weight).logits, [texts[i] for i in own])
    m = fit(sample, np.arange(len(got)), y, weight)
    calibrated(m, z, y, weight)
    a, b = m.scale
    return m, thresholds(1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))), y, weight, [r["lang"] for r in got])


def _in_parts(f, texts: list[str]) -> np.ndarray:
    return np.concatenate([f(texts[at : at + 128]) for at in range(0, len(texts), 128)] or [np.zeros(0)])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with tox_score (0 to 1) of the whole text; null and empty texts get the score of no words. A column of that name is replaced.

    Texts are scored in slices of CHUNK bytes or one text, so very long ones take memory in proportion to their own length.
    """
    docs = docs.drop("tox_score")
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", CHUNK):
            got = sent.value.scores(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*names, "tox_score"])

    return docs.mapInArrow(lambda x: released(score(x)), docs.withColumn("tox_score", F.lit(0.0)).schema)


def rejected(cuts: dict[str | None, float], score: Column, lang: Column) -> Column:
    """Whether a score reaches its language's threshold; null and unknown languages have DEFAULT."""
    out = F.lit(DEFAULT)
    for name, cut in cuts.items():
        out = F.when(lang == name, F.lit(cut)).otherwise(out)
    return score >= out


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose score reaches the threshold of their language. A column tox_score of docs stays as it is."""
    model, cuts = learn(docs, labels)
    names = docs.columns
    aside = docs.withColumnsRenamed({c: f"_pl_own_{c}" for c in names if c == "tox_score"})
    kept = scored(aside, model)
    kept = kept.where(~rejected(cuts, F.col("tox_score"), F.col("lang"))).drop("tox_score")
    return kept.withColumnsRenamed({f"_pl_own_{c}": c for c in names}).select(*names)


def digest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model, cuts = learn(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select(
        "doc_id",
        (id_fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.3).cast("int").alias("predicted"),
        rejected(cuts, F.col("tox_score"), F.col("lang")).alias("rejected"),
    )
