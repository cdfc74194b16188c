"""Quality scores: a Gaussian kernel over document statistics by random Fourier features, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, NOT_SPACE, Chunk, chunks, hash_words, mix64, sums
from .staging import stage

COSINES = 256
#: Width of the kernel in units of the standardised statistics.
WIDTH = 3.0
RIDGE = 1e-3
#: Bins of the raw score between which calibration is decided.
BINS = 1024
#: At most so many partial sums of normal equations reach the driver.
PARTIALS = 32
SEED = 7

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(0x61, 0x7B)]] = 1
_CLASS[[*range(0x41, 0x5B)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[ord(c) for c in "!"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[range(0x80, 0x100)] = 7
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 8
_CLASS[0x0A] = 9
_NOT_LINE = np.ones(256, dtype=bool)
_NOT_LINE[0x0A] = False
N_STATS = 24


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document: its number of distinct hashes, and the count of the commonest."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    key = mix64(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, doc[at], count)
    return np.bincount(doc[at], minlength=n).astype(float), most


def statistics(c: Chunk) -> np.ndarray:
    """A row of ``N_STATS`` numbers for each document of a chunk in its original case; all 0 for an empty one."""
    kind = _CLASS[c.data[: c.size]]
    size = np.diff(c.offsets).astype(float)
    each = np.stack([sums(kind == k, c.offsets) for k in range(10)], axis=1)
    share = each / np.maximum(size, 1)[:, None]
    starts, ends, first = c.words(NOT_SPACE)
    n = np.diff(first).astype(float)
    some = np.maximum(n, 1)
    length = (ends - starts).astype(float)
    last = c.data[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, np.uint8)
    low = Chunk(c.first, LOWER[c.data], c.offsets)
    distinct, most = _distinct(hash_words(low, starts, ends), first)
    ls, le, lf = c.words(_NOT_LINE)
    lines = np.diff(lf).astype(float)
    ld, lm = _distinct(hash_words(low, ls, le), lf)
    mean = sums(length, first) / some
    caps = (_CLASS[c.data[starts]] == 2) & (_CLASS[c.data[np.minimum(starts + 1, len(c.data) - 1)]] == 2) if len(starts) else np.zeros(0, bool)
    columns = [
        np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(sums(length**2, first) / some - mean**2, 0)), *share.T[1:],
        sums(_CLASS[last] == 6, first) / some, sums(_CLASS[last] == 5, first) / some, sums(_CLASS[last] == 4, first) / some, sums(caps, first) / some,
        distinct / some, most / some, np.log1p(lines), ld / np.maximum(lines, 1), lm / np.maximum(lines, 1), share[:, 2] / np.maximum(share[:, 1] + share[:, 2], 1e-9), sums(length > 20, first) / some,
    ]
    return np.where(size[:, None] > 0, np.stack(columns, axis=1), 0.0)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(1), lower=False):
            x = statistics(c)
            where = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.ListArray.from_arrays(where, pa.array(x.ravel()))], names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Features:
    """Standardised statistics as cosines of random directions, and a constant."""

    def __init__(self, mean: np.ndarray, dev: np.ndarray, width: float = WIDTH, cosines: int = COSINES):
        rng = np.random.default_rng(SEED)
        self.mean, self.dev = mean, dev
        self.w = rng.standard_normal((len(mean), cosines)) / width
        self.b = rng.uniform(0, 2 * np.pi, cosines)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.dev, -8, 8)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], axis=1)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sums to one."""
    total: list[np.ndarray] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            got = [np.frombuffer(v) for v in row]
            total = [t + g for t, g in zip(total, got)] if total else got
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()]) for t in total], names=["a", "b"])


def _equations(make: Features):
    """One row of sums for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(make.b) + 1
        a, b = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            f = make(_matrix(batch.column(0)))
            a += f.T @ f
            b += f.T @ batch.column(1).to_numpy().astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["a", "b"])

    return run


def _raw(make: Features, beta: np.ndarray, with_label: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = make(_matrix(batch.column(1))) @ beta
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["y" if with_label else "doc_id", "s"])

    return run


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means nearest to ``y`` with weights ``n``."""
    means, weights, spans = [], [], []
    for m, w in zip(y, n):
        means.append(m), weights.append(w), spans.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            m2, w2, s2 = means.pop(), weights.pop(), spans.pop()
            means[-1] = (means[-1] * weights[-1] + m2 * w2) / (weights[-1] + w2)
            weights[-1] += w2
            spans[-1] += s2
    return np.repeat(means, spans)


def train(known: DataFrame) -> tuple[Features, np.ndarray, np.ndarray, np.ndarray] | None:
    """Model from rows of x and y (0 or 1): features, ridge weights, and the calibration's knots.

    A third of the rows, by hash, is kept from the fit and calibrates it.
    """
    part = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(3))
    known = known.select("doc_id", "x", "y", (part == 0).alias("calibrate"))
    stats = known.select(*(F.struct(F.avg(F.col("x")[i]).alias("m"), F.stddev_pop(F.col("x")[i]).alias("d")).alias(f"s{i}") for i in range(N_STATS)), F.count("*").alias("n"), F.avg("y").alias("y")).first()
    if not stats["n"] or stats["y"] in (0.0, 1.0):
        return None
    mean = np.array([stats[f"s{i}"]["m"] for i in range(N_STATS)])
    dev = np.array([stats[f"s{i}"]["d"] for i in range(N_STATS)])
    make = Features(mean, np.where(dev > 1e-9, dev, 1.0))
    each = known.filter("not calibrate").select("x", "y").mapInArrow(_equations(make), "a binary, b binary")
    sums_ = each.repartition(PARTIALS).mapInArrow(_added, "a binary, b binary").toArrow()
    k = len(make.b) + 1
    a = sum((np.frombuffer(v.as_py()).reshape(k, k) for v in sums_.column("a")), np.zeros((k, k)))
    b = sum((np.frombuffer(v.as_py()) for v in sums_.column("b")), np.zeros(k))
    n = max(a[-1, -1], 1.0)
    beta = np.linalg.solve(a + RIDGE * n / len(make.b) * np.eye(k), b)
    scored = known.filter("calibrate").select("y", "x").mapInArrow(_raw(make, beta, True), "y int, s double")
    bins = F.least(F.greatest(F.floor((F.col("s") + 0.5) / 2 * BINS), F.lit(0)), F.lit(BINS - 1))
    rows = scored.groupBy(bins.alias("bin")).agg(F.sum("y").cast("double").alias("y"), F.count("*").cast("double").alias("n")).orderBy("bin").toPandas()
    if rows.empty:
        return make, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0])
    value = isotonic((rows["y"] / rows["n"]).to_numpy(), rows["n"].to_numpy())
    return make, beta, (rows["bin"].to_numpy(float) + 0.5) / BINS * 2 - 0.5, value


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, beta, knots, value = shared.value
        for batch in batches:
            s = make(_matrix(batch.column(1))) @ beta
            # a trace of the raw score tells equal calibrated scores apart
            p = np.interp(s, knots, value) * (1 - 1e-6) + 1e-6 * np.clip((s + 0.5) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(p, 0, 1))], names=["doc_id", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of every document.

    Statistics come from the whole text (null: empty) alone and are written once;
    labels meet these small rows, not the texts. Learned from labelled rows that
    aren't held out; a doc_id with several labels counts once for each. Without
    labels of both kinds every score is the constant 0.5. Rows that repeat are
    scored each; an empty table gives no rows; other columns, whatever their
    names, are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {kind}, x array<double>"), "quality-stats")
    known = rows.join(labels.filter("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id").filter(~held_out())
    known = stage(known, "quality-known")
    model = train(known)
    if model is None:
        return rows.select("doc_id", held_out().alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_score(shared), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
