"""Toxicity grades by cumulative-link regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, Chunk, chunks, hash_words, mix64, tidy
from .staging import stage

#: Labelled documents (in expectation) on which the model is fitted, and words it may use.
SAMPLE = 20_000
FEATURES = 2048
#: A word is a feature if the G statistic of its association with the label is at least this, and it occurs in so many documents.
LEAST_G, LEAST_DOCS = 12.0, 3
#: Bytes of the word beginnings that are features too: they stand for a word's forms. Whole words are features as well, and whole texts are read.
PREFIXES = (5, 6, 7)
GRADES = 4
RIDGE = 0.05
ROUNDS = 300


def _hashed(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Features in text order, and each document's first: every word, and the beginnings of longer words."""
    starts, ends, first = c.words(ALNUM)
    whole, lane, size = hash_words(c, starts, ends), c.lanes()[starts], ends - starts
    all_, doc = [whole], [np.repeat(np.arange(c.n), np.diff(first))]
    for k in PREFIXES:
        long = size > k
        all_.append(mix64((lane[long] & np.uint64((1 << 8 * k) - 1)) ^ np.uint64(0x9E3779B97F4A7C15 + k)))
        doc.append(doc[0][long])
    doc = np.concatenate(doc)
    order = np.argsort(doc, kind="stable")
    return np.concatenate(all_)[order], np.searchsorted(doc[order], np.arange(c.n + 1))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic) once for each document and word."""
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for c in chunks(batch.column(0)):
            h, first = _hashed(c)
            for i in range(c.n):
                w = np.unique(h[first[i] : first[i + 1]])
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), toxic[c.first + i], np.int32))], names=["word", "toxic"])


def _select(sample: DataFrame, n_toxic: int, n_clean: int, features: int) -> np.ndarray:
    """Hashes of the words most associated with the label, sorted; at most ``features``."""
    df = sample.select("text", "toxic").mapInArrow(tidy(_vocabulary), "word long, toxic int").groupBy("word").agg(F.sum("toxic").cast("double").alias("t"), F.count("*").cast("double").alias("n"))
    df = df.filter(F.col("n") >= LEAST_DOCS)
    share, rest = n_toxic / (n_toxic + n_clean), n_clean / (n_toxic + n_clean)
    log = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    t, u = F.col("t"), F.col("n") - F.col("t")
    g = 2 * (log(t, F.col("n") * share) + log(u, F.col("n") * rest))
    # what the absence of the word adds
    at, au = F.lit(float(n_toxic)) - t, F.lit(float(n_clean)) - u
    m = at + au
    g = g + 2 * (log(at, m * share) + log(au, m * rest))
    top = df.select("word", g.alias("g")).filter(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "word").limit(features)
    return np.sort(top.toPandas()["word"].to_numpy(np.int64).view(np.uint64))


def _hits(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word among the features, or -1."""
    if not len(words):
        return np.full(len(h), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at, -1)


def _rows(words: np.ndarray):
    """Sparse rows: 1 + the log of the count of each feature that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0)):
                h, first = _hashed(c)
                at = _hits(h, words)
                cols, vals = [], []
                for i in range(c.n):
                    own = at[first[i] : first[i + 1]]
                    k, n = np.unique(own[own >= 0], return_counts=True)
                    cols.append(k), vals.append(1 + np.log(n))
                where = np.concatenate([[0], np.cumsum([len(k) for k in cols])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(c.first, c.n), pa.ListArray.from_arrays(where, pa.array(np.concatenate(cols).astype(np.int32))), pa.ListArray.from_arrays(where, pa.array(np.concatenate(vals).astype(np.float64)))],
                    names=["toxic", "cols", "vals"],
                )

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, width: int, grades: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights shared by all thresholds, and the thresholds: P(grade >= k) = sigmoid(x.w - theta_k).

    Penalised likelihood of the ordered grades; steps are scaled per coordinate (Adam).
    """
    n, w = len(grade), np.zeros(width)
    share = np.array([max(np.mean(grade >= k), 0.5 / max(n, 1)) for k in range(1, grades)])
    gaps = np.log(1 / np.minimum(share, 1 - 1e-3) - 1)
    raw = np.concatenate([gaps[:1], np.log(np.maximum(np.diff(gaps), 1e-3))])
    m, v = np.zeros(width + grades - 1), np.zeros(width + grades - 1)
    for step in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        eta = np.bincount(rows, vals * w[cols], minlength=n)
        high = np.where(grade > 0, _sigmoid(eta - theta[np.maximum(grade - 1, 0)]), 1.0)
        low = np.where(grade < grades - 1, _sigmoid(eta - theta[np.minimum(grade, grades - 2)]), 0.0)
        p = np.maximum(high - low, 1e-12)
        dh, dl = np.where(grade > 0, high * (1 - high), 0) / p, np.where(grade < grades - 1, low * (1 - low), 0) / p
        de = dh - dl
        gw = np.bincount(cols, vals * de[rows], minlength=width) - RIDGE * w
        gt = np.zeros(grades - 1)
        np.add.at(gt, np.maximum(grade - 1, 0), -dh * (grade > 0))
        np.add.at(gt, np.minimum(grade, grades - 2), dl * (grade < grades - 1))
        tail = np.cumsum(gt[::-1])[::-1]
        gr = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])])
        g = np.concatenate([gw, gr]) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, raw = w + move[:width], raw + move[width:]
    return w, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def grade_of(toxic: np.ndarray, strength: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Severity grades of labelled documents: 0 if not toxic, else 1 to grades - 1 by quantile of how many telling words they hold."""
    out = np.zeros(len(toxic), dtype=np.int64)
    if (toxic > 0).any():
        cut = np.quantile(strength[toxic > 0], np.arange(1, grades - 1) / (grades - 1))
        out[toxic > 0] = 1 + np.searchsorted(cut, strength[toxic > 0], side="left")
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Features (word hashes), weights and thresholds; None without labels of both kinds.

    About ``sample`` labelled ids, chosen by hash, are sent to the documents (their texts aren't shuffled).
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return None
    ids = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < 1_000_000 * sample / n)
    rows = docs.join(ids.hint("broadcast"), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = stage(rows, "toxicity-sample")
    n_toxic, n_all = (int(x or 0) for x in rows.agg(F.sum("toxic"), F.count("*")).first())
    if not n_toxic or n_toxic == n_all:
        return None
    words = _select(rows, n_toxic, n_all - n_toxic, features)
    got = rows.mapInArrow(tidy(_rows(words)), "toxic int, cols array<int>, vals array<double>").toArrow()
    toxic = got.column("toxic").to_numpy().astype(np.int64)
    cols, vals = (np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in got.column(k).chunks)]) for k in ("cols", "vals"))
    cols = cols.astype(np.int64)
    lens = np.array([len(x) for x in got.column("cols").to_pylist()])
    at = np.repeat(np.arange(len(lens)), lens)
    ratio = (np.bincount(cols, toxic[at], minlength=len(words)) + 0.5) / (np.bincount(cols, minlength=len(words)) + 1)
    telling = ratio[cols] > max(0.5, n_toxic / n_all)
    grade = grade_of(toxic, np.bincount(at[telling], np.exp(vals[telling] - 1), minlength=len(lens)))
    w, theta = fit(at, cols, vals, grade, len(words), GRADES)
    return words, w, theta


def _score(shared, carried: int):
    """Column 0 has the texts, the next ``carried`` ones are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w, theta = shared.value
        for batch in batches:
            for c in chunks(batch.column(0)):
                h, first = _hashed(c)
                at = _hits(h, words)
                here = np.flatnonzero(at >= 0)
                doc = np.searchsorted(first, here, side="right") - 1
                pair, n = np.unique(doc * max(len(words), 1) + at[here], return_counts=True)
                eta = np.bincount(pair // max(len(words), 1), (1 + np.log(n)) * w[pair % max(len(words), 1)], minlength=c.n) if len(pair) else np.zeros(c.n)
                above = _sigmoid(eta[:, None] - theta[None, :])
                most = np.concatenate([np.ones((c.n, 1)), above], axis=1) - np.concatenate([above, np.zeros((c.n, 1))], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(c.first, c.n) for k in range(1, carried + 1)), pa.array(above.sum(axis=1)), pa.array(most.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)],
                    names=[*batch.schema.names[1 : carried + 1], "severity", "grade", "p_toxic", "toxic"],
                )

    return run


def grade_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Severity of every document: the id and ``carry``, severity (expected grade, 0 to 3), grade (most probable), p_toxic, toxic (p_toxic >= 0.5).

    Words are lower-cased (A-Z) runs of letters, digits and bytes beyond ASCII, of
    the whole text; a null or empty text has none and gets the severity of a
    document without features. Without labels of both kinds all severities are 0.
    Rows that repeat are graded each; an empty table gives no rows; ``carry``
    names the only other columns that are read.
    """
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, sample, features)
    kept = list(dict.fromkeys([id_col, *carry]))
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return docs.select(F.col(text_col).alias("_text"), *kept).mapInArrow(tidy(_score(shared, len(kept))), f"{kinds}severity double, grade int, p_toxic double, toxic boolean")
