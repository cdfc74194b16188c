"""Language identification: unigrams over a fixed vocabulary, summed over all segmentations."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import chunks, hash_words, tidy, worker_model

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of each language (in expectation) from which piece probabilities are learned.
SAMPLE = 400
EM_ROUNDS = 3
#: Added to the expected count of each piece.
SMOOTHING = 0.02
#: A longer word is learned in runs of so many bytes (scores take it whole).
RUN = 48
#: Words whose scores a worker keeps.
KEPT_WORDS = 400_000
UNKNOWN = "und"
#: Bases of the keys of pieces of up to 8 bytes (a key is the piece itself) and of longer ones (hits are compared).
_SHORT, _LONG = np.uint64(256), np.uint64(0x9E3779B97F4A7C15)

LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def pieces(path: str = VOCABULARY) -> list[bytes]:
    """All pieces of the vocabulary (a word's start is a space) and all single bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            found.add(model.id_to_piece(i).replace("▁", " ").encode())
    return sorted(found)


class Segments:
    """Finds the pieces that end at each place of many words at once."""

    def __init__(self, vocabulary: list[bytes]):
        self.size, self.longest = len(vocabulary), max(map(len, vocabulary))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(set(map(len, vocabulary))):
            ids = np.array([i for i, p in enumerate(vocabulary) if len(p) == n], dtype=np.int64)
            text = np.frombuffer(b"".join(vocabulary[i] for i in ids), dtype=np.uint8).reshape(len(ids), n)
            key = np.zeros(len(ids), dtype=np.uint64)
            for k in range(n - 1, -1, -1):
                key = key * (_SHORT if n <= 8 else _LONG) + text[:, k]
            if len(np.unique(key)) < len(key):
                raise ValueError(f"pieces of {n} bytes share a key")
            order = np.argsort(key, kind="stable")
            self.tables[n] = key[order], ids[order], text[order]

    def ending(self, words: np.ndarray, t: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, rows of ``words``, ids) for each length of piece that ends before position ``t``."""
        short, long = np.zeros(len(words), dtype=np.uint64), np.zeros(len(words), dtype=np.uint64)
        for n in range(1, min(self.longest, t) + 1):
            if n <= 8:
                short = short * _SHORT + words[:, t - n]
            if t > 8:
                long = long * _LONG + words[:, t - n]
            if n not in self.tables:
                continue
            keys, ids, text = self.tables[n]
            key = short if n <= 8 else long
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == key)
            if n > 8:
                hit = hit[(words[hit, t - n : t] == text[at[hit]]).all(axis=1)]
            if len(hit):
                yield t - n, hit, ids[at[hit]]

    def forward(self, words: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations, for each word and column of ``p``."""
        a = [np.ones((len(words), p.shape[1]))]
        scale = np.zeros((len(words), p.shape[1]))
        for t in range(1, words.shape[1] + 1):
            now = np.zeros(scale.shape)
            for s, rows, ids in self.ending(words, t):
                now[rows] += a[s][rows] * p[ids]
            a.append(now)
            if t > self.longest:
                a[t - self.longest - 1] = None
            if t % 16 == 0:
                scale += np.log(now)
                for k in range(max(0, t - self.longest), t + 1):
                    a[k] = a[k] / now
        return np.log(a[-1]) + scale

    def expected(self, words: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces in words that occur ``counts`` times in each language."""
        n = words.shape[1]
        found = [list(self.ending(words, t)) for t in range(n + 1)]
        a = [np.zeros((len(words), p.shape[1])) for _ in range(n + 1)]
        b = [np.zeros_like(a[0]) for _ in range(n + 1)]
        a[0] += 1
        b[n] += 1
        for t in range(1, n + 1):
            for s, rows, ids in found[t]:
                a[t][rows] += a[s][rows] * p[ids]
        for t in range(n, 0, -1):
            for s, rows, ids in found[t]:
                b[s][rows] += b[t][rows] * p[ids]
        total, out = np.maximum(a[n], 1e-300), np.zeros_like(p)
        for t in range(1, n + 1):
            for s, rows, ids in found[t]:
                share = a[s][rows] * p[ids] * b[t][rows] / total[rows] * counts[rows]
                for k in range(p.shape[1]):
                    out[:, k] += np.bincount(ids, share[:, k], minlength=self.size)
        return out


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and bytes of the words of each length, marked with a space in front."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for lo in range(0, len(rows), 1 << 15):
            part = rows[lo : lo + (1 << 15)]
            flat = np.frombuffer(b"".join(b" " + words[i] for i in part), dtype=np.uint8)
            yield part, flat.reshape(len(part), n + 1)


def train(docs: DataFrame, vocabulary: list[bytes], sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities with a column for each, by expectation maximisation.

    ``docs``: doc_id, text, lang. Each language gives about ``sample`` whole documents, chosen by a hash of the id.
    Words are those that scores have: runs of letters, lower-cased (A-Z).
    """
    known = docs.filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(vocabulary), 0))
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(sample / n)) for k, n in sizes.items()))
    taken = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) < share * 1_000_000)
    low = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.regexp_extract_all(low, F.lit(r"([a-z\x{80}-\x{10FFFF}]+)"), F.lit(1))
    rows = taken.select("lang", F.explode(words).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")).toPandas()
    column = {k: i for i, k in enumerate(langs)}
    found: dict[bytes, np.ndarray] = {}
    for lang, w, n in zip(rows["lang"], rows["w"], rows["n"]):
        raw = w.encode()
        for lo in range(0, len(raw), RUN):
            found.setdefault(raw[lo : lo + RUN], np.zeros(len(langs)))[column[lang]] += n
    words = sorted(found)
    counts = np.array([found[w] for w in words]).reshape(len(words), len(langs))
    seg, held = Segments(vocabulary), list(_by_length(words))
    p = np.full((len(vocabulary), len(langs)), 1 / len(vocabulary))
    for _ in range(EM_ROUNDS):
        got = sum((seg.expected(m, counts[i], p) for i, m in held), np.zeros_like(p)) + SMOOTHING
        p = got / got.sum(axis=0)
    return langs, p


class Scorer:
    """Scores words of any text; a worker keeps what it has scored."""

    def __init__(self, vocabulary: list[bytes], p: np.ndarray):
        self.segments, self.p = Segments(vocabulary), p
        self.where: dict[int, int] = {}
        self.held = np.zeros((KEPT_WORDS, p.shape[1]))

    def words(self, chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probabilities, a row for each word."""
        h = hash_words(chunk, starts, ends)
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        get = self.where.get
        at = np.array([get(k, -1) for k in unique.tolist()], dtype=np.int64)
        out = np.empty((len(unique), self.p.shape[1]))
        out[at >= 0] = self.held[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        raw = chunk.data.tobytes()
        lo, hi = starts[first[new]].tolist(), ends[first[new]].tolist()
        for rows, m in _by_length([raw[a:b] for a, b in zip(lo, hi)]):
            out[new[rows]] = self.segments.forward(m, self.p)
        if len(self.where) + len(new) > KEPT_WORDS:
            self.where.clear()
        keep = new[:KEPT_WORDS]
        n = len(self.where)
        self.held[n : n + len(keep)] = out[keep]
        self.where.update(zip(unique[keep].tolist(), range(n, n + len(keep))))
        return out[back]


def _scorer(model) -> Scorer:
    """One scorer for each Python worker and model."""
    key, vocabulary, p = model
    return worker_model(("langid", key), lambda: Scorer(vocabulary, p))


def _predict(shared, langs: list[str], carried: int):
    """Column 0 has the texts, the next ``carried`` ones are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in batches:
            texts = batch.column(0)
            for c in chunks(texts):
                starts, ends, first = c.words(LETTERS)
                n = np.diff(first)
                ascii_ = np.concatenate([[0], np.cumsum(LETTERS[c.data[: c.size]] & (c.data[: c.size] < 0x80))])
                letter = np.diff(ascii_[c.offsets]) > 0
                for i in np.flatnonzero(~letter & (n > 0)):
                    letter[i] = any(x.isalpha() for x in texts[c.first + int(i)].as_py())
                ll = np.zeros((len(starts) + 1, len(langs)))
                np.cumsum(scorer.words(c, starts, ends), axis=0, out=ll[1:])
                ll = ll[first[1:]] - ll[first[:-1]]
                # words of a text aren't independent: evidence counts as the root of their number
                z = ll / np.sqrt(np.maximum(n, 1))[:, None]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                best = z.argmax(axis=1)
                score = np.where(letter, z[np.arange(len(z)), best] / z.sum(axis=1), 0.0)
                names = np.where(letter, np.array(langs, dtype=object)[best], UNKNOWN)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(c.first, c.n) for k in range(1, carried + 1)), pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names[1 : carried + 1], "lang_pred", "score"]
                )

    return run


def identify(docs: DataFrame, training: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The id and ``carry``, lang_pred and score (posterior share, 0 to 1) of every row of ``docs``.

    ``training``: doc_id, text, lang. A null text, or one without a letter, is
    ``und`` with score 0; so is every text if nothing could be learned. Ties go
    to the language first by code point. The whole text counts. Words are runs of
    letters, lower-cased (A-Z). Rows that repeat are scored each; an empty table
    gives no rows; ``carry`` names the only other columns that are read. A run of
    thousands of letters without a space takes about a millisecond a letter.
    """
    v = pieces(vocabulary)
    langs, p = train(training, v, sample)
    kept = list(dict.fromkeys([id_col, *carry]))
    if not langs:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((hash(p.tobytes()), v, p))
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return docs.select(F.col(text_col).alias("_text"), *kept).mapInArrow(tidy(_predict(shared, langs, len(kept))), f"{kinds}lang_pred string, score double")


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def document_languages(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Languages of all documents, learned from those that aren't held out: doc_id, held_out, lang_pred, score."""
    rows = docs.select("doc_id", "text", "lang")
    out = identify(rows, rows.filter(~F.coalesce(held_out(), F.lit(True))), vocabulary)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
