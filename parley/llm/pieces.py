"""SentencePiece encoding and decoding: Viterbi over a trie of distinct marked words."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from .bytewords import Chunk, chunks, gather, hash_words, tidy, worker_model

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: How much worse than the worst piece an unknown character is.
UNKNOWN_PENALTY = 10.0
#: Scores by rank are multiples of 1 / GRID, so that sums are exact and equal ones tie.
GRID = 64
#: Words whose ids a worker keeps; longer words are not kept.
KEPT_WORDS, KEPT_BYTES = 200_000, 64
CHUNK = 1 << 20
#: Rows of a batch that are marked at once.
ROWS = 512


class Vocabulary:
    """Pieces of a model with a score each; a text falls into words that no piece crosses.

    ``scores``: "rank" gives each piece the log probability of its rank under
    Zipf's law (merge models have ranks, not probabilities); "stored" takes the
    scores in the file. A character without a piece becomes byte pieces.
    """

    def __init__(self, path: str = MODEL, scores: str = "rank"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(self.size)]
        normal = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        if scores == "rank":
            norm = math.log(sum(1 / (k + 2) for k in range(len(normal))))
            self.score = {i: round((-math.log(k + 2) - norm) * GRID) / GRID for k, i in enumerate(normal)}
        else:
            self.score = {i: model.get_score(i) for i in normal}
        self.piece = {self.names[i]: (i, self.score[i]) for i in normal}
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        # lengths of the pieces that end with a character
        lengths: dict[str, set[int]] = {}
        for name in self.piece:
            lengths.setdefault(name[-1], set()).add(len(name))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}
        self.text = [b""] * self.size
        for i in normal:
            self.text[i] = self.names[i].replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The best segmentation of each marked word (spaces stand for marks).

        The words are taken in sorted order, that is depth first through their
        trie: scores and back links of the common beginning of one word and the
        next are those already computed. Of equal scores the longer last piece wins.
        """
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[tuple[int, ...]] = [()] * len(words)
        best, back, ids = [0.0], [0], [-1]
        piece, lengths, unknown, last = self.piece.get, self.lengths.get, self.unknown, ""
        for k in order:
            word = words[k].replace(" ", MARK)
            n, same = min(len(word), len(last)), 0
            while same < n and word[same] == last[same]:
                same += 1
            del best[same + 1 :], back[same + 1 :], ids[same + 1 :]
            for e in range(same + 1, len(word) + 1):
                top, start, which, single = -math.inf, 0, -1, False
                for size in lengths(word[e - 1], ()):
                    if size > e:
                        break
                    hit = piece(word[e - size : e])
                    if hit is not None:
                        single = single or size == 1
                        if (s := best[e - size] + hit[1]) >= top:
                            top, start, which = s, e - size, hit[0]
                if not single and (s := best[e - 1] + unknown) > top:
                    top, start, which = s, e - 1, -1
                best.append(top), back.append(start), ids.append(which)
            last, e, found = word, len(word), []
            while e:
                if ids[e] < 0:
                    raw = (" " if word[e - 1] == MARK else word[e - 1]).encode()
                    found.extend(self.bytes[b] for b in reversed(raw))
                else:
                    found.append(ids[e])
                e = back[e]
            out[k] = tuple(reversed(found))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts in front goes."""
        raw = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


def split(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of marked words, and each document's first: runs of spaces with what follows; control bytes and literal marks apart.

    Each document of the chunk starts with the space put in front of it.
    """
    d, n = c.data[: c.size], c.size
    space, apart = d == 0x20, d < 0x20
    first = np.zeros(n + 1, dtype=bool)
    first[c.offsets] = True
    begin = first[:n].copy()
    if n:
        begin |= apart
        begin[1:] |= (space[1:] & ~space[:-1]) | apart[:-1]
        mark = np.flatnonzero((d[:-2] == 0xE2) & (d[1:-1] == 0x96) & (d[2:] == 0x81)) if n > 2 else np.zeros(0, np.int64)
        begin[mark] = True
        begin[(mark + 3)[mark + 3 < n]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, c.offsets)


class Encoder:
    """Encodes chunks of texts; ids of short words are kept by a worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.kept: dict[int, tuple[int, ...]] = {}

    def _ids(self, raw: bytes) -> tuple[int, ...] | None:
        if raw == MARK.encode() or (len(raw) == 1 and raw[0] < 0x20):
            return tuple(self.vocabulary.bytes[b] for b in raw)
        return None

    def chunk(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a chunk (with the space in front), and their offsets."""
        starts, ends, first = split(c)
        unique, at, back = np.unique(hash_words(c, starts, ends), return_index=True, return_inverse=True)
        raw = c.data.tobytes()
        lo, hi = starts[at].tolist(), ends[at].tolist()
        found = [self.kept.get(k) for k in unique.tolist()]
        new = [i for i, f in enumerate(found) if f is None]
        words = []
        for i in new:
            found[i] = self._ids(raw[lo[i] : hi[i]])
        new = [i for i in new if found[i] is None]
        words = [raw[lo[i] : hi[i]].decode() for i in new]
        for i, ids in zip(new, self.vocabulary.encode_words(words)):
            found[i] = ids
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
        keys = unique[new[:KEPT_WORDS]].tolist() if new else []
        self.kept.update((k, found[i]) for k, i in zip(keys, new) if hi[i] - lo[i] <= KEPT_BYTES)
        sizes = np.zeros(len(found) + 1, dtype=np.int64)
        np.cumsum([len(f) for f in found], out=sizes[1:])
        flat = np.fromiter((x for f in found for x in f), dtype=np.int32, count=int(sizes[-1]))
        ids, offsets = gather(flat, sizes, back)
        return ids, offsets[first]


def _encoder(path: str, scores: str) -> tuple[Encoder, np.ndarray, np.ndarray]:
    """An encoder for each Python worker, and the bytes of all pieces."""

    def make() -> tuple[Encoder, np.ndarray, np.ndarray]:
        v = Vocabulary(path, scores)
        sizes = np.zeros(v.size + 1, dtype=np.int64)
        np.cumsum([len(t) for t in v.text], out=sizes[1:])
        return Encoder(v), np.frombuffer(b"".join(v.text), dtype=np.uint8), sizes

    return worker_model(("pieces", path, scores), make)


def _encode(path: str, scores: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, letters, sizes = _encoder(path, scores)
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            column = batch.column(1).cast(pa.large_string())
            some = pc.fill_null(pc.not_equal(pc.binary_length(column), 0), False)
            marked = pc.if_else(some, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(column, ""), pa.scalar("", pa.large_string())), pa.scalar("", pa.large_string()))
            for c in chunks(marked, CHUNK, lower=False):
                ids, offsets = encoder.chunk(c)
                text, where = gather(letters, sizes, ids)
                where = where[offsets]
                crc_in = [zlib.crc32(c.data[a + 1 : b]) if b > a else 0 for a, b in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist())]
                crc_out = [zlib.crc32(text[a + 1 : b]) if b > a else 0 for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids)), pa.array(crc_in, pa.int64()), pa.array(crc_out, pa.int64())],
                    names=["doc_id", "n_tokens", "ids", "text_crc32", "decoded_crc32"],
                )

    return run


def encode_texts(docs: DataFrame, model: str = MODEL, scores: str = "rank") -> DataFrame:
    """doc_id, n_tokens, ids, text_crc32 and decoded_crc32 (of the text decoded from the ids) of every text.

    The encoding is lossless: tabs, line ends and literal marks become byte
    pieces, runs of spaces stay. A null or empty text has no ids (crc 0). Rows that
    repeat are encoded each; an empty table gives no rows; texts of any length are
    encoded whole; other columns, whatever their names, are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(_encode(model, scores)), f"doc_id {kind}, n_tokens long, ids array<int>, text_crc32 long, decoded_crc32 long")


def decode_texts(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of ids; null ids give a null text, none an empty one."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _encoder(model, "rank")[0].vocabulary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else v.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
