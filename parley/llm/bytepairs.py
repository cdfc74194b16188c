"""Byte-level BPE encoding and decoding: each word's pair ranks in a segment tree over byte positions."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import gather, tidy, worker_model

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Words whose ids a worker keeps; longer words are not kept.
KEPT_WORDS, KEPT_BYTES = 200_000, 64
#: Characters of text encoded at once; a longer text is cut where words end whatever stands around.
CHUNK = 1 << 19
#: Words of up to so many bytes are merged many at once, tree by tree in the rows of one array.
SIDE_BY_SIDE = 64
#: Cells of such an array.
CELLS = 1 << 20
NONE = np.int64(1) << 62


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable ones for themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Merges:
    """A vocabulary: the bytes of each id, and the rank and product of each pair of ids that merges.

    ``whole``: a word that is a token itself is taken as it is.
    """

    def __init__(self, text: list[bytes], pairs: dict[tuple[int, int], int], made: np.ndarray, whole: dict[bytes, int]):
        self.text, self.made, self.whole, self.size = text, made, whole, len(text)
        self.single = np.zeros(256, dtype=np.int64)
        for i, t in enumerate(text):
            if len(t) == 1:
                self.single[t[0]] = i
        keys = np.array([a * self.size + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(pairs.values()), dtype=np.int64)[order]

    @classmethod
    def from_ranks(cls, path: str = RANKS) -> Merges:
        """From a file of base64 tokens with ranks: any two tokens whose bytes together are a token merge at its rank."""
        with open(path, "rb") as f:
            rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        text = [b""] * (max(rank.values()) + 1)
        pairs = {}
        for t, r in rank.items():
            text[r] = t
            for k in range(1, len(t)):
                a, b = rank.get(t[:k]), rank.get(t[k:])
                if a is not None and b is not None:
                    pairs[a, b] = r
        return cls(text, pairs, np.arange(len(text)), rank)

    @classmethod
    def from_json(cls, path: str) -> Merges:
        """From a file with a vocabulary and the list of its merges, in order."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letter = model["vocab"], byte_characters()
        text = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            text[i] = bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode()
        split = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = np.array([vocab[a + b] for a, b in split], dtype=np.int64)
        return cls(text, {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(split)}, made, {})

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE for those that don't merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


class Encoder:
    """Ids of words. A tree's leaves are byte positions, a leaf holds the rank of the pair that starts there; its root is the leftmost least one."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.merges, self.words = merges, regex.compile(pattern).findall
        self.kept: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[int, int] = {}

    def _side_by_side(self, words: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        """Words of at most ``leaves`` bytes (a power of two), all trees at once: a step merges one pair in every word that has one."""
        m, n, depth = self.merges, len(words), leaves.bit_length() - 1
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), dtype=np.uint8).reshape(n, leaves)
        place = np.arange(leaves)
        live = place < size[:, None]
        ids = np.where(live, m.single[raw], 0)
        # one column more than leaves: a token after the last one, that nothing reads
        after = np.minimum(np.tile(np.arange(1, leaves + 2), (n, 1)), size[:, None]).astype(np.int32)
        after = np.where(after < size[:, None], after, leaves).astype(np.int32)
        before = np.tile(np.arange(-1, leaves, dtype=np.int32), (n, 1))
        tree = np.full((n, 2 * leaves), NONE)
        first, second = np.nonzero(live[:, 1:])
        r = m.rank(ids[first, second], ids[first, second + 1])
        tree[first, leaves + second] = np.where(r < NONE, (r << depth) | second, NONE)
        for k in range(depth - 1, -1, -1):
            lo = 1 << k
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        flat = tree.reshape(-1)
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root, base = tree[rows, 1], rows * (2 * leaves)
            p = root & (leaves - 1)
            q = after[rows, p]
            r, o = after[rows, q], before[rows, p]
            ids[rows, p] = m.made[root >> depth]
            live[rows, q] = False
            after[rows, p] = r
            before[rows, r] = p
            flat[base + leaves + q] = NONE
            # the pairs with the token after and the token before are new
            for at, left, right in ((p, p, r), (o, o, p)):
                ok = np.flatnonzero((left >= 0) & (right < leaves))
                rank = m.rank(ids[rows[ok], left[ok]], ids[rows[ok], right[ok]])
                flat[base[ok] + leaves + at[ok]] = np.where(rank < NONE, (rank << depth) | at[ok], NONE)
            flat[(base + leaves + p)[r >= leaves]] = NONE
            nodes = [leaves + p, leaves + q, leaves + np.where(o < 0, p, o)]
            for _ in range(depth):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    flat[base + x] = np.minimum(flat[base + 2 * x], flat[base + 2 * x + 1])
            rows = rows[tree[rows, 1] < NONE]
        count, found = live.sum(axis=1), ids[live].tolist()
        ends = np.cumsum(count).tolist()
        return [tuple(found[e - c : e]) for e, c in zip(ends, count.tolist())]

    def _long(self, word: bytes) -> tuple[int, ...]:
        """One word of any length: a merge updates three leaves and their way to the root."""
        m, none = self.merges, int(NONE)
        if not self._pairs:
            self._pairs = dict(zip(m.keys.tolist(), m.ranks.tolist()))
        n, rank, size, made = len(word), self._pairs.get, m.size, m.made
        depth = max((n - 1).bit_length(), 1)
        leaves = 1 << depth
        ids = m.single[np.frombuffer(word, dtype=np.uint8)]
        tree = np.full(2 * leaves, NONE)
        r = m.rank(ids[:-1], ids[1:])
        tree[leaves : leaves + n - 1] = np.where(r < NONE, (r << depth) | np.arange(n - 1), NONE)
        for k in range(depth - 1, -1, -1):
            lo = 1 << k
            tree[lo : 2 * lo] = np.minimum(tree[2 * lo : 4 * lo : 2], tree[2 * lo + 1 : 4 * lo : 2])
        tree, ids, after, before = tree.tolist(), ids.tolist(), list(range(1, n + 1)), list(range(-1, n))

        def put(at: int, left: int, right: int) -> None:
            k = rank(ids[left] * size + ids[right]) if 0 <= left and right < n else None
            x = at + leaves
            tree[x] = none if k is None else (k << depth) | at
            while x > 1:
                x >>= 1
                a, b = tree[2 * x], tree[2 * x + 1]
                low = a if a < b else b
                if tree[x] == low:
                    break
                tree[x] = low

        while (root := tree[1]) < none:
            p = root & (leaves - 1)
            q = after[p]
            r = after[q]
            ids[p] = int(made[root >> depth])
            ids[q] = -1
            after[p] = r
            if r < n:
                before[r] = p
            put(q, -1, n)
            put(p, p, r)
            if before[p] >= 0:
                put(before[p], before[p], p)
        return tuple(i for i in ids if i >= 0)

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of distinct words (not empty), those of like lengths together."""
        out: list[tuple[int, ...]] = [()] * len(words)
        classes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            i = self.merges.whole.get(w)
            if i is not None:
                out[k] = (i,)
            elif len(w) > SIDE_BY_SIDE:
                out[k] = self._long(w)
            else:
                classes.setdefault(1 << max((len(w) - 1).bit_length(), 1), []).append(k)
        for leaves, which in classes.items():
            for lo in range(0, len(which), CELLS // leaves):
                part = which[lo : lo + CELLS // leaves]
                for k, ids in zip(part, self._side_by_side([words[k] for k in part], leaves)):
                    out[k] = ids
        return out

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in order, and each word's offset."""
        kept, distinct = self.kept, set(words)
        new = list(distinct.difference(kept))
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = list(distinct)
        ids = dict(zip(new, self.encode_words([w.encode() for w in new])))
        held = ids if not kept else kept | ids if len(ids) > KEPT_WORDS else kept
        if held is kept:
            kept.update(ids)
        got = list(map(held.__getitem__, words))
        offsets = np.zeros(len(got) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, got), dtype=np.int64, count=len(got)), out=offsets[1:])
        flat = np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(offsets[-1]))
        if held is kept:
            for w in ids:
                if len(w) > KEPT_BYTES:
                    kept.pop(w, None)
        elif len(ids) <= KEPT_WORDS:
            kept.update((w, i) for w, i in ids.items() if len(w) <= KEPT_BYTES)
        return flat, offsets

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's offset."""
        found = [list(chain.from_iterable(map(self.words, cuts(t)))) for t in texts]
        flat, ends = self._ids(list(chain.from_iterable(found)))
        return flat, ends[np.cumsum([0, *map(len, found)])]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for many short texts that begin with a space each: those that end in no white space are split into words as one text."""
        ends_blank = np.array([u[-1].isspace() for u in units], dtype=bool)
        order = np.argsort(ends_blank, kind="stable")
        n = len(units) - int(ends_blank.sum())
        size = np.array([len(units[i]) for i in order], dtype=np.int64)
        words = self.words("".join(units[i] for i in order[:n])) if n else []
        for i in order[n:]:
            words.extend(self.words(units[i]))
        flat, ends = self._ids(words)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))])
        first = ends[np.searchsorted(at, np.concatenate([[0], np.cumsum(size)]))]
        place = np.empty(len(units), dtype=np.int64)
        place[order] = np.arange(len(units))
        return gather(flat, first, place)


def cuts(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``size`` characters: a word always starts at a space that follows no white space, so parts end before one."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text):
            end = text.find(" ", end)
            if end < 0:
                end = len(text)
            elif text[end - 1].isspace():
                end += 1
                continue
            break
        yield text[at:end]
        at = end


def runs(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """First and end of rows whose texts together are of about ``size`` characters."""
    lo, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > size:
            yield lo, k
            lo, held = k, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def letters(text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes one after the other, and their offsets."""
    sizes = np.zeros(len(text) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in text], out=sizes[1:])
    return np.frombuffer(b"".join(text), dtype=np.uint8), sizes


def _model(path: str, pattern: str) -> tuple[Encoder, np.ndarray, np.ndarray]:
    def make() -> tuple[Encoder, np.ndarray, np.ndarray]:
        merges = Merges.from_ranks(path)
        return Encoder(merges, pattern), *letters(merges.text)

    return worker_model(("bytepairs", path, pattern), make)


def binary_array(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is empty, bytes that aren't UTF-8 become replacement characters."""
    return [(b or b"").decode("utf-8", "replace") for b in column.cast(pa.large_binary()).to_pylist()]


def _encode(path: str, pattern: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, text, sizes = _model(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = texts_of(batch.column(1))
                for lo, hi in runs(rows):
                    ids, offsets = encoder.encode(rows[lo:hi])
                    columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids))]
                    if decoded:
                        raw, where = gather(text, sizes, ids)
                        columns.append(binary_array(raw, where[offsets]))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return run


def encode_texts(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids of every row of ``docs``; with ``decoded`` also the bytes that the ids stand for.

    Each match of the pattern is encoded by itself: the pair of neighbouring
    tokens with the least rank merges, the leftmost of equal ones, until none is
    left. A null or empty text has no ids; special tokens' names are ordinary
    text. Texts of any length are encoded whole. Rows that repeat, also with the
    same id, are encoded each; an empty table gives none; other columns, whatever
    their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(_encode(ranks, pattern, decoded)), f"doc_id {kind}, n_tokens long, ids array<int>" + (", decoded binary" if decoded else ""))


def decode_texts(encoded: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id and text of rows of ids; null ids give a null text, none an empty one. Bytes that aren't UTF-8 become replacement characters."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _model(ranks, pattern)[0].merges.text
        for batch in batches:
            found = [None if x is None else b"".join(map(token.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, text string")


def encoded_digests(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 (of the decoded bytes) of every text."""
    rows = encode_texts(docs, ranks, decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
