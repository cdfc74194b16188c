"""Alignment of two tokenizers: groups and links of tokens over the same bytes, by array functions after tokenising."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytepairs import Encoder, Merges, letters, texts_of
from .bytewords import Chunk, chunks, gather, hash_words, tidy, worker_model
from .staging import discard, stage

PAIRS = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: A pair of ids is hot if more than one in HOT of all links is of it; so there are fewer than HOT hot pairs, which go to every task.
HOT = 1 << 17
#: Bytes of text of a row of units, rows of a batch that are read at once, and tokens whose units a worker keeps.
CHUNK, ROWS, KEPT = 1 << 19, 512, 3 << 20
#: Bytes of a batch that goes to a worker, as rows of units are large.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 21))
UNITS = ("doc_id", "docs", "units", "a_ids", "a_ends", "b_ids", "b_ends", "bounds")
PARTS = ("a_ids", "a_ends", "b_ids", "b_ends")


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each id: byte pieces their byte, others their characters with a mark as a space."""
    return [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(MARK, " ").encode() for i, name in ((i, model.id_to_piece(i)) for i in range(model.vocab_size()))]


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens.

    A text falls into units that neither crosses: one starts at each space that
    follows no white space. The first tokenizer's pattern starts a word there,
    and no piece of the second one has a space after anything else.
    """

    def __init__(self, pairs: str = PAIRS, pieces: str = PIECES):
        merges = Merges.from_json(pairs)
        self.a, self.b = Encoder(merges), sentencepiece.SentencePieceProcessor(model_file=pieces)
        if any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(self.b.vocab_size())):
            raise ValueError("a piece has a space within")
        self.mark = self.b.piece_to_id(MARK)
        self.a_text, self.b_text = letters(merges.text), letters(piece_bytes(self.b))

    def encode(self, units: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """For each tokenizer ids, ends in bytes within their unit, and offsets of the units; and which units both restore, the others have no tokens."""
        found = self.b.encode([u[1:] for u in units], num_threads=1)
        found = [ids if len(u) > 1 else [self.mark] for u, ids in zip(units, found)]
        where = np.zeros(len(units) + 1, dtype=np.int64)
        np.cumsum([len(i) for i in found], out=where[1:])
        raw = [u.encode() for u in units]
        size = np.zeros(len(units) + 1, dtype=np.int64)
        np.cumsum([len(u) for u in raw], out=size[1:])
        data, same, out = np.frombuffer(b"".join(raw), dtype=np.uint8), np.ones(len(units), dtype=bool), []
        for ids, offsets, (text, sizes) in ((*self.a.encode_units(units), self.a_text), (np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(where[-1])), where, self.b_text)):
            joined, ends = gather(text, sizes, ids)
            at = ends[offsets]
            even = np.diff(at) == np.diff(size)
            same &= even
            if even.all():
                same[np.searchsorted(size, np.flatnonzero(joined != data), side="right") - 1] = False
            else:
                for k in np.flatnonzero(same):
                    same[k] = (joined[at[k] : at[k + 1]] == data[size[k] : size[k + 1]]).all()
            out.append((ids, (ends[1:] - np.repeat(at[:-1], np.diff(offsets))).astype(np.int32), offsets))
        if not same.all():
            for k, (ids, ends, offsets) in enumerate(out):
                n = np.diff(offsets)
                token = np.repeat(same, n)
                out[k] = ids[token], ends[token], np.concatenate([[0], np.cumsum(np.where(same, n, 0))])
        return out, same


def unit_starts(c: Chunk) -> np.ndarray:
    """Where units begin: each document, and each space that follows no white space (beyond ASCII it is enough that it may be some)."""
    d = c.data[: c.size]
    begin = np.zeros(c.size, dtype=bool)
    if c.size > 3:
        p1, p2, p3 = d[2:-1], d[1:-2], d[:-3]
        wide = (p1 >= 0x80) & (((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | ((p3 == 0xE1) & (p2 == 0x9A)) | ((p3 == 0xE2) & ((p2 == 0x80) | (p2 == 0x81))) | ((p3 == 0xE3) & (p2 == 0x80)))
        begin[3:] = (d[3:] == 0x20) & (p1 > 0x20) & (p1 != 0x7F) & ~wide
    begin[c.offsets[:-1][np.diff(c.offsets) > 0]] = True
    return np.flatnonzero(begin)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets).astype(np.int32)), values)


class Units:
    """The tokens of units met before, known by a 64-bit hash, so that each is encoded once as long as it is kept."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, dtype=np.int32)
        self.hashes, self.numbers, self.same = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.tokens = [(none, none, np.zeros(1, dtype=np.int64))] * 2

    def find(self, hashes: np.ndarray, units: Callable[[np.ndarray], list[str]]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """What ``Tokenizers.encode`` gives, for ascending hashes; ``units`` gives the texts of those at some places."""
        at = np.searchsorted(self.hashes, hashes)
        met = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        met[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~met)
        if len(new):
            tokens, same = self.both.encode(units(new))
            self.both.a.kept.clear()  # words are kept as parts of units
            numbers = np.arange(len(new)) + len(self.same)
            self.numbers = np.insert(self.numbers, at[new], numbers)
            self.hashes, self.same = np.insert(self.hashes, at[new], hashes[new]), np.concatenate([self.same, same])
            self.tokens = [(np.concatenate([ids, i]), np.concatenate([ends, e]), np.concatenate([offsets, offsets[-1] + o[1:]])) for (ids, ends, offsets), (i, e, o) in zip(self.tokens, tokens)]
        which = self.numbers[np.searchsorted(self.hashes, hashes)]
        found = [(gather(ids, offsets, which)[0], *gather(ends, offsets, which)) for ids, ends, offsets in self.tokens]
        same = self.same[which]
        if sum(len(ids) for ids, _, _ in self.tokens) > KEPT:
            self._forget()
            if sum(len(ids) for ids, _, _ in found) <= KEPT // 2:
                self.hashes, self.numbers, self.same, self.tokens = hashes, np.arange(len(hashes)), same, found
        return found, same


def _units(pairs: str, pieces: str, batch: pa.RecordBatch) -> Iterator[tuple]:
    """For each chunk of a batch of ids and texts: the chunk, where its units start, each document's first unit, each unit's number among the different ones, the tokens of these, and which documents have tokens."""
    kept: Units = worker_model(("alignment", pairs, pieces), lambda: Units(Tokenizers(pairs, pieces)))
    texts = pa.array([" " + t if t else "" for t in texts_of(batch.column(1))], pa.large_string())
    for c in chunks(texts, CHUNK, lower=False):
        starts = unit_starts(c)
        ends = np.append(starts[1:], c.size)[: len(starts)]
        hashes, first, back = np.unique(hash_words(c, starts, ends), return_index=True, return_inverse=True)
        raw = c.data.tobytes()
        tokens, same = kept.find(hashes, lambda new: [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])  # noqa: B023
        of = np.searchsorted(starts, c.offsets)
        doc = np.repeat(np.arange(c.n), np.diff(of))
        yield c, starts, of, doc, back, tokens, np.bincount(doc[~same[back]], minlength=c.n) == 0


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS))


def _tokenise(pairs: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            for c, starts, of, doc, back, tokens, whole in _units(pairs, pieces, batch):
                used = whole[doc]
                seq = np.concatenate([[0], np.cumsum(np.where(whole, np.diff(of), 0))])
                columns = [batch.column(0).slice(c.first, c.n)]
                for ids, place, offsets in tokens:
                    ids, where = gather(ids, offsets, back[used])
                    place, _ = gather(place, offsets, back[used])
                    ahead = (starts - c.offsets[:-1][doc])[used]
                    columns += [_lists(where[seq], pa.array(ids)), _lists(where[seq], pa.array((place + np.repeat(ahead, np.diff(where))).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *PARTS])

    return run


def _tokenise_units(pairs: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            for c, _, of, doc, back, tokens, whole in _units(pairs, pieces, batch):
                used = whole[doc]
                seq = np.concatenate([[0], np.cumsum(np.where(whole, np.diff(of), 0))])
                # units without tokens go, so a unit's number is its place among those with some
                full = np.diff(tokens[0][2]) > 0
                columns = [batch.column(0).slice(c.first, c.n), seq, (np.cumsum(full) - 1)[back[used]]]
                for ids, ends, offsets in tokens:
                    first = offsets[:-1][full]
                    size = np.diff(ends, prepend=0)
                    size[first] = ends[first]
                    at = np.cumsum(size, dtype=np.int64)
                    columns += [ids, at]
                columns.append(np.concatenate([[0], at[offsets[1:][full] - 1]]))
                columns[1:] = [pa.array(np.asarray(x).astype(np.int32)) for x in columns[1:]]
                yield pa.RecordBatch.from_arrays([_lists(np.array([0, len(x)]), x) for x in columns], names=list(UNITS))

    return run


@functools.cache
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below ``size`` with a comma after each, then all with a bar, then all with a semicolon."""
    return letters([b"%d%s" % (i, after) for after in (b",", b"|", b";") for i in range(size)])


def _unit_texts(u: dict[str, np.ndarray]) -> list[bytes]:
    """Each unit's groups as `a1,a2|b1;a3|b2,b3;`."""
    part = np.concatenate([2 * np.searchsorted(u["groups"], u["a_ends"]), 2 * np.searchsorted(u["groups"], u["b_ends"]) + 1])
    order = np.argsort(part, kind="stable")
    ids, part, count = np.concatenate([u["a_ids"], u["b_ids"]])[order], part[order], np.bincount(part, minlength=1)
    last = np.append(part[1:] != part[:-1], True)[: len(part)]
    size = 1 << int(ids.max(initial=0)).bit_length()
    text, sizes = _decimals(size)
    raw, where = gather(text, sizes, ids + size * np.where(last, 1 + (part & 1), 0))
    tokens = np.concatenate([[0], np.cumsum(count)])
    # the tokens before the end of each unit, by the groups before it
    at = where[tokens[2 * np.searchsorted(u["groups"], u["bounds"], side="right")]].tolist()
    raw = raw.tobytes()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # this worker may have been a tokenizer's, whose model goes
    worker_model("alignment texts", lambda: None)
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].values for name in batch.schema.names}
            u = {name: x.to_numpy() for name, x in row.items() if name != "doc_id"}
            texts = _unit_texts(u)
            pairs = u["a_ids"][np.searchsorted(u["a_ends"], u["places"])].astype(np.int64) << 32 | u["b_ids"][np.searchsorted(u["b_ends"], u["places"])]
            bound = {side: np.searchsorted(u[f"{side}_ends"], u["bounds"], side="right") for side in "ab"}
            seq, units = u["docs"], u["units"]
            sizes = [np.diff(np.concatenate([[0], np.cumsum(np.diff(bound[side])[units])])[seq]) for side in "ab"]
            found, where = gather(pairs, np.searchsorted(u["places"], u["bounds"], side="right"), units)
            held = list(map(texts.__getitem__, units.tolist()))
            sha = [hashlib.sha256(b"".join(held[a:b])[:-1]).hexdigest() if b > a else "" for a, b in zip(seq.tolist(), seq[1:].tolist())]
            yield pa.RecordBatch.from_arrays([row["doc_id"], *map(pa.array, sizes), pa.array(sha, pa.string()), _lists(where[seq], pa.array(found))], names=["doc_id", "n_a", "n_b", "groups_sha256", "pairs"])


def tokenise_both(docs: DataFrame, pairs: str = PAIRS, pieces: str = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and ids and byte ends of the tokens of a space and the text, by each tokenizer; none for a text that is null, empty or not restored by both.

    Units that occur again are encoded once, as long as a worker keeps them (``KEPT``); they are told apart by a 64-bit hash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(_tokenise(pairs, pieces)), f"doc_id {kind}, " + ", ".join(f"{c} array<int>" for c in PARTS))


def tokenise_units(docs: DataFrame, pairs: str = PAIRS, pieces: str = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for about ``CHUNK`` bytes of text, with its different units one after the other: ids and byte ends of their tokens by each tokenizer, and the units' bounds.

    Neither tokenizer has a token across units, so groups and links of a
    document are those of its units: doc_id has a row's documents, docs the
    bounds of each in units, which are the numbers of its units in order. A text
    that ``tokenise_both`` gives no tokens has no units.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(_tokenise_units(pairs, pieces)), f"doc_id array<{kind}>, " + ", ".join(f"{c} array<int>" for c in UNITS[1:]))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row."""
    return F.transform(F.array(value), use)[0]


def _upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _held(ends: Column, value=None) -> Column:
    """For each byte, the number of the token that holds it, or what ``value`` makes of the number."""
    return F.flatten(F.transform(ends, lambda e, i: F.array_repeat(i if value is None else value(i), e - F.when(i > 0, ends[i - 1]).otherwise(0))))


def aligned(t: Column) -> Column:
    """(groups, links) of a struct of a_ids, a_ends, b_ids and b_ends: groups with the ids a and b in order, links with an id a and an id b.

    Groups end where tokens of both end. A and B tokens are linked if they
    share a byte; as both cover all bytes without gaps, each place where some
    token ends is the end of one such overlap, so the work is linear in tokens
    and bytes, however long a group is.
    """
    shared = F.struct(_held(t["a_ends"]).alias("a"), _held(t["b_ends"]).alias("b"), F.array_intersect(t["a_ends"], t["b_ends"]).alias("ends"))

    def side(s: Column, k: Column, holder: str, ids: str) -> Column:
        begin = F.when(k > 0, s[holder][s["ends"][k - 1]]).otherwise(0)
        return F.transform(F.sequence(begin, s[holder][s["ends"][k] - 1]), lambda i: t[ids][i])

    def both(s: Column) -> Column:
        groups = F.transform(_upto(F.size(s["ends"])), lambda k: F.struct(side(s, k, "a", "a_ids").alias("a"), side(s, k, "b", "b_ids").alias("b")))
        places = F.sort_array(F.array_union(t["a_ends"], t["b_ends"]))
        return F.struct(groups.alias("groups"), F.transform(places, lambda e: F.struct(t["a_ids"][s["a"][e - 1]].alias("a"), t["b_ids"][s["b"][e - 1]].alias("b"))).alias("links"))

    return _let(shared, both)


def align(tokens: DataFrame) -> DataFrame:
    """doc_id, groups and links of rows with a doc_id, a_ids, a_ends, b_ids and b_ends, as any two lossless tokenizers give them."""
    return tokens.select("doc_id", aligned(F.struct("a_ids", "a_ends", "b_ids", "b_ends")).alias("_")).select("doc_id", "_.groups", "_.links")


def documents_of(units: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, groups_sha256 and pairs (each link as a * 2^32 + b) of each document of rows of ``tokenise_units``.

    As in ``aligned``, groups end where tokens of both end, and a link ends
    wherever some token ends; both are found for all units of a row at once, and
    then written for each document.
    """
    kind = units.schema["doc_id"].dataType.elementType.simpleString()
    rows = units.select("*", F.array_intersect("a_ends", "b_ends").alias("groups"), F.sort_array(F.array_union("a_ends", "b_ends")).alias("places"))
    return rows.mapInArrow(tidy(_write), f"doc_id {kind}, n_a long, n_b long, groups_sha256 string, pairs array<bigint>")


@contextmanager
def _batched(spark: SparkSession) -> Iterator[None]:
    """Batches of ``BATCH`` bytes for what is planned inside."""
    key, value = BATCH
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair (a * 2^32 + b), n (links of all rows) and best (no other pair with its b has more) of rows with ``pairs``."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    counts = stage(counts, "align-pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    out = stage(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "align-counts")
    discard(counts)
    return out


def align_documents(docs: DataFrame, pairs: str = PAIRS, pieces: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs`` (doc_id, text).

    A text that is null, empty or not restored by both tokenizers has zeros and
    an empty digest; special tokens' names are ordinary text; texts of any
    length are taken whole. Rows that repeat, also with the same id, count each;
    an empty table gives no rows. Other columns, whatever their names, are not
    read. Ties for the highest count are all best.

    Links are written once, with a number for each row. The most frequent pairs,
    fewer than ``HOT``, go to every task with their counts; the others meet
    theirs in a join by pair, in which no key has more than one in ``HOT`` of
    the links.
    """
    rows = documents_of(tokenise_units(docs, pairs, pieces)).withColumn("row", F.monotonically_increasing_id())
    with _batched(docs.sparkSession):
        rows = stage(rows, "align-rows")
    counts = pair_counts(rows)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") * HOT > total).select("pair", F.col("n").alias("hot_n"), F.col("best").cast("int").alias("hot_best"))
    met = rows.select("row", F.explode("pairs").alias("pair")).join(F.broadcast(hot), "pair", "left")
    # links of hot pairs are summed under a key of their row's own, which no pair has
    key = F.when(F.col("hot_n").isNull(), F.col("pair")).otherwise(-1 - F.col("row"))
    met = met.groupBy("row", key.alias("pair")).agg(F.count("*").alias("links"), F.sum("hot_n").alias("hot_sum"), F.sum("hot_best").alias("hot_best"))
    met = met.join(counts.filter(F.col("n") * HOT <= total), "pair", "left")
    sums = met.groupBy("row").agg(
        F.sum(F.coalesce("hot_best", F.when(F.col("best"), F.col("links")), F.lit(0))).cast("long").alias("n_best"), F.sum(F.coalesce("hot_sum", F.col("n") * F.col("links"))).cast("long").alias("count_sum"),
    )
    out = rows.select("doc_id", "n_a", "n_b", "groups_sha256", F.size("pairs").cast("long").alias("n_links"), "row").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - F.col("n_links")).alias("n_groups"), "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
