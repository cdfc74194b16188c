"""Spans of a document's tokens that are like a given short text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField, StructType

from parley.functions import text as T

#: Documents whose counts are made at once.
DOCS = 256
#: Tokens of items that every task holds at once.
ITEM_TOKENS = 20_000_000


def best_span(codes: list[int], wanted: set[int], size: int, threshold: Fraction, shared: int) -> tuple[int, int] | None:
    """(shared, union) of the span most similar to a set of ``size`` tokens, of which ``wanted`` occur in ``codes``; None below the threshold.

    A span similar enough holds ``need`` tokens of the set, so one of any
    ``size - need + 1``: only spans around the places of the rarest are tried. It
    has at most ``extra`` tokens besides the set's, and some best one begins
    with a token of the set that it holds once.
    """
    need, extra = max(math.ceil(threshold * size), shared), math.floor(size / threshold) - size
    if len(wanted) < need:
        return None
    places: dict[int, list[int]] = {c: [] for c in wanted}
    for i, c in enumerate(codes):
        if c in places:
            places[c].append(i)
    rarest = sorted(places.values(), key=len)[: max(size - need + 1 - (size - len(wanted)), 0)]
    starts: set[int] = set()
    for at in (i for some in rarest for i in some):
        held: set[int] = set()
        region = []
        for step in (-1, 1):
            other: set[int] = set()
            i = at
            while 0 <= i < len(codes):
                if codes[i] in wanted:
                    held.add(codes[i])
                else:
                    other.add(codes[i])
                    if len(other) > extra:
                        break
                if step < 0:
                    region.append(i)
                i += step
        if len(held) >= need:
            starts.update(i for i in region if codes[i] in wanted)
    best = None
    for i in sorted(starts):
        held, other = set(), set()
        for j in range(i, len(codes)):
            c = codes[j]
            if j > i and c == codes[i]:
                break
            if c not in wanted:
                other.add(c)
                if len(other) > extra:
                    break
            elif c not in held:
                held.add(c)
                s, u = len(held), size + len(other)
                if s >= need and s >= threshold * u and (best is None or (s * best[1], s) > (best[0] * u, best[0])):
                    best = (s, u)
        if best == (size, size):
            break
    return best


def spans_like(items: DataFrame, docs: DataFrame, item_id: str, doc_id: str, item_text: str, doc_text: str, threshold: float = 0.6, shared: int = 3) -> DataFrame:
    """(item, document, shared, similarity): the best span of each document, of any length and across lines, by Jaccard similarity of content tokens.

    Every document with such a span has its row. The items' tokens go to all
    tasks, in blocks of about ``ITEM_TOKENS`` (documents are read once a block);
    documents are never shuffled, only their hits. Rows with the same ids give their best.
    """
    sets = items.select(F.col(item_id), F.array_distinct(T.content_tokens(F.col(item_text))).alias("set")).filter(F.size("set") >= shared)
    blocks = max(-(-(sets.agg(F.sum(F.size("set"))).first()[0] or 0) // ITEM_TOKENS), 1)
    part = F.pmod(F.xxhash64(item_id, "set"), F.lit(blocks))
    kinds = items.schema[item_id].dataType, docs.schema[doc_id].dataType
    tokens = docs.select(doc_id, T.content_tokens(F.col(doc_text)).alias("tokens"))
    each = [_spans_of(sets.filter(part == b).toArrow(), tokens, item_id, doc_id, kinds, threshold, shared) for b in range(blocks)]
    best = reduce(DataFrame.unionByName, each).groupBy(item_id, doc_id).agg(F.max(F.struct("similarity", "shared")).alias("best"))
    return best.select(item_id, doc_id, F.col("best.shared").alias("shared"), F.col("best.similarity").alias("similarity"))


def _spans_of(known: pa.Table, docs: DataFrame, item_id: str, doc_id: str, kinds: tuple[DataType, DataType], threshold: float, shared: int) -> DataFrame:
    """Spans of ``docs`` (id, tokens) like the items of one block (id, set)."""
    least = Fraction(str(threshold))
    names = known.column(0).combine_chunks()
    sets = known.column(1).combine_chunks()
    flat = sets.flatten()
    vocabulary = flat.unique()
    token = pc.index_in(flat, value_set=vocabulary).to_numpy(zero_copy_only=False)
    sizes = np.asarray(pc.list_value_length(sets).to_numpy(zero_copy_only=False), dtype=np.int64)
    item = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(token, kind="stable")
    posting = item[order]
    first = np.searchsorted(token[order], np.arange(len(vocabulary) + 1))
    members = np.split(token, np.cumsum(sizes)[:-1]) if len(sizes) else []
    need = np.maximum([math.ceil(least * int(n)) for n in sizes], shared) if len(sizes) else np.zeros(0, dtype=np.int64)
    schema = StructType([StructField(item_id, kinds[0]), StructField(doc_id, kinds[1]), StructField("shared", IntegerType()), StructField("similarity", DoubleType())])

    def candidates(doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Keys doc * items + item of pairs that share enough tokens."""
        pair = np.unique(doc[ids >= 0] * len(vocabulary) + ids[ids >= 0])
        d, t = pair // len(vocabulary), pair % len(vocabulary)
        count = first[t + 1] - first[t]
        at = np.repeat(first[t] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(t) else np.zeros(0, dtype=np.int64)
        key, hits = np.unique(np.repeat(d, count) * len(sizes) + posting[at], return_counts=True)
        return key[hits >= need[key % len(sizes)]]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows if len(sizes) else 0, DOCS):
                part = batch.slice(lo, DOCS)
                lists = part.column(1)
                tokens = lists.flatten()
                length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(length)])
                ids = pc.fill_null(pc.index_in(tokens, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                rows = []
                last, codes = -1, []
                for key in candidates(np.repeat(np.arange(len(length)), length), ids, len(length)).tolist():
                    d, i = divmod(key, len(sizes))
                    if d != last:
                        own = ids[offsets[d] : offsets[d + 1]]
                        # tokens of no item get numbers of their own, below 0
                        other = tokens.slice(int(offsets[d]), int(length[d])).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                        last, codes, there = d, np.where(own >= 0, own, -1 - other).tolist(), set(own.tolist())
                    best = best_span(codes, there.intersection(members[i].tolist()), int(sizes[i]), least, shared)
                    if best:
                        rows.append((i, d, best[0], best[0] / best[1]))
                i, d, s, x = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i, pa.int64())), part.column(0).take(pa.array(d, pa.int64())), pa.array(s, pa.int32()), pa.array(x, pa.float64())], names=[item_id, doc_id, "shared", "similarity"])

    return docs.mapInArrow(find, schema)
