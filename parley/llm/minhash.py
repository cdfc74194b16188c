"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import NOT_SPACE, Chunk, chunks, hash_words, mix64, tidy
from .components import connected_components
from .staging import discard, stage

SHINGLE = 5
#: Coordinates of a signature and of a band. A pair at a similarity of 0.85 shares no band with probability 8e-6.
BANDS, ROWS = 20, 5
CHUNK = 1 << 19
#: Bits of the filter that tells which texts are read again; a fixed bound (16 MB).
FILTER_BITS = 1 << 27
#: Open pairs for each row of the buckets up to which it is looked which of them their distances leave possible.
FEW = 16
#: Members of a bucket up to which all its open pairs may be compared.
SMALL = 16
_U, _V = np.uint64, np.uint32
_STEP = _V(0x9E3779B1)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


def shingles(chunk: Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document (flat) and their offsets.

    A document with 1 to ``size - 1`` words has its whole sequence as the only one; one without words has none.
    """
    starts, ends, first = chunk.words(NOT_SPACE)
    h = hash_words(chunk, starts, ends)
    n = np.diff(first)
    full = np.maximum(n - size + 1, 0)
    count = np.where(n == 0, 0, np.maximum(full, 1))
    offsets = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(count, out=offsets[1:])
    doc = np.repeat(np.arange(len(n)), count)
    at = first[:-1][doc] + np.arange(offsets[-1]) - offsets[:-1][doc]
    held = np.minimum(n, size)[doc]
    s = held.astype(_U) * _U(0x2545F4914F6CDD1D)
    padded = np.concatenate([h, np.zeros(size, dtype=_U)])
    for k in range(size):
        term = padded[at + k] * _ODD[k]
        s += np.where(held > k, term, _U(0)) if (n < size).any() else term
    s = mix64(s)
    for i in range(len(n)):
        s[offsets[i] : offsets[i + 1]].sort()
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    new[offsets[:-1][count > 0]] = True
    kept = np.zeros(len(s) + 1, dtype=np.int64)
    np.cumsum(new, out=kept[1:])
    return s[new], kept[offsets]


def bands_for(percent: int) -> int:
    """Bands at which a pair just at ``percent`` is missed no more often than one at 0.85 in ``BANDS`` of them."""
    if percent >= 100:
        return 1
    met = max(percent, 1) / 100
    return max(math.ceil(BANDS * math.log1p(-(0.85**ROWS)) / math.log1p(-(met**ROWS)) - 1e-9), 1)


def signatures(sets: np.ndarray, offsets: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A row of bands * ROWS minima for each non-empty document.

    Circulant: one permutation (the shingle's hash, 32 bits) places a shingle on
    the circle, a second one (an integer bijection), shifted by k steps, gives
    coordinate k.
    """
    x = (sets >> _U(32)).astype(_V)
    begins = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(begins), bands * ROWS), dtype=_V)
    y, t = np.empty_like(x), np.empty_like(x)
    for k in range(bands * ROWS):
        np.add(x, _V((k * int(_STEP)) & 0xFFFFFFFF), out=y)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
            np.right_shift(y, _V(shift), out=t)
            np.bitwise_xor(y, t, out=y)
            if factor:
                np.multiply(y, _V(factor), out=y)
        if len(begins):
            out[:, k] = np.minimum.reduceat(y, begins)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    s = signature.reshape(-1, bands, ROWS).astype(_U)
    key = np.arange(1, bands + 1, dtype=_U)[None, :] * _U(0x2545F4914F6CDD1D)
    for j in range(ROWS):
        key = mix64(key ^ (s[:, :, j] + _ODD[j]))
    return key.view(np.int64)


def _set_keys(sets: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """Two 64-bit sums of hashes of each set; with its size they name it."""
    keys = []
    for odd in (_ODD[0], _ODD[1]):
        total = np.zeros(len(sets) + 1, dtype=_U)
        np.cumsum(mix64(sets ^ odd), out=total[1:])
        keys.append(pa.array((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)))
    return keys


def _sketch(count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), CHUNK):
                sets, offsets = shingles(c)
                n = np.diff(offsets)
                bands = band_keys(signatures(sets, offsets, count), count).ravel()
                where = np.concatenate([[0], np.cumsum(np.where(n > 0, count, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n), pa.array(n.astype(np.int64)), *_set_keys(sets, offsets), pa.ListArray.from_arrays(where, pa.array(bands))],
                    names=["doc_id", "n", "k1", "k2", "bands"],
                )

    return read


def _slot(ids: pa.Array, bits: int) -> np.ndarray:
    """The bit of each id in the filter; rows without an id share one."""
    ids = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    return mix64(ids.astype(np.int64).view(_U).copy()) & _U(bits - 1)


def _sets(bitmap: np.ndarray, bits: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column(0), bits)
            asked = (bitmap[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(asked.astype(bool)))
            for c in chunks(batch.column(1), CHUNK):
                sets, offsets = shingles(c)
                held = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(offsets).astype(np.int64)), *_set_keys(sets, offsets), held], names=["n", "k1", "k2", "shingles"])

    return read


def _texts_again(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, n and shingle set of ``classes`` (node, doc_id, n, k1, k2); texts aren't shuffled.

    The ids go out as a bitmap of their hashes, of bounded size; where it fills up,
    more texts are read again, none is missed. A set is known by its own keys, so
    other texts under the same id don't take its place.
    """
    n = classes.count()
    bits = 1 << 16
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(batch.column(0), bits)).view(np.int64))], names=["slot"])

    words = classes.select("doc_id").mapInArrow(slots, "slot long").groupBy(F.shiftright("slot", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("b")).toArrow()
    bitmap = np.zeros(bits // 32, dtype="<u4")
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy().astype("<u4")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))
    sets = docs.mapInArrow(lambda batches: tidy(_sets(shared.value, bits))(batches), "n long, k1 long, k2 long, shingles array<long>")
    return sets.join(classes.select("node", "n", "k1", "k2"), ["n", "k1", "k2"]).dropDuplicates(["n", "k1", "k2"]).select("node", "n", "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, apart (elements that only one of the sets has), linked; all in whole numbers, on full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("inter"))
    union = F.col("na") + F.col("nb") - F.col("inter")
    return both.select("a", "b", (union - F.col("inter")).alias("apart"), (F.col("inter") * 100 >= union * percent).alias("linked"))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of the keys that several sets have."""
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "key")


def _weighed(sets: DataFrame, percent: int) -> DataFrame:
    """node, n and lone (shingles that no other set has) of the sets that can have a link at all.

    A set's similarity to any other is at most the share of its shingles that some
    other one holds. Altered copies of one text, or documents around one passage,
    are far more often told apart by their own shingles than by comparison.
    """
    own = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
    lone = own.groupBy("node").agg(F.count("*").alias("lone"))
    weighed = sets.select("node", "n").join(lone, "node", "left").select("node", "n", F.coalesce("lone", F.lit(0)).alias("lone"))
    return weighed.filter((F.col("n") - F.col("lone")) * 100 >= F.col("n") * percent)


def _alone(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """p, node and alone: elements in which the set differs from its pivot, but no other set of that pivot in ``rows`` does."""
    held = rows.select("p", "node").distinct()
    differ = held.join(sets.select("node", F.col("shingles").alias("sx")), "node").join(sets.select(F.col("node").alias("p"), F.col("shingles").alias("sp")), "p")
    differ = differ.select("p", "node", F.explode(F.concat(F.array_except("sx", "sp"), F.array_except("sp", "sx"))).alias("e"))
    alone = differ.groupBy("p", "e").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
    return held.join(alone.groupBy("p", "node").agg(F.count("*").alias("alone")), ["p", "node"], "left").select("p", "node", F.coalesce("alone", F.lit(0)).alias("alone"))


def _able(rows: DataFrame, percent: int) -> DataFrame:
    """Rows that can have a link between two components of their bucket; ``common``: the differing elements that another set may share.

    Two sets at ``apart`` s and t from their pivot have s + t - 2i elements that
    only one has, i being the differing elements they share. They are linked if
    that is at most (100 - percent) / (100 + percent) of both sizes together. At
    least one of them is in another component than the pivot, so not linked with
    it, which bounds its t from below. Altered copies of one text share few
    alterations, so nearly all of them leave here.
    """
    least, most = F.lit(100 + percent), F.lit(100 - percent)
    rows = rows.filter("node <> p").withColumn("far", least * (F.col("apart") - 2 * F.col("common")) < most * (F.col("n") - F.col("np")))
    hub = rows.filter("far AND mine = theirs").groupBy("key").agg(F.max("n").alias("hub"))
    near = least * (F.col("apart") - F.col("common")) <= most * (F.col("hub") + F.col("n"))
    return rows.join(hub, "key", "left").filter(F.col("far") | ((F.col("mine") != F.col("theirs")) & F.coalesce(near, F.lit(False)))).drop("far", "hub")


def _able_closely(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The same, first by the shingles that no other set has at all, which are known, then by all differing elements of the rows left."""
    rows = _able(rows, percent)
    return _able(rows.join(_alone(rows, sets), ["p", "node"]).withColumn("common", F.col("apart") - F.col("alone")).drop("alone"), percent)


def _open(placed: DataFrame) -> DataFrame:
    """key, members and the number of pairs in different components of the buckets that have such pairs."""
    sizes = placed.groupBy("key", "mine").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("m"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).cast("long").alias("open"))
    return sizes.filter("open > 0")


def _links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b: nodes) that connect all similar classes met in a band; each has been verified on full sets.

    Sets that can't have a link go first. Each bucket has a pivot with which all
    its members are compared: of the members, and of those they meet in other
    buckets, the set with the fewest elements of its own, so all buckets of one
    family mostly have the same, nearest to what its texts have in common. (Later
    rounds take a member.) What this leaves open are
    pairs of a bucket in different components. Small buckets are finished: their
    open pairs are compared, unless their distances to the pivot rule a link out.
    Members of large buckets that can have no such link leave. If few pairs are
    left that a link is possible for, no more than ``FEW`` for each row of the
    buckets, these are compared. Else the rest gets a new pivot, and so on, with
    twice as many pairs allowed each time. So few of a bucket's pairs are made, but
    for families whose members share alterations without links: there the pairs
    grow with the square. No link between components is lost.
    """
    spent = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        spent.append(stage(df, label))
        return spent[-1]

    def finish(links: DataFrame | None) -> DataFrame | None:
        out = None if links is None else stage(links, "minhash-links")
        for df in spent:
            discard(df)
        return out

    members = keep(_shared(classes.select("node", F.explode("bands").alias("key"))).select("key", "node"), "minhash-buckets")
    if members.isEmpty():
        return finish(None)
    met = classes.join(members.select("node").distinct(), "node").select("doc_id", "node", "n", "k1", "k2")
    sets = keep(_texts_again(docs, met), "minhash-sets")
    members = keep(_shared(members.join(_weighed(sets, percent), "node")).select("key", "node", "n", "lone", F.col("lone").alias("own")), "minhash-members")
    total = members.count()
    if not total:
        return finish(None)
    known, few = None, max(total, 1)
    while True:
        lead = F.min(F.struct("own", F.xxhash64("node").alias("h"), F.col("node").alias("p"), F.col("n").alias("np")))
        pivots = members.groupBy("key").agg(lead.alias("l"))
        if known is None:
            best = members.join(pivots, "key").groupBy("node").agg(F.min("l").alias("l"))
            pivots = members.join(best, "node").groupBy("key").agg(F.min("l").alias("l"))
        pivots = pivots.select("key", "l.p", "l.np")
        spokes = keep(members.join(pivots, "key").select("key", "p", "np", "node", "n", "lone", F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")), "minhash-spokes")
        pairs = spokes.filter("a <> b").select("a", "b").distinct()
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        fresh = keep(_verified(pairs, sets, percent), "minhash-pairs")
        known = fresh if known is None else known.unionByName(fresh)
        component = connected_components(known.filter("linked").select("a", "b"))
        own = component.select("node", F.col("component").alias("mine"))
        hub = component.select(F.col("node").alias("p"), F.col("component").alias("theirs"))
        placed = spokes.join(known.select("a", "b", "apart"), ["a", "b"], "left").join(own, "node", "left").join(hub, "p", "left")
        apart = F.when(F.col("node") == F.col("p"), F.lit(0).cast("long")).otherwise(F.col("apart"))
        placed = placed.select("key", "p", "np", "node", "n", "lone", apart.alias("apart"), F.coalesce("mine", "node").alias("mine"), F.coalesce("theirs", "p").alias("theirs"))
        placed = keep(placed.withColumn("common", F.greatest(F.col("apart") - F.col("lone"), F.lit(0))), "minhash-placed")
        sizes = keep(_open(placed), "minhash-open")
        small = placed.join(sizes.filter(F.col("m") <= SMALL).select("key"), "key")
        large = keep(_able_closely(placed.join(sizes.filter(F.col("m") > SMALL).select("key"), "key"), sets, percent).select(small.columns), "minhash-able")
        sizes = keep(_open(large), "minhash-open")
        done = (sizes.agg(F.sum("open")).first()[0] or 0) <= FEW * few
        last = keep(_apart_pairs(small.unionByName(large) if done else small, known, percent), "minhash-last")
        if done and last.count() > few:
            done, last = False, keep(_apart_pairs(small, known, percent), "minhash-last")
        known = known.unionByName(keep(_verified(last, sets, percent), "minhash-pairs"))
        if done:
            return finish(known.filter("linked").select("a", "b"))
        rest = large.join(sizes.select("key"), "key")
        members = rest.select("key", "node", "n", "lone", (F.col("apart") - F.col("common")).alias("own"))
        few = 2 * few


def _apart_pairs(placed: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket in different components, not in ``known``, that their differences from the pivot don't rule out."""
    rows = placed.filter("node <> p")
    x = rows.select("key", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("apart").alias("sx"), F.col("common").alias("cx"), F.col("mine").alias("mx"))
    y = rows.select("key", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("apart").alias("sy"), F.col("common").alias("cy"), F.col("mine").alias("my"))
    near = (100 + percent) * (F.col("sx") + F.col("sy") - 2 * F.least("cx", "cy")) <= (100 - percent) * (F.col("nx") + F.col("ny"))
    return x.join(y, "key").filter((F.col("mx") < F.col("my")) & near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components of documents by their distinct 5-word shingles.

    Words are lower-cased (A-Z) and split at ASCII white space. Documents are
    linked if 100 * |intersection| >= percent * |union|. A document of fewer
    words has its whole sequence as its one shingle; a null, empty or blank text
    has none and is linked with nothing. Documents with equal sets (by count
    and a 128-bit sum of hashes) form a class, so copies are never compared. Rows
    with the same id give one row each, by their own texts. Rows without an id
    are compared like others; component_id is null (and kept true) where no row
    of the component has an id. An empty table gives no rows.

    Returns doc_id, n_shingles, component_id (smallest id reachable), kept.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = stage(source.mapInArrow(tidy(_sketch(bands_for(percent))), "doc_id long, n long, k1 long, k2 long, bands array<long>"), "minhash-sketch")
    classes = sketch.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    links = _links(source, classes, percent)
    top = classes.select("n", "k1", "k2", "node", "doc_id")
    if links is not None:
        top = top.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = top.groupBy("component").agg(F.min("doc_id").alias("least"))
        top = top.join(least, "component")
    else:
        top = top.withColumn("least", F.col("doc_id"))
    out = sketch.select("doc_id", "n", "k1", "k2").join(top.select("n", "k1", "k2", "least"), ["n", "k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def oracle(percent: int = 85) -> str:
    """All pairs that share a shingle, and reachability by recursion."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS ss FROM w),
e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
r(node, reach) AS (SELECT a, b FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a),
c AS (SELECT node, min(reach) AS low FROM r GROUP BY node)
SELECT doc_id, len(ss)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM s LEFT JOIN c ON node = doc_id"""
