"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .staging import stage

THRESHOLD = 0.98
#: A pair just at the threshold meets in no table with at most this probability.
MISS = 1e-8
#: Vectors of one bucket that are compared at once; a larger bucket is compared block by block.
BLOCK = 128
SEED = 20240229
#: What a block is known by.
COLUMNS = ("label", "t", "key", "bi", "bj", "name")


def plan_tables(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and number of tables: buckets of unrelated vectors stay small as ``n`` grows."""
    bits = min(max(math.ceil(math.log2(max(n, 2))) + 4, 12), 40)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """Normals of random hyperplanes in whole numbers: with vectors in whole numbers every sum is exact, in any order."""
    return np.rint(np.random.default_rng([SEED, dim, bits, tables]).standard_normal((dim, bits * tables)) * 1024)


def keys_of(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A key for each vector and table."""
    unit = np.rint(x / np.linalg.norm(x, axis=1)[:, None] * (1 << 20))
    sign = (unit @ _planes(x.shape[1], bits, tables) >= 0).reshape(len(x), tables, bits)
    return sign @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows scaled by powers of two, so that no square over- or underflows; cosines stay the same to the last bit."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))
    return np.ldexp(x, -exponent)


def _by_dim(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield batch.filter(pa.array(sizes == d))


def _hash(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dim(batch, 1):
                for lo in range(0, part.num_rows, 2048):
                    piece = part.slice(lo, 2048)
                    keys = keys_of(_matrix(piece.column(1)), bits, tables)
                    where = np.arange(0, keys.size + 1, tables, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(where, pa.array(keys.ravel()))], names=["rep", "keys"])

    return run


def _pairs_within(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i < j) of runs of equal small size; and the run of each."""
    a, b, g = [], [], []
    for m in np.unique(size):
        runs = np.flatnonzero(size == m)
        i, j = np.triu_indices(m, 1)
        a.append((begin[runs][:, None] + i).ravel())
        b.append((begin[runs][:, None] + j).ravel())
        g.append(np.repeat(runs, len(i)))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(a), cat(b), cat(g)


def _verify(bits: int, tables: int, threshold: float):
    """Blocks of one bucket, or of two parts of a bucket, to links and degrees.

    A pair that meets in several tables counts in the first of them. Of the links
    of a block only a spanning forest goes on; degrees are summed.
    """

    def block(rows: pa.Table) -> pa.RecordBatch:
        x = _matrix(rows.column("v").combine_chunks())
        rep, weight = rows.column("rep").to_numpy(), rows.column("size").to_numpy()
        table, side = rows.column("t").to_numpy(), rows.column("side").to_numpy()
        change = np.zeros(len(rep), dtype=bool)
        change[:1] = True
        for c in COLUMNS:
            v = rows.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        begin = np.flatnonzero(change)
        size = np.diff(np.append(begin, len(rep)))
        norm = np.linalg.norm(x, axis=1)
        out_a, out_b = [], []
        small = size <= 16
        a, b, _ = _pairs_within(begin[small], size[small])
        for lo in range(0, len(a), 1 << 16):
            i, j = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
            ok = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
            out_a.append(i[ok]), out_b.append(j[ok])
        for s, m in zip(begin[~small], size[~small]):
            i, j = np.nonzero(np.triu((x[s : s + m] @ x[s : s + m].T) / np.outer(norm[s : s + m], norm[s : s + m]) >= threshold - 1e-9, 1))
            i, j = i + s, j + s
            ok = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
            out_a.append(i[ok]), out_b.append(j[ok])
        a, b = np.concatenate([np.zeros(0, np.int64), *out_a]), np.concatenate([np.zeros(0, np.int64), *out_b])
        two = rows.column("bi").to_numpy() != rows.column("bj").to_numpy()
        ok = (~two[a]) | (side[a] != side[b])
        a, b = a[ok], b[ok]
        if len(a):
            used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            keys = keys_of(x[used], bits, tables)
            ia, ib = back[: len(a)], back[len(a) :]
            ok = np.empty(len(a), dtype=bool)
            for lo in range(0, len(a), 1 << 15):
                cut = slice(lo, lo + (1 << 15))
                ok[cut] = (keys[ia[cut]] == keys[ib[cut]]).argmax(axis=1) == table[a[cut]]
            a, b = a[ok], b[ok]
        degree = np.bincount(np.concatenate([a, b]), np.concatenate([weight[b], weight[a]]), minlength=len(rep)).astype(np.int64)
        parent: dict[int, int] = {}

        def top(k: int) -> int:
            while (p := parent.get(k, k)) != k:
                parent[k] = k = parent.get(p, p)
            return k

        edges = []
        for p, q in zip(rep[a].tolist(), rep[b].tolist()):
            u, v = top(p), top(q)
            if u != v:
                parent[max(u, v)] = min(u, v)
                edges.append((p, q))
        who, inverse = np.unique(rep, return_inverse=True)
        total = np.bincount(inverse, degree, minlength=len(who)).astype(np.int64)
        who, total = who[total > 0], total[total > 0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([who, np.array([e[0] for e in edges], dtype=np.int64)])),
                pa.array(np.concatenate([np.full(len(who), -1, np.int64), np.array([e[1] for e in edges], dtype=np.int64)])),
                pa.array(np.concatenate([np.ones(len(who), bool), np.zeros(len(edges), bool)])),
                pa.array(np.concatenate([total, np.zeros(len(edges), np.int64)])),
            ],
            names=["a", "b", "is_degree", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows < 4096:
                continue
            last = held.slice(held.num_rows - 1)
            same = np.ones(held.num_rows, dtype=bool)
            for c in COLUMNS:
                same &= held.column(c).to_numpy() == last.column(c).to_numpy()[0]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            if cut:
                yield from _dims(held.slice(0, cut), block)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from _dims(held, block)

    return run


def _dims(rows: pa.Table, block) -> Iterator[pa.RecordBatch]:
    sizes = pc.list_value_length(rows.column("v")).to_numpy()
    for d in np.unique(sizes):
        yield block(rows.filter(pa.array(sizes == d)))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of one label with a cosine of at least ``threshold``, and their components.

    Vectors that are null, zero, or hold a null or non-finite number, and those
    without a label, are linked with nothing; nor are vectors of different
    length. Equal vectors of a label are one class; its copies are never compared.
    Rows with the same id are vectors of their own; rows without an id have a null
    component where no vector of it has one. An empty table gives no rows.
    Candidates meet in a bucket of some table; unrelated vectors hardly do, as
    keys get longer with the logarithm of the table. Every pair in a bucket is
    verified in double precision, in blocks, each pair once; a bucket of any
    size is dealt out by blocks of ``BLOCK``.

    Returns vec_id, n_links (other vectors linked directly), component_id, kept.
    """
    v = F.col(vec_col).cast("array<double>")
    sound = F.coalesce(F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"), sound.alias("sound"),
        F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), F.size(v), v).alias("h2"),
    )
    rows = stage(rows, "vec-rows")
    classes = rows.filter("sound").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("v").alias("v"))
    # a class is known by a number of its own, as ids may repeat; labels meet by hash and are told apart in each block
    classes = stage(classes.withColumns({"rep": F.monotonically_increasing_id(), "group": F.xxhash64("label"), "name": F.col("label").cast("string")}), "vec-classes")
    bits, tables = plan_tables(classes.count(), threshold)
    keyed = classes.select("rep", "v").mapInArrow(_hash(bits, tables), "rep long, keys array<long>").join(classes.select("rep", "group"), "rep")
    keyed = stage(keyed.select("rep", F.col("group").alias("label"), F.posexplode("keys").alias("t", "key")), "vec-keys")
    counts = keyed.groupBy("label", "t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(counts, ["label", "t", "key"]).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("label", "t", "key", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "rep")
    full = met.join(classes.select("rep", "size", "v", "name"), "rep")
    found = (
        full.repartition("label", "t", "key", "bi", "bj").sortWithinPartitions("label", "t", "key", "bi", "bj", "name", "rep")
        .select("label", "t", "key", "bi", "bj", "side", "rep", "size", "v", "name")
        .mapInArrow(_verify(bits, tables, threshold), "a long, b long, is_degree boolean, links long")
    )
    found = stage(found, "vec-links")
    degree = found.filter("is_degree").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(found.filter("not is_degree").select("a", "b")).withColumnRenamed("node", "rep")
    placed = classes.select("rep", "least").join(component, "rep").select("rep", "component", "least")
    low = placed.join(placed.groupBy("component").agg(F.min("least").alias("low")), "component").select("rep", "low")
    known = classes.select(F.col("label").alias("l"), "h1", "h2", "rep", "size", "least").join(degree, "rep", "left").join(low, "rep", "left")
    out = rows.select("vec_id", F.when(F.col("sound"), F.col("label")).alias("l"), "h1", "h2").join(known, ["l", "h1", "h2"], "left")
    component_id = F.coalesce("low", "least", "vec_id")
    return out.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"),
    )


def oracle(threshold: float = THRESHOLD) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
r(node, reach) AS (SELECT a, b FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a),
c AS (SELECT node, min(reach) AS low FROM r GROUP BY node), d AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.node = vec_id LEFT JOIN d ON d.a = vec_id"""
