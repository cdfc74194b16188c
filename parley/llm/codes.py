"""Vector codes: a codebook for each part of the vectors, by Lloyd rounds that add up only what changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .bytewords import tidy
from .staging import discard, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components lie within this; beyond it a squared distance doesn't fit in a long.
LIMIT = 1 << 31
#: Components up to which squared distances are exact in double precision, for parts of up to 2048 components.
SMALL = 1 << 20
LONGEST = (1 << 63) - 1
#: A label with more than one in HOT_SHARE rows is hot; there are fewer than HOT_SHARE of those.
HOT_SHARE = 100
#: Rows of a batch that are compared at once.
ROWS = 4096

Books = dict[int, list[np.ndarray]]


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where each part of a vector begins and ends: equal parts, or ones that differ by one component."""
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def whole(column: pa.Array) -> np.ndarray:
    """Vectors of one length as whole numbers, floor(SCALE * x)."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -LIMIT, LIMIT).astype(np.int64).reshape(len(column), -1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of equal ones, and its squared distance; exact."""
    if x.shape[1] == 0:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if top <= SMALL and x.shape[1] <= 2048:
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(x)), at].astype(np.int64)
    d = np.stack([((x.astype(object) - row.astype(object)) ** 2).sum(axis=1) for row in book], axis=1)
    at = np.array([min(range(len(row)), key=row.__getitem__) for row in d], dtype=np.int64)
    return at, np.array([min(row[k], LONGEST) for row, k in zip(d, at)], dtype=np.int64)


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        part = batch.filter(pa.array(sizes == d))
        for lo in range(0, part.num_rows, ROWS):
            yield part.slice(lo, ROWS)


def _assign(books: Books, parts: int, schema: list[str]):
    """vec_id, label, v and code to the same with the nearest entries as code, the code before as prev, and the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for raw in batches for b in _by_length(raw, 2)):
            x, n = whole(batch.column(2)), batch.num_rows
            found = [nearest(x[:, lo:hi], book) for (lo, hi), book in zip(bounds(x.shape[1], parts), books[x.shape[1]])]
            code = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            error = sum((d.astype(object) for _, d in found), np.zeros(n, dtype=object)) if any((d > LONGEST // parts).any() for _, d in found) else sum(d for _, d in found)
            error = np.array([min(int(e), LONGEST) for e in error], dtype=np.int64) if error.dtype == object else error
            raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * parts).astype(np.int32)), pa.py_buffer(code.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), raw, batch.column(3), pa.array(error)], names=schema)

    return run


def _changes(entries: int, parts: int):
    """v, code and prev of rows whose code changed to a task's sums: what each part's new entry gains and its old one loses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in (b for raw in batches for b in _by_length(raw, 0)):
            x = whole(batch.column(0))
            dim, n = x.shape[1], len(x)
            held = sums.setdefault(dim, [np.zeros((entries, hi - lo + 1), dtype=np.int64) for lo, hi in bounds(dim, parts)])
            new = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(n, parts)
            first = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            old = np.frombuffer(b"".join(p if p is not None else bytes(parts) for p in batch.column(2).to_pylist()), dtype=np.uint8).reshape(n, parts)
            for p, (lo, hi) in enumerate(bounds(dim, parts)):
                part = np.column_stack([np.ones(n, dtype=np.int64), x[:, lo:hi]])
                moved = first | (new[:, p] != old[:, p])
                np.add.at(held[p], new[moved, p], part[moved])
                gone = moved & ~first
                np.subtract.at(held[p], old[gone, p], part[gone])
        rows = [(dim, p, e, held[p][e].tolist()) for dim, held in sums.items() for p in range(parts) for e in range(entries) if held[p][e].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["dim", "part", "entry", "sums"])

    return run


def label_sums(rows: DataFrame, value: str, label: str = "label") -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of the same label, nulls together, as label_``value``.

    Labels with a hundredth of all rows, fewer than a hundred, are sent to every task; the
    others are joined by key. So no label's rows meet in one task.
    """
    total = F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias(f"label_{value}")
    sums = stage(rows.groupBy(F.col(label).alias("_l")).agg(total, F.count("*").alias("_n")), "code-labels")
    n = sums.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(sums.filter(F.col("_n") * HOT_SHARE > n).drop("_n"))
    same = F.col(label).eqNullSafe(F.col("_l"))
    cold = rows.join(hot, same, "left_anti").join(sums.filter(F.col("_n") * HOT_SHARE <= n).drop("_n"), same)
    return rows.join(hot, same).unionByName(cold).drop("_l")


def code_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector whose components are all finite numbers.

    A part's codebook starts as that part of the vectors with the ``entries``
    smallest ids (null last; equal ids by their components). A round assigns
    every part to the nearest entry and moves each entry to the mean of its
    parts. The running sums of all entries are kept as whole numbers; a round
    writes the assignments and adds up only the parts that changed: minus for
    the entry before, plus for the one after. Rounds end early if nothing
    changes. The driver holds ``entries`` * dimension numbers.

    Vectors of another length have codebooks of their own; a length that
    ``parts`` doesn't divide gives parts that differ by one component. With
    fewer vectors than entries, a codebook has as many entries as vectors. Null
    vectors and those with a null or non-finite component are left out; rows
    that repeat, also with the same id, are coded each; an empty table gives no
    rows. Scaled components are held within 2^31, errors within a long. Other
    columns, whatever their names, are not read.
    """
    v = F.col(vec_col)
    kind = vectors.schema[vec_col].dataType
    if not isinstance(kind, ArrayType) or kind.elementType.typeName() not in ("float", "double"):
        v = v.cast(ArrayType(DoubleType()))
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).filter(sound)
    dims = sorted(r["dim"] for r in rows.select(F.size("v").alias("dim")).distinct().collect())
    books: Books = {}
    for dim in dims:
        first = rows.filter(F.size("v") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column(0).combine_chunks()
        x = whole(first)
        books[dim] = [x[:, lo:hi].copy() for lo, hi in bounds(dim, parts)]
    running = {dim: [np.zeros((len(b), b.shape[1] + 1), dtype=object) for b in books[dim]] for dim in dims}
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = ["vec_id", "label", "v", "code", "prev", "error"]
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, v {kinds['v']}, code binary, prev binary, error long"

    def assign(held: DataFrame) -> DataFrame:
        return held.select("vec_id", "label", "v", "code").mapInArrow(tidy(_assign(books, parts, names)), schema)

    held = rows.withColumn("code", F.lit(None).cast("binary"))
    for _ in range(rounds if dims else 0):
        now = stage(assign(held), "codes")
        discard(held)
        held = now
        moved = held.filter("prev IS NULL OR code <> prev").select("v", "code", "prev").mapInArrow(tidy(_changes(entries, parts)), "dim int, part int, entry int, sums array<long>")
        moved = moved.select("dim", "part", "entry", F.posexplode("sums").alias("at", "change")).groupBy("dim", "part", "entry", "at").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change")).collect()
        if not moved:
            break
        for r in moved:
            running[r["dim"]][r["part"]][r["entry"], r["at"]] += int(r["change"])
        for dim in dims:
            for book, total in zip(books[dim], running[dim]):
                for e in range(len(book)):
                    if total[e, 0]:
                        book[e] = [s // total[e, 0] for s in total[e, 1:]]
    done = stage(assign(held).select("vec_id", "label", F.size("v").alias("dim"), "code", "error"), "codes")
    discard(held)
    digests = {dim: hashlib.sha256(",".join(str(c) for book in books[dim] for c in book.ravel().tolist()).encode()).hexdigest() for dim in dims}
    digest = F.coalesce(*(F.when(F.col("dim") == d, F.lit(h)) for d, h in digests.items()), F.lit(None).cast("string"))
    return label_sums(done, "error").select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same for vectors of one length that ``parts`` divides."""
    steps = [
        f"k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v "
        "FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM k, range({parts}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries})",
    ]
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT r, p.part, entry, x, coalesce({far}, 0)::BIGINT AS d FROM p JOIN b{n} ON p.part = b{n}.part)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, part, arg_min(entry, d * {entries} + entry) AS entry, any_value(x) AS x, min(d) AS d FROM d{n} GROUP BY r, part)")
        if n < rounds:
            steps.append(f"u{n} AS (SELECT part, entry, count(*) AS n, i, sum(x[i])::DOUBLE AS s FROM a{n}, unnest(range(1, len(x) + 1)) t(i) GROUP BY part, entry, i)")
            steps.append(f"m{n} AS (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM u{n} GROUP BY part, entry)")
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON b.part = m.part AND b.entry = m.entry)")
    last = rounds
    steps.append(f"g AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})")
    steps.append(f"e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY r)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN e USING (r), g"
