"""Greedy matching of two sets of vectors: how well each side's vectors find one like them on the other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

#: Vectors of a block of one side; meetings of blocks that a call compares, one after the other.
BLOCK, MEETINGS = 1024, 64


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of length 1 in double precision; zeros for a null or zero vector, and for missing numbers."""
    held = column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(held), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = pc.fill_null(held.flatten(), 0).to_numpy(zero_copy_only=False)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _meet(rows: pa.Table) -> pa.Table:
    """The largest cosine of every vector in each meeting of two blocks: the product's row and column maxima."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("meeting", "ascending"), ("left", "descending")]))
    v, meeting, left = _unit(rows.column("v")), rows.column("meeting").to_numpy(), rows.column("left").to_numpy(zero_copy_only=False)
    best = np.full(len(v), -np.inf)
    edges = [0, *(np.flatnonzero(np.diff(meeting)) + 1).tolist(), len(v)]
    for lo, hi in zip(edges, edges[1:]):
        mid = lo + int(left[lo:hi].sum())
        if lo < mid < hi:
            product = v[lo:mid] @ v[mid:hi].T
            best[lo:mid], best[mid:hi] = product.max(axis=1), product.max(axis=0)
    ok = np.isfinite(best)
    return pa.table({"uid": rows.column("uid").filter(pa.array(ok)), "pair": rows.column("pair").filter(pa.array(ok)), "left": rows.column("left").filter(pa.array(ok)), "best": pa.array(best[ok])})


def greedy_match(vectors: DataFrame, pair: str, left: str, vec: str) -> DataFrame:
    """pair, n_left, n_right, precision, recall and f1 of every pair.

    ``vectors``: one vector a row, with its pair's name (null is a name) and
    whether it is on the ``left`` (the candidate's) side. Precision is the mean,
    over the left side, of a vector's largest cosine on the other side; recall
    the same for the right. Without vectors on either side, both are 0; a vector
    that is null or zero has cosine 0. Repeated vectors count each.

    Sides are cut into blocks; every block of one side meets every block of the
    other, and a vector's maxima of its meetings are then compared, so a pair of
    any size is dealt out and no table of cosines is kept.
    """
    rows = vectors.select(F.col(pair).alias("pair"), F.coalesce(F.col(left), F.lit(False)).alias("left"), F.col(vec).alias("v"))
    sizes = rows.groupBy("pair").agg(F.count_if("left").alias("n_left"), F.count_if(~F.col("left")).alias("n_right")).persist()
    met = sizes.select(F.col("pair").alias("_p"), F.ceil(F.col("n_left") / BLOCK).cast("int").alias("ln"), F.ceil(F.col("n_right") / BLOCK).cast("int").alias("rn")).filter("ln > 0 AND rn > 0")
    buckets = max((met.agg(F.sum(F.col("ln").cast("long") * F.col("rn"))).first()[0] or 0) // MEETINGS, 1)
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).join(met, F.col("pair").eqNullSafe(F.col("_p")))
    own, other = F.when(F.col("left"), F.col("ln")).otherwise(F.col("rn")), F.when(F.col("left"), F.col("rn")).otherwise(F.col("ln"))
    rows = rows.withColumns({"a": F.pmod(F.xxhash64("uid"), own).cast("int"), "b": F.explode(F.sequence(F.lit(0), other - 1))})
    first, second = F.when(F.col("left"), F.col("a")).otherwise(F.col("b")), F.when(F.col("left"), F.col("b")).otherwise(F.col("a"))
    # a meeting is told from others of its bucket by its pair and both blocks
    rows = rows.select("uid", "pair", "left", "v", F.to_json(F.struct("pair", first.alias("l"), second.alias("r"))).alias("name"))
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64("name"), F.lit(buckets)), "meeting": F.xxhash64("name", F.lit("meeting"))}).drop("name")
    schema = StructType([StructField("uid", LongType()), StructField("pair", vectors.schema[pair].dataType), StructField("left", BooleanType()), StructField("best", DoubleType())])
    best = rows.groupBy("bucket").applyInArrow(_meet, schema).groupBy("uid", "pair", "left").agg(F.max("best").alias("best"))
    means = best.groupBy("pair").agg(F.avg(F.when(F.col("left"), F.col("best"))).alias("precision"), F.avg(F.when(~F.col("left"), F.col("best"))).alias("recall"))
    means = means.withColumnRenamed("pair", "_p")
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    return sizes.join(means, F.col("pair").eqNullSafe(F.col("_p")), "left").select("pair", "n_left", "n_right", p.alias("precision"), r.alias("recall"), F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
