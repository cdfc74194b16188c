"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, stage


def _stars(e: DataFrame) -> DataFrame:
    """One large star and one small star over edges (a, b) with b < a."""
    sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = sym.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
    return large.join(low, "a").select(F.explode(pairs).alias("p")).select("p.a", "p.b").filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of ``edges`` (a, b: long).

    Each round is a written table; a hub's edges meet only in joins that Spark
    can split. Ends when a round changes nothing. Loops and repeated edges are
    ignored; without edges the result is empty.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while True:
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if got["n"] == 0 or (got["n"], got["h"]) == mark:
            break
        mark, before = (got["n"], got["h"]), now
        now = stage(_stars(before), "cc")
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
