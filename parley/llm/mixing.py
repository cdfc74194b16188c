"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import discard, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point of their name, repeating; null comes last.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often, and no target exceeds so many times its source's size.
CAP = 3
ROUNDS = 60
TOLERANCE = 1e-7
#: Rows of one stratum (source and size) that are ranked together; the root of their number if that is more.
RANKED = 256
#: Rates are whole multiples of one in so many, so that their sums are exact.
UNIT = 1 << 20
#: Sizes whose strata are summed up in one task.
RANGE = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets_of(sizes: np.ndarray, weights: np.ndarray, cap: float = CAP) -> np.ndarray:
    """Shares of all sizes by weight; a share above ``cap`` times its size stops there and the excess is shared anew."""
    total, out, held = float(sizes.sum()), np.zeros(len(sizes)), np.zeros(len(sizes), dtype=bool)
    while not held.all():
        free = (total - cap * sizes[held].sum()) * weights[~held] / weights[~held].sum()
        out[~held] = free
        over = ~held & (out > cap * sizes)
        if not over.any():
            break
        out[over], held = cap * sizes[over], held | over
    return out


def with_targets(sources: DataFrame) -> DataFrame:
    """source, source_size and target; ``sources`` has a row for each source, and the number of sources is all the driver sees.

    A source is a configured input (thousands at most), never a key taken from the documents' contents.
    """
    rows = sources.toPandas()
    rows = rows.assign(rank=[(s is None, s.encode() if s is not None else b"") for s in rows["source"]]).sort_values("rank").reset_index(drop=True)
    weights = np.resize(np.array(WEIGHTS), len(rows))
    rows["target"] = targets_of(rows["source_size"].to_numpy(np.float64), weights)
    data = [(s, int(n), float(t)) for s, n, t in zip(rows["source"], rows["source_size"], rows["target"])]
    return sources.sparkSession.createDataFrame(data, "source string, source_size long, target double")


def tilted(lam: Column, size: Column, scale: Column) -> Column:
    """Copies of a document of this size: 1 tilted by exp(lam * size / scale), bent so as not to pass ``CAP``."""
    return F.lit(float(CAP)) / (F.lit(1.0) + F.lit(float(CAP - 1)) * F.exp(-F.least(F.greatest(lam * size / scale, F.lit(-500.0)), F.lit(500.0))))


def balance(strata: DataFrame, goals: DataFrame) -> DataFrame:
    """Newton iterations on the convex dual: one multiplier per source, such that the tilted sizes sum to its target.

    ``strata``: source, size, n. The rate of a document is the one nearest to 1
    (in relative entropy within 0 and ``CAP``) that meets the token constraint.
    Each round sums gradient and curvature over the strata of all partitions; a
    bracket keeps a Newton step that would leave it (then it is halved).
    """
    spark = strata.sparkSession
    scale = {r["source"]: float(max(r["m"], 1)) for r in strata.groupBy("source").agg(F.max("size").alias("m")).collect()}
    state = {r["source"]: {"lam": 0.0, "lo": -np.inf, "hi": np.inf, "target": r["target"], "size": r["source_size"]} for r in goals.collect()}
    for s in state.values():
        s["done"] = s["size"] == 0
        if s["target"] >= CAP * s["size"] * (1 - 1e-12):
            s |= {"lam": 1e9, "done": True}
    for _ in range(ROUNDS):
        if all(s["done"] for s in state.values()):
            break
        lam = spark.createDataFrame([(k, s["lam"], scale.get(k, 1.0)) for k, s in state.items() if not s["done"]], "source string, lam double, scale double").hint("broadcast")
        rate = tilted(F.col("lam"), F.col("size"), F.col("scale"))
        rows = (
            strata.withColumnRenamed("source", "_source").join(lam, F.col("_source").eqNullSafe(F.col("source")))
            .groupBy("source")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("scale") * rate * (1 - rate / CAP)).alias("slope"))
            .collect()
        )
        for r in rows:
            s = state[r["source"]]
            gap = r["got"] - s["target"]
            if abs(gap) <= TOLERANCE * max(s["target"], 1.0):
                s["done"] = True
                continue
            s["hi" if gap > 0 else "lo"] = s["lam"]
            step = s["lam"] - gap / r["slope"] if r["slope"] > 0 else np.nan
            if not s["lo"] < step < s["hi"]:
                far = s["lam"] + (-1 if gap > 0 else 1) * max(1.0, abs(s["lam"]))
                step = (s["lo"] + s["hi"]) / 2 if np.isfinite(s["lo"]) and np.isfinite(s["hi"]) else far
            s["lam"] = float(step)
    return spark.createDataFrame([(k, s["lam"], scale.get(k, 1.0), float(s["target"]), int(s["size"])) for k, s in state.items()], "source string, lam double, scale double, target double, source_size long")


def _rounded(rated: DataFrame) -> DataFrame:
    """source, size, n and copies: the rates of a source's strata summed up by size, largest first, and the whole part of each sum less that of the one before.

    Sums are whole multiples of 1 / ``UNIT``, so exact in any order; ranges of
    ``RANGE`` sizes are summed apart and put one after the other. A stratum is
    within one copy of its rate, a source within half its largest document.
    Documents without words stay once.
    """
    rows = rated.withColumns({"q": F.when(F.col("size") > 0, F.round(F.col("n") * F.col("rate") * UNIT)).otherwise(0).cast("long"), "range": F.floor(F.col("size") / RANGE)})
    rows = stage(rows.select("source", "size", "n", "q", "range"), "mix-rates")
    above = rows.groupBy("source", "range").agg(F.sum("q").alias("q"))
    above = above.select(F.col("source").alias("_s"), F.col("range").alias("_r"), (F.sum("q").over(Window.partitionBy("source").orderBy(F.desc("range"))) - F.col("q")).alias("before"))
    rows = rows.join(above, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    upto = F.col("before") + F.sum("q").over(Window.partitionBy("source", "range").orderBy(F.desc("size"))) + UNIT // 2
    whole = lambda x: F.floor(x / UNIT)
    return rows.withColumn("upto", upto).select("source", "size", "n", F.when(F.col("size") == 0, F.col("n")).otherwise(whole(F.col("upto")) - whole(F.col("upto") - F.col("q"))).cast("long").alias("copies"))


def _whole(rated: DataFrame, goals: DataFrame) -> DataFrame:
    """Copies of each stratum: source, size, n, copies, with each source as near its target as its documents allow.

    What rounding leaves of a target is made up by whole documents, the largest
    that fit first: copies are added, or taken away, where there is room for
    it, until no document is small enough. Each round asks the strata for one
    size of each source; sizes fall, and what is left at least halves unless room ran out.
    """
    spark, rows = rated.sparkSession, stage(_rounded(rated), "mix-rounded")
    got = {r["source"]: r["got"] for r in rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got")).collect()}
    left = {r["source"]: [r["target"] - got.get(r["source"], 0), None] for r in goals.collect()}
    moved, kind = [], "_s string, _due double, _below long"
    while left:
        due = spark.createDataFrame([(s, float(d), z) for s, (d, z) in left.items()], kind).hint("broadcast")
        room = F.when(F.col("_due") > 0, CAP * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = rows.join(due, F.col("source").eqNullSafe(F.col("_s"))).withColumn("room", room)
        fits = fits.filter((F.col("size") > 0) & (F.col("room") > 0) & (F.col("size") <= F.abs("_due")) & (F.col("_below").isNull() | (F.col("size") < F.col("_below"))))
        found = fits.groupBy("_s").agg(F.max(F.struct("size", "room")).alias("top")).select("_s", "top.*").collect()
        now = {}
        for r in found:
            d, z = left[r["_s"]][0], r["size"]
            k = min(int(abs(d) // z), r["room"])
            moved.append((r["_s"], z, k if d > 0 else -k))
            now[r["_s"]] = [d - moved[-1][2] * z, z]
        left = now
    change = spark.createDataFrame(moved, "_s string, _z long, _k long").hint("broadcast")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    return rows.join(change, same, "left").select("source", "size", "n", (F.col("copies") + F.coalesce("_k", F.lit(0))).alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", order_col: str | None = None) -> DataFrame:
    """How often the mix takes each document.

    A document's size is its number of words (a null text has none). Documents of
    one source and size share a rate and form a stratum; strata are bounded by
    the distinct sizes, not by the documents. The copies of a stratum go to its
    documents as evenly as whole numbers allow, by rank of a hash of the id (or of
    ``order_col``); ranks are made in salted buckets, which like their number
    grow no faster than the root of a stratum, so that no group meets in one task. Equal ids share a hash and differ in rank only.

    Returns doc_id, size, source_size, target (of the source), taken (copies
    times size) and copies (0 to ``CAP``; documents without words keep one).
    An empty table gives no rows.
    """
    sized = stage(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(order_col or id_col).alias("h"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")), "mix-sizes")
    strata = stage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-strata")
    goals = with_targets(strata.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    dual = balance(strata, goals)
    d = dual.hint("broadcast")
    rated = strata.join(d.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "size", "n", tilted(F.col("lam"), F.col("size"), F.col("scale")).alias("rate"))
    whole = stage(_whole(rated, goals), "mix-copies")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    plan = whole.select(key.alias("_k"), F.col("size").alias("_z"), "n", "copies")
    hashed = sized.withColumnRenamed("h", "_h").withColumn("_k0", key)
    rows = hashed.join(plan, (F.col("_k0") == F.col("_k")) & (F.col("size") == F.col("_z")))
    rows = rows.withColumn("_b", F.pmod(F.shiftright("_h", 20), F.greatest(F.ceil(F.col("n") / F.greatest(F.lit(float(RANKED)), F.sqrt("n"))), F.lit(1))))
    rows = rows.select("doc_id", "source", "size", "n", "copies", "_h", "_k", "_b")
    small = rows.filter(F.col("n") <= RANKED)
    large = rows.filter(F.col("n") > RANKED)
    sums = large.groupBy("_k", "size", "_b").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    w = Window.partitionBy("_k", "size").orderBy("_b")
    upto, before = F.sum("m").over(w), F.sum("m").over(w) - F.col("m")
    whole_div = lambda a: F.floor(a * F.col("copies") / F.col("n"))
    quota = sums.select("_k", "size", "_b", "m", (whole_div(upto) - whole_div(before)).cast("long").alias("q"))
    quota = quota.select(F.col("_k").alias("_qk"), F.col("size").alias("_qs"), F.col("_b").alias("_qb"), "m", "q")
    large = large.join(quota, (F.col("_k") == F.col("_qk")) & (F.col("size") == F.col("_qs")) & (F.col("_b") == F.col("_qb")))
    both = small.select("doc_id", "source", "size", "_h", "_k", "_b", F.col("n").alias("m"), F.col("copies").alias("q")).unionByName(large.select("doc_id", "source", "size", "_h", "_k", "_b", "m", "q"))
    rank = F.row_number().over(Window.partitionBy("_k", "size", "_b").orderBy("_h", "doc_id"))
    base = F.floor(F.col("q") / F.col("m"))
    out = both.withColumn("copies", (base + F.when(rank <= F.col("q") - base * F.col("m"), 1).otherwise(0)).cast("int"))
    goal = dual.select(F.col("source").alias("_s"), "source_size", "target").hint("broadcast")
    return out.join(goal, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
