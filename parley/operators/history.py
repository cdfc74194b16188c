"""Users' histories, jobs, and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The latest row of each key."""
    return top_n(df, key, order, 1).drop("place")


def top_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts each partition's groups before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= n)


def with_children(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, order: str, columns: list[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children; empty if they have none."""
    nested = child.groupBy(F.col(child_key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order)))).alias(name))
    return parent.join(nested, F.col(parent_key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.from_json(F.lit("[]"), nested.schema[name].dataType)))


def lower_set(a: Column) -> Column:
    return F.array_distinct(F.transform(a, F.lower))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two sets of strings whatever their case; 0 if both are empty."""
    x, y = lower_set(a), lower_set(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def gaps(have: Column, wanted: Column) -> Column:
    """Wanted skills one hasn't, in their own writing and order."""
    low = F.transform(have, F.lower)
    return F.filter(wanted, lambda s: ~F.array_contains(low, F.lower(s)))


def band_fit(overall: Column, seniority: Column) -> Column:
    s = F.lower(seniority)
    return (
        F.when(F.coalesce(s, F.lit("")) == "", 0.6).when(F.contains(s, F.lit("junior")), F.when(overall < 65, 1.0).otherwise(0.6))
        .when(F.contains(s, F.lit("senior")) | F.contains(s, F.lit("lead")), F.when(overall >= 80, 1.0).otherwise(0.4)).otherwise(F.when((overall >= 65) & (overall < 85), 1.0).otherwise(0.55))
    )


def match_score(similarity: Column, fit: Column) -> Column:
    return F.floor((0.7 * similarity + 0.3 * fit) * 100 + 0.5)


def _grade(seniority: Column) -> Column:
    """Jobs of one grade fit a candidate equally."""
    s = F.lower(F.coalesce(seniority, F.lit("")))
    return F.when(s == "", "").when(F.contains(s, F.lit("junior")), "junior").when(F.contains(s, F.lit("senior")) | F.contains(s, F.lit("lead")), "senior").otherwise("other")


def match_jobs(candidates: DataFrame, jobs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best jobs of each candidate (id, skills, overall) among jobs (job_id, wanted, seniority), with what is missing.

    Candidates meet the jobs they share a skill with. Of the others only the
    grade counts, so the first ``k`` jobs of each of the four grades are enough:
    every job behind them has no higher score and a larger id. Skills are brought
    into one case once on either side; missing ones are looked up for the best only.
    """
    people = candidates.select("id", "skills", "overall", lower_set(F.col("skills")).alias("_have"))
    shelf = jobs.select("job_id", "wanted", "seniority", lower_set(F.col("wanted")).alias("_want"))
    shared = people.select("id", F.explode("_have").alias("s")).join(shelf.select("job_id", F.explode("_want").alias("s")), "s").groupBy("id", "job_id").agg(F.count("*").alias("both"))
    first = top_n(jobs.select("job_id", _grade(F.col("seniority")).alias("g")), "g", [F.asc("job_id")], k)
    few = [r["job_id"] for r in first.select("job_id").collect()]
    kind = jobs.schema["job_id"].dataType
    rest = people.select("id", F.explode(F.lit(few).cast(ArrayType(kind))).alias("job_id"), F.lit(0).cast("long").alias("both"))
    pairs = shared.unionByName(rest).groupBy("id", "job_id").agg(F.sum("both").alias("both"))
    # pairs are scored and ranked by numbers; lists join the best only
    rows = pairs.join(people.select("id", "overall", F.size("_have").alias("_h")), "id").join(shelf.select("job_id", "seniority", F.size("_want").alias("_w")), "job_id")
    alike = F.coalesce(F.try_divide("both", F.col("_h") + F.col("_w") - F.col("both")), F.lit(0.0))
    rows = rows.select("id", "job_id", match_score(alike, band_fit(F.col("overall"), F.col("seniority"))).alias("score"))
    best = top_n(rows, "id", [F.desc("score"), F.asc("job_id")], k).join(people.select("id", "skills"), "id").join(shelf.select("job_id", "wanted"), "job_id")
    return best.select("id", "job_id", "score", gaps(F.col("skills"), F.col("wanted")).alias("missing"), "place")


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Islands of inclusive integer intervals that overlap or touch: (key, start, end)."""
    w = Window.partitionBy(key).orderBy(start, end)
    top = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("_top").isNull() | (F.col(start) > F.col("_top") + 1), 1).otherwise(0)
    rows = df.withColumn("_top", top).withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"))


def covered(islands: DataFrame, key: str) -> DataFrame:
    return islands.groupBy(key).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"), F.count("*").alias("islands"))


def carry_forward(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The last known value at each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("current", F.last(value, ignorenulls=True).over(w))


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows in place of existing ones with their key."""
    return existing.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
