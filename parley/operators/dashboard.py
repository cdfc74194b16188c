"""What a user sees of their own sessions: latest rows with details, averages, trends, gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T
from parley.operators.history import top_n


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def recent(reports: DataFrame, sessions: DataFrame, report_key: str, session_key: str, user: str, order: list[Column], n: int = 50) -> DataFrame:
    """The newest ``n`` reports of each user with their session's columns."""
    return top_n(reports.join(sessions, F.col(report_key) == F.col(session_key)), user, order, n)


def matching(sessions: DataFrame, text: Column, query: str, category: Column, wanted: str = "all") -> DataFrame:
    """Rows whose text has the query, whatever its case, in the wanted category ('all': any)."""
    hit = F.contains(F.lower(text), F.lit(query.lower()))
    return sessions.filter(hit if wanted == "all" else hit & (category == wanted))


def rounded(scores: list[str], pace: list[Column]) -> dict[str, Column]:
    """Whole scores, and the pace from the first measurement there is."""
    return {c: half_up(F.col(c)) for c in scores} | {"pace": half_up(F.coalesce(*pace, F.lit(0.0)))}


def looked_up(rows: DataFrame, profiles: DataFrame, key: str, profile_key: str, ready: Column, columns: list[str]) -> DataFrame:
    """Rows with the columns of their profile; null if there is none or it isn't ready."""
    return rows.join(profiles.filter(ready).select(F.col(profile_key).alias("_p"), *columns), F.col(key) == F.col("_p"), "left").drop("_p")


def with_position(rows: DataFrame, session: str, order: str, vectors: DataFrame, vector_key: str, vector: str) -> DataFrame:
    """The k-th row of each session with the k-th number of its vector; null if it has fewer."""
    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy(session).orderBy(order)))
    numbers = vectors.select(F.col(vector_key).alias("_s"), F.posexplode(vector).alias("_k", "metric"))
    return placed.join(numbers, (F.col(session) == F.col("_s")) & (F.col("k") == F.col("_k") + 1), "left").drop("_s", "_k")


def by_level(answers: DataFrame, session: str, level: str, metric: str) -> DataFrame:
    """Count and mean of a metric by difficulty, in the levels' order; levels without answers don't appear."""
    place = F.array_position(F.array(*(F.lit(x) for x in L.DIFFICULTIES)), F.col(level))
    rows = answers.withColumn("place", place.cast("int")).filter("place > 0")
    return rows.groupBy(session, level, "place").agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))


def question_scores(metrics: list[Column], skipped: Column) -> Column:
    """Mean of an answer's metrics, rounded; one that is missing counts as 0, and so does a declined answer."""
    total = sum((F.coalesce(m, F.lit(0.0)) for m in metrics), F.lit(0.0))
    return F.when(skipped, 0).otherwise(half_up(total / len(metrics)))


def summary(reports: DataFrame, user: str, score: str, status: str, order: list[Column], done: str = "COMPLETED", n: int = 7) -> DataFrame:
    """For each user: reports, completed sessions, the mean score (none is 0) and the last ``n`` scores, oldest first."""
    all_ = reports.groupBy(user).agg(F.count("*").alias("reports"), F.count_if(F.col(status) == done).alias("completed"), half_up(F.avg(F.coalesce(score, F.lit(0.0)))).alias("average"))
    last = top_n(reports, user, order, n).groupBy(user).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(score).alias("s"))), asc=False), lambda r: r["s"]).alias("trend"))
    return all_.join(last, user)


def level_for(mean: Column) -> Column:
    """Next difficulty by the running mean of scores."""
    return F.when(mean >= 85, "Hard").when(mean >= 60, "Medium").otherwise("Easy")


def running_level(answers: DataFrame, session: str, order: str, score: str, default: float = 70.0) -> DataFrame:
    """Mean of all scores so far (a missing one counts as ``default``) and the level it asks for next."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mean = F.avg(F.coalesce(score, F.lit(default))).over(w)
    return answers.withColumn("mean", mean).withColumn("next_level", level_for(F.col("mean")))


def gauge(pace: Column) -> Column:
    """Words per minute on a dial to 100."""
    return F.least(F.lit(100), half_up((pace - 60) / 1.2))


def scaled(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each value between the least and the largest of its series (0.5 if they are equal)."""
    w = Window.partitionBy(key)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("height", F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.5)))


def duration_seconds(start: Column, end: Column) -> Column:
    return half_up((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000)


def next_ordinal(rows: DataFrame, session: str, ordinal: str) -> DataFrame:
    return rows.groupBy(session).agg((F.max(ordinal) + 1).alias("next"))


def conversation_scores(pairs: DataFrame, session: str, scores: list[str], sessions: DataFrame, default: float = 50.0) -> DataFrame:
    """Means of the scores of each session's answers; sessions without answers have ``default``."""
    means = pairs.groupBy(session).agg(*(F.avg(c).alias(c) for c in scores), F.count("*").alias("answers"))
    return sessions.select(session).distinct().join(means, session, "left").select(session, *(T.rounded(F.coalesce(c, F.lit(default)), 1).alias(c) for c in scores), F.coalesce("answers", F.lit(0)).alias("answers"))


def zero_filled_means(rows: DataFrame, session: str, metrics: list[str]) -> DataFrame:
    """Means over a session's turns; a missing value counts as 0."""
    return rows.groupBy(session).agg(*(F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in metrics))
