"""Profiles of tables: counts, moments, correlations, vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.corpus import exact_quantiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.join(df.agg(F.count("*").alias("total")).hint("broadcast")).select(F.col(column).alias("value"), "n", (F.col("n") / F.col("total")).alias("share"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: count, nulls, mean, deviation, quartiles (interpolated), ends, fences and population moments; one pass beside the quartiles'."""
    quartiles = {c: F.lit(exact_quantiles(df, c, (0.25, 0.5, 0.75))).cast("array<double>") for c in columns}
    quart = quartiles.__getitem__
    each = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), quart(c)[0].alias("q1"), quart(c)[1].alias("median"), quart(c)[2].alias("q3"), F.max(c).cast("double").alias("max"),
            F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"),
        )
        for c in columns
    ]
    rows = df.agg(F.array(*each).alias("r")).select(F.inline("r"))
    iqr = F.col("q3") - F.col("q1")
    return rows.withColumns({"low_fence": F.col("q1") - 1.5 * iqr, "high_fence": F.col("q3") + 1.5 * iqr})


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values beyond the fences, by column."""
    fences = describe(df, columns).select("column", "low_fence", "high_fence").hint("broadcast")
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))))
    return long.join(fences, "column").groupBy("column").agg(F.count_if((F.col("x") < F.col("low_fence")) | (F.col("x") > F.col("high_fence"))).alias("outliers"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs)).alias("r")).select(F.inline("r"))


def codes(df: DataFrame, column: str) -> DataFrame:
    """Integer codes of the sorted values; null has -1."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    ranked = values.select(F.col(column).alias("_v"), (F.row_number().over(Window.orderBy(column)) - 1).alias("code"))
    return df.join(ranked, F.col(column) == F.col("_v"), "left").drop("_v").withColumn("code", F.coalesce("code", F.lit(-1)))


def text_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """Words, distinct words, their ratio, and sentences of each text."""
    words = T.words(F.lower(F.coalesce(F.col(text), F.lit(""))))
    sentences = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[.!?]+"), lambda s: T.strip(s) != ""))
    rows = df.select(key, F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("unique_words"), sentences.alias("sentences"))
    return rows.withColumn("ratio", F.coalesce(F.try_divide("unique_words", "words"), F.lit(0.0)))


def vocabulary(df: DataFrame, text: str, n: int) -> DataFrame:
    """The ``n`` most frequent content tokens with their rank as id; equals by token."""
    counts = df.select(F.explode(T.content_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    top = counts.orderBy(F.desc("count"), "token").limit(n)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("count"), "token")) - 1)


def vocabulary_summary(df: DataFrame, text: str) -> DataFrame:
    counts = df.select(F.explode(T.content_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    return counts.agg(F.count("*").alias("types"), F.sum("c").alias("tokens"), F.count_if(F.col("c") == 1).alias("hapax"), F.max("c").alias("most"))


def coverage_size(df: DataFrame, text: str, share: float = 0.99) -> DataFrame:
    """How many of the most frequent tokens make up this share of all occurrences, from the counts of counts."""
    counts = df.select(F.explode(T.content_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    levels = counts.groupBy("c").agg(F.count("*").alias("types"))
    w = Window.orderBy(F.desc("c"))
    runs = levels.select("c", "types", F.sum(F.col("c") * F.col("types")).over(w).alias("upto"), F.sum("types").over(w).alias("many"))
    goal = levels.agg((F.sum(F.col("c") * F.col("types")) * share).alias("goal")).hint("broadcast")
    first = runs.join(goal).filter(F.col("upto") >= F.col("goal")).agg(F.min(F.struct("many", "types", "c", "upto", "goal")).alias("r")).select("r.*")
    return first.select((F.col("many") - F.floor((F.col("upto") - F.col("goal")) / F.col("c"))).cast("long").alias("tokens"))


def imbalance(df: DataFrame, column: str) -> DataFrame:
    """Largest by smallest group."""
    return df.groupBy(column).agg(F.count("*").alias("n")).agg((F.max("n") / F.min("n")).alias("ratio"), F.count("*").alias("groups"))


def character_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Characters with their counts, most frequent first; the ids follow those of the tokens."""
    chars = df.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "")).alias("char")).filter("char <> ''").groupBy("char").agg(F.count("*").alias("count"))
    return chars.withColumn("id", F.row_number().over(Window.orderBy(F.desc("count"), "char")) - 1)


def length_summary(df: DataFrame, text: str) -> DataFrame:
    """Lengths at fixed places of the sorted list (no interpolation), from their histogram."""
    h = df.groupBy(F.length(F.coalesce(F.col(text), F.lit(""))).alias("x")).agg(F.count("*").alias("c"))
    w = Window.orderBy("x")
    runs = h.withColumn("upto", F.sum("c").over(w))
    total = h.agg(F.sum("c").alias("n")).hint("broadcast")
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("x")))
    rows = runs.join(total)
    return rows.agg(F.max("n").alias("n"), F.min("x").alias("min"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.col("n") * 0.95)).alias("p95"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("c")) / F.max("n")).alias("mean"))


def element_means(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean of vectors place by place, for each key."""
    rows = df.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("m"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda r: r["m"]).alias("mean"))


def null_tally(df: DataFrame) -> DataFrame:
    return df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls")) for c in df.columns)).alias("r")).select(F.inline("r"))
