"""Performance classes of candidates by a forest fitted on made-up candidates, and by bands where there is no vector to judge."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.audio import performance_band

# --- fixed values: classes, how often each is drawn, and the ranges of its first eight features; the other 13 are normal about the last number ---
CLASSES = ["BEGINNER", "INTERMEDIATE", "ADVANCED"]
SHARES = [0.3, 0.4, 0.3]
RANGES = [
    ([(40, 90), (20, 55), (20, 55), (20, 60), (0.01, 0.04), (90, 150), (15, 40), (0.35, 0.60)], -0.5),
    ([(90, 130), (55, 80), (55, 80), (60, 85), (0.04, 0.10), (120, 200), (5, 15), (0.18, 0.35)], 0.0),
    ([(130, 175), (80, 100), (80, 100), (85, 100), (0.08, 0.18), (130, 220), (1, 6), (0.10, 0.22)], 0.5),
]
SEED, CANDIDATES, TREES, DEPTH = 42, 1500, 100, 8
NORMAL = 13


def made_up(spark: SparkSession, n: int = CANDIDATES, seed: int = SEED) -> DataFrame:
    """label (0 to 2) and features (21 numbers) of ``n`` candidates, the same for a seed."""
    draw = F.rand(seed)
    rows = spark.range(0, n, 1, 1).withColumn("_u", draw)
    rows = rows.withColumn("label", F.when(F.col("_u") < SHARES[0], 0.0).when(F.col("_u") < SHARES[0] + SHARES[1], 1.0).otherwise(2.0))
    of_class = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.col("label") + 1).cast("int"))
    uniform = [of_class([r[0][i][0] for r in RANGES]) + F.rand(seed + 1 + i) * of_class([r[0][i][1] - r[0][i][0] for r in RANGES]) for i in range(8)]
    normal = [F.randn(seed + 100 + i) + of_class([r[1] for r in RANGES]) for i in range(NORMAL)]
    return rows.select("label", F.array(*uniform, *normal).alias("features"))


def fit_performance(candidates: DataFrame, seed: int = SEED) -> RandomForestClassificationModel:
    """A forest on rows of label and features; the seed fixes it."""
    rows = candidates.select("label", array_to_vector("features").alias("features"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(rows)


def performance_classes(rows: DataFrame, features: str, model: RandomForestClassificationModel, confidence: Column, fluency: Column) -> DataFrame:
    """``rows`` with class and ``by`` (forest, or bands).

    A vector that is null, of another length, or has a null or a number that is not finite can't be judged
    by the forest: the mean of confidence and fluency decides by bands.
    """
    v = F.col(features).cast("array<double>")
    sound = F.coalesce((F.size(v) == 8 + NORMAL) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    held = rows.withColumn("_sound", sound).withColumn("_v", array_to_vector(F.when(F.col("_sound"), v).otherwise(F.array_repeat(F.lit(0.0), 8 + NORMAL))))
    names = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("_class") + 1).cast("int"))
    judged = model.copy().setFeaturesCol("_v").setPredictionCol("_class").setProbabilityCol("").setRawPredictionCol("").transform(held)
    band = performance_band((confidence + fluency) / 2)
    return judged.withColumns({"class": F.when(F.col("_sound"), names).otherwise(band), "by": F.when(F.col("_sound"), "forest").otherwise("bands")}).drop("_sound", "_v", "_class")
