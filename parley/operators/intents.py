"""Intents of turns: rules first, then a text classifier fitted on labelled turns, then the length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T
from parley.operators import scoring

#: Lengths of the pieces of words that are features.
SHORTEST, LONGEST = 2, 5
#: Inverse strength of the penalty on coefficients.
C = 4.0
#: Below this probability the length decides; from so many words on a turn is substantive then.
LEAST, SUBSTANTIVE = 0.45, 20


def grams(text: Column) -> Column:
    """Pieces of ``SHORTEST`` to ``LONGEST`` characters of each word with a space on both sides."""
    def of_word(w: Column) -> Column:
        sizes = F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length(w)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))))

    return F.flatten(F.transform(T.words(F.lower(text)), lambda w: F.transform(F.array(F.concat(F.lit(" "), w, F.lit(" "))), of_word)[0]))


def _counts(turns: DataFrame, key: list[str], text: str) -> DataFrame:
    return turns.select(*key, F.explode(grams(F.col(text))).alias("gram"))


@dataclass
class IntentModel:
    """Labels, an intercept each, and for each piece its rarity and a coefficient for each label. Its size is that of the vocabulary of the labelled turns."""

    labels: list[str]
    intercepts: list[float]
    terms: list[tuple[str, float, list[float]]]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.terms, "gram string, idf double, coefficients array<double>")


def labelled_turns(spark: SparkSession) -> DataFrame:
    """The fixed labelled turns: text, label."""
    return spark.createDataFrame([(t, k) for k, v in L.INTENT_TURNS.items() for t in v], "text string, label string")


def training_rows(turns: DataFrame) -> tuple[DataFrame, list[str], list[tuple[str, float]]]:
    """label (number), weight and features of labelled turns, the labels, and pieces with their rarity in index order.

    A piece weighs (1 + ln count) * (ln((1 + n) / (1 + turns with it)) + 1), rows
    have length 1; a label's rows weigh together as much as another's.
    """
    rows = turns.withColumn("id", F.monotonically_increasing_id()).persist()
    n = rows.count()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    labels = sorted(sizes)
    tf = _counts(rows, ["id"], "text").groupBy("id", "gram").agg((1 + F.log(F.count("*"))).alias("tf"))
    idf = [(r["gram"], r["idf"]) for r in tf.groupBy("gram").agg((F.log((F.lit(n) + 1) / (F.count("*") + 1)) + 1).alias("idf")).orderBy("gram").collect()]
    index = turns.sparkSession.createDataFrame([(g, w, i) for i, (g, w) in enumerate(idf)], "gram string, idf double, i int")
    weighed = tf.join(F.broadcast(index), "gram").select("id", "i", (F.col("tf") * F.col("idf")).alias("w"))
    held = weighed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("v"))
    size = len(idf)

    @F.udf(VectorUDT())
    def vector(v) -> SparseVector:
        norm = sum(x["w"] ** 2 for x in v or []) ** 0.5
        return Vectors.sparse(size, [x["i"] for x in v or []], [x["w"] / norm for x in v or []])

    number = F.coalesce(*(F.when(F.col("label") == k, F.lit(float(i))) for i, k in enumerate(labels)))
    weight = F.coalesce(*(F.when(F.col("label") == k, F.lit(n / (len(labels) * m))) for k, m in sizes.items()))
    return rows.join(held, "id", "left").select(number.alias("label"), weight.alias("weight"), vector("v").alias("features")), labels, idf


def fit_intents(turns: DataFrame, c: float = C) -> IntentModel:
    """Multinomial logistic regression on ``turns`` (text, label): a curated list, whose vocabulary the driver holds."""
    rows, labels, idf = training_rows(turns)
    n = rows.agg(F.sum("weight")).first()[0]
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10).fit(rows)
    w = fitted.coefficientMatrix.toArray()
    return IntentModel(labels, [float(b) for b in fitted.interceptVector], [(g, float(r), w[:, i].tolist()) for i, (g, r) in enumerate(idf)])


def probabilities(turns: DataFrame, key: list[str], text: str, model: IntentModel) -> DataFrame:
    """key and p (a probability for each label). The model's pieces go to every task; a turn's pieces meet in its own task first."""
    k = len(model.labels)
    terms = F.broadcast(model.frame(turns.sparkSession))
    tf = _counts(turns, key, text).join(terms, "gram").groupBy(*key, "gram").agg((1 + F.log(F.count("*"))).alias("tf"), F.first("idf").alias("idf"), F.first("coefficients").alias("c"))
    w = F.col("tf") * F.col("idf")
    sums = tf.groupBy(*key).agg(F.sum(w * w).alias("square"), *(F.sum(w * F.col("c")[i]).alias(f"m{i}") for i in range(k)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    norm = F.sqrt(F.when(zero("square") > 0, F.col("square")).otherwise(1.0))
    sums = sums.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(key)), "square", *(f"m{i}" for i in range(k)))
    same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(key)]
    margins = F.array(*(zero(f"m{i}") / norm + b for i, b in enumerate(model.intercepts)))
    rows = turns.select(*key).join(sums, same, "left").select(*key, margins.alias("m"))
    e = F.transform("m", lambda x: F.exp(x - F.array_max("m")))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.select(*key, e.alias("e")).select(*key, F.transform("e", lambda x: x / total).alias("p"))


def classified(turns: DataFrame, key: list[str], text: str, model: IntentModel) -> DataFrame:
    """key, intent, confidence and rule of every turn; ``key`` tells turns apart.

    Turns that no rule settles, those of 7 to 34 words, go to the model; below
    ``LEAST`` their length decides. Of equal probabilities the first label by name wins.
    """
    n = F.size(T.words(F.coalesce(text, F.lit(""))))
    rows = turns.select(*key, F.col(text).alias("_text"), n.alias("_n"), scoring.intent_rule(F.col(text)).alias("_r"))
    middle = rows.filter("_r IS NULL")
    best = F.array_max(F.transform(F.arrays_zip("p", F.sequence(F.lit(0), F.lit(len(model.labels) - 1)).alias("i")), lambda x: F.struct(x["p"].alias("p"), (-x["i"]).alias("i"))))
    found = probabilities(middle, key, "_text", model).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), best.alias("b"))
    sure = F.element_at(F.create_map(*(F.lit(x) for kv in scoring.SURE.items() for x in kv)), F.col("_r.rule"))
    by_rule = rows.filter("_r IS NOT NULL").select(*key, F.col("_r.intent").alias("intent"), sure.alias("confidence"), F.col("_r.rule").alias("rule"))
    near = F.col("b.p") >= LEAST
    label = F.element_at(T.strs(model.labels), 1 - F.col("b.i"))
    by_model = middle.join(found, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]).select(
        *key, F.when(near, label).when(F.col("_n") >= SUBSTANTIVE, "substantive").otherwise("thin").alias("intent"), F.round("b.p", 3).alias("confidence"), F.when(near, "model").otherwise("length").alias("rule"),
    )
    return by_rule.unionByName(by_model)
