"""Rows on which queries once differed from their SQL at larger sizes."""

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import answers, cv, dashboard, records


def test_delivery_is_rounded_half_up_as_in_sql(spark):
    row = spark.createDataFrame([("a word", 63.849999999999994)], "t string, x double")
    n = F.lit(1)
    r = answers.route(F.lit("thin"), F.lit("tech"), F.lit(True), F.col("x"), F.col("x"), F.col("x"), n, n, F.col("x"), F.lit(12.34))
    got = row.select(r.alias("r")).select("r.*").first()
    assert [got[c] for c in ("communication", "relevance", "technical", "confidence", "fluency")] == [63.9] * 4 + [12.3]


def test_mean_scores_are_rounded_half_up_as_in_sql(spark):
    turns = spark.createDataFrame([(1,), (2,)], "s long")
    pairs = spark.createDataFrame([(1, 61.349999999999994)], "s long, c double")
    assert sorted(map(tuple, dashboard.conversation_scores(pairs, "s", ["c"], turns).collect())) == [(1, 61.4, 1), (2, 50.0, 0)]


def test_numbers_before_dates_are_no_phones(spark):
    texts = ["Role 1350001  05/1995 to 07/1996\n+94 100000001\n", "Role 1350001 05/1995", "call (077) 123-4567-890 or 077.123.4567", "01.2015 - 05.2019", "12345678", "0711234567 05/2019"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", cv.contacts(F.col("t"))["phones"].alias("p")).orderBy("i").collect()
    assert [r["p"] for r in rows] == [["+94 100000001"], [], ["077) 123-4567-890", "077.123.4567"], [], [], ["0711234567"]]


def test_a_capital_is_one_letter(spark):
    rows = spark.createDataFrame([("ßheit  da",), ("ŉ",), ("éa?",), ("ᾳ",), ("",)], "q string")
    assert [r[0] for r in rows.select(records.tidy_question(F.col("q"))).collect()] == ["ẞheit da?", "ŉ?", "Éa?", "ᾼ?", "?"]
    assert rows.select(F.max(F.length(T.capital(F.left("q", F.lit(1)))))).first()[0] == 1
