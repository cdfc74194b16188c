"""Queries of users' own histories; customers stand for users, orders for sessions, line items for answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import dashboard as D
from parley.operators import history as H
from parley.plans.tables import table

def _answers(spark, sf_dir):
    at = F.pmod("l_linenumber", F.lit(4))
    levels = F.array(F.lit("Beginner"), F.lit("Intermediate"), F.lit("Advanced"))
    return table(spark, sf_dir, "lineitem").withColumn("level", F.get(levels, at))


def report_details(spark, sf_dir):
    """Each order with its customer's nation and its ten largest lines."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    best = H.top_n(table(spark, sf_dir, "lineitem"), "l_orderkey", [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], 10)
    rows = H.with_children(o, best, "o_orderkey", "l_orderkey", "place", ["l_extendedprice"], "top")
    rows = rows.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n.hint("broadcast"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("o_orderkey", "c_name", "n_name", F.size("top").alias("lines"), F.round(F.get("top", F.lit(0))["l_extendedprice"], 2).alias("largest"))


def recent_reports(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return D.recent(o, c, "o_custkey", "c_custkey", "c_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("c_custkey", "o_orderkey", "c_mktsegment", "place")


def history_search(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return D.matching(o, F.col("o_orderpriority"), "NOT SPEC", F.col("o_orderstatus"), "F").select("o_orderkey", "o_custkey")


def rounded_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"price": F.col("o_totalprice") / 100, "wpm": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 1000), "score": F.when(F.col("o_orderkey") % 3 == 1, F.lit(61.5))})
    return o.select("o_orderkey", *(v.alias(k) for k, v in D.rounded(["price"], [F.col("wpm"), F.col("score")]).items()))


def profile_lookup(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return D.looked_up(o.select("o_orderkey", "o_custkey"), c, "o_custkey", "c_custkey", F.col("c_acctbal") > 0, ["c_name"]).select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("profile"))


def metrics_by_position(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").filter("role = 'user'")
    v = table(spark, sf_dir, "embeddings")
    return D.with_position(t.select("conv_id", "turn"), "conv_id", "turn", v, "vec_id", F.slice("embedding", 1, 2)).select("conv_id", "turn", "k", F.round(F.col("metric").cast("double"), 6).alias("metric"))


def level_means(spark, sf_dir):
    return D.by_level(_answers(spark, sf_dir), "l_orderkey", "level", "l_quantity").select("l_orderkey", "level", "place", "n", F.round("mean", 6).alias("mean"))


def question_means(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    value = D.question_scores([F.col("l_quantity"), F.nullif(F.col("l_discount"), F.lit(0.0)) * 1000, F.col("l_tax") * 1000], F.col("l_returnflag") == "R")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.cast("long").alias("value"))


def user_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("score", F.when(F.col("o_orderkey") % 5 > 0, F.round(F.col("o_totalprice") / 4000)))
    rows = D.summary(o, "o_custkey", "score", "o_orderstatus", [F.desc("o_orderdate"), F.desc("o_orderkey")], "F")
    return rows.select("o_custkey", "reports", "completed", "average", F.array_join(F.transform("trend", lambda x: x.cast("long").cast("string")), ",", "-").alias("trend"))


def running_levels(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("score", F.when(F.col("event_type") != "error", F.least(F.lit(100.0), F.round("value"))))
    return D.running_level(e, "user_id", "event_id", "score").select("event_id", F.round("mean", 6).alias("mean"), "next_level")


def pace_gauges(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("gauge", D.gauge(F.round("value")))
    return D.scaled(e, "user_id", "value").select("event_id", F.col("gauge").cast("long").alias("gauge"), F.round("height", 6).alias("height"))


def session_durations(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.col("ts").cast("timestamp")).alias("a"), F.max(F.col("ts").cast("timestamp")).alias("b"), F.max("event_id").alias("last"))
    return e.select("user_id", D.duration_seconds(F.col("a"), F.col("b")).alias("seconds"), (F.col("last") + 1).alias("next"))


def turn_means(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("heard", F.when(F.col("event_type") != "view", F.col("value")))
    return D.zero_filled_means(rows, "user_id", ["heard"]).withColumn("heard", F.round("heard", 6))


QUERIES = [
    report_details, recent_reports, history_search, rounded_scores, profile_lookup, metrics_by_position, level_means, question_means, user_summary, running_levels, pace_gauges, session_durations, turn_means,
]

ORACLE = {
    "report_details": """WITH r AS (SELECT l_orderkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, max(x) AS x FROM r WHERE k <= 10 GROUP BY 1)
SELECT o_orderkey, c_name, n_name, coalesce(n, 0)::INT AS lines, round(x, 2) AS largest FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN g ON l_orderkey = o_orderkey""",
    "recent_reports": "SELECT c_custkey, o_orderkey, c_mktsegment, (row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))::INT AS place FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY place <= 5",
    "history_search": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'not spec')",
    "rounded_scores": """SELECT o_orderkey, floor(o_totalprice / 100 + 0.5::DOUBLE)::BIGINT AS price,
floor(CASE o_orderkey % 3 WHEN 0 THEN o_totalprice / 1000 WHEN 1 THEN 61.5::DOUBLE ELSE 0 END + 0.5::DOUBLE)::BIGINT AS pace FROM orders""",
    "profile_lookup": "SELECT o_orderkey, coalesce(c_name, '') AS profile FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0",
    "metrics_by_position": """WITH t AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS k FROM conversations WHERE role = 'user')
SELECT conv_id, turn, k, round(CASE WHEN k <= 2 THEN embedding[k]::DOUBLE END, 6) AS metric FROM t LEFT JOIN embeddings ON vec_id = conv_id""",
    "level_means": """WITH a AS (SELECT l_orderkey, l_quantity, CASE l_linenumber % 4 WHEN 0 THEN 'Beginner' WHEN 1 THEN 'Intermediate' WHEN 2 THEN 'Advanced' END AS level FROM lineitem)
SELECT l_orderkey, level, CASE level WHEN 'Beginner' THEN 1 WHEN 'Intermediate' THEN 2 ELSE 3 END::INT AS place, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM a WHERE level IS NOT NULL GROUP BY 1, 2""",
    "question_means": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
CASE WHEN l_returnflag = 'R' THEN 0 ELSE floor((0.0::DOUBLE + l_quantity + coalesce(nullif(l_discount, 0) * 1000, 0) + l_tax * 1000) / 3 + 0.5::DOUBLE) END::BIGINT AS value FROM lineitem""",
    "user_summary": """WITH s AS (SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice / 4000) END AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT o_custkey, count(*) AS reports, count(*) FILTER (o_orderstatus = 'F') AS completed, floor(avg(coalesce(score, 0)) + 0.5::DOUBLE)::BIGINT AS average,
string_agg(coalesce(score::BIGINT::VARCHAR, '-'), ',' ORDER BY k DESC) FILTER (k <= 7) AS trend FROM s GROUP BY 1""",
    "running_levels": """WITH m AS (SELECT event_id, avg(CASE WHEN event_type <> 'error' THEN least(100.0::DOUBLE, round(value)) ELSE 70 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS mean FROM events)
SELECT event_id, round(mean, 6) AS mean, CASE WHEN mean >= 85 THEN 'Hard' WHEN mean >= 60 THEN 'Medium' ELSE 'Easy' END AS next_level FROM m""",
    "pace_gauges": """SELECT event_id, least(100, floor((round(value) - 60) / 1.2::DOUBLE + 0.5::DOUBLE))::BIGINT AS gauge,
round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0.5::DOUBLE), 6) AS height FROM events WINDOW w AS (PARTITION BY user_id)""",
    "session_durations": "SELECT user_id, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 + 0.5::DOUBLE)::BIGINT AS seconds, max(event_id) + 1 AS next FROM events GROUP BY 1",
    "turn_means": "SELECT user_id, round(avg(CASE WHEN event_type <> 'view' THEN value ELSE 0 END), 6) AS heard FROM events GROUP BY 1",
}
