"""Queries of retrieval, evaluation, history, profiles and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T
from parley.operators import corpus as C
from parley.operators import evaluation as E
from parley.operators import history as H
from parley.operators import profile as P
from parley.operators import retrieval as R
from parley.plans import sql as Q
from parley.plans.tables import table
from parley.streaming import events as V


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def tfidf_topk(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    top = R.top_texts(bench, "item_id", "text", docs, "doc_id", "text", 5)
    return top.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "place")


def embedding_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return R.top_by_vector(v.filter("vec_id % 100 = 0"), v, 5, "vec_id", "embedding").select("query", "id", "similarity", "place")


def history_left_join(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = c.join(o, c.c_custkey == o.o_custkey, "left")
    return rows.select("c_custkey", "o_orderkey", F.coalesce("o_orderstatus", F.lit("none")).alias("status"), F.coalesce("o_totalprice", F.lit(0.0)).alias("price"))


def latest_per_user(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return H.latest(e, "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


def top_n_per_user(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return H.top_n(e, "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "place")


def nested_session(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = H.with_children(o, li, "o_orderkey", "l_orderkey", "l_linenumber", ["l_partkey", "l_quantity"], "items")
    return rows.select("o_orderkey", F.size("items").alias("n"), F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


def match_topk(spark, sf_dir):
    o, li, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    bought = o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey).groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set("p_brand")).alias("skills"), F.count("*").alias("n"))
    people = bought.select("id", "skills", F.least(F.col("n") * 3, F.lit(100)).alias("overall"))
    jobs = p.groupBy(F.pmod("p_partkey", F.lit(12)).alias("job_id")).agg(F.array_sort(F.collect_set(F.when(F.col("p_size") > 46, F.col("p_brand")))).alias("wanted"))
    jobs = jobs.withColumn("seniority", F.element_at(F.array(F.lit("Junior"), F.lit("Mid"), F.lit("Senior")), (F.col("job_id") % 3 + 1).cast("int")))
    return H.match_jobs(people, jobs, 3).select("id", "job_id", "score", F.array_join("missing", ",").alias("missing"), "place")


def session_trend(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    slope = F.when(F.count("value") >= 3, F.regr_slope("value", "i"))
    return _r(rows.groupBy("user_id").agg(F.count("*").alias("n"), slope.alias("trend")), "trend")


def null_skipping_means(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") != "error", F.nanvl("value", F.lit(None)))
    return _r(e.groupBy("user_id").agg(F.avg(value).alias("mean"), F.count_if(value.isNull()).alias("skipped")), "mean")


def confusion_metrics(spark, sf_dir):
    return _r(E.confusion(_scored(spark, sf_dir), F.col("s"), F.col("toxic")), "accuracy", "precision", "recall", "f1")


def _scored(spark, sf_dir):
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = P.text_statistics(d, "doc_id", "text")
    return y.join(stats, "doc_id").select("doc_id", "toxic", "quality", F.round("ratio", 3).alias("s"))


def roc_pr_auc(spark, sf_dir):
    return _r(E.curves(_scored(spark, sf_dir), "s", "quality"), "roc_auc", "pr_auc")


def grouped_eval(spark, sf_dir):
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(y, "doc_id").groupingSets([[], ["lang"], ["source"], ["lang", "source"]], "lang", "source")
    out = rows.agg(F.count("*").alias("n"), F.avg("quality").alias("quality"), (F.sum("n_chars") / F.count("*")).alias("mean_chars"), F.exp(F.try_divide(F.sum("toxic"), F.sum("quality"))).alias("ratio"))
    return _r(out, "quality", "mean_chars", "ratio")


def minmax_rank(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return E.minmax_rank(s, "s_suppkey", {"balance": 0.7, "nation": 0.3}, {"nation"})


def _replies(spark, sf_dir):
    """Each assistant turn with the next one of its conversation."""
    t = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.withColumn("next", F.lead("text").over(w)).filter("next IS NOT NULL").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", "next")


def bleu_corpus(spark, sf_dir):
    rows = E.corpus_bleu(_replies(spark, sf_dir), "id", E.tokens_13a(F.col("text")), E.tokens_13a(F.col("next")))
    return _r(rows.select("m1", "m2", "t1", "t2", "ref", "bleu"), "bleu")


def rouge_scores(spark, sf_dir):
    return _r(E.rouge_n(_replies(spark, sf_dir), "id", E.word_tokens(F.col("text")), E.word_tokens(F.col("next"))), "rouge1", "rouge2")


def sentence_bleu(spark, sf_dir):
    rows = E.matches(_replies(spark, sf_dir), "id", E.tokens_13a(F.col("text")), E.tokens_13a(F.col("next")), 4)
    return _r(E.sentence_bleu(rows, "id"), "bleu")


def rouge_l(spark, sf_dir):
    return _replies(spark, sf_dir).select("id", F.round(E.rouge_l(F.col("text"), F.col("next")), 6).alias("rouge_l"))


def run_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    half = lambda lo, hi: o.filter(F.year("o_orderdate").between(lo, hi)).groupBy(F.col("o_orderpriority").alias("task")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("n")).selectExpr("task", "stack(2, 'price', price, 'n', n) AS (metric, value)")
    rows = E.run_diff(half(1992, 1996), half(1997, 2003), ["task", "metric"], ["n"])
    return _r(rows, "base", "candidate", "delta", "percent")


def character_errors(spark, sf_dir):
    return _r(E.error_rates(_replies(spark, sf_dir), F.col("text"), F.col("next")), "cer")


def interval_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("s"), (F.floor(F.unix_timestamp("ts") / 3600) + F.floor(F.col("value") % 7)).alias("e"))
    return H.covered(H.merge_intervals(e, "user_id", "s", "e"), "user_id")


def carried_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("known", F.when(F.col("event_type") != "click", F.col("value")))
    return H.carry_forward(e, "user_id", ["ts", "event_id"], "known").select("event_id", "current")


def upserted(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return H.upsert(c, c.filter("c_custkey % 7 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


def eda_describe(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    rows = P.describe(table(spark, sf_dir, "lineitem"), cols)
    return _r(rows, "mean", "std", "q1", "median", "q3", "skew", "kurtosis", "low_fence", "high_fence")


def eda_outliers(spark, sf_dir):
    return P.outliers(table(spark, sf_dir, "documents"), ["n_chars", "doc_id"])


def eda_corr(spark, sf_dir):
    return _r(P.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "r")


def value_counts(spark, sf_dir):
    return _r(P.value_counts(table(spark, sf_dir, "documents"), "lang"), "share")


def category_codes(spark, sf_dir):
    return P.codes(table(spark, sf_dir, "part"), "p_type").select("p_partkey", "code")


def vocab_top(spark, sf_dir):
    return P.vocabulary(table(spark, sf_dir, "documents"), "text", 500)


def vocab_stats(spark, sf_dir):
    return P.vocabulary_summary(table(spark, sf_dir, "documents"), "text")


def vocab_coverage(spark, sf_dir):
    return P.coverage_size(table(spark, sf_dir, "documents"), "text")


def source_imbalance(spark, sf_dir):
    return _r(P.imbalance(table(spark, sf_dir, "documents"), "source"), "ratio")


def character_vocab(spark, sf_dir):
    return P.character_vocabulary(table(spark, sf_dir, "documents"), "text").withColumn("char", F.hex("char"))


def domain_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("domain", T.domain(F.col("text")))
    return C.zero_filled(docs, "domain", list(L.DOMAIN_TERMS)).select(F.col("value").alias("domain"), "n")


def uncovered_domains(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("domain", T.domain(F.col("text")))
    return C.uncovered(docs, "domain", list(L.DOMAIN_TERMS)).withColumnRenamed("value", "domain")


def random_negative_pairs(spark, sf_dir):
    return C.random_negatives(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def doc_tokens_stats(spark, sf_dir):
    return _r(P.text_statistics(table(spark, sf_dir, "documents"), "doc_id", "text"), "ratio")


def length_summary(spark, sf_dir):
    return _r(P.length_summary(table(spark, sf_dir, "documents"), "text"), "mean")


def vector_means(spark, sf_dir):
    rows = P.element_means(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return rows.select("label", F.posexplode("mean").alias("at", "m")).select("label", "at", F.round("m", 6).alias("m"))


def null_tally(spark, sf_dir):
    return P.null_tally(table(spark, sf_dir, "documents"))


def score_histogram(spark, sf_dir):
    return E.histogram(table(spark, sf_dir, "events"), "value", "event_type")


def event_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("kind", F.try_element_at(F.create_map(*(F.lit(x) for x in ("view", "planned", "click", "started", "purchase", "completed", "error", "aborted"))), F.col("event_type")))
    return V.current_state(e.select(F.floor(F.col("event_id") / 7).alias("session"), "kind", "ts"), "session", "kind", "ts")


def rate_limit(spark, sf_dir):
    rows = V.over_limit(table(spark, sf_dir, "events"), "event_type", "ts", 2, "600 seconds")
    return rows.select("event_type", F.unix_timestamp("start").alias("start"), "n")


def pending_outbox(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("published_at"))
    return V.pending(e).select("id")


def tumbling_counts(spark, sf_dir):
    rows = V.windowed(table(spark, sf_dir, "events"), "ts", "value", "event_type", "6 hours")
    return rows.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(spark, sf_dir):
    rows = V.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def first_of_kind(spark, sf_dir):
    return V.once(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


QUERIES = [
    tfidf_topk, embedding_topk, history_left_join, latest_per_user, top_n_per_user, nested_session, match_topk, session_trend, null_skipping_means, confusion_metrics, roc_pr_auc,
    grouped_eval, minmax_rank, bleu_corpus, rouge_scores, sentence_bleu, rouge_l, run_diff, character_errors, interval_merge, carried_values, upserted, eda_describe, eda_outliers, eda_corr,
    value_counts, category_codes, vocab_top, vocab_stats, vocab_coverage, source_imbalance, character_vocab, domain_counts, uncovered_domains, random_negative_pairs, doc_tokens_stats, length_summary, vector_means, null_tally, score_histogram, event_status, rate_limit, pending_outbox,
    tumbling_counts, user_sessions, first_of_kind,
]

_WORDS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN {Q.tup(L.SCORE_STOP)})"
_TERMS = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
_SCORED = f"""sc AS (SELECT doc_id, toxic, quality, round(coalesce(len(list_distinct(ws)) / nullif(len(ws), 0), 0), 3) AS s FROM labels JOIN
  (SELECT doc_id, {Q.words("lower(coalesce(text, ''))")} AS ws FROM documents) USING (doc_id))"""
_REPLIES = """rp AS (SELECT conv_id || '-' || turn AS id, text, nx FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations WHERE role = 'assistant') WHERE nx IS NOT NULL)"""


def _tok13(t: str) -> str:
    x = f"replace(replace(replace({t}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, {Q.lit(a)}, {Q.lit(b)})"
    x = Q.sub(x, r"([\{-~\[-` -&\(-+:-@/])", r" \1 ")
    x = Q.sub(Q.sub(x, r"([^0-9])([.,])", r"\1 \2 "), r"([.,])([^0-9])", r" \1 \2")
    return Q.words(Q.sub(x, r"([0-9])(-)", r"\1 \2 "))


def _grams(tokens: str, orders: int) -> str:
    return f"""(SELECT id, n, array_to_string(ts[i:i+n-1], ' ') AS g, count(*) AS c FROM (SELECT id, n, ts, unnest(range(1, len(ts) - n + 2)) AS i FROM (SELECT id, {tokens} AS ts, unnest(range(1, {orders + 1})) AS n FROM rp)) GROUP BY id, n, g)"""


def _matches(a: str, b: str, orders: int) -> str:
    return f"""mt AS (SELECT id, n, sum(least(coalesce(p.c, 0), coalesce(r.c, 0)))::BIGINT AS matched, coalesce(sum(p.c), 0)::BIGINT AS total, coalesce(sum(r.c), 0)::BIGINT AS wanted
  FROM {_grams(a, orders)} p FULL JOIN {_grams(b, orders)} r USING (id, n, g) GROUP BY id, n)"""


_WORD = lambda t: f"regexp_extract_all(lower({t}), '[a-z0-9]+')"

ORACLE = {
    "tfidf_topk": f"""WITH n AS (SELECT count(*) AS n FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)) GROUP BY ALL),
f AS (SELECT term, ln((any_value(n.n) + 1) / (count(*) + 1)) + 1 AS idf FROM c, n GROUP BY term), w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM c JOIN f USING (term)),
d AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
q AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark)) GROUP BY ALL) JOIN f USING (term)),
qn AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM q), s AS (SELECT item_id, doc_id, sum(qn.w * d.w) AS s FROM qn JOIN d USING (term) GROUP BY ALL)
SELECT item_id, doc_id, round(s, 6) AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS place FROM s) WHERE place <= 5 AND s > 0""",
    "embedding_topk": """SELECT query, id, similarity, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM (
SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)) WHERE place <= 5""",
    "history_left_join": "SELECT c_custkey, o_orderkey, coalesce(o_orderstatus, 'none') AS status, coalesce(o_totalprice, 0) AS price FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "latest_per_user": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "top_n_per_user": "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))::INT AS place FROM events QUALIFY place <= 5",
    "nested_session": """SELECT o_orderkey, count(l_orderkey)::INT AS n, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_quantity) FILTER (l_orderkey IS NOT NULL), '') AS parts
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "match_topk": """WITH p AS (SELECT o_custkey AS id, list(DISTINCT p_brand) AS skills, least(count(*) * 3, 100) AS overall FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
j AS (SELECT p_partkey % 12 AS job_id, list_sort(list(DISTINCT p_brand) FILTER (p_size > 46)) AS wanted FROM part GROUP BY 1),
s AS (SELECT id, job_id, list_filter(wanted, lambda x: NOT list_contains(skills, x)) AS missing, floor((0.7::DOUBLE * (len(list_intersect(skills, wanted)) / (len(skills) + len(wanted) - len(list_intersect(skills, wanted)))) + 0.3::DOUBLE *
  CASE job_id % 3 WHEN 0 THEN CASE WHEN overall < 65 THEN 1 ELSE 0.6::DOUBLE END WHEN 2 THEN CASE WHEN overall >= 80 THEN 1 ELSE 0.4::DOUBLE END ELSE CASE WHEN overall >= 65 AND overall < 85 THEN 1 ELSE 0.55::DOUBLE END END) * 100 + 0.5::DOUBLE)::BIGINT AS score FROM p, j)
SELECT id, job_id, score, array_to_string(missing, ',') AS missing, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, job_id) AS place FROM s) WHERE place <= 3""",
    "session_trend": """SELECT user_id, count(*) AS n, round(CASE WHEN count(value) >= 3 THEN regr_slope(value, i) END, 6) AS trend FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY user_id""",
    "null_skipping_means": "SELECT user_id, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean, count(*) FILTER (event_type = 'error') AS skipped FROM events GROUP BY user_id",
    "confusion_metrics": f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (s >= 0.5 AND toxic = 1) AS tp, count(*) FILTER (s >= 0.5 AND toxic = 0) AS fp, count(*) FILTER (s < 0.5 AND toxic = 0) AS tn, count(*) FILTER (s < 0.5 AND toxic = 1) AS fn FROM sc)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "roc_pr_auc": f"""WITH {_SCORED}, p AS (SELECT s, sum(quality) AS p, count(*) - sum(quality) AS n FROM sc GROUP BY s), t AS (SELECT sum(p) AS pp, sum(n) AS nn FROM p),
r AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM p),
c AS (SELECT s, tp / pp AS tpr, fp / nn AS fpr, tp / (tp + fp) AS prec FROM r, t),
d AS (SELECT (fpr - lag(fpr, 1, 0) OVER w) * (tpr + lag(tpr, 1, 0) OVER w) / 2 AS roc, (tpr - lag(tpr, 1, 0) OVER w) * (prec + lag(prec, 1, 1) OVER w) / 2 AS pr FROM c WINDOW w AS (ORDER BY s DESC))
SELECT round(sum(roc), 6) AS roc_auc, round(sum(pr), 6) AS pr_auc FROM d""",
    "grouped_eval": """SELECT lang, source, count(*) AS n, round(avg(quality), 6) AS quality, round(sum(n_chars) / count(*), 6) AS mean_chars, round(exp(sum(toxic) / nullif(sum(quality), 0)), 6) AS ratio
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))""",
    "minmax_rank": """WITH s AS (SELECT s_suppkey, s_acctbal AS b, s_nationkey::DOUBLE AS n FROM supplier), e AS (SELECT min(b) AS b0, max(b) AS b1, min(n) AS n0, max(n) AS n1 FROM s),
f AS (SELECT s_suppkey, round(0.7::DOUBLE * ((b - b0) / (b1 - b0 + 1e-8)) + 0.3::DOUBLE * ((n1 - n) / (n1 - n0 + 1e-8)), 4) AS final_score FROM s, e)
SELECT s_suppkey, final_score, (row_number() OVER (ORDER BY final_score DESC, s_suppkey))::INT AS rank FROM f""",
    "bleu_corpus": f"""WITH {_REPLIES}, {_matches(_tok13('text'), _tok13('nx'), 4)}, o AS (SELECT n, sum(matched) AS m, sum(total) AS t, sum(wanted) AS w FROM mt GROUP BY n)
SELECT (max(m) FILTER (n = 1))::BIGINT AS m1, (max(m) FILTER (n = 2))::BIGINT AS m2, (max(t) FILTER (n = 1))::BIGINT AS t1, (max(t) FILTER (n = 2))::BIGINT AS t2, (max(w) FILTER (n = 1))::BIGINT AS ref,
round(CASE WHEN min(m) = 0 THEN 0 ELSE CASE WHEN t1 > ref THEN 1 ELSE exp(1 - ref / t1) END * exp(avg(ln(m / t))) END, 6) AS bleu FROM o""",
    "rouge_scores": f"""WITH {_REPLIES}, {_matches(_WORD('text'), _WORD('nx'), 2)}
SELECT id, round(coalesce(max(CASE WHEN matched > 0 THEN 2 * matched / (total + wanted) ELSE 0 END) FILTER (n = 1), 0), 6) AS rouge1, round(coalesce(max(CASE WHEN matched > 0 THEN 2 * matched / (total + wanted) ELSE 0 END) FILTER (n = 2), 0), 6) AS rouge2
FROM rp LEFT JOIN mt USING (id) GROUP BY id""",
    "run_diff": """WITH o AS (SELECT *, year(o_orderdate) AS y FROM orders), h AS (SELECT o_orderpriority AS task, y BETWEEN 1992 AND 1996 AS old, avg(o_totalprice) AS price, count(*)::DOUBLE AS n FROM o WHERE y BETWEEN 1992 AND 2003 GROUP BY 1, 2),
u AS (SELECT task, old, 'price' AS metric, price AS value FROM h UNION ALL SELECT task, old, 'n', n FROM h), j AS (SELECT task, metric, max(value) FILTER (old) AS base, max(value) FILTER (NOT old) AS candidate FROM u GROUP BY 1, 2)
SELECT task, metric, round(base, 6) AS base, round(candidate, 6) AS candidate, round(candidate - base, 6) AS delta, round((candidate - base) * 100 / abs(base), 6) AS percent, CASE WHEN metric = 'n' THEN candidate < base ELSE candidate > base END AS improved FROM j""",
    "interval_merge": """WITH e AS (SELECT user_id, floor(epoch(ts)::BIGINT / 3600)::BIGINT AS s, floor(epoch(ts)::BIGINT / 3600)::BIGINT + floor(value % 7)::BIGINT AS e FROM (SELECT user_id, date_trunc('second', ts) AS ts, value FROM events)),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT user_id, island, max(e) - min(s) + 1 AS c FROM i GROUP BY 1, 2) SELECT user_id, sum(c)::BIGINT AS covered, count(*) AS islands FROM g GROUP BY user_id""",
    "carried_values": """SELECT event_id, last_value(CASE WHEN event_type <> 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current FROM events""",
    "upserted": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer",
    "eda_describe": """WITH l AS (SELECT unnest([{'c': 'l_quantity', 'x': l_quantity}, {'c': 'l_extendedprice', 'x': l_extendedprice}, {'c': 'l_discount', 'x': l_discount}], recursive := true) FROM lineitem),
m AS (SELECT c, count(x) AS n, avg(x) AS m FROM l GROUP BY c), q AS (SELECT c, any_value(n) AS n, count(*) - count(x) AS nulls, any_value(m) AS mean, stddev_samp(x) AS std, min(x) AS mn, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3,
  max(x) AS mx, avg((x - m) ** 2) AS v2, avg((x - m) ** 3) AS v3, avg((x - m) ** 4) AS v4 FROM l JOIN m USING (c) GROUP BY c)
SELECT c AS "column", n, nulls, round(mean, 6) AS mean, round(std, 6) AS std, mn AS min, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, mx AS max, round(v3 / v2 ** 1.5, 6) AS skew, round(v4 / (v2 * v2) - 3, 6) AS kurtosis,
round(q1 - 1.5::DOUBLE * (q3 - q1), 6) AS low_fence, round(q3 + 1.5::DOUBLE * (q3 - q1), 6) AS high_fence FROM q""",
    "eda_outliers": """WITH l AS (SELECT 'n_chars' AS c, n_chars::DOUBLE AS x FROM documents UNION ALL SELECT 'doc_id', doc_id::DOUBLE FROM documents), q AS (SELECT c, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM l GROUP BY c)
SELECT c AS "column", count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS outliers FROM l JOIN q USING (c) GROUP BY c""",
    "eda_corr": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i + 1 :]),
    "value_counts": "SELECT lang AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang",
    "category_codes": "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS code FROM part",
    "vocab_top": f"""SELECT token, count, (row_number() OVER (ORDER BY count DESC, token) - 1)::INT AS id FROM (SELECT token, count(*) AS count FROM (SELECT unnest({Q.tokens('text')}) AS token FROM documents) GROUP BY token ORDER BY count DESC, token LIMIT 500)""",
    "vocab_stats": f"SELECT count(*) AS types, sum(c)::BIGINT AS tokens, count(*) FILTER (c = 1) AS hapax, max(c) AS most FROM (SELECT token, count(*) AS c FROM (SELECT unnest({Q.tokens('text')}) AS token FROM documents) GROUP BY token)",
    "vocab_coverage": f"""WITH c AS (SELECT token, count(*) AS c FROM (SELECT unnest({Q.tokens('text')}) AS token FROM documents) GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY c DESC, token) AS k, sum(c) OVER (ORDER BY c DESC, token ROWS UNBOUNDED PRECEDING) AS u, sum(c) OVER () AS t FROM c)
SELECT min(k)::BIGINT AS tokens FROM r WHERE u >= t * 0.99::DOUBLE""",
    "source_imbalance": "SELECT round(max(n) / min(n), 6) AS ratio, count(*) AS groups FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)",
    "character_vocab": """WITH c AS (SELECT ch, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY 1) SELECT hex(ch) AS char, count, (row_number() OVER (ORDER BY count DESC, ch) - 1)::INT AS id FROM c""",
    "domain_counts": f"""WITH h AS (SELECT {Q.domain('hay')} AS best FROM (SELECT {Q.haystack('text')} AS hay FROM documents)), n AS (SELECT best.domain AS d, count(*) AS n FROM h WHERE best.score >= 3 GROUP BY 1)
SELECT domain, coalesce(n, 0) AS n FROM (SELECT unnest({Q.arr(L.DOMAIN_TERMS)}) AS domain) LEFT JOIN n ON d = domain""",
    "uncovered_domains": f"""WITH h AS (SELECT {Q.domain('hay')} AS best FROM (SELECT {Q.haystack('text')} AS hay FROM documents)) SELECT domain FROM (SELECT unnest({Q.arr(L.DOMAIN_TERMS)}) AS domain) WHERE domain NOT IN (SELECT best.domain FROM h WHERE best.score >= 3)""",
    "random_negative_pairs": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY ('0x' || left(sha256('42:' || doc_id), 12))::BIGINT, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT a.doc_id AS positive, b.doc_id AS negative FROM r a JOIN r b ON (a.i + 1) % a.n = b.i""",
    "doc_tokens_stats": f"""SELECT doc_id, len(ws)::INT AS words, len(list_distinct(ws))::INT AS unique_words, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: {Q.strip('s')} <> ''))::INT AS sentences,
round(coalesce(len(list_distinct(ws)) / nullif(len(ws), 0), 0), 6) AS ratio FROM (SELECT doc_id, text, {Q.words("lower(coalesce(text, ''))")} AS ws FROM documents)""",
    "length_summary": """WITH l AS (SELECT length(text) AS x, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT any_value(n) AS n, min(x)::INT AS min, (max(x) FILTER (i = floor(n / 2)))::INT AS median, (max(x) FILTER (i = floor(n * 0.95::DOUBLE)))::INT AS p95, max(x)::INT AS max, round(avg(x), 6) AS mean FROM l""",
    "vector_means": "SELECT label, (at_ - 1)::INT AS at, round(avg(x::DOUBLE), 6) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS at_ FROM embeddings) GROUP BY 1, 2",
    "null_tally": " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls FROM documents""" for c in ("doc_id", "text", "lang", "source", "n_chars")),
    "score_histogram": """WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT event_type, least(floor((value - lo) / greatest(hi - lo, 1e-12) * 15), 14)::INT AS bin, count(*) AS n FROM events JOIN e USING (event_type) GROUP BY 1, 2""",
    "event_status": """WITH e AS (SELECT event_id // 7 AS session, ts, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 2 END AS r,
  CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'LIVE' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'ABORTED' END AS s FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY r DESC, ts) AS k, count(*) OVER (PARTITION BY session) AS events FROM e WHERE s IS NOT NULL)
SELECT session, s AS state, events FROM w WHERE k = 1""",
    "rate_limit": "SELECT event_type, (epoch(ts)::BIGINT // 600) * 600 AS start, count(*) AS n FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events) GROUP BY 1, 2 HAVING count(*) > 2",
    "pending_outbox": "SELECT event_id AS id FROM events WHERE event_id % 3 = 0",
    "tumbling_counts": "SELECT (epoch(ts)::BIGINT // 21600) * 21600 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, date_trunc('second', ts) AS ts FROM events) GROUP BY 1, 2",
    "user_sessions": """WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "first_of_kind": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) = 1",
}
