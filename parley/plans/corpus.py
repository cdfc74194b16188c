"""Queries of the question corpus, over documents, benchmark and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T
from parley.operators import corpus as C
from parley.operators import spans as S
from parley.plans import sql as Q
from parley.plans.tables import table


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of each document as a question, the rest as its body."""
    parts = F.split("text", "\n", 2)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", T.one_line(parts[0]).alias("question"), T.clean_text(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("body"))


_Q = f"""q AS (SELECT doc_id, lang, source, {Q.one_line("split_part(text, chr(10), 1)")} AS question,
  {Q.clean("CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END")} AS body FROM documents)"""


def doc_clean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    t = T.clean_text(F.col("text"))
    return docs.select("doc_id", F.length(t).alias("chars"), F.md5(t).alias("digest"))


def page_clean_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    # a step of its own: the text is cleaned once
    pages, t = pages.select("page_id", T.clean_text(F.col("html")).alias("t")), F.col("t")
    return pages.select("page_id", F.length(t).alias("chars"), F.md5(t).alias("digest"), T.is_prose(t).alias("prose"))


def reject_reasons(spark, sf_dir):
    rows = _questions(spark, sf_dir)
    return rows.select("doc_id", F.coalesce(T.reject_reason(F.col("question")), F.lit("usable")).alias("reason"))


def reject_counts(spark, sf_dir):
    rows = C.label_questions(_questions(spark, sf_dir))
    return C.drop_counts(rows, F.col("source"))


def domain_labels(spark, sf_dir):
    rows = _questions(spark, sf_dir)
    best = F.array_max(T.domain_scores(F.concat_ws("\n", "question", "body")))
    return rows.select("doc_id", best["score"].alias("score"), F.when(best["score"] >= L.MIN_DOMAIN_SCORE, best["domain"]).alias("domain"))


def difficulty_labels(spark, sf_dir):
    rows = _questions(spark, sf_dir)
    s = T.difficulty_score(F.col("question"), F.col("body"))
    return rows.select("doc_id", s.alias("score"), T.difficulty(F.col("question"), F.col("body")).alias("difficulty"))


def condensed_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    t = T.condense(F.col("text"))
    return docs.select("doc_id", F.length(t).alias("chars"), F.md5(t).alias("digest"))


def dedup_exact_near(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return C.deduplicate(docs, "text", [F.col("doc_id")]).select("doc_id", "outcome")


def balance_round_robin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    order = [F.desc("n_chars"), F.desc("doc_id")]
    return C.round_robin(docs, "source", F.col("source"), order, 30, 400).select("doc_id", "source", "place")


def stratified_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return C.stratified_split(docs, ["lang", "source"], "doc_id").select("doc_id", "split")


def split_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = C.stratified_split(docs, ["lang", "source"], "doc_id")
    return C.statistics(rows, "text").select("split", "source", "n", "min_chars", F.round("mean_chars", 6).alias("mean_chars"), "max_chars")


def split_leakage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", "lang", "source", C.token_set_key(F.col("text")).alias("k"))
    return C.leaked(C.stratified_split(keyed, ["lang", "source"], "doc_id"), "k", docs, "text")


def contamination(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = S.spans_like(bench, docs, "item_id", "doc_id", "text", "text", 0.6)
    return rows.withColumn("similarity", F.round("similarity", 6))


def split_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("key", T.exact_key(F.col("text")))
    rows = C.stratified_split(docs, ["lang", "source"], "doc_id")
    keys = rows.groupBy("key").agg(*(F.max(F.when(F.col("split") == s, 1).otherwise(0)).alias(s) for s in ("train", "validation", "test")))
    both = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}")
    return keys.agg(F.count("*").alias("keys"), both("train", "validation"), both("train", "test"), both("validation", "test"))


def merged_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    key = F.lower(T.strip(F.regexp_replace("text", r"\s+", " ")))
    old, new = docs.filter(F.col("lang") == "en"), docs.filter(~F.col("lang").eqNullSafe("en"))
    return C.merge_new(old, new, key, F.col("doc_id")).select("doc_id", "lang")


def negative_pairs(spark, sf_dir):
    return C.shifted_pairs(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


QUERIES = [
    doc_clean, page_clean_text, reject_reasons, reject_counts, domain_labels, difficulty_labels, condensed_texts, dedup_exact_near, balance_round_robin,
    stratified_split, split_statistics, split_leakage, contamination, split_overlap, merged_corpus, negative_pairs,
]

_SPLIT = """r AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS n,
  row_number() OVER (PARTITION BY lang, source ORDER BY sha256('42:' || doc_id), doc_id) AS k FROM documents),
f AS (SELECT *, CASE WHEN n >= 3 AND floor(n * 0.8) = 0 THEN 1 ELSE floor(n * 0.8::DOUBLE) END AS t, floor(n * 0.8::DOUBLE) AS t0, floor(n * (0.8::DOUBLE + 0.1::DOUBLE)) AS v FROM r),
sp AS (SELECT *, CASE WHEN k <= t THEN 'train' WHEN k <= t + v - t0 THEN 'validation' ELSE 'test' END AS split FROM f)"""

_PROSE = f"""(len(ls) > 0 AND len(list_filter(ls, lambda x: starts_with(x, ' ') OR starts_with(x, chr(9))
  OR len(list_filter({Q.arr(L.CODE_SUFFIXES)}, lambda s: ends_with(regexp_replace(x, '\\s+$', ''), s))) > 0
  OR len(list_filter({Q.arr(L.CODE_PREFIXES)}, lambda p: starts_with(regexp_replace(x, '^\\s+', ''), p))) > 0)) <= 0.4::DOUBLE * len(ls)
  AND length(regexp_replace(t, '[^\\p{{L}}\\s]', '', 'g')) >= 0.75::DOUBLE * length(t))"""


def _similar(a: str, b: str, threshold: float) -> str:
    """Pairs (a, b, shared, similarity) by joining on every token; a and b are tables of (id, s)."""
    return f"""SELECT x.id AS a, y.id AS b, count(*) AS shared, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS similarity
  FROM (SELECT id, len(s) AS n, unnest(s) AS t FROM {a}) x JOIN (SELECT id, len(s) AS n, unnest(s) AS t FROM {b}) y USING (t)
  GROUP BY x.id, y.id HAVING count(*) >= 3 AND count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= {threshold}"""


def _leak(a: str, b: str) -> str:
    return f"""SELECT '{a}->{b}' AS pair, (SELECT count(DISTINCT b) FROM ({_similar(f"(SELECT * FROM w WHERE split = '{a}')", f"(SELECT * FROM w WHERE split = '{b}')", 0.9)})) AS n"""


_LAST = "coalesce(length(w) - nullif(strpos(reverse(w), reverse({0})), 0) - length({0}) + 1, -1)"

ORACLE = {
    "doc_clean": f"SELECT doc_id, length(t)::INT AS chars, md5(t) AS digest FROM (SELECT doc_id, {Q.clean('text')} AS t FROM documents)",
    "page_clean_text": f"""SELECT page_id, length(t)::INT AS chars, md5(t) AS digest, {_PROSE} AS prose FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: {Q.strip('x')} <> '') AS ls
  FROM (SELECT page_id, {Q.clean('html')} AS t FROM pages))""",
    "reject_reasons": f"WITH {_Q} SELECT doc_id, coalesce({Q.reject_reason('question')}, 'usable') AS reason FROM q",
    "reject_counts": f"""WITH {_Q}, h AS (SELECT *, {Q.haystack("question || chr(10) || body")} AS hay FROM q)
SELECT source AS tag, coalesce({Q.reject_reason('question')}, CASE WHEN {Q.domain('hay')}.score < 3 THEN 'off_domain' END, 'kept') AS reason, count(*) AS n FROM h GROUP BY 1, 2""",
    "domain_labels": f"""WITH {_Q}, h AS (SELECT doc_id, {Q.haystack("question || chr(10) || body")} AS hay FROM q), b AS (SELECT doc_id, {Q.domain('hay')} AS best FROM h)
SELECT doc_id, best.score AS score, CASE WHEN best.score >= 3 THEN best.domain END AS domain FROM b""",
    "difficulty_labels": f"""WITH {_Q}, h AS (SELECT doc_id, question, {Q.haystack('question')} AS qh, {Q.haystack('body')} AS bh FROM q),
s AS (SELECT doc_id, {Q.difficulty_score('qh', 'bh', 'question')} AS score FROM h)
SELECT doc_id, score, CASE WHEN score <= 3 THEN 'Beginner' WHEN score >= 5 THEN 'Advanced' ELSE 'Intermediate' END AS difficulty FROM s""",
    "condensed_texts": f"""WITH c AS (SELECT doc_id, {Q.clean('text')} AS t FROM documents), p AS (SELECT doc_id, t, left(t, 1200) AS w FROM c),
m AS (SELECT *, greatest({", ".join(_LAST.format(Q.lit(x)) for x in (". ", "! "))}, {_LAST.format("'?' || chr(10)")}, {_LAST.format("'.' || chr(10)")}) AS s, {_LAST.format("' '")} AS sp FROM p),
o AS (SELECT doc_id, CASE WHEN length(t) <= 1200 THEN t ELSE {Q.strip("left(w, CASE WHEN s < 600 THEN sp ELSE s END + 1)")} END AS x FROM m)
SELECT doc_id, length(x)::INT AS chars, md5(x) AS digest FROM o""",
    "dedup_exact_near": f"""WITH k AS (SELECT doc_id, array_to_string({Q.tokens('text')}, ' ') AS e, array_to_string(list_sort(list_distinct({Q.tokens('text')})), ' ') AS f FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY doc_id) AS r, first(e) OVER (PARTITION BY f ORDER BY doc_id) AS kept FROM k)
SELECT doc_id, CASE WHEN r = 1 THEN 'kept' WHEN e = kept THEN 'dedup_exact' ELSE 'dedup_near' END AS outcome FROM w""",
    "balance_round_robin": """SELECT doc_id, source, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS place FROM documents)
WHERE place <= 30 ORDER BY place, source LIMIT 400""",
    "stratified_split": f"WITH {_SPLIT} SELECT doc_id, split FROM sp",
    "split_statistics": f"""WITH {_SPLIT} SELECT split, source, count(*) AS n, min(length(text))::INT AS min_chars, round(avg(length(text)), 6) AS mean_chars, max(length(text))::INT AS max_chars
FROM sp GROUP BY GROUPING SETS ((split), (source), (split, source), ())""",
    "split_leakage": f"""WITH {_SPLIT}, w AS (SELECT doc_id AS id, split, list_distinct({Q.tokens('text')}) AS s FROM sp)
{_leak('train', 'validation')} UNION ALL {_leak('train', 'test')} UNION ALL {_leak('validation', 'test')}""",
    "split_overlap": f"""WITH {_SPLIT}, k AS (SELECT array_to_string({Q.tokens('text')}, ' ') AS key, split FROM sp),
g AS (SELECT key, bool_or(split = 'train') AS tr, bool_or(split = 'validation') AS va, bool_or(split = 'test') AS te FROM k GROUP BY key)
SELECT count(*) AS keys, (count(*) FILTER (tr AND va))::BIGINT AS train_validation, (count(*) FILTER (tr AND te))::BIGINT AS train_test, (count(*) FILTER (va AND te))::BIGINT AS validation_test FROM g""",
    "merged_corpus": f"""WITH k AS (SELECT doc_id, lang, lower({Q.strip(Q.sub('text', r'\s+', ' '))}) AS key FROM documents)
SELECT doc_id, lang FROM k WHERE lang = 'en' UNION ALL
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS r FROM k WHERE lang IS DISTINCT FROM 'en') n
WHERE key IS NULL OR (r = 1 AND NOT EXISTS (SELECT 1 FROM k e WHERE e.lang = 'en' AND e.key = n.key))""",
    "negative_pairs": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT a.doc_id AS positive, b.doc_id AS negative FROM r a JOIN r b ON (a.i + 37) % a.n = b.i""",
}
