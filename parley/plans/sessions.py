"""Queries of conversations: pairing, evidence, scores, reports, decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T
from parley.operators import scoring, sessions as S
from parley.plans import sql as Q
from parley.plans.tables import table


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def session_report(spark, sf_dir):
    rows = S.report(_turns(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return rows.select(
        "conv_id", "answers", "answered", "declined", r("coverage"), r("technical"), r("communication"), r("confidence"), r("fluency"), "words", r("filler_rate"),
        "concrete", "structured", "hedges", r("overall"), "level", F.array_join("diagnosis", ",").alias("diagnosis"), F.array_join("resources", ",").alias("resources"),
    )


def turn_pairs_preceding(spark, sf_dir):
    return S.pair_preceding(_turns(spark, sf_dir), "conv_id", "turn", "role", "text")


def turn_pairs_positional(spark, sf_dir):
    return S.pair_positional(_turns(spark, sf_dir), "conv_id", "turn", "role", "text")


def turn_intents(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", scoring.intent(F.col("text")).alias("intent"))


def answer_scores(spark, sf_dir):
    t = F.col("text")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(scoring.communication(t), 6).alias("communication"), F.round(scoring.technical(t), 6).alias("technical"))


def turn_decisions(spark, sf_dir):
    pairs = S.pair_preceding(_turns(spark, sf_dir), "conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id")
    rows = pairs.select("conv_id", "turn", scoring.intent(F.col("answer")).alias("intent"), scoring.technical(F.col("answer")).alias("technical"))
    rows = rows.withColumn("remaining", F.count("*").over(w) - F.row_number().over(w.orderBy("turn")))
    return S.decide(rows).select("conv_id", "turn", "intent", "remaining", "action")


def unanswered_questions(spark, sf_dir):
    turns = _turns(spark, sf_dir).withColumn("kind", S.turn_kind(F.col("role"))).filter("kind IS NOT NULL")
    nxt = F.lead("kind").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.withColumn("next", nxt).filter("kind = 'q' AND (next IS NULL OR next = 'q')")
    return rows.groupBy("conv_id").agg(F.count("*").alias("open"), F.min("turn").alias("first_open"))


def term_idf(spark, sf_dir):
    rows = scoring.inverse_frequency(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("term", "df", F.round("idf", 6).alias("idf"))


def idf_recall(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    idf = scoring.inverse_frequency(docs, "doc_id", "text").select("term", "idf")
    default = F.log(F.lit(docs.count()) + 1) + 1
    pairs = S.pair_preceding(_turns(spark, sf_dir), "conv_id", "turn", "role", "text")
    return scoring.recall(pairs, idf, default, ["conv_id", "turn"]).withColumn("recall", F.round("recall", 6))


def question_quality(spark, sf_dir):
    """How many lines of each document could be asked aloud, and the best quality of one."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("q"))
    rows = lines.select("doc_id", scoring.question_quality(F.col("q"), F.col("source")).alias("quality"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("quality") >= L.LEAST_QUALITY).alias("askable"), F.round(F.max("quality"), 6).alias("best"))


def pace_scores(spark, sf_dir):
    wpm = F.col("value") * 2
    rows = table(spark, sf_dir, "events").select("event_id", F.round(scoring.pace(wpm), 6).alias("pace"), F.round(scoring.speaking_speed(wpm), 6).alias("speed"))
    return rows


def words_by_role(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("n", F.size(T.words(F.col("text"))).cast("double"))
    return S.by_group(rows, "conv_id", "role", "n").select("conv_id", "grp", "n", F.round("mean", 6).alias("mean"), "place")


QUERIES = [session_report, turn_pairs_preceding, turn_pairs_positional, turn_intents, answer_scores, turn_decisions, unanswered_questions, term_idf, idf_recall, question_quality, pace_scores, words_by_role]

_KIND = f"CASE WHEN lower(role) IN {Q.tup(L.INTERVIEWER_ROLES)} THEN 'q' WHEN lower(role) IN {Q.tup(L.CANDIDATE_ROLES)} THEN 'a' END"
_PAIRS = f"""k AS (SELECT *, {_KIND} AS kind FROM conversations),
pr AS (SELECT conv_id, turn, CASE WHEN lag(kind) OVER w = 'q' THEN lag(text) OVER w ELSE '' END AS question, text AS answer, kind FROM k WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pa AS (SELECT conv_id, turn, question, answer FROM pr WHERE kind = 'a')"""


def _intent(t: str) -> str:
    low = f"lower({Q.strip(f'coalesce({t}, chr(32))')})"
    n = f"len({Q.words(low)})"
    return f"""CASE WHEN {low} = '' THEN 'silent' WHEN {n} = 1 AND {low} IN {Q.tup(L.SINGLE_DECLINES)} THEN 'dont_know' WHEN {n} = 1 AND {low} IN {Q.tup(L.SINGLE_FILLERS)} THEN 'thin'
  WHEN {Q.has_phrase(t, L.DECLINE)} THEN 'dont_know' WHEN {Q.has_phrase(t, L.CLARIFY)} THEN 'clarify' WHEN {n} >= 35 THEN 'substantive' WHEN {n} <= 6 THEN 'thin' WHEN {n} >= 15 THEN 'substantive' ELSE 'thin' END"""


def _communication(t: str) -> str:
    low = f"lower(coalesce({t}, ''))"
    n, share = "len(ws)", "(len(list_distinct(ws)) / greatest(len(ws), 1))"
    sent = f"greatest(len(list_filter(regexp_split_to_array({t}, '[.!?]+'), lambda s: {Q.strip('s')} <> '')), 1)"
    return f"""(SELECT CASE WHEN length({Q.strip('low')}) < 10 OR {n} < 5 THEN 20.0::DOUBLE ELSE greatest(0.0::DOUBLE,
  CASE WHEN sh >= 0.8::DOUBLE THEN 100.0::DOUBLE WHEN sh >= 0.6::DOUBLE THEN 70 + (sh - 0.6::DOUBLE) * 150 WHEN sh >= 0.4::DOUBLE THEN 40 + (sh - 0.4::DOUBLE) * 150 ELSE sh * 100 END * 0.30::DOUBLE
  + CASE WHEN ln BETWEEN 10 AND 25 THEN 100.0::DOUBLE WHEN ln < 10 THEN greatest(20.0::DOUBLE, ln * 8) ELSE greatest(20.0::DOUBLE, 100 - (ln - 25) * 3) END * 0.25::DOUBLE
  + least(100.0::DOUBLE, 50 + {Q.count_terms('low', L.DISCOURSE)} * 15.0::DOUBLE) * 0.25::DOUBLE
  - least(40.0::DOUBLE, len(list_filter(ws, lambda w: w IN {Q.tup(L.SCORE_FILLERS)})) / greatest({n}, 1) * 200)) END
  FROM (SELECT *, {share} AS sh, {n} / sents AS ln FROM (SELECT {low} AS low, {Q.words(low)} AS ws, {sent} AS sents)))"""


def _technical(t: str) -> str:
    low = f"lower(coalesce({t}, ''))"
    n = f"len({Q.words(low)})"
    hits = lambda p: Q.count_phrases(t, p)
    return f"""CASE WHEN {n} = 0 THEN 0.0::DOUBLE WHEN {n} < 4 THEN 10.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN {n} < 12 THEN 35 WHEN {n} < 25 THEN 60 WHEN {n} < 40 THEN 85 ELSE 100 END,
  35 * (1 - exp(-0.5::DOUBLE * {Q.count_terms(low, sorted(L.TECHNICAL_TERMS))})) + least(25, {hits(L.MECHANISM)} * 9) + least(22, {hits(L.TRADEOFF)} * 11) + least(18, {hits(L.SPECIFIC)} * 8) - least(15, {hits(L.VAGUE)} * 5))) END"""


_IDF = f"""n AS (SELECT count(*) AS n FROM documents), t AS (SELECT unnest(list_distinct({Q.content_terms('text')})) AS term FROM documents),
idf AS (SELECT term, count(*) AS df, ln((any_value(n.n) + 1) / (count(*) + 1)) + 1 AS idf FROM t, n GROUP BY term)"""

_CASES = " ".join(f"({i}, {Q.lit(k)}, {Q.arr(t)})," for i, (k, t) in enumerate(L.RESOURCES)).rstrip(",")

ORACLE = {
    "turn_pairs_preceding": f"WITH {_PAIRS} SELECT * FROM pa",
    "turn_pairs_positional": f"""WITH k AS (SELECT conv_id, {_KIND} AS kind, text, turn FROM conversations WHERE {Q.strip('text')} <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn) AS k FROM k WHERE kind IS NOT NULL)
SELECT a.conv_id, a.k::INT AS k, coalesce(q.text, '') AS question, a.text AS answer FROM r a LEFT JOIN r q ON q.conv_id = a.conv_id AND q.k = a.k AND q.kind = 'q' WHERE a.kind = 'a'""",
    "turn_intents": f"SELECT conv_id, turn, {_intent('text')} AS intent FROM conversations",
    "answer_scores": f"SELECT conv_id, turn, round({_communication('text')}, 6) AS communication, round({_technical('text')}, 6) AS technical FROM conversations",
    "turn_decisions": f"""WITH {_PAIRS}, i AS (SELECT conv_id, turn, {_intent('answer')} AS intent, {_technical('answer')} AS technical,
  count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS remaining FROM pa),
p AS (SELECT *, remaining > 1 AND (intent = 'thin' OR (intent = 'substantive' AND technical >= 78)) AS wants FROM i),
g AS (SELECT *, coalesce(sum((intent = 'dont_know')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS gaps,
  coalesce(sum(wants::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p)
SELECT conv_id, turn, intent, remaining, CASE WHEN intent IN ('clarify', 'silent') THEN 'repeat' WHEN intent = 'dont_know' THEN CASE WHEN gaps >= 1 AND remaining > 1 THEN 'easier' ELSE 'next' END
  WHEN wants AND used < 1 THEN 'followup' WHEN intent = 'substantive' AND remaining <= 0 THEN 'end' ELSE 'next' END AS action FROM g""",
    "unanswered_questions": f"""WITH k AS (SELECT conv_id, turn, {_KIND} AS kind FROM conversations),
l AS (SELECT *, lead(kind) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM k WHERE kind IS NOT NULL)
SELECT conv_id, count(*) AS open, min(turn) AS first_open FROM l WHERE kind = 'q' AND (nx IS NULL OR nx = 'q') GROUP BY conv_id""",
    "term_idf": f"WITH {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "idf_recall": f"""WITH {_PAIRS}, {_IDF}, x AS (SELECT conv_id, turn, unnest(list_distinct({Q.content_terms('question')})) AS term, {Q.content_terms('answer')} AS said FROM pa),
y AS (SELECT x.*, coalesce(idf, ln(n.n + 1) + 1) AS w FROM x LEFT JOIN idf USING (term), n)
SELECT conv_id, turn, round(sum(CASE WHEN list_contains(said, term) THEN w ELSE 0 END) / sum(w), 6) AS recall FROM y GROUP BY 1, 2""",
    "pace_scores": """SELECT event_id, round(CASE WHEN v BETWEEN 110 AND 160 THEN 100.0::DOUBLE WHEN v < 110 THEN greatest(20, 100 - (110 - v) * 1.4::DOUBLE) ELSE greatest(20, 100 - (v - 160) * 1.1::DOUBLE) END, 6) AS pace,
round(CASE WHEN v <= 0 THEN 50.0::DOUBLE WHEN v < 80 THEN v / 80 * 55 WHEN v < 120 THEN 55 + (v - 80) / 40 * 25 WHEN v <= 160 THEN 80 + (v - 120) / 40 * 20 WHEN v <= 200 THEN greatest(50, 100 - (v - 160) / 40 * 30) ELSE 20 END, 6) AS speed
FROM (SELECT event_id, value * 2 AS v FROM events)""",
    "words_by_role": f"""WITH w AS (SELECT conv_id, CASE WHEN role <> '' THEN role ELSE 'General' END AS grp, len({Q.words('text')})::DOUBLE AS n FROM conversations),
g AS (SELECT conv_id, grp, count(*) AS n, avg(n) AS m FROM w GROUP BY 1, 2)
SELECT conv_id, grp, n, round(m, 6) AS mean, row_number() OVER (PARTITION BY conv_id ORDER BY m ASC NULLS LAST, grp)::INT AS place FROM g""",
    "session_report": f"""WITH {_PAIRS}, e AS (SELECT conv_id, turn, answer, {_intent('answer')} IN ('dont_know', 'silent') AS skipped, {Q.words(Q.strip('answer'))} AS ws, {_technical('answer')} AS technical,
  {_communication('answer')} AS communication, {Q.count_terms(f"lower({Q.strip('answer')})", L.HEDGES)} AS hedges, {Q.count_phrases('answer', L.CONCRETE)} > 0 AS concrete, {Q.count_phrases('answer', L.STRUCTURE)} >= 2 AS structured FROM pa),
f AS (SELECT *, len(ws) AS wc, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: lower(regexp_replace(w, '^[.,!?]+|[.,!?]+$', '', 'g')) IN {Q.tup(L.FILLERS)})) * 100 / len(ws) ELSE 0.0::DOUBLE END AS fr FROM e),
h AS (SELECT *, greatest(20, least(100, 100 - fr * 6)) AS fluency FROM f), m AS (SELECT *, greatest(20, least(100, communication * 0.6::DOUBLE + fluency * 0.4::DOUBLE)) AS confidence,
  row_number() OVER (PARTITION BY conv_id, skipped ORDER BY turn) - 1 AS i FROM h),
a AS (SELECT conv_id, count(*) AS answers, count(*) FILTER (NOT skipped) AS answered, count(*) FILTER (skipped) AS declined, avg(technical) FILTER (NOT skipped) AS technical,
  avg(communication) FILTER (NOT skipped AND wc >= 3) AS communication, avg(confidence) FILTER (NOT skipped AND wc >= 3) AS confidence, avg(fluency) FILTER (NOT skipped AND wc >= 3) AS fluency,
  sum(wc)::BIGINT AS words, coalesce(avg(fr) FILTER (NOT skipped AND wc >= 3), 0) AS filler_rate, count(*) FILTER (NOT skipped AND concrete) AS concrete, count(*) FILTER (NOT skipped AND structured) AS structured,
  coalesce(sum(hedges) FILTER (NOT skipped), 0)::BIGINT AS hedges, CASE WHEN count(*) FILTER (NOT skipped) >= 3 THEN regr_slope(technical, i) FILTER (NOT skipped) END AS trend FROM m GROUP BY conv_id),
b AS (SELECT *, answered / answers AS coverage, (coalesce(technical * 0.30::DOUBLE, 0) + coalesce(communication * 0.20::DOUBLE, 0) + coalesce(confidence * 0.13::DOUBLE, 0) + coalesce(fluency * 0.12::DOUBLE, 0))
  / nullif((technical IS NOT NULL)::INT * 0.30::DOUBLE + (communication IS NOT NULL)::INT * 0.20::DOUBLE + (confidence IS NOT NULL)::INT * 0.13::DOUBLE + (fluency IS NOT NULL)::INT * 0.12::DOUBLE, 0) AS raw FROM a),
o AS (SELECT *, coalesce(greatest(0, least(100, raw * CASE WHEN coverage < 0.8::DOUBLE THEN 0.65::DOUBLE + 0.35::DOUBLE * (coverage / 0.8::DOUBLE) ELSE 1 END)), 0) AS overall,
  list_filter([CASE WHEN technical < 62 THEN 'low_technical' END, CASE WHEN confidence < 48 THEN 'low_confidence' END, CASE WHEN filler_rate >= 6 THEN 'high_fillers' END,
  CASE WHEN hedges >= greatest(4, answered, 1) THEN 'hedging' END, CASE WHEN concrete = 0 AND answered >= 3 THEN 'no_examples' END, CASE WHEN declined > 0 THEN 'declined_questions' END,
  CASE WHEN trend <= -2.5::DOUBLE THEN 'declining_trend' END], lambda x: x IS NOT NULL) AS tags FROM b),
c(i, name, triggers) AS (VALUES {_CASES}),
z AS (SELECT conv_id, i, name, len(list_intersect(triggers, tags)) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY len(list_intersect(triggers, tags)) DESC, i) AS r FROM o, c),
y AS (SELECT conv_id, string_agg(name, ',' ORDER BY r) AS resources FROM z WHERE s > 0 AND r <= 5 GROUP BY conv_id)
SELECT conv_id, answers, answered, declined, round(coverage, 6) AS coverage, round(technical, 6) AS technical, round(communication, 6) AS communication, round(confidence, 6) AS confidence,
  round(fluency, 6) AS fluency, words, round(filler_rate, 6) AS filler_rate, concrete, structured, hedges, round(overall, 6) AS overall,
  CASE WHEN overall >= 78 AND answered >= 4 THEN 'ADVANCED' WHEN overall >= 62 AND answered >= 2 THEN 'INTERMEDIATE' ELSE 'BEGINNER' END AS level,
  array_to_string(tags, ',') AS diagnosis, coalesce(resources, '') AS resources FROM o LEFT JOIN y USING (conv_id)""",
}
