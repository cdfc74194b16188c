"""Queries of whole answer scores, evaluation slices, and rows that other queries only use inside."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T
from parley.operators import answers as A
from parley.operators import audio as U
from parley.operators import evaluation as E
from parley.operators import retrieval as R
from parley.operators import scoring
from parley.operators import sessions as S
from parley.plans import analytics as N
from parley.plans import sessions as P
from parley.plans import sql as Q
from parley.plans.tables import table

EXPECTS = ["the process", "of state", "another thing"]


def _pairs(spark, sf_dir):
    return S.pair_preceding(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def personal_relevance(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.personal(F.col("text")).alias("score"))


def form_matches(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(A.form_match(F.col("question"), F.col("answer")), 6).alias("form"))


def concept_shares(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    expects = T.strs(EXPECTS)
    return rows.select("conv_id", "turn", F.round(S.concept_coverage(expects, F.col("answer")), 6).alias("coverage"), F.round(scoring.concept_share(expects, F.col("answer")), 6).alias("share"))


def answer_relevance(spark, sf_dir):
    """Relevance of each answer to the question before it, terms weighed by the documents' frequencies."""
    docs = table(spark, sf_dir, "documents")
    idf = scoring.inverse_frequency(docs, "doc_id", "text").select("term", "idf")
    pairs = _pairs(spark, sf_dir)
    recall = scoring.recall(pairs, idf, F.log(F.lit(docs.count()) + 1) + 1, ["conv_id", "turn"])
    rows = pairs.join(recall, ["conv_id", "turn"], "left")
    return A.relevance(rows, "recall", "question", "answer", T.strs(EXPECTS)).select("conv_id", "turn", "relevance")


def answer_evaluation(spark, sf_dir):
    rows = A.evaluate(_pairs(spark, sf_dir), "question", "answer", F.lit("index and cache"), F.lit(50.0), F.lit(40.0), F.lit(30.0))
    return rows.select("conv_id", "turn", "verdict", "technical", "relevance", "depth", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"))


def answer_routes(spark, sf_dir):
    w = F.size(T.words(F.coalesce("answer", F.lit(""))))
    fillers = F.size(F.filter(T.words(F.coalesce("answer", F.lit(""))), lambda x: F.lower(F.regexp_replace(x, r"^[.,!?]+|[.,!?]+$", "")).isin(L.SCORE_FILLERS)))
    phase = A.phase(F.col("turn") % 20, F.lit(20))
    a = F.col("answer")
    r = A.route(scoring.intent(a), phase, F.col("turn") % 3 == 0, scoring.communication(a), F.lit(55.0), scoring.technical(a), fillers, w, F.lit(61.0), F.lit(72.0))
    return _pairs(spark, sf_dir).select("conv_id", "turn", phase.alias("phase"), r.alias("r")).select("conv_id", "turn", "phase", "r.*")


def code_heuristics(spark, sf_dir):
    """Pages as code in five languages; those in Python are loops and functions by the page's number, some with an error, and the page as a text."""
    k = F.col("page_id")
    language = F.element_at(T.strs(["javascript", "java", "php", "go", "python"]), (k % 5 + 1).cast("int"))
    lines = [F.repeat(F.lit("for x in y:\n    pass\n"), (k % 3).cast("int")), F.repeat(F.lit("def f():\n    pass\n"), (k % 2).cast("int")), F.when(k % 7 == 0, "def (\n").otherwise(""), F.lit("# "), F.regexp_replace("html", r"[\r\n\f\x00]", " ")]
    code = F.when(k % 5 == 4, F.concat(*lines)).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", A.code_scores(code, language).alias("s")).select("page_id", "s.*")


def evaluation_slices(spark, sf_dir):
    """Corpus BLEU, exact matches, empties, lengths and perplexity of replies: of all, by task, by domain, and crossed."""
    rows = N._replies(spark, sf_dir).withColumns({"prediction": F.col("text"), "reference": F.col("next"), "nll": F.length("text") * 0.25, "tokens": F.size(T.words(F.col("text"))), "task": F.concat(F.lit("t"), F.pmod(F.length("text"), F.lit(3))), "domain": F.when(F.pmod(F.length("next"), F.lit(4)) > 0, F.concat(F.lit("d"), F.pmod(F.length("next"), F.lit(4))))})
    out = E.evaluation_slices(rows, "id", ["task", "domain"])
    return out.select("task", "domain", "n", "exact_match", "empty", *(F.round(c, 6).alias(c) for c in ("bleu", "prediction_chars", "reference_chars", "perplexity")))


def proxy_rouge(spark, sf_dir):
    rows = E.proxy_rouge(N._replies(spark, sf_dir), F.col("text"), F.col("next"))
    return rows.select("id", F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


def word_errors(spark, sf_dir):
    return E.word_error_rate(N._replies(spark, sf_dir), F.col("text"), F.col("next")).withColumn("wer", F.round("wer", 6))


def comparable_runs(spark, sf_dir):
    """Settings in which two runs (here: two halves of the orders) differ."""
    o = table(spark, sf_dir, "orders")
    run = lambda r: o.filter(F.col("o_orderkey") % 2 == r).agg(F.count("*").cast("string").alias("n"), F.min("o_orderstatus").alias("status"), F.max("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("seed"))
    return E.setting_differences(run(0), run(1), ["n", "status", "priority", "seed"])


def perplexities(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    loss = F.when(F.col("event_type") != "error", F.col("value") / 25 - 0.1)
    return e.select("event_id", F.round(F.when(E.perplexity(loss) < float("inf"), E.perplexity(loss)).otherwise(-1.0), 4).alias("perplexity"))


def top_hits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ranked"), F.max("l_linenumber").alias("target"))
    return E.hit_rates(li, F.col("ranked"), F.when(F.col("l_orderkey") % 5 > 0, F.col("target"))).select(F.round("top1", 6).alias("top1"), F.round("top5", 6).alias("top5"))


def keyword_retrieval(spark, sf_dir):
    """The passages that hold most of the distinct words of each item; ties by id."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.words(F.lower(F.col("text")))).alias("words"))
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return R.top_by_keywords(items, pages, "item_id", "words", "page_id", "html", 3).select("item_id", "page_id", "hits", "place")


def rag_topk(spark, sf_dir):
    """Uncapped index with plain term counts; the least score is asked for after the cut."""
    docs, bench = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), table(spark, sf_dir, "benchmark")
    counts, n = R.term_counts(docs, "page_id", "text", pairs=False), docs.count()
    idfs = R.idf(counts, n)
    queries = R.weigh(R.term_counts(bench, "item_id", "text", pairs=False), idfs, sublinear=False)
    # terms that no item has count for a page's length only
    weights = R.weigh(counts, idfs, sublinear=False, only=queries.select("term").distinct())
    top = R.top_by_terms(queries, weights, 3, least=0.05)
    return top.select(F.col("query").alias("item_id"), F.col("id").alias("page_id"), F.round("score", 6).alias("score"), "place")


def pool_fallback(spark, sf_dir):
    """Parts by type in the wanted brand and size, or of the size alone; those asked before are left out."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("difficulty"), "p_brand", "p_name", "p_retailprice")
    asked = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select("p_name")
    rows = R.with_fallback(R.not_asked(p, asked, "p_name"), F.col("p_brand") == "Brand#11", F.lit("7"), [F.desc("p_retailprice"), F.asc("p_partkey")], 5)
    return rows.select("p_partkey", "tier")


def answers_by_role(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("s", scoring.technical(F.col("text")))
    return S.by_group(rows, "conv_id", "role", "s").select("conv_id", "grp", "n", F.round("mean", 6).alias("mean"), "place")


def words_per_minute(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    n = F.size(T.words(F.col("text")))
    ends = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct((i * (F.col("turn") + 1) * 2.0).alias("end"), F.when(i > 1, -i / 10.0).alias("avg_logprob")))
    return t.select(
        "conv_id", "turn", F.round(S.words_per_minute(n, F.col("turn") * 1500), 6).alias("wpm"), F.round(U.wpm_from_segments(n, ends), 6).alias("segment_wpm"), F.round(U.mean_log_probability(ends), 6).alias("logprob"),
    )


def audio_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.explode(U.windows((F.col("value") * 10_000).cast("int"))).alias("w"))
    return e.select("event_id", "w.start", "w.end")


def normalised_peaks(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    top = F.array_max(F.transform(U.peak_normalise(F.col("embedding").cast("array<double>")), F.abs))
    return v.select("vec_id", F.round(top, 6).alias("peak"), U.performance_band(F.col("vec_id") % 101).alias("band"))


QUERIES = [
    personal_relevance, form_matches, concept_shares, answer_relevance, answer_evaluation, answer_routes, code_heuristics, evaluation_slices, proxy_rouge, word_errors, comparable_runs, perplexities, top_hits,
    keyword_retrieval, rag_topk, pool_fallback, answers_by_role, words_per_minute, audio_windows, normalised_peaks,
]


def _personal(t: str) -> str:
    n = f"len({Q.words(t)})"
    names = f"len(regexp_extract_all(substr({t}, 2), '(?:^|[^\\p{{L}}\\p{{N}}_])[A-Z][a-zA-Z.+#]{{2,}}'))"
    return f"""round(least(100.0::DOUBLE, least(30, {Q.count_words(t, L.SELF_REFERENCE)} * 7.0::DOUBLE) + least(30, {Q.count_phrases(t, L.SPECIFIC)} * 9.0::DOUBLE + least({names}, 4) * 4.0::DOUBLE)
  + least(20, {Q.count_words(t, L.NARRATIVE)} * 7.0::DOUBLE) + CASE WHEN {n} >= 45 THEN 20 WHEN {n} >= 25 THEN 15 WHEN {n} >= 12 THEN 9 ELSE {n} * 0.5::DOUBLE END), 1)"""


def _form(q: str, a: str) -> str:
    asked = {k: f"{Q.has_words(q, p)}::INT" for k, p in L.QUESTION_FORMS.items()}
    n = "(" + " + ".join(asked.values()) + ")"
    met = "(" + " + ".join(f"{asked[k]} * {Q.has_words(a, p)}::INT" for k, p in L.ANSWER_FORMS.items()) + ")"
    return f"CASE WHEN {n} > 0 THEN 25 + 75.0::DOUBLE * {met} / {n} ELSE 60 END"


def _share(a: str) -> str:
    hit = " + ".join(f"list_has_any({Q.content_terms(Q.lit(e))}, said)::INT" for e in EXPECTS)
    return f"(SELECT 100.0::DOUBLE * ({hit}) / {len(EXPECTS)} FROM (SELECT {Q.content_terms(a)} AS said))"


def _concepts(t: str) -> str:
    low = f"lower({t})"
    known = "[" + ", ".join(f"CASE WHEN regexp_matches({low}, {Q.lit(T.whole(c))}) THEN {Q.lit(c)} END" for c in L.CONCEPTS) + "]"
    words = f"list_filter(regexp_extract_all({low}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{5,}}') AND w NOT IN {Q.tup(L.CONCEPT_STOP)})"
    both = f"list_concat(list_filter({known}, lambda c: c IS NOT NULL), {words})"
    return f"list_filter({both}, lambda c, i: list_position({both}, c) = i)[1:10]"


_STEM3 = " + ".join(
    f"len(list_filter([1], lambda z: len(list_filter(regexp_extract_all(lower({Q.lit(e)}), '[a-z]{{4,}}'), lambda t: contains(lower(answer), t))) > 0))" for e in EXPECTS)

ORACLE = {
    "personal_relevance": f"SELECT conv_id, turn, {_personal('text')} AS score FROM conversations",
    "form_matches": f"WITH {P._PAIRS} SELECT conv_id, turn, round({_form('question', 'answer')}, 6) AS form FROM pa",
    "concept_shares": f"WITH {P._PAIRS} SELECT conv_id, turn, round(({_STEM3}) / {len(EXPECTS)}, 6) AS coverage, round({_share('answer')}, 6) AS share FROM pa",
    "answer_relevance": f"""WITH {P._PAIRS}, {P._IDF}, x AS (SELECT conv_id, turn, unnest(list_distinct({Q.content_terms('question')})) AS term, {Q.content_terms('answer')} AS said FROM pa),
y AS (SELECT x.*, coalesce(idf, ln(n.n + 1) + 1) AS w FROM x LEFT JOIN idf USING (term), n), rc AS (SELECT conv_id, turn, sum(CASE WHEN list_contains(said, term) THEN w ELSE 0 END) / sum(w) AS recall FROM y GROUP BY 1, 2),
z AS (SELECT conv_id, turn, {Q.strip('question')} AS q, {Q.strip('answer')} AS a, recall FROM pa LEFT JOIN rc USING (conv_id, turn)),
f AS (SELECT *, len({Q.words('a')}) AS n, {_form('q', 'a')} AS form, {_share('a')} AS sh, {Q.count_terms('lower(a)', L.TECHNICAL_TERMS)} AS engaged FROM z),
g AS (SELECT *, greatest(0, least(100, 0.40::DOUBLE * least(100.0::DOUBLE, coalesce(recall, 0) * 250) + 0.25::DOUBLE * form + 0.35::DOUBLE * sh)) AS s,
  CASE WHEN n >= 20 AND engaged >= 3 THEN CASE WHEN form >= 50 THEN 40.0::DOUBLE ELSE 35 END WHEN n >= 30 THEN 30 ELSE 0 END AS least_ FROM f)
SELECT conv_id, turn, CASE WHEN a = '' THEN 0 WHEN q = '' THEN CASE WHEN n >= 15 THEN 50.0::DOUBLE ELSE 25 END WHEN n < 4 THEN 15 WHEN {Q.has_words('q', L.PERSONAL_PROMPT)} THEN {_personal('a')}
  ELSE round(greatest(s, least_), 1) END AS relevance FROM g""",
    "answer_evaluation": f"""WITH {P._PAIRS}, z AS (SELECT conv_id, turn, {Q.strip('answer')} AS a, {Q.strip('question')} || ' index and cache' AS r FROM pa), c AS (SELECT *, {_concepts('a')} AS said, {_concepts('r')} AS wanted, len({Q.words('a')}) AS n FROM z),
d AS (SELECT *, list_filter(wanted, lambda x: list_contains(said, x) OR contains(lower(a), x)) AS cov, least(n / 25.0::DOUBLE, 1.2::DOUBLE) AS ln FROM c),
e AS (SELECT *, len(cov) / greatest(len(wanted), 1) AS sh FROM d),
f AS (SELECT *, round(greatest(10, least(98, sh * 60.0::DOUBLE + 12.5::DOUBLE + ln * 15.0::DOUBLE)), 1) AS t, round(greatest(20, least(99, 16.0::DOUBLE + sh * 40.0::DOUBLE + 20.0::DOUBLE)), 1) AS rel,
  round(greatest(15, least(98, len(said) * 12.0::DOUBLE + ln * 20.0::DOUBLE + 6.0::DOUBLE)), 1) AS dp FROM e)
SELECT conv_id, turn, CASE WHEN n < 3 THEN 'INCORRECT' WHEN t >= 75 THEN 'CORRECT' WHEN t >= 45 THEN 'PARTIALLY_CORRECT' WHEN rel < 35 THEN 'OFF_TOPIC' ELSE 'INCORRECT' END AS verdict,
  CASE WHEN n < 3 THEN 0 ELSE t END AS technical, CASE WHEN n < 3 THEN 0 ELSE rel END AS relevance, CASE WHEN n < 3 THEN 0 ELSE dp END AS depth, CASE WHEN n < 3 THEN '' ELSE array_to_string(cov, ',') END AS covered,
  array_to_string(CASE WHEN n < 3 THEN wanted ELSE list_filter(wanted, lambda x: NOT list_contains(cov, x)) END, ',') AS missing FROM f""",
    "answer_routes": f"""WITH {P._PAIRS}, x AS (SELECT conv_id, turn, {P._intent('answer')} IN ('dont_know', 'silent') AS skipped, turn % 3 = 0 AS measured, {P._communication('answer')} AS c, {P._technical('answer')} AS t, {Q.words("coalesce(answer, '')")} AS ws, (turn % 20) / 20 AS r FROM pa),
y AS (SELECT *, CASE WHEN r < 0.15::DOUBLE THEN 'greet' WHEN r < 0.3::DOUBLE THEN 'intro' WHEN r < 0.6::DOUBLE THEN 'tech' WHEN r < 0.8::DOUBLE THEN 'follow' WHEN r < 0.95::DOUBLE THEN 'behavior' ELSE 'wrap' END AS phase,
  greatest(20, least(100, 100 - coalesce(len(list_filter(ws, lambda w: lower(regexp_replace(w, '^[.,!?]+|[.,!?]+$', '', 'g')) IN {Q.tup(L.SCORE_FILLERS)})) * 100.0::DOUBLE / nullif(len(ws), 0), 0) * 6)) AS f FROM x)
SELECT conv_id, turn, phase, skipped, measured, CASE WHEN skipped THEN 0 ELSE round(c, 1) END AS communication, CASE WHEN skipped THEN 0.0::DOUBLE ELSE 55 END AS relevance,
  CASE WHEN skipped THEN 0 WHEN phase NOT IN {Q.tup(L.NON_TECHNICAL_PHASES)} THEN round(t, 1) END AS technical, round(CASE WHEN measured THEN 72.0::DOUBLE WHEN skipped THEN 0 ELSE f END, 1) AS fluency,
  round(CASE WHEN measured THEN 61.0::DOUBLE WHEN skipped THEN 0 ELSE greatest(20, least(100, c * 0.6::DOUBLE + f * 0.4::DOUBLE)) END, 1) AS confidence FROM y""",
    "code_heuristics": """WITH p AS (SELECT page_id, page_id % 5 AS l, page_id % 7 = 0 AS bad, CASE WHEN page_id % 5 = 4 THEN repeat('for x in y:' || chr(10) || '    pass' || chr(10), page_id % 3) || repeat('def f():' || chr(10) || '    pass' || chr(10), page_id % 2)
  || CASE WHEN page_id % 7 = 0 THEN 'def (' || chr(10) ELSE '' END || '# ' || regexp_replace(html, '[\r\n\f\x00]', ' ', 'g') ELSE html END AS c FROM pages),
s AS (SELECT page_id, c, l, bad, CASE WHEN l = 4 AND bad THEN 30 WHEN l = 4 THEN 85 WHEN l = 0 AND (contains(c, 'function') OR contains(c, '=>')) THEN 85 WHEN l = 1 AND contains(c, 'class ') THEN 85 WHEN l = 2 AND (contains(c, '<?php') OR contains(c, '$')) THEN 80 ELSE 70 END AS correctness,
  CASE WHEN l = 4 AND bad THEN 40 WHEN l = 4 AND page_id % 2 = 0 THEN 65 WHEN l = 0 AND contains(c, 'var ') THEN 65 WHEN l = 1 AND contains(c, 'public ') THEN 85 ELSE 75 END - CASE WHEN len(string_split(c, chr(10))) < 3 THEN 10 ELSE 0 END - CASE WHEN contains(c, 'TODO') OR contains(c, 'FIXME') THEN 5 ELSE 0 END AS quality,
  CASE WHEN l = 0 AND contains(c, 'eval(') THEN 20 WHEN l = 2 AND (contains(c, 'eval(') OR contains(c, 'exec(')) THEN 30 ELSE 90 END AS security FROM p)
SELECT page_id, floor((correctness * 4 + quality * 4 + security * 2) / 10)::INT AS score, correctness::INT AS correctness, quality::INT AS quality, security::INT AS security,
  CASE WHEN l = 4 AND NOT bad AND page_id % 3 = 0 THEN 'O(1)' WHEN l = 4 AND NOT bad AND page_id % 3 = 2 THEN 'O(N^2)' ELSE 'O(N)' END AS complexity FROM s""",
    "evaluation_slices": f"""WITH {N._REPLIES}, {N._matches(N._tok13('text'), N._tok13('nx'), 4)}, r AS (SELECT id, text, nx, 't' || length(text) % 3 AS task, CASE WHEN length(nx) % 4 > 0 THEN 'd' || length(nx) % 4 END AS domain, length(text) * 0.25::DOUBLE AS nll, len({Q.words('text')}) AS tokens FROM rp),
s AS (SELECT task, domain, grouping(task, domain) AS g, count(*) AS n, round(avg(({Q.strip('text')} = {Q.strip('nx')})::INT), 6) AS exact_match, count(*) FILTER ({Q.strip('text')} = '') AS empty, avg(length(text)) AS pc, avg(length(nx)) AS rc, exp(sum(nll) / nullif(sum(tokens), 0)) AS ppl
  FROM r GROUP BY GROUPING SETS ((), (task), (domain), (task, domain))),
b AS (SELECT task, domain, grouping(task, domain) AS g, n AS o, sum(matched) AS m, sum(total) AS t, sum(wanted) AS w FROM r JOIN mt USING (id) GROUP BY GROUPING SETS ((n), (task, n), (domain, n), (task, domain, n))),
c AS (SELECT task, domain, g, CASE WHEN count(*) < 4 OR min(m) = 0 THEN 0 ELSE CASE WHEN max(t) FILTER (o = 1) > max(w) FILTER (o = 1) THEN 1 ELSE exp(1 - max(w) FILTER (o = 1) / greatest(max(t) FILTER (o = 1), 1)) END * exp(avg(ln(m / t)) FILTER (m > 0)) END AS bleu FROM b GROUP BY task, domain, g)
SELECT s.task, s.domain, n, exact_match, empty, round(coalesce(bleu, 0), 6) AS bleu, round(pc, 6) AS prediction_chars, round(rc, 6) AS reference_chars, round(ppl, 6) AS perplexity
FROM s LEFT JOIN c ON s.g = c.g AND s.task IS NOT DISTINCT FROM c.task AND s.domain IS NOT DISTINCT FROM c.domain WHERE (s.g & 2 > 0 OR s.task IS NOT NULL) AND (s.g & 1 > 0 OR s.domain IS NOT NULL)""",
    "proxy_rouge": f"""WITH {N._REPLIES}, w AS (SELECT id, {Q.words('lower(text)')} AS a, {Q.words('lower(nx)')} AS b FROM rp), g AS (SELECT *, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) AS a2, list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]) AS b2 FROM w)
SELECT id, round(coalesce(2 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0), 0), 6) AS rouge1, round(CASE WHEN len(a2) > 0 AND len(b2) > 0 THEN 2 * len(list_intersect(a2, b2)) / (len(a2) + len(b2)) ELSE 0 END, 6) AS rouge2 FROM g""",
    "comparable_runs": """WITH r AS (SELECT o_orderkey % 2 AS r, count(*)::VARCHAR AS n, min(o_orderstatus) AS status, max(o_orderpriority) AS priority FROM orders GROUP BY 1),
u AS (SELECT 'n' AS setting, a.n AS base, b.n AS candidate FROM r a, r b WHERE a.r = 0 AND b.r = 1 UNION ALL SELECT 'status', a.status, b.status FROM r a, r b WHERE a.r = 0 AND b.r = 1 UNION ALL SELECT 'priority', a.priority, b.priority FROM r a, r b WHERE a.r = 0 AND b.r = 1)
SELECT setting, base, candidate, base IS NOT DISTINCT FROM candidate AS same FROM u UNION ALL SELECT 'seed', NULL, NULL, true""",
    "perplexities": "SELECT event_id, round(CASE WHEN event_type <> 'error' AND value / 25 - 0.1::DOUBLE >= 0 THEN exp(least(80, value / 25 - 0.1::DOUBLE)) ELSE -1 END, 4) AS perplexity FROM events",
    "top_hits": """WITH l AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS r, max(l_linenumber) AS t FROM lineitem GROUP BY 1)
SELECT round(avg(list_contains(r[1:1], t)::INT) FILTER (l_orderkey % 5 > 0), 6) AS top1, round(avg(list_contains(r[1:5], t)::INT) FILTER (l_orderkey % 5 > 0), 6) AS top5 FROM l""",
    "keyword_retrieval": f"""WITH q AS (SELECT item_id, unnest(list_distinct({Q.words('lower(text)')})) AS w FROM benchmark), h AS (SELECT item_id, page_id, count(*) AS hits FROM q JOIN pages ON contains(lower(html), w) GROUP BY 1, 2)
SELECT item_id, page_id, hits::INT AS hits, (row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, page_id))::INT AS place FROM h QUALIFY place <= 3""",
    "rag_topk": f"""WITH n AS (SELECT count(*) AS n FROM pages), c AS (SELECT page_id, term, count(*) AS tf FROM (SELECT page_id, unnest({N._WORDS}) AS term FROM (SELECT page_id, html AS text FROM pages)) GROUP BY ALL),
f AS (SELECT term, ln((any_value(n.n) + 1) / (count(*) + 1)) + 1 AS idf FROM c, n GROUP BY term), d AS (SELECT page_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY page_id)) AS w FROM c JOIN f USING (term)),
q AS (SELECT item_id, term, tf * idf AS w FROM (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({N._WORDS}) AS term FROM benchmark) GROUP BY ALL) JOIN f USING (term)),
qn AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM q), s AS (SELECT item_id, page_id, sum(qn.w * d.w) AS s FROM qn JOIN d USING (term) GROUP BY ALL)
SELECT item_id, page_id, round(s, 6) AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, page_id) AS place FROM s) WHERE place <= 3 AND s > 0.05""",
    "pool_fallback": """WITH a AS (SELECT DISTINCT lower(p_name) AS n FROM part WHERE p_partkey % 3 = 0), p AS (SELECT p_partkey, p_retailprice, CASE WHEN p_brand = 'Brand#11' THEN 0 ELSE 1 END AS tier FROM part WHERE p_size = 7 AND lower(p_name) NOT IN (SELECT n FROM a)),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY p_retailprice DESC, p_partkey) AS k FROM p) SELECT p_partkey, tier::INT AS tier FROM r WHERE k <= 5 AND tier = (SELECT min(tier) FROM p)""",
    "answers_by_role": f"""WITH w AS (SELECT conv_id, CASE WHEN role <> '' THEN role ELSE 'General' END AS grp, {P._technical('text')} AS s FROM conversations), g AS (SELECT conv_id, grp, count(*) AS n, avg(s) AS m FROM w GROUP BY 1, 2)
SELECT conv_id, grp, n, round(m, 6) AS mean, row_number() OVER (PARTITION BY conv_id ORDER BY m ASC NULLS LAST, grp)::INT AS place FROM g""",
    "words_per_minute": f"""WITH w AS (SELECT conv_id, turn, len({Q.words('text')}) AS n FROM conversations)
SELECT conv_id, turn, round(CASE WHEN turn * 1500 > 2000 AND n > 0 THEN n / (turn * 1500 / 60000) END, 6) AS wpm, round(n / (6.0::DOUBLE * (turn + 1) / 60), 6) AS segment_wpm, round(-0.25::DOUBLE, 6) AS logprob FROM w""",
    "audio_windows": """WITH e AS (SELECT event_id, floor(value * 10000)::BIGINT AS n FROM events), s AS (SELECT event_id, n, unnest(range(0, n, 480000)) AS st FROM e WHERE n > 0)
SELECT event_id, st::INT AS start, least(st + 480000, n)::INT AS "end" FROM s""",
    "normalised_peaks": """SELECT vec_id, round(CASE WHEN list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) > 0 THEN 10.0::DOUBLE ** (-1.0::DOUBLE / 20) ELSE 0 END, 6) AS peak,
CASE WHEN vec_id % 101 >= 80 THEN 'ADVANCED' WHEN vec_id % 101 >= 55 THEN 'INTERMEDIATE' ELSE 'BEGINNER' END AS band FROM embeddings""",
}
