"""Queries of records: documents as collected records, first line as question, the rest as answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T
from parley.operators import records as R
from parley.plans import sql as Q
from parley.plans.tables import table

MARKS = ["the ", "\n", "of "]


def _records(spark, sf_dir):
    parts = F.split(F.coalesce("text", F.lit("")), "\n", 2)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", parts[0].alias("question"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("answer"))


def missing_counts(spark, sf_dir):
    return R.missing(_records(spark, sf_dir), ["question", "answer", "lang", "source"])


def filled_records(spark, sf_dir):
    rows = R.filled(_records(spark, sf_dir), "question", {"answer": "Comprehensive technical explanation.", "lang": "General Software Engineering"})
    return rows.select("doc_id", "lang", F.md5("answer").alias("digest"))


def clean_numbered(spark, sf_dir):
    rows = R.numbered(R.clean_records(_records(spark, sf_dir), "question", "doc_id"), "doc_id")
    return rows.select("doc_id", "record_id", F.md5(R.prompt(F.coalesce("source", F.lit("none")), F.lit("Intermediate"), F.col("question"))).alias("prompt"))


def tidy_questions(spark, sf_dir):
    rows = _records(spark, sf_dir).filter(~R.is_blank(F.col("question")))
    return rows.select("doc_id", F.md5(R.tidy_question(F.col("question"))).alias("tidy"), F.md5(R.normal_form(F.col("question"))).alias("normal"))


def coarse_labels(spark, sf_dir):
    q, a = F.col("question"), F.col("answer")
    return _records(spark, sf_dir).select("doc_id", R.coarse_domain(q, a).alias("domain"), R.coarse_difficulty(q, a).alias("difficulty"))


def threads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    t = R.thread(F.col("text"), 40)
    return d.select("doc_id", t.alias("t")).select("doc_id", F.md5("t.title").alias("title"), F.length("t.body").alias("body"), F.md5("t.answer").alias("answer"))


def prior_domains(spark, sf_dir):
    sites = F.element_at(T.strs([*L.SITE_PRIORS, "other"]), (F.col("doc_id") % (len(L.SITE_PRIORS) + 1) + 1).cast("int"))
    rows = _records(spark, sf_dir).withColumn("site", sites)
    text = F.concat_ws("\n", "question", "answer")
    return rows.select("doc_id", T.domain(text, priors=T.site_priors(F.col("site"))).alias("by_site"), T.domain(text, priors=T.prompt_priors(F.col("source")), prior_weight=L.PROMPT_PRIOR_WEIGHT).alias("by_prompt"))


def _shaped(spark, sf_dir):
    k = F.col("doc_id") % 6
    has = lambda *n: k.isin(*n)
    q, a = F.col("question"), F.col("answer")
    cols = {
        "instruction": F.when(has(0), q), "input": F.when(has(0) & (F.col("doc_id") % 4 == 0), F.col("source")), "output": F.when(has(0), a), "prompt": F.when(has(1), q),
        "completion": F.when(has(1), a), "question": F.when(has(2, 3), q), "answer": F.when(has(2), a), "text": F.when(has(4), q), "difficulty": F.when(has(2), F.lit("Advanced")), "topic": F.col("source"),
    }
    kind = F.element_at(T.strs(["instruction_io", "prompt_completion", "question_answer", "question_only", "raw_text", "unknown"]), (k + 1).cast("int"))
    return _records(spark, sf_dir).select("doc_id", kind.alias("kind"), *(v.alias(c) for c, v in cols.items()))


def training_examples(spark, sf_dir):
    rows = R.examples(_shaped(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "shape", "example", F.md5("user").alias("user"), F.md5("assistant").alias("assistant"), F.coalesce("reason", F.lit("kept")).alias("reason"))


def example_counts(spark, sf_dir):
    rows = R.examples(_shaped(spark, sf_dir), "doc_id")
    return rows.groupBy("shape", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def unique_examples(spark, sf_dir):
    rows = R.examples(_shaped(spark, sf_dir), "doc_id").filter("reason IS NULL")
    kept = R.first_of(rows, F.struct(F.lower("user"), F.lower("assistant")), [F.col("doc_id"), F.col("example")])
    return kept.groupBy("example").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def cut_answers(spark, sf_dir):
    c = R.cut_at(F.coalesce("text", F.lit("")), MARKS)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", F.md5("c.text").alias("text"), "c.cut")


def nested_settings(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.k.deeper").alias("deeper"))


def shuffled_splits(spark, sf_dir):
    return R.shuffled_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


def task_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return R.subsample(d, "source", "doc_id", 60).select("doc_id", "source")


def tag_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.concat_ws(" , ", F.split("text", " ")).alias("csv"))
    t = R.tags(F.col("csv"))
    return rows.select("doc_id", F.size(t).alias("n"), R.listed(t).alias("listed"), F.array_join(R.distinct_by_start(t, 2), "|").alias("starts"), R.slug("domain_", F.get(t, F.lit(0))).alias("slug"))


def tracks_inferred(spark, sf_dir):
    skills = T.strs(["Python", "SQL", "React", "Docker", "Linux", "HTML/CSS"])
    asked = F.element_at(T.strs(["", "react", "UI/UX", "swe", "Data Science", "unknown", "hr"]), (F.col("p_partkey") % 7 + 1).cast("int"))
    have = F.slice(skills, (F.col("p_partkey") % 5 + 1).cast("int"), (F.col("p_size") % 3).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", asked.alias("asked"), have.alias("have"))
    return p.select("p_partkey", R.track_of(F.col("asked")).alias("track"), R.infer_track(F.col("have"), F.col("asked")).alias("inferred"))


def plan_slots(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.element_at(T.strs(["easy", "medium", "hard", "odd"]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("d"))
    s = R.slots(F.col("p_size"))
    rows = p.select("p_partkey", s.alias("s"), "d", R.planned_questions(F.col("p_size") * 60).alias("planned"))
    return rows.select("p_partkey", "s.total", "s.cv", "s.behavioural", "s.technical", F.array_join(R.ladder(F.col("d"), F.col("s.technical")), ",").alias("ladder"), "planned")


QUERIES = [
    missing_counts, filled_records, clean_numbered, tidy_questions, coarse_labels, threads, prior_domains, training_examples, example_counts, unique_examples, cut_answers, nested_settings,
    shuffled_splits, task_sample, tag_lists, tracks_inferred, plan_slots,
]

_REC = """rec AS (SELECT doc_id, lang, source, split_part(coalesce(text, ''), chr(10), 1) AS question,
  CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS answer FROM documents)"""
_BLANK = lambda c: f"coalesce({Q.strip(c)} = '', true)"
_HASH = lambda c: f"('0x' || left(sha256('42:' || {c}), 12))::BIGINT"
_ANY = lambda low, terms: f"{Q.count_terms(low, terms)} > 0"
_LOW = "lower(question || ' ' || answer)"
_NW = lambda c: f"len({Q.words(c)})"


def _prior(score_of: str, weight: float) -> str:
    """Best domain of a haystack ``hay`` with a list ``pri`` of hinted domains."""
    rows = ", ".join(
        f"{{'score': 3.0::DOUBLE * {Q.count_terms('hay', [f' {t} ' for t in strong])} + 1.0::DOUBLE * {Q.count_terms('hay', [f' {t} ' for t in weak])} + {weight}::DOUBLE * len(list_filter({score_of}, lambda d: d = {Q.lit(name)})), 'rank': {-i}, 'domain': {Q.lit(name)}}}"
        for i, (name, (strong, weak)) in enumerate(L.DOMAIN_TERMS.items())
    )
    return f"list_max([{rows}])"


_SHAPED = f"""{_REC}, sh AS (SELECT doc_id, ['instruction_io', 'prompt_completion', 'question_answer', 'question_only', 'raw_text', 'unknown'][doc_id % 6 + 1] AS shape, {Q.strip('question')} AS q, {Q.strip('answer')} AS a,
  CASE WHEN doc_id % 4 = 0 THEN {Q.strip("coalesce(source, '')")} ELSE '' END AS inp, {Q.strip("coalesce(source, '')")} AS topic FROM rec),
pr AS (SELECT doc_id, shape, unnest(CASE shape WHEN 'prompt_completion' THEN [{{'u': q, 'a': a, 'e': 'prompt_completion'}}]
  WHEN 'instruction_io' THEN [{{'u': CASE WHEN inp <> '' THEN q || chr(10) || inp ELSE q END, 'a': a, 'e': 'question_generation'}}, {{'u': a, 'a': '', 'e': 'answer'}}]
  WHEN 'question_answer' THEN [{{'u': 'Ask me a advanced software engineering interview question' || CASE WHEN topic <> '' THEN ' about ' || topic ELSE '' END || '.', 'a': q, 'e': 'question_generation'}}, {{'u': q, 'a': a, 'e': 'answer'}}]
  WHEN 'question_only' THEN [{{'u': 'Ask me a software engineering interview question' || CASE WHEN topic <> '' THEN ' about ' || topic ELSE '' END || '.', 'a': q, 'e': 'question_generation'}}, {{'u': q, 'a': '', 'e': 'answer'}}]
  WHEN 'raw_text' THEN [{{'u': '', 'a': q, 'e': 'raw_text'}}] ELSE [] END, recursive := true) FROM sh),
us AS (SELECT doc_id, shape, u, a, e FROM pr WHERE a <> '' AND (u <> '' OR e = 'raw_text')),
ex AS (SELECT * FROM us UNION ALL SELECT doc_id, shape, '', '', 'none' FROM sh WHERE doc_id NOT IN (SELECT doc_id FROM us)),
er AS (SELECT *, CASE WHEN shape = 'unknown' THEN 'unrecognised_schema' WHEN e = 'none' THEN 'no_usable_pair_' || shape WHEN e = 'raw_text' AND length(a) < 8 THEN 'empty_text'
  WHEN e <> 'raw_text' AND length(u) < 8 THEN 'user_turn_too_short' WHEN length(a) < 8 THEN 'assistant_turn_too_short' END AS reason FROM ex)"""

_TRACK = "CASE " + "lower(asked) " + " ".join(
    [f"WHEN {Q.lit(k)} THEN {Q.lit(v)}" for k, v in L.TRACK_ALIASES.items()] + [f"WHEN {Q.lit(v[0].lower())} THEN {Q.lit(k)}" for k, v in L.TRACKS.items()]) + f" ELSE {Q.lit(L.DEFAULT_TRACK)} END"

ORACLE = {
    "missing_counts": f"WITH {_REC} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({_BLANK(c)}) AS missing FROM rec""" for c in ("question", "answer", "lang", "source")),
    "filled_records": f"""WITH {_REC} SELECT doc_id, CASE WHEN {_BLANK('lang')} THEN 'General Software Engineering' ELSE {Q.strip('lang')} END AS lang,
md5(CASE WHEN {_BLANK('answer')} THEN 'Comprehensive technical explanation.' ELSE {Q.strip('answer')} END) AS digest FROM rec WHERE NOT {_BLANK('question')}""",
    "clean_numbered": f"""WITH {_REC}, k AS (SELECT *, row_number() OVER (PARTITION BY lower({Q.strip(Q.sub('question', r'\s+', ' '))}) ORDER BY doc_id) AS r FROM rec WHERE {_NW('question')} >= 3)
SELECT doc_id, printf('CLEAN_%05d', row_number() OVER (ORDER BY doc_id)) AS record_id, md5('[DOMAIN: ' || coalesce(source, 'none') || '] [DIFFICULTY: Intermediate] Question: ' || question) AS prompt FROM k WHERE r = 1""",
    "tidy_questions": f"""WITH {_REC}, t AS (SELECT doc_id, question, {Q.strip(Q.sub('question', r'\s+', ' '))} AS c FROM rec WHERE NOT {_BLANK('question')}), u AS (SELECT *, CASE WHEN c LIKE '%?' THEN c ELSE c || '?' END AS d FROM t)
SELECT doc_id, md5(upper(left(d, 1)) || substr(d, 2)) AS tidy, md5(trim(regexp_replace(lower(question), '[^a-z0-9 ]', '', 'g'))) AS normal FROM u""",
    "coarse_labels": f"""WITH {_REC} SELECT doc_id, CASE {" ".join(f"WHEN {_ANY(_LOW, terms)} THEN {Q.lit(name)}" for name, terms in L.COARSE_DOMAINS.items())} ELSE {Q.lit(L.COARSE_OTHER)} END AS domain,
CASE WHEN {_NW('question')} > 25 OR {_NW('answer')} > 80 OR {_ANY(_LOW, L.COARSE_ADVANCED)} THEN 'Advanced' WHEN {_NW('question')} > 12 OR {_NW('answer')} > 35 OR {_ANY(_LOW, L.COARSE_INTERMEDIATE)} THEN 'Intermediate' ELSE 'Beginner' END AS difficulty FROM rec""",
    "prior_domains": f"""WITH {_REC}, h AS (SELECT doc_id, {Q.haystack("question || chr(10) || answer")} AS hay, [{", ".join(Q.arr(v) for v in L.SITE_PRIORS.values())}, []::VARCHAR[]][doc_id % {len(L.SITE_PRIORS) + 1} + 1] AS sp,
  list_concat({", ".join(f"CASE WHEN contains(lower(coalesce(source, '')), {Q.lit(k)}) THEN {Q.arr(v)} ELSE []::VARCHAR[] END" for k, v in L.PROMPT_PRIORS.items())}) AS pp FROM rec),
b AS (SELECT doc_id, {_prior('sp', 1.0)} AS s, {_prior('pp', 3.0)} AS p FROM h)
SELECT doc_id, CASE WHEN s.score >= 3 THEN s.domain END AS by_site, CASE WHEN p.score >= 3 THEN p.domain END AS by_prompt FROM b""",
    "training_examples": f"WITH {_SHAPED} SELECT doc_id, shape, e AS example, md5(u) AS user, md5(a) AS assistant, coalesce(reason, 'kept') AS reason FROM er",
    "example_counts": f"WITH {_SHAPED} SELECT shape, coalesce(reason, 'kept') AS reason, count(*) AS n FROM er GROUP BY 1, 2",
    "unique_examples": f"""WITH {_SHAPED}, k AS (SELECT *, row_number() OVER (PARTITION BY lower(u), lower(a) ORDER BY doc_id, e) AS r FROM er WHERE reason IS NULL)
SELECT e AS example, count(*) AS n, min(doc_id) AS first FROM k WHERE r = 1 GROUP BY 1""",
    "cut_answers": f"""WITH c AS (SELECT conv_id, turn, text, least({", ".join(f"nullif(strpos(text, {Q.lit(m) if m != chr(10) else 'chr(10)'}), 0)" for m in MARKS)}) AS p FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN p IS NULL THEN text ELSE left(text, p - 1) END) AS text, p IS NOT NULL AS cut FROM c""",
    "nested_settings": "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, props::JSON ->> '$.k.deeper' AS deeper FROM events",
    "shuffled_splits": f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_HASH('doc_id')}, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k < floor(n * 0.8::DOUBLE) THEN 'train' WHEN k < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r""",
    "task_sample": f"""WITH h AS (SELECT doc_id, source, {_HASH('doc_id')} AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS k, count(*) OVER (PARTITION BY source) AS m, count(*) OVER () AS n FROM h)
SELECT doc_id, source FROM r WHERE k <= greatest(1, round_even(60.0::DOUBLE * m / n, 0)) ORDER BY h, doc_id LIMIT 60""",
    "tracks_inferred": f"""WITH p AS (SELECT p_partkey, ['', 'react', 'UI/UX', 'swe', 'Data Science', 'unknown', 'hr'][p_partkey % 7 + 1] AS asked,
  (['python', 'sql', 'react', 'docker', 'linux', 'html/css'])[p_partkey % 5 + 1 : p_partkey % 5 + p_size % 3] AS have FROM part), t AS (SELECT *, {_TRACK} AS track FROM p),
b AS (SELECT *, list_max([{", ".join(f"{{'n': len(list_intersect({Q.arr([s.lower() for s in v[1]])}, have)), 'i': {-i}, 'k': {Q.lit(k)}}}" for i, (k, v) in enumerate(L.TRACKS.items()))}]) AS best FROM t)
SELECT p_partkey, track, CASE WHEN asked <> '' AND track <> {Q.lit(L.DEFAULT_TRACK)} THEN track WHEN best.n > 0 THEN best.k ELSE track END AS inferred FROM b""",
    "plan_slots": """WITH p AS (SELECT p_partkey, p_size, greatest(4, least(20, p_size)) AS t, [0, 1, 2, 1][p_partkey % 4 + 1] AS e FROM part),
q AS (SELECT *, greatest(1, least(3, round_even(t * 0.28::DOUBLE, 0))) AS cv, CASE WHEN t >= 10 THEN 2 ELSE 1 END AS b FROM p), r AS (SELECT *, greatest(1, t - 2 - cv - b) AS n FROM q)
SELECT p_partkey, t::INT AS total, cv::INT AS cv, b::INT AS behavioural, n::INT AS technical,
array_to_string(list_transform(range(0, n::BIGINT), lambda i: ['Beginner', 'Intermediate', 'Advanced'][least(2, e + i // 2) + 1]), ',') AS ladder, greatest(4, least(16, floor(p_size * 60 / 180 + 0.5::DOUBLE)))::INT AS planned FROM r""",
}
