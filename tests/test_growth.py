"""Work that once grew faster than its tables."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parley.operators import corpus, cv, evaluation, history, planning, qualifications, retrieval
from parley.plans import corpus as plans

RECORD = "qid long, question string, domain string, difficulty string, source string"
PROFILE = "profile_id long, technologies array<string>, skills array<string>, experience array<string>, education array<string>, certifications array<string>, projects array<string>, role string, years double, track string, difficulty string, total int"


def test_profiles_that_are_alike_are_planned_once(spark, monkeypatch):
    pool = planning.question_pool(spark.createDataFrame([(i, f"What is an index in a table of kind{i} rows?", "SQL", "Beginner", "x") for i in range(9)], RECORD), "qid")
    profiles = spark.createDataFrame([(i, ["sql"], ["index"], [], ["x"], [], [], None, 1.0, "", "easy", 8 if i < 8 else 9) for i in range(10)], PROFILE)
    asked, top = [], retrieval.top_in_blocks
    monkeypatch.setattr(retrieval, "top_in_blocks", lambda q, *rest: asked.append(q.select("id").distinct().count()) or top(q, *rest))
    plans = {r["profile_id"]: r["questions"] for r in planning.build_plans(profiles, pool).collect()}
    assert plans.keys() == set(range(10)) and all(plans[i] == plans[0] for i in range(8)) and plans[8] == plans[9]
    now = spark.createDataFrame([(i, "What is a join?", "Intermediate") for i in range(10)], "profile_id long, text string, difficulty string")
    had = spark.createDataFrame([(9, "What is an index in a table of kind0 rows?")], "profile_id long, text string")
    easier = {r["profile_id"]: r["qid"] for r in planning.easier_questions(profiles, now, had, pool).collect()}
    assert easier == {i: 0 for i in range(9)} | {9: 1}
    # two plans of at most three levels in two tiers; two sets of questions before
    assert asked[0] <= 2 * 3 * 2 and asked[1] == 2


def test_plans_with_one_query_and_track_share_their_candidates(spark, monkeypatch):
    pool = planning.question_pool(spark.createDataFrame([(i, f"What is an index in a table of kind{i} rows?", "SQL", planning.L.DIFFICULTIES[i % 3], "x") for i in range(30)], RECORD), "qid")
    rows = [(i, ["sql"], ["index"], [], ["x"], [], [], None, i % 5 + 0.5, "", ["easy", "medium", "hard", "odd"][i % 4], 6 + i) for i in range(12)]
    asked, top = [], retrieval.top_in_blocks
    monkeypatch.setattr(retrieval, "top_in_blocks", lambda q, *rest: asked.append(q.select("id").distinct().count()) or top(q, *rest))
    plan = lambda some: {r["profile_id"]: r["questions"] for r in planning.build_plans(spark.createDataFrame(some, PROFILE), pool).collect()}
    plans = plan(rows)
    # one query and track, whatever the ladders: three levels in two tiers
    assert asked == [3 * 2] and plans.keys() == set(range(12))
    assert {3: plans[3]} == plan(rows[3:4]) and {10: plans[10]} == plan(rows[10:11]) and plans[3] != plans[10]


def test_blocks_meet_in_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 5)
    rows = spark.createDataFrame([(i, f"t{i % 3}", 1.0) for i in range(20)], "id long, term string, weight double")
    hits = retrieval.top_in_blocks(retrieval.sparse(rows), retrieval.sparse(rows), 2)
    assert "REPARTITION_BY_NUM" in hits._jdf.queryExecution().toString()
    assert sorted((r["query"], r["place"], r["id"]) for r in hits.collect()) == [(q, p + 1, q % 3 + 3 * p) for q in range(20) for p in (0, 1)]


def test_only_the_rarest_tokens_of_a_set_meet(spark):
    luck = random.Random(3)
    families = [[f"w{luck.randrange(300)}" for _ in range(luck.choice([4, 9, 12, 40, 90]))] for _ in range(40)]
    rows = []
    for i in range(400):
        words = list(families[i % 40])
        for _ in range(luck.randrange(6)):
            words[luck.randrange(len(words))] = f"w{luck.randrange(300)}"
        rows.append((i, luck.choice(["train", "train", "validation", "test"]), " ".join(words)))
    docs = spark.createDataFrame(rows, "id long, split string, text string")
    got = {r["pair"]: r["n"] for r in corpus.leaked(docs.select("split", corpus.token_set_key(F.col("text")).alias("k")), "k", docs, "text").collect()}
    sets = [(split, set(text.split())) for _, split, text in rows]
    near = lambda x, y: len(x & y) >= 3 and len(x & y) / len(x | y) >= 0.9
    want = {f"{a}->{b}": sum(t == b and any(s == a and near(x, y) for s, x in sets) for t, y in sets) for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))}
    assert got == want and min(want.values()) > 5
    # a set of a hundred tokens sends eleven
    batch = pa.RecordBatch.from_pydict({"k": [b"x"], "one": [True], "two": [True], "hashes": [list(range(1, 101))]})
    assert [b.num_rows for b in corpus._rarest(np.zeros(corpus.RANGES, dtype=np.int64), 0.9)([batch])] == [11]


def test_texts_of_a_small_file_are_read_by_all_cores(spark):
    cvs = spark.createDataFrame([(i, "Ann Lee\nSkills\nSQL\none two three four five\nWork Experience\nA role here") for i in range(50)], "id long, text string").coalesce(1)
    lines = cv.lines(cvs, "id", "text")
    assert "REPARTITION_BY_NUM" in lines._jdf.queryExecution().toString()
    got = {(r["line"], r["section"]) for r in lines.filter("id = 7").collect()}
    assert got == {("Ann Lee", "header"), ("SQL", "skills"), ("one two three four five", "skills"), ("A role here", "experience")}
    # nothing is dealt out once more by key
    assert lines.groupBy("id").count()._jdf.queryExecution().toString().split("Physical Plan")[-1].count("Exchange") == 1


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dear_steps_are_taken_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", "a b d"), (2, "", "x")], "id long, text string, next string").write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    rows = evaluation.proxy_rouge(pairs, F.col("text"), F.col("next"))
    assert {r["id"]: (round(r["rouge1"], 6), round(r["rouge2"], 6)) for r in rows.collect()} == {1: (0.666667, 0.5), 2: (0.0, 0.0)}
    assert _optimized(rows).count("lower(") == 2
    spark.createDataFrame([(1, "<p>a  b</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert _optimized(plans.page_clean_text(spark, str(tmp_path))).count("```") == 2  # both in one pattern


def test_pairs_are_ranked_without_their_lists(spark):
    people = spark.createDataFrame([(1, ["a", "B"], 70), (2, [], 90)], "id long, skills array<string>, overall int")
    jobs = spark.createDataFrame([(1, ["b", "c"], "Junior"), (2, ["x"], "Senior")], "job_id long, wanted array<string>, seniority string")
    best = history.match_jobs(people, jobs, 1)
    assert {r["id"]: (r["job_id"], r["missing"], r["place"]) for r in best.collect()} == {1: (1, ["c"], 1), 2: (2, ["x"], 1)}
    ranked = _optimized(best).split("Window [row_number()")[1].split("Join")[0]
    assert "score" in ranked and "skills" not in ranked and "wanted" not in ranked


def test_lines_about_education_are_read_before_they_are_gathered(spark, tmp_path):
    rows = [(1, 0, "B.Sc. in Physics", "education"), (1, 1, "University of Colombo, 2012 - 2016", "education"), (1, 2, "Java", "skills")]
    spark.createDataFrame(rows, "id long, line_no long, line string, section string").write.parquet(f"{tmp_path}/lines")
    found = qualifications.education(spark.read.parquet(f"{tmp_path}/lines"), "id")
    assert [(r["place"], r["institution"], r["year"]) for r in found.collect()] == [(1, "University of Colombo", 2016)]
    # no pattern is left above the gathering but those that tidy a label
    above = _optimized(found).split("Aggregate [")[0]
    assert "regexp_extract" not in above


def test_documents_that_cannot_be_among_the_best_send_no_terms(spark, monkeypatch):
    luck = random.Random(5)
    some = [(i % 90, " ".join(f"w{min(int(luck.expovariate(0.03)), 400)}" for _ in range(luck.choice([0, 1, 5, 30, 80])))) for i in range(120)]
    copies = [(500 + i, "w1 w2 w3 w700 w1 w2") for i in range(9)]
    docs = spark.createDataFrame(some + copies + [(900, None)], "id long, text string")
    items = spark.createDataFrame([(0, "w1 w2 w3"), (1, "w5 w90 w5"), (2, "nothing known"), (3, None), (4, some[3][1]), (5, "w700")], "item long, text string")
    counts = retrieval.term_counts(docs, "id", "text")
    idfs = retrieval.idf(counts, docs.count())
    near = lambda df: {(r["query"], r["place"]): (r["id"], round(r["score"], 9)) for r in df.collect()}
    want = near(retrieval.top_by_terms(retrieval.weigh(retrieval.term_counts(items, "item", "text"), idfs), retrieval.weigh(counts, idfs), 5))
    of, count = [], retrieval.term_counts
    monkeypatch.setattr(retrieval, "term_counts", lambda df, *rest, **named: of.append(df.count()) or count(df, *rest, **named))
    for name, value in (("SUMS", retrieval.SUMS), ("SUMS", 1), ("SENT", 0), ("BLOCK", 40)):
        monkeypatch.setattr(retrieval, name, value)
        assert near(retrieval.top_texts(items, "item", "text", docs, "id", "text", 5)) == want
    assert of == [6] * 4 and len(want) > 15
    # the plan of the query counts terms of its items only
    from parley.plans import analytics

    of.clear()
    analytics.tfidf_topk(spark, "/root/testdata/sf0.001")
    assert of == [spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()]


def test_lists_of_responses_are_read_once(spark):
    from parley.operators import normalise

    bodies = ['{"a": ["x", 1, null]}', '{"a": "[1]"}', '{"a": {"b": 1}}', '{"a": 3, "b": ["y"]}', '{"a": null}', '{"a": [], "b": ["z"]}', "{}"]
    v = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id long, body string").select("id", F.try_parse_json("body").alias("v"))
    a, b = (normalise.strings(F.col("v"), f"$.{c}") for c in "ab")
    got = v.select("id", normalise.first_filled(a, b).alias("x"), F.size(normalise.elements(F.col("v"), "$.a")).alias("n"))
    assert [(r["x"], r["n"]) for r in got.orderBy("id").collect()] == [(["x"], 3), ([], None), ([], None), (["y"], None), ([], None), (["z"], 0), ([], None)]
    # one look at each of both lists
    plan = v.select(normalise.first_filled(a, b).alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("$.a") == plan.count("$.b") == 1


def _sent(monkeypatch):
    """How many rows of queries each search sends to its blocks."""
    sent, meet = [], retrieval._meetings
    monkeypatch.setattr(retrieval, "_meetings", lambda q, *rest: sent.append(q.count()) or meet(q, *rest))
    return sent


def test_a_query_is_sent_and_scored_once_whatever_was_asked_before(spark, monkeypatch):
    pool = planning.question_pool(spark.createDataFrame([(i, f"What is an index in a table of kind{i} rows?", "SQL", "Beginner", "x") for i in range(9)], RECORD), "qid")
    profiles = spark.createDataFrame([(i, ["sql"], ["index"], [], ["x"], [], [], None, 1.0, "", "easy", 8) for i in range(6)], PROFILE)
    now = spark.createDataFrame([(i, "What is a join?", "Intermediate") for i in range(6)], "profile_id long, text string, difficulty string")
    had = spark.createDataFrame([(i, f"What is an index in a table of kind{j} rows?") for i in range(6) for j in range(i)], "profile_id long, text string")
    sent = _sent(monkeypatch)
    assert {r["profile_id"]: r["qid"] for r in planning.easier_questions(profiles, now, had, pool).collect()} == {i: i for i in range(6)}
    assert sent == [1]


def test_a_question_is_rated_once(spark):
    rows = [(i, f"What is an index in a table of kind{i % 3} rows?", "SQL", "Beginner", "x" if i < 12 else "interviews") for i in range(15)]
    pool = planning.question_pool(spark.createDataFrame(rows, RECORD), "qid")
    assert sorted(r["qid"] for r in pool.collect()) == [0, 1, 2]
    # no rating below the step that takes the first
    assert "rlike" not in _optimized(pool.unpersist()).lower().split("window")[-1]


def test_plans_send_a_query_once_and_are_made_once(spark, monkeypatch):
    from parley.plans import interviews

    pool = planning.question_pool(spark.createDataFrame([(i, f"What is an index in a table of kind{i} rows?", "SQL", planning.L.DIFFICULTIES[i % 3], "x") for i in range(30)], RECORD), "qid")
    rows = [(i, ["sql"], ["index"], [], ["x"], [], [], None, i % 5 + 0.5, "", ["easy", "medium", "hard", "odd"][i % 4], 6 + i) for i in range(12)]
    sent = _sent(monkeypatch)
    assert planning.build_plans(spark.createDataFrame(rows, PROFILE), pool).count() == 12 and sent == [1]
    assert _optimized(interviews.interview_plans(spark, "/root/testdata/sf0.001")).count("aggregate(") == 1
