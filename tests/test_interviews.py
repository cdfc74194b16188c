"""Plans, fitted intents, greedy matches, qualifications, normalised responses and positions against plain versions."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.operators import cv, intents, matching, normalise, planning, qualifications, retrieval
from parley.plans import services
from parley.sources import readers

RECORD = "qid long, question string, domain string, difficulty string, source string"
PROFILE = (
    "profile_id long, technologies array<string>, skills array<string>, experience array<string>, education array<string>, certifications array<string>, projects array<string>, role string, years double, track string, difficulty string, total int"
)


def plain_terms(text):
    words = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in L.SCORE_STOP]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_ranking(pool, query, domains, level, exclude, k):
    """The best k of a level in domains (any if none has it), by relevance and quality, as one reads it."""
    docs = [plain_terms(f"{q['question']} {q['domain']}") for q in pool]
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1

    def vector(terms):
        v = {t: (1 + math.log(terms.count(t))) * (math.log((1 + len(pool)) / (1 + df[t])) + 1) for t in set(terms) if t in df}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / n for t, x in v.items()}

    q = vector(plain_terms(query))
    rows = [i for i, p in enumerate(pool) if p["difficulty"] == level and p["domain"] in domains] or [i for i, p in enumerate(pool) if p["difficulty"] == level]
    score = {i: round(0.65 * sum(x * q.get(t, 0) for t, x in vector(docs[i]).items()) + 0.35 * pool[i]["quality"], 9) for i in rows}
    return [pool[i] for i in sorted(rows, key=lambda i: (-score[i], pool[i]["qid"])) if pool[i]["question"].lower() not in exclude][:k]


def plain_plan(pool, outline):
    used, plan = set(), []

    def add(text):
        if text.strip().lower() not in used:
            used.add(text.strip().lower())
            plan.append(text)

    add(L.OPENING[0])
    for q in outline["cv"]:
        add(q["text"])
    for i, level in enumerate(outline["ladder"]):
        got = plain_ranking(pool, outline["query"], L.TRACK_DOMAINS[outline["track_id"]], level, used, planning.NEXT) or plain_ranking(pool, outline["query"], [], level, used, planning.NEXT)
        if got:
            add(got[i % len(got)]["question"])
    for q in outline["behavioural"]:
        add(q)
    add(L.CLOSING[0])
    return plan


def pool_rows(n, seed):
    """Questions with many ties: few words, few levels; some equal but for signs, some unfit."""
    rng = random.Random(seed)
    words = ["python", "sql", "cache", "index", "queue", "react"]
    return [(i, f"What is the {rng.choice(['role', 'cost'])} of a {rng.choice(words)} and a {rng.choice(words)}{rng.choice(['?', '', '!?'])}", rng.choice(["SQL", "OOP", "Security", ""]), rng.choice(L.DIFFICULTIES + [""]), rng.choice(["interviews", "x"])) for i in range(n)]


@pytest.mark.parametrize("n", [6, 60])
def test_plans_against_a_loop(spark, n):
    rng = random.Random(n)
    pool = planning.question_pool(spark.createDataFrame(pool_rows(n, n), RECORD), "qid").persist()
    lists = lambda *v: rng.sample(v, rng.randint(0, len(v)))
    people = [
        (i, lists("Python", "SQL", "React"), lists("SQL", ""), lists("Engineer"), ["B.Sc."], lists("AWS cert"), lists("Chat App", "Shop"), rng.choice(["", None, "Lead"]), rng.choice([None, 0.5, 2.0, 3.5]), rng.choice(["", "ui_ux", "Data Science", "odd"]),
         rng.choice(["easy", "medium", "hard", "odd"]), rng.choice([0, 1, 6, 12, 20, 50]))
        for i in range(25)
    ]
    profiles = spark.createDataFrame([*people, (25, None, None, None, None, None, None, None, None, None, None, None)], PROFILE)
    held = [r.asDict() for r in pool.collect()]
    outlines = {r["profile_id"]: r.asDict(recursive=True) for r in planning.outlined(profiles).collect()}
    got = {r["profile_id"]: [q["text"] for q in r["questions"]] for r in planning.build_plans(profiles, pool).collect()}
    assert got.keys() == outlines.keys() and len(got) == 26
    for k, o in outlines.items():
        assert got[k] == plain_plan(held, o)
    assert n > 6 or any(len(o["ladder"]) + 4 > len(got[k]) for k, o in outlines.items())


def test_a_pool_of_one_level_and_an_empty_one(spark):
    profiles = spark.createDataFrame([(1, ["SQL"], [], [], [], [], [], "", 1.0, "data_science", "easy", 8)], PROFILE)
    one = planning.question_pool(spark.createDataFrame([(1, "What is an index in a table of rows?", "SQL", "Beginner", "x")], RECORD), "qid")
    for pool, n in ((one, 1), (one.limit(0), 0)):
        (r,) = planning.build_plans(profiles, pool).collect()
        assert sum(q["source"] == "dataset" for q in r["questions"]) == n


def test_easier_questions_against_a_loop(spark):
    pool = planning.question_pool(spark.createDataFrame(pool_rows(60, 3), RECORD), "qid").persist()
    held = [r.asDict() for r in pool.collect()]
    profiles = spark.createDataFrame([(i, ["SQL"] if i % 2 else ["Python", "React"], [], [], [], [], [], "", 1.0, ["ui_ux", "data_science", ""][i % 3], "easy", 8) for i in range(12)], PROFILE)
    rng = random.Random(1)
    now = [(i, rng.choice(held)["question"], rng.choice(L.DIFFICULTIES + ["odd"])) for i in range(12)]
    asked = [(i, q["question"].upper()) for i in range(12) for q in rng.sample(held, rng.choice([0, 3, len(held)]))]
    got = {r["profile_id"]: r["question"] for r in planning.easier_questions(profiles, spark.createDataFrame(now, "profile_id long, text string, difficulty string"), spark.createDataFrame(asked, "profile_id long, text string"), pool).collect()}
    outlines = {r["profile_id"]: r for r in planning.outlined(profiles).collect()}
    want = {}
    for i, text, level in now:
        at = L.DIFFICULTIES.index(level) if level in L.DIFFICULTIES else 1
        if at:
            out = {t.lower() for j, t in asked if j == i} | {text.lower()}
            found = plain_ranking(held, outlines[i]["query"], L.TRACK_DOMAINS[outlines[i]["track_id"]], L.DIFFICULTIES[at - 1], out, 1)
            if found:
                want[i] = found[0]["question"]
    assert got == want and 0 < len(want) < 12


def test_blocks_of_texts_give_the_best_of_all(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=4))) for i in range(40)], "id long, text string")
    counts = retrieval.term_counts(docs, "id", "text")
    weights = retrieval.weigh(counts, retrieval.idf(counts, 40)).persist()
    got = {(r["query"], r["place"]): r["id"] for r in retrieval.top_by_terms(weights.filter("id < 9"), weights, 3).collect()}
    rows = {}
    for r in weights.collect():
        rows.setdefault(r["id"], {})[r["term"]] = r["weight"]
    for q in range(9):
        best = sorted(rows, key=lambda d: (-round(sum(w * rows[d].get(t, 0) for t, w in rows[q].items()), 9), d))[:3]
        assert [got[q, k + 1] for k in range(3)] == best


def plain_grams(text):
    return [f" {w} "[i : i + n] for w in text.lower().split() for n in range(2, min(5, len(w) + 2) + 1) for i in range(len(w) + 2 - n + 1)]


def test_fitted_intents_are_the_optimum(spark):
    """The coefficients are where a plain gradient of the same objective vanishes, and what a plain descent finds gives the same probabilities."""
    model = intents.fit_intents(intents.labelled_turns(spark))
    texts = [(t, k) for k, v in L.INTENT_TURNS.items() for t in v]
    vocabulary = sorted({g for t, _ in texts for g in plain_grams(t)})
    assert [g for g, _, _ in model.terms] == vocabulary and model.labels == sorted(L.INTENT_TURNS)
    at, n = {g: i for i, g in enumerate(vocabulary)}, len(texts)
    tf = np.zeros((n, len(vocabulary)))
    for i, (t, _) in enumerate(texts):
        for g in plain_grams(t):
            tf[i, at[g]] += 1
    idf = np.log((1 + n) / (1 + (tf > 0).sum(axis=0))) + 1
    assert np.allclose(idf, [r for _, r, _ in model.terms])
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([model.labels.index(k) for _, k in texts])
    weight = n / (len(model.labels) * np.bincount(y))[y]
    onehot = np.eye(len(model.labels))[y]

    def gradient(w, b):
        z = x @ w.T + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        r = (p - onehot) * weight[:, None]
        return intents.C * r.T @ x + w, intents.C * r.sum(axis=0), p

    w, b = np.array([c for _, _, c in model.terms]).T, np.array(model.intercepts)
    gw, gb, p = gradient(w, b)
    assert np.abs(gw).max() < 1e-3 and np.abs(gb).max() < 1e-3
    v, c = np.zeros_like(w), np.zeros_like(b)
    pv, pc = v, c
    for k in range(4000):
        m = k / (k + 3)
        av, ac = v + m * (v - pv), c + m * (c - pc)
        gv, gc, _ = gradient(av, ac)
        pv, pc, v, c = v, c, av - gv / 60, ac - gc / 400
    assert np.abs(gradient(v, c)[2] - p).max() < 1e-3
    rows = spark.createDataFrame(texts, "text string, label string").withColumn("id", F.monotonically_increasing_id()).drop("label")
    got = {r["text"]: r["p"] for r in intents.probabilities(rows, ["id"], "text", model).join(rows, "id").collect()}
    assert all(np.allclose(got[t], p[i], atol=1e-9) for i, (t, _) in enumerate(texts))


def test_turns_of_middle_length_go_to_the_model(spark):
    model = intents.fit_intents(intents.labelled_turns(spark))
    middle = "we handled the race condition with a lock on the version column"
    rows = spark.createDataFrame([(1, None), (2, "pass"), (3, "i really do not know that one at all sorry"), (4, middle), (5, "xq zzv wwk qqj vvx jjq kkz"), (6, "word " * 40), (7, "it is a framework"), (1, middle)], "id long, text string")
    got = sorted((r["id"], r["intent"], r["rule"]) for r in intents.classified(rows.withColumn("n", F.monotonically_increasing_id()), ["id", "n"], "text", model).collect())
    assert got[:5] == [(1, "silent", "silent"), (1, "substantive", "model"), (2, "dont_know", "single"), (3, "dont_know", "decline"), (4, "substantive", "model")]
    assert got[6:] == [(6, "substantive", "long"), (7, "thin", "short")]
    p = intents.probabilities(rows.filter("id = 5"), ["id"], "text", model).first()["p"]
    assert got[5][2] == ("model" if max(p) >= intents.LEAST else "length")


@pytest.mark.parametrize("block", [1024, 3])
def test_greedy_matches_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    monkeypatch.setattr(matching, "MEETINGS", 2)
    rng = np.random.default_rng(4)
    rows = [(p, bool(rng.integers(2)), rng.normal(size=4).tolist()) for p in ["a", "b", None] for _ in range(11)]
    rows += [("left only", True, [1.0, 0.0, 0.0, 0.0]), ("nulls", True, None), ("nulls", False, [0.0] * 4), *rows[:3]]
    got = {r["pair"]: r for r in matching.greedy_match(spark.createDataFrame(rows, "pair string, cand boolean, v array<double>"), "pair", "cand", "v").collect()}
    assert len(got) == 5
    for p, r in got.items():
        unit = lambda v: np.zeros(4) if v is None or not np.linalg.norm(v) else np.array(v) / np.linalg.norm(v)
        a, b = [unit(v) for q, s, v in rows if q == p and s], [unit(v) for q, s, v in rows if q == p and not s]
        m = np.array([[x @ y for y in b] for x in a])
        want = (m.max(axis=1).mean(), m.max(axis=0).mean()) if a and b else (0, 0)
        assert (r["n_left"], r["n_right"]) == (len(a), len(b)) and np.allclose((r["precision"], r["recall"]), want)


def plain_education(lines):
    """Education entries by a plain loop over the lines, with the library's reading of single lines."""
    out, seen, consumed = [], set(), set()
    for i, x in enumerate(lines):
        if len(x["line"]) < 5 or i in consumed:
            continue
        place = x["here"]
        if place is None and i + 1 < len(lines):
            place = lines[i + 1]["here"]
            if place is not None and x["degree"]:
                consumed.add(i + 1)
        if not (x["degree"] or place):
            continue
        parts = [p for p in (x["degree"], x["field"] and f"in {x['field']}") if p]
        label = " ".join(parts) if parts else (place or x["line"][:70])
        label = f"{label}, {place}" if place and parts else label
        key = re.sub(r"\W+", "", label.lower())
        years = [int(y) for y in re.findall(r"\b(?:19|20)\d{2}\b", " ".join(r["line"] for r in lines[i : i + 2]))]
        if key in seen:
            continue
        if not x["degree"] and place and out and not out[-1][3]:
            out[-1] = (f"{out[-1][0]}, {place}", out[-1][1], out[-1][2], place, max(years) if years else out[-1][4])
            continue
        seen.add(key)
        out.append((re.sub(r"\s{2,}", " ", label).strip(" .,-"), x["degree"], x["field"], place, max(years) if years else None))
    return out[:4]


def test_education_in_any_order_of_lines(spark):
    kinds = [
        "B.Sc. in Physics", "University of Colombo, 2014 - 2018", "the Academy of Arts (2015)", "MBA", "HND", "Diploma in Nets, City College", "NATIONAL COLLEGE", "in 2019 something else", "Bachelor's degree", "Institute of Sums", "M.Sc. from Open University, 2020", "abc",
    ]
    rng = random.Random(6)
    cvs = {k: [rng.choice(kinds) for _ in range(rng.randint(0, 9))] for k in range(150)}
    rows = spark.createDataFrame([(k, i, x, "education") for k, v in cvs.items() for i, x in enumerate(v)], "cv long, line_no int, line string, section string")
    read = spark.createDataFrame([(x,) for x in kinds], "line string").select("line", qualifications.institution(F.col("line")).alias("here"), qualifications.degree_name(qualifications.first_match(F.col("line"), L.DEGREE)).alias("degree"),
                                                                             qualifications.trimmed(qualifications.first_match(F.col("line"), L.FIELD_OF_STUDY), r" .,\-").alias("field"))
    known = {r["line"]: r for r in read.collect()}
    assert known["University of Colombo, 2014 - 2018"]["here"] == "University of Colombo" and known["NATIONAL COLLEGE"]["here"] == "National College" and known["M.Sc. from Open University, 2020"]["degree"] == "M.Sc."
    assert known["the Academy of Arts (2015)"]["here"] == "Academy of Arts" and known["Diploma in Nets, City College"]["field"] == "Nets"
    got = {}
    for r in qualifications.education(rows, "cv").orderBy("cv", "place").collect():
        got.setdefault(r["cv"], []).append(tuple(r)[2:])
    assert got == {k: e for k, v in cvs.items() if (e := plain_education([known[x] for x in v]))}


def test_education_of_many_lines_and_none(spark):
    rows = spark.createDataFrame([(1, i, f"B.Sc. in Subject {i}", "education") for i in range(3000)] + [(2, 0, "Paris", "education"), (3, 0, "MBA, City College", "skills")], "cv long, line_no int, line string, section string")
    assert [(r["cv"], r["place"], r["field"]) for r in qualifications.education(rows, "cv").orderBy("place").collect()] == [(1, k + 1, f"Subject {k}") for k in range(4)]
    assert qualifications.education(rows.limit(0), "cv").count() == qualifications.certifications(rows.limit(0), "cv").count() == 0


def test_employers_and_certificates(spark):
    lines = ["Software Engineer at Ceylon Systems (Pvt) Ltd", "Web Developer, Blue Harbour Labs, 2020", "QA Engineer"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r[0] for r in rows.select(qualifications.organisation(F.col("line"), qualifications.first_match(F.col("line"), L.JOB_TITLE))).collect()]
    assert got == ["Ceylon Systems (Pvt) Ltd", "Blue Harbour Labs", None]
    c = spark.createDataFrame([(1, 0, "AWS Certified Developer; Cisco CCNA", "education"), (1, 1, "A plain course", "certifications"), (1, 2, "aws certified developer", "certifications"), (1, 3, "2020 dates", "certifications")], "cv long, line_no int, line string, section string")
    assert [r["name"] for r in qualifications.certifications(c, "cv").orderBy("place").collect()] == ["A plain course", "aws certified developer", "Cisco CCNA"]


def test_responses_of_any_shape(spark):
    bodies = [None, "", "nope", "3", "[]", "{}", json.dumps({"skills": [["x"], "y", None, {"z": 1}], "yearsTotal": 0, "readinessScore": -0.5, "contact": None, "readinessBreakdown": None}), json.dumps({"yearsTotal": True, "skills": None, "extracted_info": [], "seniority": "", "readinessScore": 1e3})]
    rows = normalise.normalised(spark.createDataFrame(list(enumerate(bodies)), "id long, body string"), "body").orderBy("id").collect()
    assert [r["ok"] for r in rows] == [False] * 5 + [True] * 3
    assert rows[6]["skills"] == ["y"] and rows[6]["years_total"] == 0.0 and rows[6]["readiness"] == 0 and rows[6]["breakdown"] == "{}" and rows[6]["contact_links"] == []
    assert rows[7]["years_total"] is None and rows[7]["skills"] == [] and rows[7]["seniority"] == "" and rows[7]["readiness"] == 1000
    assert all(r["seniority"] == "unknown" and r["years_total"] is None and r["raw_text"] == "" and r["confidence"] == 0 for r in rows[:6])
    assert normalise.normalised(spark.createDataFrame([], "id long, body string"), "body").count() == 0


def test_positions_are_the_same_at_any_partitioning(spark, tmp_path):
    path = str(tmp_path / "rows")
    for k, n in enumerate((700, 1, 0, 299)):
        spark.range(1000 * k, 1000 * k + n).withColumn("_row", F.lit("own")).coalesce(1).write.option("parquet.block.size", 1024).parquet(f"{path}/part={k}")
    found = []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = readers.with_positional_id(spark.read.parquet(path), "interviews")
        found.append(sorted((r["raw_id"], r["id"], r["_row"]) for r in rows.collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and [r[0] for r in found[0]] == [f"interviews-{i:05d}" for i in range(1000)]
    assert [r[1] for r in found[0]] == [*range(700), 1000, *range(3000, 3299)]


def test_headings_give_the_lines_of_education(spark):
    text = "Jo Bloggs\nEDUCATION\nM.B.A. with honours\nCity College, 2019\nSkills\nSQL"
    rows = cv.lines(spark.createDataFrame([(1, text)], "cv long, text string"), "cv", "text")
    (r,) = qualifications.education(rows, "cv").collect()
    assert (r["degree"], r["institution"], r["year"]) == ("MBA", "City College", 2019)


def test_bodies_hold_what_the_queries_say(spark):
    rows = services._bodies(spark, "/root/testdata/sf0.001").orderBy("event_id").limit(5).collect()
    assert [r["body"][0] for r in rows] == ["{", "{", "{", "[", "{"] and "{type}" not in "".join(r["body"] for r in rows)
