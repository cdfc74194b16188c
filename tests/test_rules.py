"""Values at the thresholds of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import corpus as C
from parley.operators import cv, history, scoring, sessions
from parley.operators import evaluation as E
from parley.streaming import events as V


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_reject_reasons(spark):
    cases = {
        None: "empty", "": "empty", "  ": "empty", "what is a tr": "too_short", "what is a tree": "too_short", "what is a tree?": None, "what " + "x " * 107 + "y": None, "what " + "x " * 107 + "yz": "too_long",
        "whatisthisthingcalled now": "too_few_words", "tell me about trees": "not_a_question", "why is my code slow": "non_interview_content", "what 1234567890 12345 + 1234": "corrupted",
    }
    assert column(spark, list(cases), T.reject_reason) == list(cases.values())


def test_clean_text(spark):
    assert column(spark, ["a <b>x</b> &amp; y", "```code```z", "[t](http://u) http://v w", "# h\n> q\n\n\n\n*e*_m", None], T.clean_text) == ["a x & y", "z", "t w", "h\nq\n\nem", ""]


def test_pace(spark):
    got = column(spark, [109.0, 110.0, 160.0, 161.0, 10.0], scoring.pace, "double")
    assert got == pytest.approx([98.6, 100, 100, 98.9, 20])
    got = column(spark, [0.0, 79.0, 80.0, 119.0, 120.0, 160.0, 161.0, 200.0, 201.0], scoring.speaking_speed, "double")
    assert got == pytest.approx([50, 54.3125, 55, 79.375, 80, 100, 99.25, 70, 20])


def test_intents(spark):
    cases = {None: "silent", "": "silent", "pass": "dont_know", "yes": "thin", "recursion": "thin", "I really don't know that": "dont_know", "could you clarify the term": "clarify", "a b c d e f": "thin", "a b c d e f g": "thin", " ".join("abcdefghijklmno"): "substantive", "w " * 35: "substantive"}
    assert column(spark, list(cases), scoring.intent) == list(cases.values())


def test_levels(spark):
    rows = spark.createDataFrame([(77.9, 9), (78.0, 3), (78.0, 4), (61.9, 9), (62.0, 1), (62.0, 2)], "s double, n int")
    assert [r[0] for r in rows.select(sessions.level(F.col("s"), F.col("n"))).collect()] == ["INTERMEDIATE", "INTERMEDIATE", "ADVANCED", "BEGINNER", "BEGINNER", "INTERMEDIATE"]


def test_trend_needs_three_scored_answers(spark):
    rows = [("a", i, v, False, 5, 0.0, 0, False, False) for i, v in enumerate([80.0, None, 60.0])] + [("b", i, v, False, 5, 0.0, 0, False, False) for i, v in enumerate([80.0, 70.0, 60.0])]
    df = spark.createDataFrame(rows, "s string, t int, technical double, skipped boolean, word_count int, filler_rate double, hedge_count int, concrete boolean, structured boolean")
    got = {r["s"]: r["trend"] for r in sessions.aggregate(df, "s", "t").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(-10)


def test_seniority(spark):
    assert column(spark, [None, 0.9, 1.0, 3.0, 6.0, 10.0], cv.seniority, "double") == ["unknown", "entry", "junior", "mid", "senior", "principal"]


def test_band_fit(spark):
    rows = spark.createDataFrame([(64, "junior"), (65, "Junior dev"), (80, "lead"), (79, "senior"), (84, "mid"), (85, "mid"), (10, None)], "o int, s string")
    assert [r[0] for r in rows.select(history.band_fit(F.col("o"), F.col("s"))).collect()] == [1.0, 0.6, 1.0, 0.4, 1.0, 0.55, 0.6]


def test_intervals_against_a_set(spark):
    rng = random.Random(1)
    rows = [(k, s, s + rng.randrange(5)) for k in range(20) for s in (rng.randrange(60) for _ in range(rng.randrange(1, 12)))]
    df = spark.createDataFrame(rows, "k int, s int, e int")
    got = {r["k"]: r["covered"] for r in history.covered(history.merge_intervals(df, "k", "s", "e"), "k").collect()}
    want = {k: len({m for q, s, e in rows if q == k for m in range(s, e + 1)}) for k in {r[0] for r in rows}}
    assert got == want


def test_prefix_filter_loses_no_pair(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(3, 12)))) for i in range(120)]
    df = spark.createDataFrame(texts, "id int, t string")
    got = {(r["a"], r["b"]) for r in C.similar_pairs(df, df, "id", "id", "t", "t", 0.6).collect()}
    sets = {i: set(t.split()) for i, t in texts}
    want = {(a, b) for a in sets for b in sets if len(sets[a]) >= 3 and len(sets[b]) >= 3 and len(sets[a] & sets[b]) >= 3 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert got == want


def test_metrics_of_equal_texts(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b", "c d"), (3, "", "x")], "id int, p string, r string")
    rouge = {r["id"]: (r["rouge1"], r["rouge2"]) for r in E.rouge_n(df, "id", E.word_tokens(F.col("p")), E.word_tokens(F.col("r"))).collect()}
    assert rouge == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    assert [r[0] for r in df.orderBy("id").select(E.rouge_l(F.col("p"), F.col("r"))).collect()] == [1.0, 0.0, 0.0]
    one = df.filter("id = 1")
    assert E.corpus_bleu(one, "id", E.tokens_13a(F.col("p")), E.tokens_13a(F.col("r"))).first()["bleu"] == pytest.approx(1.0)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.withColumn("ts", F.col("ts").cast("timestamp")).repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    live = V.windowed(spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in")), "ts", "value", "event_type", "6 hours")
    query = live.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda rows: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 4)) for r in rows)
    assert key(spark.table("windows").collect()) == key(V.windowed(stored, "ts", "value", "event_type", "6 hours").collect())


CV = (
    "NIMAL PERERA\nnimal.perera@mail.example\nSummary\n5+ years of experience with C++ and JavaScript\nExperience\nSenior Software Engineer at Acme\nJan 2020 - Mar 2021\n"
    "Web Developer, Bolt 2018 - 2018 using Docker and React.js\nweb developer\nSkills\nPython, SQL, oop\nProjects\nA REST API in Django"
)


def test_skills_by_section(spark):
    rows = cv.lines(spark.createDataFrame([(1, CV), (2, ""), (3, "java script only")], "id int, t string"), "id", "t")
    got = {r["id"]: r for r in cv.skills(cv.zones(rows, "id"), "id").collect()}
    assert got[1]["technologies"] == ["Python", "JavaScript", "React", "Django", "SQL", "REST API", "Docker"] and got[1]["concepts"] == ["Object-Oriented Programming (OOP)"]
    assert got[1]["demonstrated"] == ["React", "Django", "REST API", "Docker"] and got[1]["evidence"]["Python"] == ["skills"] and got[1]["evidence"]["JavaScript"] == ["summary"]
    assert 2 not in got and got[3]["technologies"] == []


def test_years_claimed_and_dated(spark):
    assert column(spark, [CV, "3 yrs professional experience, 12 years of experience", "60 years of experience", "none", None], cv.declared_years) == [5, 12, None, None, None]
    df = spark.createDataFrame([(14, 5), (80, 5), (None, 2), (0, None), (7, None)], "m int, d int")
    assert [r[0] for r in df.select(cv.total_years(F.col("m"), F.col("d"))).collect()] == [5.0, 6.7, 2.0, None, 0.6]


def test_names(spark):
    rows = [(["NIMAL PERERA", "x"], None), (["Curriculum Vitae", "Ann Smith"], None), (["12 Main Street"], "ann.other7@mail.example"), (["x"], "solo@mail.example")]
    df = spark.createDataFrame(rows, "h array<string>, e string")
    assert [r[0] for r in df.select(cv.name_of(F.col("h"), F.col("e"))).collect()] == ["Nimal Perera", "Ann Smith", "Ann Other", None]


def test_roles_take_the_dates_below_them(spark):
    rows = cv.lines(spark.createDataFrame([(1, CV), (2, "Experience\n2019 - 2020\nQA Engineer")], "id int, t string"), "id", "t")
    got = sorted((r["id"], r["place"], r["title"], r["months"]) for r in cv.roles(rows, "id", (2024, 6)).collect())
    assert got == [(1, 1, "Senior Software Engineer", 15), (1, 2, "Web Developer", 12), (2, 1, "Qa Engineer", None)]


def test_word_errors_against_a_table(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randrange(0, 90))), " ".join(rng.choices("abcde", k=rng.randrange(1, 90)))) for i in range(60)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    want = sum(edits(a.split(), b.split()) for _, a, b in rows) / sum(len(b.split()) for _, _, b in rows)
    got = E.word_error_rate(spark.createDataFrame(rows, "id int, p string, r string"), F.col("p"), F.col("r")).first()["wer"]
    assert got == pytest.approx(want)


def test_runs_that_differ_do_not_compare(spark):
    a, b = (spark.createDataFrame([(7, x)], "seed int, split string") for x in ("test", None))
    E.require_comparable(E.setting_differences(a, a, ["seed", "split"]))
    with pytest.raises(ValueError, match="split"):
        E.require_comparable(E.setting_differences(a, b, ["seed", "split"]))


def test_python_code_is_parsed(spark):
    from parley.operators import answers

    code = ["def f(x):\n    for i in x:\n        pass\n    return x", "x = 1\ny = 2\nz = 3", "def (", "", "for a in b:\n  for c in d:\n    pass"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(code)], "i int, c string").select("i", answers.code_scores(F.col("c"), F.lit("python")).alias("s")).orderBy("i")
    assert [(r["s"]["score"], r["s"]["complexity"]) for r in df.collect()] == [(82, "O(N)"), (78, "O(1)"), (42, "O(N)"), (0, "N/A"), (78, "O(N^2)")]


def test_thread_takes_the_longest_prose_block(spark):
    from parley.operators import records

    prose = "This explains the matter in words that anyone can read and follow. " * 8
    text = f"A title\nthe body here\n\n{prose} or not?\n\n{prose}\n\nint a;\nint b;\n\n{prose[:450]}"
    assert [tuple(r) for r in column(spark, [text, None], records.thread)] == [("A title", "the body here", prose.strip()), ("", "", "")]


def test_job_matching_against_all_jobs(spark):
    rng = random.Random(11)
    skills = [f"S{i}" for i in range(9)]
    people = [(i, rng.sample(skills, rng.randrange(0, 5)), rng.randrange(40, 100)) for i in range(40)]
    jobs = [(i, [s.lower() for s in rng.sample(skills, rng.randrange(0, 4))], rng.choice(["Junior", "Senior", "", None, "Mid", "Lead dev"])) for i in range(60)]
    got = {(r["id"], r["place"]): (r["job_id"], r["score"], r["missing"]) for r in history.match_jobs(spark.createDataFrame(people, "id int, skills array<string>, overall int"), spark.createDataFrame(jobs, "job_id int, wanted array<string>, seniority string"), 4).collect()}

    def fit(o, s):
        s = (s or "").lower()
        return 0.6 if not s else (1.0 if o < 65 else 0.6) if "junior" in s else (1.0 if o >= 80 else 0.4) if "senior" in s or "lead" in s else 1.0 if 65 <= o < 85 else 0.55

    for i, have, o in people:
        low = {s.lower() for s in have}
        rank = []
        for j, wanted, s in jobs:
            union = len(low | set(wanted))
            rank.append((-int((0.7 * (len(low & set(wanted)) / union if union else 0.0) + 0.3 * fit(o, s)) * 100 + 0.5), j, [w for w in wanted if w not in low]))
        assert [got[i, k + 1] for k in range(4)] == [(j, -x, m) for x, j, m in sorted(rank)[:4]]


def test_exact_quantiles(spark):
    from statistics import quantiles

    rng = random.Random(13)
    values = [rng.choice([0.0, 5.5, rng.random() * 100]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    assert C.exact_quantiles(df, "x", (0.25, 0.5, 0.75), 16) == pytest.approx(quantiles(values, n=4, method="inclusive"))
    assert C.exact_quantiles(df.filter("x > 1e9"), "x", (0.5,)) == [None]
