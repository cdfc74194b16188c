"""Records of collected corpora: fill, shape, unpivot, check, number, split and sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T
from parley.operators.corpus import global_rank

#: Least characters of the two sides of an example.
LEAST_USER, LEAST_ASSISTANT = 8, 8
NONE = "array<string>"


def collapsed(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return T.strip(F.regexp_replace(text, r"\s+", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(T.strip(text) == "", F.lit(True))


def missing(records: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows lack each column (null or blank), in one pass."""
    return records.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(is_blank(F.col(c))).alias("missing")) for c in columns)).alias("r")).select(F.inline("r"))


def filled(records: DataFrame, required: str, defaults: dict[str, str]) -> DataFrame:
    """Rows that have the required column; other blank columns get their default."""
    kept = records.filter(~is_blank(F.col(required)))
    return kept.withColumns({c: F.when(is_blank(F.col(c)), d).otherwise(T.strip(F.col(c))) for c, d in defaults.items()})


def first_of(records: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key, exact after the key's own normalisation; Spark cuts each partition's groups before the shuffle."""
    return records.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def clean_records(records: DataFrame, question: str, order: str, words: int = 3) -> DataFrame:
    """Questions of at least ``words`` words, each once whatever its spacing and case, the first in order."""
    long = records.filter(F.size(T.words(F.coalesce(F.col(question), F.lit("")))) >= words)
    return first_of(long, F.lower(collapsed(F.col(question))), [F.col(order)])


def numbered(records: DataFrame, order: str, pattern: str = "CLEAN_%05d") -> DataFrame:
    """Adds record_id from each row's place in the order, counted from 1; no task sorts the whole table."""
    return global_rank(records, order).withColumn("record_id", F.format_string(pattern, F.col("place") + 1)).drop("place")


def prompt(domain: Column, difficulty: Column, question: Column) -> Column:
    return F.format_string("[DOMAIN: %s] [DIFFICULTY: %s] Question: %s", domain, difficulty, question)


def tidy_question(question: Column) -> Column:
    """On one line, with a question mark and a capital."""
    q = collapsed(question)
    q = F.when(F.endswith(q, F.lit("?")), q).otherwise(F.concat(q, F.lit("?")))
    return F.concat(T.capital(F.left(q, F.lit(1))), F.substring(q, 2, 1 << 30))


def normal_form(question: Column) -> Column:
    """Lower-case letters, digits and spaces only."""
    return F.trim(F.regexp_replace(F.lower(question), "[^a-z0-9 ]", ""))


def coarse_domain(question: Column, answer: Column) -> Column:
    """The first of the coarse domains one of whose terms occurs anywhere."""
    low = F.lower(F.concat(question, F.lit(" "), answer))
    return F.coalesce(*(F.when(T.contains_any(low, terms), name) for name, terms in L.COARSE_DOMAINS.items()), F.lit(L.COARSE_OTHER))


def coarse_difficulty(question: Column, answer: Column) -> Column:
    n, m, low = F.size(T.words(question)), F.size(T.words(answer)), F.lower(F.concat(question, F.lit(" "), answer))
    return F.when((n > 25) | (m > 80) | T.contains_any(low, L.COARSE_ADVANCED), "Advanced").when((n > 12) | (m > 35) | T.contains_any(low, L.COARSE_INTERMEDIATE), "Intermediate").otherwise("Beginner")


def thread(text: Column, least: int = L.MIN_ANSWER_CHARS) -> Column:
    """(title, body, answer) of a flattened thread of blocks: the answer is the longest later block that reads as prose and asks nothing, the first of equals."""
    blocks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), T.strip), lambda b: b != "")
    head = F.coalesce(F.get(blocks, F.lit(0)), F.lit(""))
    rest = F.filter(F.slice(blocks, 2, 1 << 30), lambda b: ~F.endswith(b, F.lit("?")) & (F.length(b) >= least) & T.is_prose(b))
    best = F.aggregate(rest, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    title = F.substring_index(head, "\n", 1)
    return F.struct(T.strip(title).alias("title"), T.strip(F.substring(head, F.length(title) + 2, F.lit(1 << 30))).alias("body"), best.alias("answer"))


def request(difficulty: Column, topic: Column) -> Column:
    """The turn that asks for a question, from the fields a record has."""
    level = F.when(is_blank(difficulty), "").otherwise(F.concat(F.lit(" "), F.lower(T.strip(difficulty))))
    about = F.when(is_blank(topic), "").otherwise(F.concat(F.lit(" about "), T.strip(topic)))
    return F.concat(F.lit("Ask me a"), level, F.lit(" software engineering interview question"), about, F.lit("."))


def examples(records: DataFrame, key: str, kind: str = "kind", task: str = "both") -> DataFrame:
    """(key, shape, user, assistant, kind, reason): one or two examples of each record, by its shape; ``reason`` says why one can't be used.

    ``records`` has the record's ``kind`` (its shape) and the columns instruction,
    input, output, prompt, completion, question, answer, text, difficulty, topic,
    null where a record has none. Every assistant turn is text of the record.
    """
    c = {k: T.strip(F.coalesce(F.col(k), F.lit(""))) for k in ("instruction", "input", "output", "prompt", "completion", "question", "answer", "text")}
    both = F.when(c["input"] != "", F.concat(c["instruction"], F.lit("\n"), c["input"])).otherwise(c["instruction"])
    pair = lambda u, a, name: F.struct(u.alias("user"), a.alias("assistant"), F.lit(name).alias("example"))
    ask = task in ("question_generation", "both")
    say = task in ("answer", "both")
    none = F.array().cast("array<struct<user:string,assistant:string,example:string>>")
    generation = lambda u, a: F.array(pair(u, a, "question_generation")) if ask else none
    answer = lambda u, a: F.array(pair(u, a, "answer")) if say else none
    asked = F.when(c["question"] != "", c["question"]).otherwise(c["output"])
    made = (
        F.when(F.col(kind) == "prompt_completion", F.array(pair(c["prompt"], c["completion"], "prompt_completion")))
        .when(F.col(kind) == "instruction_io", F.concat(generation(both, c["output"]), answer(asked, c["answer"])))
        .when(F.col(kind).isin("question_answer", "question_only"), F.concat(generation(request(F.col("difficulty"), F.col("topic")), c["question"]), answer(c["question"], c["answer"])))
        .when(F.col(kind) == "raw_text", F.array(pair(F.lit(""), c["text"], "raw_text"))).otherwise(none)
    )
    usable = F.filter(made, lambda e: (e["assistant"] != "") & ((e["user"] != "") | (e["example"] == "raw_text")))
    missing_ = F.array(F.struct(F.lit("").alias("user"), F.lit("").alias("assistant"), F.lit("none").alias("example")))
    rows = records.select(key, F.col(kind).alias("shape"), F.explode(F.when(F.size(usable) > 0, usable).otherwise(missing_)).alias("e")).select(key, "shape", "e.*")
    raw = F.col("example") == "raw_text"
    reason = (
        F.when(F.col("shape") == "unknown", "unrecognised_schema").when(F.col("example") == "none", F.concat(F.lit("no_usable_pair_"), F.col("shape")))
        .when(raw & (F.length("assistant") < LEAST_ASSISTANT), "empty_text").when(~raw & (F.length("user") < LEAST_USER), "user_turn_too_short")
        .when(F.length("assistant") < LEAST_ASSISTANT, "assistant_turn_too_short")
    )
    return rows.withColumn("reason", reason)


def cut_at(text: Column, marks: list[str]) -> Column:
    """(text, cut): up to the first of the marks."""
    places = F.filter(F.array(*(F.locate(m, text) for m in marks)), lambda p: p > 0)
    cut = F.size(places) > 0
    return F.struct(F.when(cut, F.left(text, F.array_min(places) - 1)).otherwise(text).alias("text"), cut.alias("cut"))


def place_of_hash(key: Column, seed: int) -> Column:
    """A whole number of 48 bits by which rows are shuffled, the same everywhere."""
    return F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), F.lit(12)), 16, 10).cast("long")


def shuffled_split(records: DataFrame, key: str, seed: int = 42, ratios: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """Adds split over all rows alike: the first ``int(n * 0.8)`` in shuffled order train, the next ``int(n * 0.1)`` validate, the rest tests."""
    n = records.count()
    train, validation = int(n * ratios[0]), int(n * ratios[1])
    ranked = global_rank(records.withColumn("_h", place_of_hash(F.col(key), seed)), "_h", (key,))
    split = F.when(F.col("place") < train, "train").when(F.col("place") < train + validation, "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("_h", "place")


def subsample(examples_: DataFrame, task: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows at most, each task by its share (at least one, halves to even), drawn by hash; all rows if there are no more than ``n``.

    The feature is a small sample: only quotas, never whole tasks, are ranked past each partition.
    """
    total = examples_.count()
    if n >= total:
        return examples_
    sizes = examples_.groupBy(F.col(task).alias("_task")).agg(F.count("*").alias("_n")).hint("broadcast")
    rows = examples_.withColumn("_h", place_of_hash(F.col(key), seed))
    rank = F.row_number().over(Window.partitionBy(task).orderBy("_h", key))
    rows = rows.withColumn("_r", rank).filter(F.col("_r") <= n).join(sizes, F.col(task).eqNullSafe(F.col("_task")))
    picked = rows.filter(F.col("_r") <= F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_n") / total)))
    return picked.orderBy("_h", key).limit(n).drop("_h", "_r", "_task", "_n")


def tags(value: Column) -> Column:
    """Parts of a comma-separated text, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), T.strip), lambda x: x != "")


def listed(items: Column) -> Column:
    """Items as "a, b and c"; blanks don't count."""
    some = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    n = F.size(some)
    return F.when(n <= 1, F.array_join(some, "")).otherwise(F.concat(F.array_join(F.slice(some, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.try_element_at(some, F.lit(-1))))


def distinct_by_start(items: Column, chars: int = 50) -> Column:
    """Items whose first characters, whatever their case, no earlier one has; in order. Sorted twice, so long lists cost little more than short ones."""
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.left(F.lower(x), F.lit(chars)).alias("key"), i.alias("i"), x.alias("x"))))
    firsts = lambda s: F.filter(s, lambda r, j: (j == 0) | ~r["key"].eqNullSafe(F.get(s, j - 1)["key"]))
    kept = F.transform(F.array(keyed), lambda s: F.array_sort(F.transform(firsts(s), lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x")))))[0]
    return F.transform(kept, lambda r: r["x"])


def slug(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def track_of(name: Column) -> Column:
    """A track's id from its id, label or alias; the default for anything else."""
    key = F.regexp_replace(F.lower(T.strip(F.coalesce(name, F.lit("")))), "[ -]", "_")
    label = F.lower(T.strip(F.coalesce(name, F.lit(""))))
    return F.coalesce(
        F.when(key.isin(list(L.TRACKS)), key), *(F.when(key == k, v) for k, v in L.TRACK_ALIASES.items()), *(F.when(label == v[0].lower(), k) for k, v in L.TRACKS.items()), F.lit(L.DEFAULT_TRACK),
    )


def infer_track(have: Column, requested: Column) -> Column:
    """The requested track unless it is the default; else that with most signals among what one has, the first of equals; without any, the requested one."""
    asked = track_of(requested)
    low = F.transform(have, F.lower)
    hits = F.array(*(F.struct(F.size(F.array_intersect(T.strs([s.lower() for s in signals]), low)).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, (_, signals)) in enumerate(L.TRACKS.items())))
    best = F.array_max(hits)
    return F.when(~is_blank(requested) & (asked != L.DEFAULT_TRACK), asked).when(best["n"] > 0, best["k"]).otherwise(asked)


def ladder(difficulty: Column, n: Column) -> Column:
    """Levels of ``n`` questions: from the entry level upwards, a step every two, the highest at last."""
    entry = F.coalesce(*(F.when(F.lower(difficulty) == k, L.DIFFICULTIES.index(v)) for k, v in L.DIFFICULTY_ENTRY.items()), F.lit(1))
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    levels = F.transform(at, lambda i: F.element_at(T.strs(L.DIFFICULTIES), (F.least(F.lit(2), entry + F.floor(i / 2)) + 1).cast("int")))
    return F.when(n > 0, levels).otherwise(F.array().cast(NONE))


def slots(total: Column) -> Column:
    """(total, cv, behavioural, technical): how an interview of 4 to 20 questions is shared out."""
    t = F.greatest(F.lit(4), F.least(F.lit(20), total))
    cv = F.greatest(F.lit(1), F.least(F.lit(3), F.bround(t * 0.28).cast("int")))
    behavioural = F.when(t >= 10, 2).otherwise(1)
    return F.struct(t.alias("total"), cv.alias("cv"), behavioural.alias("behavioural"), F.greatest(F.lit(1), t - 2 - cv - behavioural).alias("technical"))


def planned_questions(seconds: Column) -> Column:
    """Questions for a planned length: one in three minutes, 4 to 16; 20 minutes if none is planned."""
    return F.greatest(F.lit(4), F.least(F.lit(16), F.floor(F.coalesce(seconds, F.lit(1200)) / 180 + 0.5).cast("int")))
