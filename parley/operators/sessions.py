"""Conversations to answers, evidence, reports and diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T
from parley.operators import scoring

#: Weight of each metric in the overall score.
WEIGHTS = {"technical": 0.30, "relevance": 0.25, "communication": 0.20, "confidence": 0.13, "fluency": 0.12}


def turn_kind(role: Column) -> Column:
    low = F.lower(role)
    return F.when(low.isin(L.INTERVIEWER_ROLES), "q").when(low.isin(L.CANDIDATE_ROLES), "a")


def first_text(*columns: str) -> Column:
    """The first of several columns that isn't blank, as it is; else an empty text."""
    return F.coalesce(*(F.when(T.strip(F.col(c)) != "", F.col(c)) for c in columns), F.lit(""))


def pair_preceding(turns: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """Each candidate turn with the interviewer turn just before it (else an empty question)."""
    known = turns.withColumn("_kind", turn_kind(F.col(role))).filter("_kind IS NOT NULL")
    w = Window.partitionBy(session).orderBy(order)
    asked = F.when(F.lag("_kind").over(w) == "q", F.lag(text).over(w)).otherwise("")
    return known.withColumn("question", asked).filter("_kind = 'a'").select(session, order, "question", F.col(text).alias("answer"))


def pair_positional(turns: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """The k-th answer of a session with its k-th question (else an empty one); blank turns don't count."""
    known = turns.withColumn("_kind", turn_kind(F.col(role))).filter(F.col("_kind").isNotNull() & (T.strip(F.col(text)) != ""))
    k = F.row_number().over(Window.partitionBy(session, "_kind").orderBy(order))
    rows = known.withColumn("k", k)
    asked = rows.filter("_kind = 'q'").select(session, "k", F.col(text).alias("question"))
    said = rows.filter("_kind = 'a'").select(session, "k", F.col(text).alias("answer"))
    return said.join(asked, [session, "k"], "left").select(session, "k", F.coalesce("question", F.lit("")).alias("question"), "answer")


def evidence(pairs: DataFrame, answer: str = "answer") -> DataFrame:
    """What can be measured in each answer."""
    text = T.strip(F.coalesce(F.col(answer), F.lit("")))
    words, low = T.words(text), F.lower(text)
    n = F.size(words)
    fillers = F.size(F.filter(words, lambda w: F.lower(F.regexp_replace(w, r"^[.,!?]+|[.,!?]+$", "")).isin(L.FILLERS)))
    rows = pairs.withColumns({"intent": scoring.intent(F.col(answer)), "word_count": n, "filler_count": fillers, "hedge_count": T.count_terms(low, L.HEDGES)})
    rows = rows.withColumns(
        {
            "skipped": F.col("intent").isin("dont_know", "silent"),
            "filler_rate": F.when(F.col("word_count") > 0, F.col("filler_count") * 100 / F.col("word_count")).otherwise(0.0),
            "concrete": T.count_phrases(F.col(answer), L.CONCRETE) > 0,
            "structured": T.count_phrases(F.col(answer), L.STRUCTURE) >= 2,
            "technical": scoring.technical(F.col(answer)),
            "communication": scoring.communication(F.col(answer)),
        }
    )
    fluency = F.greatest(F.lit(20.0), F.least(F.lit(100.0), 100 - F.col("filler_rate") * 6))
    rows = rows.withColumn("fluency", fluency)
    return rows.withColumn("confidence", F.greatest(F.lit(20.0), F.least(F.lit(100.0), F.col("communication") * 0.6 + F.col("fluency") * 0.4)))


def concept_coverage(expects: Column, answer: Column) -> Column:
    """Share of expected concepts with a word of four letters or more in the answer; null if none are expected."""
    low = F.lower(answer)
    covered = F.filter(expects, lambda e: F.exists(F.regexp_extract_all(F.lower(e), F.lit("([a-z]{4,})"), F.lit(1)), lambda t: F.contains(low, t)))
    return F.when(F.size(expects) > 0, F.size(covered) / F.size(expects))


def words_per_minute(words: Column, duration_ms: Column) -> Column:
    return F.when((duration_ms > 2000) & (words > 0), words / (duration_ms / 60000))


def aggregate(answers: DataFrame, session: str, order: str) -> DataFrame:
    """One row for each session; declined answers count for coverage only, few-word ones not for delivery."""
    scored, spoke = ~F.col("skipped"), ~F.col("skipped") & (F.col("word_count") >= 3)
    columns = set(answers.columns)
    mean = lambda c, when: F.avg(F.when(when, F.nanvl(F.col(c).cast("double"), F.lit(None)))) if c in columns else F.lit(None).cast("double")
    place = F.row_number().over(Window.partitionBy(session, "skipped").orderBy(order)) - 1
    rows = answers.withColumn("_i", place)
    slope = F.when(F.count(F.when(scored, F.col("technical"))) >= 3, F.regr_slope(F.when(scored, F.col("technical")), F.col("_i")))
    return rows.groupBy(session).agg(
        F.count("*").alias("answers"), F.count_if(scored).alias("answered"), F.count_if(F.col("skipped")).alias("declined"),
        (F.count_if(scored) / F.count("*")).alias("coverage"),
        mean("technical", scored).alias("technical"), mean("relevance", scored).alias("relevance"),
        mean("communication", spoke).alias("communication"), mean("confidence", spoke).alias("confidence"), mean("fluency", spoke).alias("fluency"),
        slope.alias("trend"), F.sum("word_count").alias("words"), F.coalesce(F.avg(F.when(scored, F.col("word_count"))), F.lit(0.0)).alias("avg_words"),
        F.coalesce(F.avg(F.when(spoke, F.col("filler_rate"))), F.lit(0.0)).alias("filler_rate"),
        F.count_if(scored & F.col("concrete")).alias("concrete"), F.count_if(scored & F.col("structured")).alias("structured"),
        F.coalesce(F.sum(F.when(scored, F.col("hedge_count"))), F.lit(0)).alias("hedges"),
    )


def overall(coverage: str = "coverage") -> Column:
    """Weighted mean of the metrics that exist, scaled down below 80 % coverage."""
    total = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    scale = F.when(F.col(coverage) < 0.8, 0.65 + 0.35 * (F.col(coverage) / 0.8)).otherwise(1.0)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(total, weight) * scale)), F.lit(0.0))


def level(score: Column, answered: Column) -> Column:
    return F.when((score >= L.BAND_STRONG) & (answered >= 4), "ADVANCED").when((score >= L.BAND_OK) & (answered >= 2), "INTERMEDIATE").otherwise("BEGINNER")


def findings() -> Column:
    """Codes of what the session's measurements show, at most six of each kind, in the order of checking."""
    n = F.greatest(F.col("answered"), F.lit(1))
    half = F.greatest(F.lit(2), F.floor(n / 2))
    rules = [
        ("+technical", F.col("technical") >= L.BAND_STRONG), ("-technical_core", F.col("technical") < L.BAND_WEAK), ("-technical_precision", F.col("technical").between(L.BAND_WEAK, L.BAND_OK) & (F.col("technical") < L.BAND_OK)),
        ("+relevance", F.col("relevance") >= L.BAND_STRONG), ("-relevance", F.col("relevance") < L.BAND_OK),
        ("+attempted_all", (F.col("declined") == 0) & (F.col("answers") >= 3)), ("-declined", F.col("declined") > 0),
        ("+examples", F.col("concrete") >= half), ("-no_examples", (F.col("concrete") == 0) & (n >= 3)),
        ("+structure", F.col("structured") >= half), ("-too_short", (F.col("avg_words") > 0) & (F.col("avg_words") < 25) & (n >= 3)), ("-too_long", F.col("avg_words") > 220),
        ("+clean_delivery", (F.col("filler_rate") <= 2) & (F.col("words") >= 60)), ("-fillers", F.col("filler_rate") >= 6),
        ("-hedging", F.col("hedges") >= F.greatest(F.lit(4), n)), ("+confidence", F.col("confidence") >= L.BAND_STRONG), ("-confidence", F.col("confidence") < L.BAND_WEAK),
        ("+improved", F.col("trend") >= 2), ("-declined_over_time", F.col("trend") <= -2.5),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules)))
    of = lambda mark: F.slice(F.filter(found, lambda k: F.startswith(k, F.lit(mark))), 1, 6)
    return F.concat(of("+"), of("-"))


def diagnosis() -> Column:
    """Tags of the problems measured in a session."""
    n = F.greatest(F.col("answered"), F.lit(1))
    rules = [
        ("low_technical", F.col("technical") < L.BAND_OK), ("low_relevance", F.col("relevance") < L.BAND_OK), ("low_confidence", F.col("confidence") < L.BAND_WEAK),
        ("high_fillers", F.col("filler_rate") >= 6), ("hedging", F.col("hedges") >= F.greatest(F.lit(4), n)), ("no_examples", (F.col("concrete") == 0) & (F.col("answered") >= 3)),
        ("declined_questions", F.col("declined") > 0), ("declining_trend", F.col("trend") <= -2.5),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules)))


def resources(tags: Column, limit: int = 5) -> Column:
    """Resources by how many of their triggers were diagnosed, most first, at most ``limit``."""
    scored = F.array(*(F.struct((-F.size(F.array_intersect(T.strs(t), tags))).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, t) in enumerate(L.RESOURCES)))
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda r: r["s"] < 0)), 1, limit), lambda r: r["k"])


def report(turns: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Report of every conversation: one shuffle on the session serves pairing, places and aggregates."""
    rows = aggregate(evidence(pair_preceding(turns, session, order, role, text)), session, order)
    rows = rows.withColumn("overall", overall())
    tags = rows.withColumns({"level": level(F.col("overall"), F.col("answered")), "findings": findings(), "diagnosis": diagnosis()})
    return tags.withColumn("resources", resources(F.col("diagnosis")))


def by_group(answers: DataFrame, session: str, group: str, metric: str) -> DataFrame:
    """Count and mean of a metric by group within a session ('General' for a blank group), weakest first, unscored last."""
    key = F.coalesce(F.when(F.col(group) != "", F.col(group)), F.lit("General"))
    rows = answers.groupBy(session, key.alias("grp")).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))
    place = F.row_number().over(Window.partitionBy(session).orderBy(F.asc_nulls_last("mean"), "grp"))
    return rows.withColumn("place", place)


def decide(turns: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The interviewer's next move after each answer (intent, technical and remaining given): replay of all sessions in windows.

    A second gap within the last two answers eases the level; one follow-up a
    session probes a thin or a strong answer.
    """
    w = Window.partitionBy(session).orderBy(order)
    gaps = F.count_if(F.col("intent") == "dont_know").over(w.rowsBetween(-2, -1))
    strong = F.col("technical") >= L.BAND_STRONG
    wants = (F.col("remaining") > 1) & ((F.col("intent") == "thin") | ((F.col("intent") == "substantive") & strong))
    used = F.count_if(wants).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = turns.withColumns({"gaps": gaps, "used": F.least(F.coalesce(used, F.lit(0)), F.lit(1))})
    action = (
        F.when(F.col("intent").isin("clarify", "silent"), "repeat")
        .when(F.col("intent") == "dont_know", F.when((F.coalesce("gaps", F.lit(0)) >= 1) & (F.col("remaining") > 1), "easier").otherwise("next"))
        .when(wants & (F.col("used") < 1), "followup")
        .when((F.col("intent") == "substantive") & (F.col("remaining") <= 0), "end").otherwise("next")
    )
    return rows.withColumn("action", action)
