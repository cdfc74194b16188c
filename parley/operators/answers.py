"""Whole scores of an answer: relevance by kind of prompt, evaluation by concepts, and which scores apply at all."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from parley.functions import lexicons as L
from parley.functions import text as T
from parley.operators import scoring


def _within(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def personal(answer: Column) -> Column:
    """0 to 100 for an account of one's own work: ownership, specifics, narrative, length."""
    n = F.size(T.words(answer))
    names = F.regexp_count(F.substring(answer, 2, 1 << 30), F.lit(r"(?:^|[^\p{L}\p{N}_])[A-Z][a-zA-Z.+#]{2,}"))
    ownership = F.least(F.lit(30.0), T.count_words(answer, L.SELF_REFERENCE) * 7.0)
    concrete = F.least(F.lit(30.0), T.count_phrases(answer, L.SPECIFIC) * 9.0 + F.least(names, F.lit(4)) * 4.0)
    narrative = F.least(F.lit(20.0), T.count_words(answer, L.NARRATIVE) * 7.0)
    length = F.when(n >= 45, 20.0).when(n >= 25, 15.0).when(n >= 12, 9.0).otherwise(n * 0.5)
    return T.rounded(F.least(F.lit(100.0), ownership + concrete + narrative + length), 1)


def form_match(question: Column, answer: Column) -> Column:
    """0 to 100: whether the answer has the form that the question's words ask for; 60 if they ask for none."""
    asked = {k: T.has_words(question, p).cast("int") for k, p in L.QUESTION_FORMS.items()}
    met = sum((asked[k] * T.has_words(answer, p).cast("int") for k, p in L.ANSWER_FORMS.items()), F.lit(0))
    n = sum(asked.values(), F.lit(0))
    return F.when(n > 0, 25.0 + 75.0 * met / F.greatest(n, F.lit(1))).otherwise(60.0)


def relevance(rows: DataFrame, recall: str, question: str, answer: str, expects: Column | None = None) -> DataFrame:
    """Adds relevance, 0 to 100; ``recall``: the weighted share of the question's terms in the answer (null: it has none).

    Prompts about oneself are scored as accounts. Long answers that use technical
    terms have a floor, as other words can be right too.
    """
    rows = rows.withColumns({"_q": T.strip(F.coalesce(question, F.lit(""))), "_a": T.strip(F.coalesce(answer, F.lit("")))})
    q, a = F.col("_q"), F.col("_a")
    concept = scoring.concept_share(expects, a) if expects is not None else F.lit(None).cast("double")
    rows = rows.withColumns({"_n": F.size(T.words(a)), "_form": form_match(q, a), "_concept": concept, "_engaged": T.count_terms(F.lower(a), L.TECHNICAL_TERMS), "_own": T.has_words(q, L.PERSONAL_PROMPT)})
    n, form = F.col("_n"), F.col("_form")
    score = scoring.relevance(F.col(recall), form, F.col("_concept"))
    floor = F.when((n >= 20) & (F.col("_engaged") >= 3), F.when(form >= 50, 40.0).otherwise(35.0)).when(n >= 30, 30.0).otherwise(0.0)
    out = (
        F.when(a == "", 0.0).when(q == "", F.when(n >= 15, 50.0).otherwise(25.0)).when(n < 4, 15.0).when(F.col("_own"), personal(a))
        .otherwise(T.rounded(_within(F.greatest(score, floor), 0.0, 100.0), 1))
    )
    return rows.withColumn("relevance", out).drop("_q", "_a", "_n", "_form", "_concept", "_engaged", "_own")


def concepts(text: Column) -> Column:
    """Known concepts of a text, then its other long words, ten at most."""
    low = F.lower(F.coalesce(text, F.lit("")))
    known = F.array_compact(F.array(*(F.when(F.regexp_like(low, F.lit(T.whole(t))), t) for t in L.CONCEPTS)))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.regexp_like(w, F.lit("^[a-z]{5,}$")) & ~w.isin(L.CONCEPT_STOP))
    return F.slice(F.array_distinct(F.concat(known, words)), 1, 10)


def evaluate(rows: DataFrame, question: str, answer: str, expected: Column, correctness: Column, closeness: Column, depth: Column) -> DataFrame:
    """Adds verdict, scores, covered and missing concepts of each answer; the last three arguments are a model's scores (0 to 100)."""
    a, q, e = (T.strip(F.coalesce(c, F.lit(""))) for c in (F.col(answer), F.col(question), expected))
    rows = rows.withColumns({"_a": a, "_r": F.concat(q, F.lit(" "), e)})
    rows = rows.withColumns({"_n": F.size(T.words(F.col("_a"))), "_low": F.lower("_a"), "_said": concepts(F.col("_a")), "_wanted": concepts(F.col("_r"))})
    covered = F.filter("_wanted", lambda c: F.array_contains("_said", c) | F.contains(F.col("_low"), c))
    rows = rows.withColumns({"_covered": covered, "_length": F.least(F.col("_n") / 25.0, F.lit(1.2))})
    share, length, blank = F.size("_covered") / F.greatest(F.size("_wanted"), F.lit(1)), F.col("_length"), F.col("_n") < 3
    technical = _within(share * 60.0 + correctness * 0.25 + length * 15.0, 10.0, 98.0)
    relevant = _within(closeness * 0.40 + share * 40.0 + 20.0, 20.0, 99.0)
    deep = _within(F.size("_said") * 12.0 + length * 20.0 + depth * 0.20, 15.0, 98.0)
    score = lambda c: F.when(blank, 0.0).otherwise(T.rounded(c, 1))
    rows = rows.withColumns({"technical": score(technical), "relevance": score(relevant), "depth": score(deep), "overall": score(technical * 0.50 + relevant * 0.30 + deep * 0.20)})
    verdict = F.when(blank, "INCORRECT").when(F.col("technical") >= 75, "CORRECT").when(F.col("technical") >= 45, "PARTIALLY_CORRECT").when(F.col("relevance") < 35, "OFF_TOPIC").otherwise("INCORRECT")
    none = F.array().cast("array<string>")
    return rows.withColumns({"verdict": verdict, "covered": F.when(blank, none).otherwise(F.col("_covered")), "missing": F.when(blank, F.col("_wanted")).otherwise(F.array_except("_wanted", "_covered"))}).drop(
        "_a", "_r", "_n", "_low", "_said", "_wanted", "_covered", "_length")


def route(intent: Column, phase: Column, heard: Column, communication: Column, relevance_: Column, technical: Column, fillers: Column, words: Column, confidence: Column, fluency: Column) -> Column:
    """The scores that apply to an answer. Declined: none but delivery, and it is skipped. Not a technical phase: technical is null. Not heard: delivery comes from the text."""
    skipped = intent.isin("dont_know", "silent")
    smooth = _within(100 - F.coalesce(F.try_divide(fillers * 100.0, words), F.lit(0.0)) * 6, 20.0, 100.0)
    sure = _within(communication * 0.6 + smooth * 0.4, 20.0, 100.0)
    delivery = lambda measured, text: T.rounded(F.when(heard, F.coalesce(measured, F.lit(0.0))).otherwise(F.when(skipped, 0.0).otherwise(text)), 1)
    scored = lambda c: F.when(skipped, 0.0).otherwise(T.rounded(c, 1))
    return F.struct(
        skipped.alias("skipped"), heard.alias("measured"), scored(communication).alias("communication"), scored(relevance_).alias("relevance"),
        F.when(skipped, 0.0).when(~F.lower(F.coalesce(phase, F.lit(""))).isin(L.NON_TECHNICAL_PHASES), T.rounded(technical, 1)).alias("technical"),
        delivery(fluency, smooth).alias("fluency"), delivery(confidence, sure).alias("confidence"),
    )


def phase(ordinal: Column, total: Column) -> Column:
    """Part of an interview by how far it has come."""
    ratio = F.coalesce(F.try_divide(ordinal, total), F.lit(0.0))
    return F.when(ratio < 0.15, "greet").when(ratio < 0.3, "intro").when(ratio < 0.6, "tech").when(ratio < 0.8, "follow").when(ratio < 0.95, "behavior").otherwise("wrap")


def _loops(code: str | None) -> tuple[int, int]:
    """Loops and functions of a Python text; -1 if it doesn't parse."""
    try:
        nodes = list(ast.walk(ast.parse(code or "")))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return -1, -1
    return sum(isinstance(x, ast.For | ast.While) for x in nodes), sum(isinstance(x, ast.FunctionDef) for x in nodes)


@F.arrow_udf(StructType([StructField("loops", IntegerType()), StructField("functions", IntegerType())]))
def _parsed(code: pa.Array) -> pa.Array:
    loops, functions = zip(*map(_loops, code.to_pylist())) if len(code) else ((), ())
    return pa.StructArray.from_arrays([pa.array(loops, pa.int32()), pa.array(functions, pa.int32())], names=["loops", "functions"])


def code_scores(code: Column, language: Column) -> Column:
    """Score, correctness, quality, security and complexity of a piece of code by plain signs; only Python is parsed."""
    c, lang = F.coalesce(code, F.lit("")), F.lower(language)
    has = lambda *some: T.contains_any(c, some)
    py, js, java, php = lang.isin("python", "py"), lang.isin("javascript", "js", "typescript", "ts"), lang == "java", lang == "php"
    parsed = _parsed(F.when(py, c))
    loops, functions = parsed["loops"], parsed["functions"]
    broken = py & (loops < 0)
    correct = F.when(broken, 30).when(py, 85).when(js & has("function", "=>"), 85).when(java & has("class "), 85).when(php & has("<?php", "$"), 80).otherwise(70)
    quality = F.when(broken, 40).when(py & (functions == 0), 65).when(js & has("var "), 65).when(java & has("public "), 85).otherwise(75)
    quality = quality - F.when(F.size(F.split(c, "\n")) < 3, 10).otherwise(0) - F.when(has("TODO", "FIXME"), 5).otherwise(0)
    secure = F.when(js & has("eval("), 20).when(php & has("eval(", "exec("), 30).otherwise(90)
    steps = F.when(py & (loops == 0), "O(1)").when(py & (loops >= 2), "O(N^2)").otherwise("O(N)")
    none = T.strip(c) == ""
    part = lambda x, empty: F.when(none, empty).otherwise(x)
    return F.struct(
        part(F.floor((correct * 4 + quality * 4 + secure * 2) / 10).cast("int"), 0).alias("score"), part(correct, 0).alias("correctness"), part(quality, 0).alias("quality"),
        part(secure, 100).alias("security"), part(steps, "N/A").alias("complexity"),
    )
