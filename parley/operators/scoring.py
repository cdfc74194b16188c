"""Scores of one answer from its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T


def _clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def communication(text: Column) -> Column:
    """0 to 100: variety of words, length of sentences, discourse markers, less fillers. 20 for a text too short to tell."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = T.words(low)
    n = F.size(words)
    share = F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1))
    variety = F.when(share >= 0.8, 100.0).when(share >= 0.6, 70.0 + (share - 0.6) * 150).when(share >= 0.4, 40.0 + (share - 0.4) * 150).otherwise(share * 100)
    sentences = F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: T.strip(s) != ""))
    length = n / F.greatest(sentences, F.lit(1))
    shape = F.when((length >= 10) & (length <= 25), 100.0).when(length < 10, F.greatest(F.lit(20.0), length * 8)).otherwise(F.greatest(F.lit(20.0), 100 - (length - 25) * 3))
    markers = F.least(F.lit(100.0), 50 + T.count_terms(low, L.DISCOURSE) * 15.0)
    fillers = F.size(F.filter(words, lambda w: w.isin(L.SCORE_FILLERS)))
    penalty = F.least(F.lit(40.0), fillers / F.greatest(n, F.lit(1)) * 200)
    score = F.greatest(F.lit(0.0), variety * 0.30 + shape * 0.25 + markers * 0.25 - penalty)
    return F.when((F.length(T.strip(low)) < 10) | (n < 5), 20.0).otherwise(score)


def technical(text: Column, keywords=()) -> Column:
    """0 to 100: distinct technical terms, mechanisms, trade-offs and specifics, less vagueness, with a ceiling for short answers."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.size(T.words(low))
    terms = sorted({*L.TECHNICAL_TERMS, *keywords})
    hits = lambda p: T.count_phrases(text, p)
    raw = (
        35 * (1 - F.exp(-0.5 * T.count_terms(low, terms))) + F.least(F.lit(25.0), hits(L.MECHANISM) * 9.0) + F.least(F.lit(22.0), hits(L.TRADEOFF) * 11.0)
        + F.least(F.lit(18.0), hits(L.SPECIFIC) * 8.0) - F.least(F.lit(15.0), hits(L.VAGUE) * 5.0)
    )
    ceiling = F.when(n < 12, 35.0).when(n < 25, 60.0).when(n < 40, 85.0).otherwise(100.0)
    return F.when(n == 0, 0.0).when(n < 4, 10.0).otherwise(_clamp(F.least(raw, ceiling)))


def inverse_frequency(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, df and idf = ln((N + 1) / (df + 1)) + 1 over all documents."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(T.content_terms(F.col(text_col)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def recall(pairs: DataFrame, idf: DataFrame, default: Column, key: list[str], question: str = "question", answer: str = "answer") -> DataFrame:
    """Share of a question's distinct terms, weighted by rarity, that its answer takes up; null for a question without terms."""
    asked = pairs.select(*key, F.explode(F.array_distinct(T.content_terms(F.col(question)))).alias("term"), T.content_terms(F.col(answer)).alias("_said"))
    asked = asked.select(*key, "term", F.array_contains("_said", F.col("term")).alias("hit"))
    weight = F.coalesce("idf", default)
    return asked.join(idf, "term", "left").groupBy(*key).agg((F.sum(F.when(F.col("hit"), weight).otherwise(0.0)) / F.sum(weight)).alias("recall"))


def relevance(recall_: Column, intent: Column, concept: Column) -> Column:
    """0 to 100 from weighted recall, form of the answer, and share of expected concepts (null: none expected)."""
    r = F.least(F.lit(100.0), F.coalesce(recall_, F.lit(0.0)) * 250)
    return _clamp(F.when(concept.isNotNull(), 0.40 * r + 0.25 * intent + 0.35 * concept).otherwise(0.60 * r + 0.40 * intent))


def concept_share(expects: Column, answer: Column) -> Column:
    """Percent of expected concepts one of whose terms the answer has; null if none are expected."""
    said = T.content_terms(answer)
    covered = F.size(F.filter(expects, lambda e: F.arrays_overlap(T.content_terms(e), said)))
    return F.when(F.size(expects) > 0, 100.0 * covered / F.size(expects))


#: How sure each rule of ``intent_rule`` is, and turns of middle length of the word count alone.
SURE = {"silent": 1.0, "single": 0.95, "decline": 0.97, "clarify": 0.95, "long": 0.9, "short": 0.85, "length": 0.6}


def intent_rule(text: Column) -> Column:
    """(intent, rule) of the first rule that holds; null for turns of 7 to 34 words without one."""
    low = F.lower(T.strip(F.coalesce(text, F.lit(""))))
    n = F.size(T.words(low))
    has = lambda p: F.coalesce(F.regexp_like(T.spaced(text), F.lit(T.phrase(p))), F.lit(False))
    is_ = lambda name, rule: F.struct(F.lit(name).alias("intent"), F.lit(rule).alias("rule"))
    return (
        F.when(low == "", is_("silent", "silent"))
        .when((n == 1) & low.isin(L.SINGLE_DECLINES), is_("dont_know", "single"))
        .when((n == 1) & low.isin(L.SINGLE_FILLERS), is_("thin", "single"))
        .when(has(L.DECLINE), is_("dont_know", "decline"))
        .when(has(L.CLARIFY), is_("clarify", "clarify"))
        .when(n >= 35, is_("substantive", "long"))
        .when(n <= 6, is_("thin", "short"))
    )


def intent(text: Column) -> Column:
    """silent, dont_know, clarify, substantive or thin, by rules in order, and by length where none holds."""
    return F.coalesce(intent_rule(text)["intent"], F.when(F.size(T.words(F.coalesce(text, F.lit("")))) >= 15, "substantive").otherwise("thin"))


TERM = r"([A-Za-z][A-Za-z0-9+#.]{1,}(?:[./-][A-Za-z0-9+#]+)*)"


def salient_term(answer: Column) -> Column:
    """The term of an answer that is most worth asking about; null for one of less than eight words, or without a technical term.

    Known terms come before names with capitals inside, and these before
    dotted ones; of equals the longer one, then the first by code point.
    """
    text = F.coalesce(answer, F.lit(""))

    def rated(raw: Column) -> Column:
        low = F.regexp_replace(F.lower(raw), r"^\.+|\.+$", "")
        known = low.isin([*L.PROBE_CONCEPTS, *L.PROBE_PRODUCTS]) | F.regexp_replace(low, "s+$", "").isin([*L.PROBE_CONCEPTS, *L.PROBE_PRODUCTS])
        dotted, inner = F.regexp_like(raw, F.lit(r"[.-]")), F.regexp_like(raw, F.lit(r"^.+[A-Z]"))
        plus = lambda c, n: F.when(c, n).otherwise(0)
        score = plus(known, 20) + plus(inner, 8) + plus(dotted, 6) + plus(F.regexp_like(raw, F.lit("^[A-Z]")), 2)
        fits = ~low.isin(L.PROBE_STOP) & (F.length(low) >= 3) & (known | dotted | inner)
        return F.when(fits, F.struct((-score).alias("score"), (-F.length(low)).alias("size"), F.regexp_replace(raw, r"^\.+|\.+$", "").alias("term")))

    best = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(1)), rated))
    return F.when(F.size(T.words(text)) >= 8, best["term"])


def pace(wpm: Column) -> Column:
    """Words per minute to 0 to 100, best within the ideal range."""
    return F.when(wpm.between(L.PACE_LOW, L.PACE_HIGH), 100.0).when(wpm < L.PACE_LOW, F.greatest(F.lit(20.0), 100 - (L.PACE_LOW - wpm) * 1.4)).otherwise(F.greatest(F.lit(20.0), 100 - (wpm - L.PACE_HIGH) * 1.1))


def speaking_speed(wpm: Column) -> Column:
    """Words per minute to 0 to 100, piecewise; 20 above 200."""
    return (
        F.when(wpm <= 0, 50.0).when(wpm < 80, wpm / 80 * 55).when(wpm < 120, 55 + (wpm - 80) / 40 * 25).when(wpm <= 160, 80 + (wpm - 120) / 40 * 20)
        .when(wpm <= 200, F.greatest(F.lit(50.0), 100 - (wpm - 160) / 40 * 30)).otherwise(20.0)
    )


def question_quality(question: Column, source: Column) -> Column:
    """How fit a question is to be read aloud, 0 to 1; 0 for any hard reject."""
    q = T.strip(F.coalesce(question, F.lit("")))
    low, n, spaced = F.lower(q), F.size(T.words(q)), T.spaced(q)
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    context = "this|these|those|above|below|following|attached|my|mine|our|here|help|advice|suggestions?|am i|should i|can i|do i|how do i|anyone|anybody|homework"
    meta = "hire|hiring|recruit(?:er|ing|ment)?|salary|resume|cv|interviewer|candidate|job (?:offer|market|search)|career|certification worth|degree worth|which language should"
    staff = "(?:pick|choose|select|find|evaluate)(?: (?:a|an|the))?(?: good)?(?: (?:software|senior|junior))? (?:engineer|developer|programmer|team|company|employer)"
    opener = r"^\s*(?:what\s+is|what\s+are|what'?s|what\s+does|what\s+happens|why\s+(?:is|are|does|do|would|should|not)|how\s+(?:does|do|would|is|are|can|to)|when\s+(?:would|should|do|does)|which|explain|describe|compare|define|differentiate|tell\s+me|walk\s+me)(?:[^\p{L}\p{N}_]|$)"
    strong = r"difference\s+between|trade[\s-]?offs?|advantages?\s+and\s+disadvantages|pros\s+and\s+cons|when\s+would\s+you|why\s+would\s+you|how\s+does\s+.*\s+work|what\s+is\s+the\s+purpose"
    bad = (
        ~F.length(q).between(18, 160) | F.contains(q, F.lit("\n")) | like(q, r"https?://|```|<[a-z/][^>]*>|\{\{|\[[0-9]+\]|\$\$|[{};]\s*$|::|==|\+\+|&&")
        | like(spaced, T.phrase(context)) | like(spaced, T.phrase(meta)) | like(spaced, T.phrase(staff)) | like(low, r"^\s*how\s+to(?:[^\p{L}\p{N}_]|$)")
        | (F.regexp_count(q, F.lit(r"\?")) > 1) | (F.regexp_count(F.concat(F.lit("  "), F.regexp_replace(q, r"[^\p{L}\p{N}_]+", "  "), F.lit("  ")), F.lit(" [A-Z]{3,} ")) > 2) | ~n.between(4, 26)
    )
    good, asks = like(low, opener), F.endswith(q, F.lit("?"))
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    score = 0.35 + F.when(good, 0.30).otherwise(0.05) + plus(like(low, strong), 0.20) + plus(like(F.lower(F.coalesce(source, F.lit(""))), "interviews"), 0.20) + plus(n.between(6, 18), 0.10)
    return F.when(bad | ~(good | asks), 0.0).otherwise(F.least(F.lit(1.0), score))
