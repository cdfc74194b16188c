"""Evaluation of text models and classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from parley.functions import text as T
from parley.operators.corpus import global_rank


def tokens_13a(text: Column) -> Column:
    """Tokens of the mteval-13a scheme."""
    t = F.replace(F.replace(F.replace(text, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"([\{-~\[-` -&\(-+:-@/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([.,])([^0-9])", " $1 $2")
    return T.words(F.regexp_replace(t, r"([0-9])(-)", "$1 $2 "))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens, joined by a space; none if there are fewer tokens."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<string>"))


def matches(pairs: DataFrame, key: str, prediction: Column, reference: Column, orders: int) -> DataFrame:
    """(key, n, matched, total, wanted): clipped n-gram matches of each pair and order."""
    def counted(tokens: Column, name: str) -> DataFrame:
        each = F.array(*(F.struct(F.lit(n).alias("n"), ngrams(F.col("_t"), n).alias("g")) for n in range(1, orders + 1)))
        rows = pairs.select(key, tokens.alias("_t")).select(key, F.explode(each).alias("e")).select(key, "e.n", F.explode("e.g").alias("g"))
        return rows.groupBy(key, "n", "g").agg(F.count("*").alias(name))

    both = counted(prediction, "p").join(counted(reference, "r"), [key, "n", "g"], "full")
    return both.groupBy(key, "n").agg(
        F.sum(F.least(F.coalesce("p", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("matched"), F.coalesce(F.sum("p"), F.lit(0)).alias("total"), F.coalesce(F.sum("r"), F.lit(0)).alias("wanted"))


def corpus_bleu(pairs: DataFrame, key: str, prediction: Column, reference: Column, orders: int = 4) -> DataFrame:
    """One row: pooled clipped precisions, brevity penalty, and their product (0 if some order has no match)."""
    m = matches(pairs, key, prediction, reference, orders).groupBy("n").agg(F.sum("matched").alias("matched"), F.sum("total").alias("total"), F.sum("wanted").alias("wanted"))
    at = lambda c, n: F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    row = m.agg(*(at("matched", n).alias(f"m{n}") for n in range(1, orders + 1)), *(at("total", n).alias(f"t{n}") for n in range(1, orders + 1)), at("wanted", 1).alias("ref"))
    logs = sum((F.log(F.try_divide(F.col(f"m{n}"), F.col(f"t{n}"))) for n in range(1, orders + 1)), F.lit(0.0)) / orders
    brevity = F.when(F.col("t1") > F.col("ref"), 1.0).otherwise(F.exp(1 - F.col("ref") / F.greatest(F.col("t1"), F.lit(1))))
    none = F.least(*(F.col(f"m{n}") for n in range(1, orders + 1))) == 0
    return row.withColumn("bleu", F.when(none, 0.0).otherwise(brevity * F.exp(logs)))


def f1(matched: Column, predicted: Column, wanted: Column) -> Column:
    return F.when(matched > 0, 2.0 * matched / (predicted + wanted)).otherwise(0.0)


def rouge_n(pairs: DataFrame, key: str, prediction: Column, reference: Column) -> DataFrame:
    """ROUGE-1 and ROUGE-2 F1 of each pair."""
    m = matches(pairs, key, prediction, reference, 2).withColumn("f", f1(F.col("matched"), F.col("total"), F.col("wanted")))
    scores = m.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col("n") == n, F.col("f"))), F.lit(0.0)).alias(f"rouge{n}") for n in (1, 2)))
    return pairs.select(key).join(scores, key, "left").select(key, F.coalesce("rouge1", F.lit(0.0)).alias("rouge1"), F.coalesce("rouge2", F.lit(0.0)).alias("rouge2"))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of the table as the bits of one integer."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & at.get(y, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


@F.arrow_udf(IntegerType())
def _lcs_lengths(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_lcs(x.as_py() or [], y.as_py() or []) for x, y in zip(a, b, strict=True)], pa.int32())


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of tokens; 0 if one is null."""
    return _lcs_lengths(a, b)


def rouge_l(prediction: Column, reference: Column) -> Column:
    p, r = word_tokens(prediction), word_tokens(reference)
    return f1(lcs_length(p, r), F.size(p), F.size(r))


def sentence_bleu(m: DataFrame, key: str, orders: int = 4) -> DataFrame:
    """BLEU of each pair with exponential smoothing, from ``matches``."""
    rows = m.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "matched", "total", "wanted"))).alias("o"))
    step = lambda acc, x: F.struct(
        F.when(x["matched"] == 0, acc["inv"] * 2).otherwise(acc["inv"]).alias("inv"),
        (acc["log"] + F.log(F.when(x["matched"] == 0, F.try_divide(F.lit(1.0), acc["inv"] * 2 * x["total"])).otherwise(F.try_divide(x["matched"], x["total"])))).alias("log"),
    )
    folded = F.aggregate("o", F.struct(F.lit(1.0).alias("inv"), F.lit(0.0).alias("log")), step)["log"] / orders
    size, wanted = F.get("o", F.lit(0))["total"], F.get("o", F.lit(0))["wanted"]
    brevity = F.when(size > wanted, 1.0).otherwise(F.exp(1 - F.try_divide(wanted, size)))
    whole = (F.size("o") == orders) & (F.array_min(F.transform("o", lambda x: x["total"])) > 0)
    return rows.select(key, F.coalesce(F.when(whole, brevity * F.exp(folded)), F.lit(0.0)).alias("bleu"))


def perplexity(loss: Column, cap: float = 80.0) -> Column:
    return F.when(loss.isNull() | (loss < 0), float("inf")).otherwise(F.exp(F.least(loss, F.lit(cap))))


def confusion(df: DataFrame, score: Column, label: Column, threshold: float = 0.5) -> DataFrame:
    hit = score >= threshold
    n = lambda c: F.count_if(c)
    row = df.agg(n(hit & (label == 1)).alias("tp"), n(hit & (label == 0)).alias("fp"), n(~hit & (label == 0)).alias("tn"), n(~hit & (label == 1)).alias("fn"))
    d = F.try_divide
    return row.withColumns({"accuracy": d(F.col("tp") + F.col("tn"), F.expr("tp + fp + tn + fn")), "precision": d(F.col("tp"), F.expr("tp + fp")), "recall": d(F.col("tp"), F.expr("tp + fn"))}).withColumn(
        "f1", F.try_divide(2 * F.col("tp"), F.expr("2 * tp + fp + fn")))


def curves(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: areas under the ROC and the precision-recall curve, by trapezoids over distinct scores.

    Scores are first summed to their distinct values (round or bin them to bound
    these), and only those meet in the running sums.
    """
    points = df.groupBy(score).agg(F.sum(label).alias("p"), (F.count("*") - F.sum(label)).alias("n"))
    w = Window.orderBy(F.desc(score))
    runs = points.select(F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), F.col(score).alias("s"))
    total = points.agg(F.sum("p").alias("P"), F.sum("n").alias("N"))
    runs = runs.join(total.hint("broadcast"))
    w = Window.orderBy(F.desc("s"))
    prev = lambda c, d: F.lag(c, 1, d).over(w)
    tpr, fpr, prec = F.try_divide(F.col("tp"), F.col("P")), F.try_divide(F.col("fp"), F.col("N")), F.col("tp") / (F.col("tp") + F.col("fp"))
    rows = runs.select("s", tpr.alias("tpr"), fpr.alias("fpr"), prec.alias("prec"))
    roc = (F.col("fpr") - prev("fpr", 0.0)) * (F.col("tpr") + prev("tpr", 0.0)) / 2
    pr = (F.col("tpr") - prev("tpr", 0.0)) * (F.col("prec") + prev("prec", 1.0)) / 2
    return rows.select(roc.alias("roc"), pr.alias("pr")).agg(F.sum("roc").alias("roc_auc"), F.sum("pr").alias("pr_auc"))


def histogram(df: DataFrame, value: str, group: str, bins: int = 15) -> DataFrame:
    """Counts of equal-width bins between each group's own least and largest value."""
    ends = df.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * bins), F.lit(bins - 1)).cast("int")
    return df.join(ends.hint("broadcast"), group).groupBy(group, at.alias("bin")).agg(F.count("*").alias("n"))


def minmax_rank(df: DataFrame, key: str, weights: dict[str, float], lower_is_better: set[str]) -> DataFrame:
    """Score of candidates from metrics scaled to [0, 1] (all equal: 1), and their rank; weights must sum to 1."""
    if abs(sum(weights.values()) - 1) > 1e-4:
        raise ValueError("weights must sum to 1")
    ends = df.agg(*(f(m).alias(f"{m}_{f.__name__}") for m in weights for f in (F.min, F.max)))
    rows = df.join(ends.hint("broadcast"))

    def scaled(m: str) -> Column:
        lo, hi, x = F.col(f"{m}_min"), F.col(f"{m}_max"), F.col(m)
        up = (hi - x if m in lower_is_better else x - lo) / (hi - lo + 1e-8)
        return F.when(hi - lo < 1e-6, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), up)))

    score = F.round(sum((scaled(m) * w for m, w in weights.items()), F.lit(0.0)), 4)
    ranked = global_rank(rows.select(key, score.alias("final_score"), (-score).alias("_o")), "_o", (key,))
    return ranked.select(key, "final_score", (F.col("place") + 1).alias("rank"))


def gate(runs: DataFrame) -> DataFrame:
    """Promotion of each run against its base: perplexity down 15 %, ROUGE-L up 10 %, coverage 0.9, latency 150 ms."""
    ppl = (F.col("base_perplexity") - F.col("perplexity")) / F.greatest("base_perplexity", F.lit(1e-5)) * 100
    rouge = (F.col("rouge_l") - F.col("base_rouge_l")) / F.greatest("base_rouge_l", F.lit(1e-5)) * 100
    checks = {"perplexity_ok": ppl >= 15, "rouge_ok": rouge >= 10, "coverage_ok": F.col("domain_coverage") >= 0.9, "latency_ok": F.col("latency_ms") <= 150}
    return runs.withColumns(checks).withColumn("approved", F.expr(" AND ".join(checks)))


def run_diff(base: DataFrame, other: DataFrame, key: list[str], lower_is_better=()) -> DataFrame:
    """Metrics of two runs side by side: change, relative change, and whether it is one for the better (null-safe, either side may lack a metric)."""
    both = base.withColumnRenamed("value", "base").join(other.withColumnRenamed("value", "candidate"), key, "full")
    delta = F.col("candidate") - F.col("base")
    better = F.when(F.col("metric").isin(list(lower_is_better)), delta < 0).otherwise(delta > 0)
    return both.withColumns({"delta": delta, "percent": F.try_divide(delta * 100, F.abs("base")), "improved": better})


def error_rates(pairs: DataFrame, prediction: Column, reference: Column) -> DataFrame:
    """Character error rate over a corpus: edits by reference characters."""
    return pairs.agg((F.sum(F.levenshtein(prediction, reference)) / F.sum(F.length(reference))).alias("cer"))


def _edits(a: list[str], b: list[str]) -> int:
    """Word edits from ``a`` to ``b``: the columns of the table as bits of two integers."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, edits = full, 0, len(a)
    for y in b:
        same = at.get(y, 0)
        flat = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(flat | up)), up & flat
        edits += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        tall = same | down
        up, down = fall | (full & ~(tall | rise)), rise & tall
    return edits


@F.arrow_udf(IntegerType())
def _word_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_edits(x.as_py() or [], y.as_py() or []) for x, y in zip(a, b, strict=True)], pa.int32())


def word_error_rate(pairs: DataFrame, prediction: Column, reference: Column) -> DataFrame:
    """Word error rate over a corpus: edits by reference words."""
    r = T.words(F.coalesce(reference, F.lit("")))
    return pairs.agg((F.sum(_word_edits(T.words(F.coalesce(prediction, F.lit(""))), r)) / F.sum(F.size(r))).alias("wer"))


def evaluation_slices(samples: DataFrame, key: str, groups: list[str], orders: int = 4) -> DataFrame:
    """Metrics of all samples, by each group, and by the first group crossed with the others; rows without a group's value are left out of it.

    ``samples``: key, prediction, reference, nll, tokens and the groups. BLEU pools
    the n-gram counts of a slice and perplexity its losses: ratios of sums.
    """
    counts = matches(samples, key, tokens_13a(F.col("prediction")), tokens_13a(F.col("reference")), orders)
    at = lambda c, n: F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    wide = counts.groupBy(key).agg(*(at(c, n).alias(f"{c}{n}") for n in range(1, orders + 1) for c in ("matched", "total", "wanted")))
    rows = samples.join(wide, key, "left")
    sets = [[], *([g] for g in groups), *([groups[0], g] for g in groups[1:])]
    pooled = [F.coalesce(F.sum(f"{c}{n}"), F.lit(0)).alias(f"{c}{n}") for n in range(1, orders + 1) for c in ("matched", "total", "wanted")]
    same = T.strip(F.col("prediction")) == T.strip(F.col("reference"))
    out = rows.groupingSets(sets, *groups).agg(
        *(F.grouping(g).alias(f"_{g}") for g in groups), F.count("*").alias("n"), F.round(F.avg(same.cast("int")), 6).alias("exact_match"), F.count_if(T.strip(F.col("prediction")) == "").alias("empty"),
        F.avg(F.length("prediction")).alias("prediction_chars"), F.avg(F.length("reference")).alias("reference_chars"), F.exp(F.try_divide(F.sum("nll"), F.sum("tokens"))).alias("perplexity"), *pooled,
    )
    logs = sum((F.log(F.try_divide(F.col(f"matched{n}"), F.col(f"total{n}"))) for n in range(1, orders + 1)), F.lit(0.0)) / orders
    brevity = F.when(F.col("total1") > F.col("wanted1"), 1.0).otherwise(F.exp(1 - F.col("wanted1") / F.greatest(F.col("total1"), F.lit(1))))
    none = F.least(*(F.col(f"matched{n}") for n in range(1, orders + 1))) == 0
    for g in groups:
        out = out.filter((F.col(f"_{g}") == 1) | F.col(g).isNotNull())
    return out.select(*groups, "n", "exact_match", "empty", F.when(none, 0.0).otherwise(brevity * F.exp(logs)).alias("bleu"), "prediction_chars", "reference_chars", "perplexity")


def proxy_rouge(pairs: DataFrame, prediction: Column, reference: Column) -> DataFrame:
    """ROUGE-1 and -2 over distinct n-grams of white-space words: cheap stand-ins, not the scores of ``rouge_n``."""
    # words and pairs are found once, each in a step of its own
    rows = pairs.withColumns({"_p": T.words(F.lower(prediction)), "_r": T.words(F.lower(reference))})
    p, r, p2, r2 = (F.col(c) for c in ("_p", "_r", "_p2", "_r2"))
    f = lambda a, b: F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))
    rows = rows.withColumns({"_p2": ngrams(p, 2), "_r2": ngrams(r, 2)})
    return rows.withColumns({"rouge1": f(p, r), "rouge2": F.when((F.size(p2) > 0) & (F.size(r2) > 0), f(p2, r2)).otherwise(0.0)}).drop("_p", "_r", "_p2", "_r2")


def setting_differences(base: DataFrame, other: DataFrame, settings: list[str]) -> DataFrame:
    """(setting, base, candidate, same) of two runs' one-row settings, null-safe; runs compare only if all are the same."""
    long = lambda df, name: df.select(F.inline(F.array(*(F.struct(F.lit(s).alias("setting"), F.col(s).cast("string").alias(name)) for s in settings))))
    return long(base, "base").join(long(other, "candidate"), "setting").withColumn("same", F.col("base").eqNullSafe(F.col("candidate")))


def require_comparable(differences: DataFrame) -> None:
    """Raises if a setting differs."""
    bad = [r["setting"] for r in differences.filter("NOT same").select("setting").collect()]
    if bad:
        raise ValueError(f"runs differ in {', '.join(sorted(bad))}")


def hit_rates(df: DataFrame, ranked: Column, target: Column) -> DataFrame:
    """Share of positions whose target is the first, or among the first five, of the ranked predictions."""
    ok = target.isNotNull()
    hit = lambda k: F.avg(F.when(ok, F.array_contains(F.slice(ranked, 1, k), target).cast("int")))
    return df.agg(hit(1).alias("top1"), hit(5).alias("top5"))
