"""The question corpus: classify, de-duplicate, balance, split, check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import lexicons as L
from parley.functions import text as T


def label_questions(df: DataFrame, question: str = "question", body: str = "body") -> DataFrame:
    """Adds reason (null if usable), domain and difficulty."""
    q, b = F.col(question), F.col(body)
    return df.withColumns({"reason": T.reject_reason(q), "domain": T.domain(F.concat_ws("\n", q, b)), "difficulty": T.difficulty(q, b)})


def build_records(raw: DataFrame) -> DataFrame:
    """Usable records of raw rows (raw_id, title, body, answer, ...): clean, labelled, with an answer that reads as prose or none."""
    question = T.one_line(F.col("title"))
    body = F.left(T.clean_text(F.col("body")), F.lit(L.MAX_BODY_CHARS))
    rows = label_questions(raw.withColumns({"question": question, "clean_body": body}), "question", "clean_body")
    answer = T.condense(F.col("answer"))
    answer = F.when((F.length(answer) >= L.MIN_ANSWER_CHARS // 2) & T.is_prose(answer), answer).otherwise("")
    asked = F.when(F.endswith("question", F.lit("?")), F.col("question")).otherwise(F.concat(F.regexp_replace("question", r"[.!]+$", ""), F.lit("?")))
    kept = rows.filter(F.col("reason").isNull() & F.col("domain").isNotNull() & ~(F.length(F.coalesce("body", F.lit(""))) > 4 * L.MAX_BODY_CHARS))
    return kept.select("*", answer.alias("expected_answer")).withColumn("question", asked)


def drop_counts(labelled: DataFrame, tag: Column) -> DataFrame:
    """How many rows each reason drops, by tag; kept ones count as 'kept'."""
    reason = F.coalesce("reason", F.when(F.col("domain").isNull(), "off_domain"), F.lit("kept"))
    return labelled.groupBy(tag.alias("tag"), reason.alias("reason")).agg(F.count("*").alias("n"))


def deduplicate(df: DataFrame, question: str, order: list[Column]) -> DataFrame:
    """Adds outcome: 'kept' for the first row of each bag of content words, else 'dedup_exact' or 'dedup_near'.

    Equal token lists have equal bags, so the first row of a bag decides: a
    dropped row is exact if its token list equals that one's. ``order`` has to
    tell rows apart. First rows are found by partial sums and joined back, so a
    bag that most rows share (such as the empty one) meets in no task.
    """
    # both keys come from tokens that are found once
    keyed = df.withColumns({"_tokens": T.content_tokens(F.col(question)), "_order": F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))})
    keyed = keyed.withColumns({"_exact": T.exact_key_of(F.col("_tokens")), "_fuzzy": T.fuzzy_key_of(F.col("_tokens"))}).drop("_tokens")
    first = keyed.groupBy("_fuzzy").agg(F.min(F.struct("_order", "_exact")).alias("_first"))
    outcome = F.when(F.col("_order") == F.col("_first._order"), "kept").when(F.col("_exact") == F.col("_first._exact"), "dedup_exact").otherwise("dedup_near")
    return keyed.join(first, "_fuzzy").withColumn("outcome", outcome).drop("_exact", "_fuzzy", "_order", "_first")


def round_robin(df: DataFrame, group: str, group_rank: Column, order: list[Column], cap: int, budget: int) -> DataFrame:
    """At most ``cap`` rows of each group, best first; and of all, ``budget`` taken in turns over the groups."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= cap)
    return ranked.orderBy("place", group_rank).limit(budget)


def stratified_split(df: DataFrame, strata: list[str], id_col: str, seed: int = 42, ratios: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """Adds split: each stratum, in the order of a seeded hash of the id, to train, validation and test.

    ``int(n * 0.8)`` rows train, up to ``int(n * 0.9)`` validate; of three rows or
    more at least one trains. A stratum is ranked in 4096 ranges of the hash, each
    behind the sum of those before, so no task sorts a large one.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    keyed = df.withColumns({"_key": key, "_part": F.left(F.coalesce(key, F.lit("")), F.lit(3))})
    sizes = keyed.groupBy(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)), F.col("_part").alias("_p")).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*(f"_s{i}" for i in range(len(strata))))
    sizes = sizes.withColumns({"_n": F.sum("_c").over(whole), "_before": F.sum("_c").over(whole.orderBy("_p")) - F.col("_c")}).drop("_c")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_part").orderBy("_key", id_col)))
    rows = ranked.join(sizes, same).withColumn("_at", F.col("_r") + F.col("_before"))
    train = F.floor(F.col("_n") * ratios[0])
    first = F.when((F.col("_n") >= 3) & (train == 0), 1).otherwise(train)
    until = first + F.floor(F.col("_n") * (ratios[0] + ratios[1])) - train
    split = F.when(F.col("_at") <= first, "train").when(F.col("_at") <= until, "validation").otherwise("test")
    return rows.withColumn("split", split).select(*df.columns, "split")


def similar_sets(x: DataFrame, y: DataFrame, threshold: float = 0.9, shared: int = 3) -> DataFrame:
    """(a, b, shared, similarity) of the sets in ``x`` (a, set) and ``y`` (b, set) with at least this Jaccard similarity and ``shared`` elements.

    Prefix filter: sets this similar share one of their rarest elements, so only
    those meet in the join; common ones never do. The result is exact.
    """
    df = x.select(F.explode("set").alias("t")).unionByName(y.select(F.explode("set").alias("t"))).groupBy("t").agg(F.count("*").alias("df"))

    def prefix(side: DataFrame, name: str) -> DataFrame:
        # sorted by rarity; a set of n elements needs its first n - ceil(threshold * n) + 1
        tokens = side.select(name, F.size("set").alias("n"), F.explode("set").alias("t")).join(df, "t")
        rank = F.row_number().over(Window.partitionBy(name).orderBy("df", "t"))
        return tokens.withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select(name, "t")

    pairs = prefix(x, "a").join(prefix(y, "b"), "t").select("a", "b").distinct()
    both = pairs.join(x.withColumnRenamed("set", "sa"), "a").join(y.withColumnRenamed("set", "sb"), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", inter.alias("shared"), (inter / (F.size("sa") + F.size("sb") - inter)).alias("similarity")).filter((F.col("similarity") >= threshold) & (F.col("shared") >= shared))


def similar_pairs(a: DataFrame, b: DataFrame, id_a: str, id_b: str, text_a: str, text_b: str, threshold: float = 0.9, shared: int = 3) -> DataFrame:
    """Pairs (id_a, id_b) whose sets of content tokens are similar: see ``similar_sets``."""
    sets = lambda df, key, text, name: df.select(F.col(key).alias(name), F.array_distinct(T.content_tokens(F.col(text))).alias("set")).filter(F.size("set") >= shared)
    return similar_sets(sets(a, id_a, text_a, "a"), sets(b, id_b, text_b, "b"), threshold, shared)


#: Ranges of token hashes whose occurrences are counted, and bits of the sketch of a set.
RANGES, BITS = 1 << 16, 256


def _rarest(counts: np.ndarray, threshold: float):
    """For sets as hashes: a row for each of the rarest ones that sets this similar have to share one of, with its place and the set's sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("hashes")
            n, t = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), held.flatten().to_numpy(zero_copy_only=False)
            owner, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            # a bit for each hash, told by parity: of two sets, bits that differ are no more than elements that do
            odd = (np.bincount(owner * BITS + ((t >> 40) & (BITS - 1)), minlength=len(n) * BITS) & 1).astype(np.uint8)
            sketch = np.packbits(odd.reshape(len(n), BITS), axis=1).view(np.int64)
            t = t[np.lexsort((t, counts[t & (RANGES - 1)], owner))]
            place = np.arange(len(t)) - start[owner]
            kept = place <= (n - np.ceil(threshold * n - 1e-9))[owner]
            whose = owner[kept]
            kind = {c: batch.column(c).take(pa.array(whose)) for c in ("k", "one", "two")}
            yield pa.RecordBatch.from_pydict(kind | {"t": t[kept], "n": n[whose], "place": place[kept]} | {f"s{i}": sketch[whose, i] for i in range(BITS // 64)})

    return rows


def _near(classes: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """(a, b, differ, a_train, a_validation, need_train, need_validation) of classes that may be similar and of which ``b`` looks for an ``a``; a pair can come more than once."""
    # different sets this similar have so many elements at least
    rows = classes.filter(F.size("hashes") >= math.ceil(threshold / (1 - threshold) - 1e-9)) if threshold < 1 else classes.filter("false")
    schema = "k binary, one boolean, two boolean, t long, n long, place long, " + ", ".join(f"s{i} long" for i in range(BITS // 64))
    side = lambda one, two, name: rows.select("k", "hashes", one.alias("one"), two.alias("two")).filter("one OR two").mapInArrow(_rarest(counts, threshold), schema).select("t", *(F.col(c).alias(f"{name}_{c}") for c in ("k", "one", "two", "n", "place", *(f"s{i}" for i in range(BITS // 64)))))
    x, y = side(F.col("train") > 0, F.col("validation") > 0, "a"), side(F.col("need_train"), F.col("need_validation"), "b")
    least = F.ceil((F.col("a_n") + F.col("b_n")) * (threshold / (1 + threshold)) - 1e-9)
    differ = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(BITS // 64)), F.lit(0))
    met = x.join(y, "t").filter((F.col("a_k") != F.col("b_k")) & ((F.col("a_one") & F.col("b_one")) | (F.col("a_two") & F.col("b_two"))))
    # at the first element that two sets share, no more than the rest of either can follow
    met = met.filter((F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) >= least) & (differ <= F.col("a_n") + F.col("b_n") - 2 * least))
    return met.select(F.col("a_k").alias("a"), F.col("b_k").alias("b"), differ.alias("differ"), (F.col("a_one") & F.col("b_one")).alias("one"), (F.col("a_two") & F.col("b_two")).alias("two"))


def _confirmed(pairs: DataFrame, classes: DataFrame, threshold: float, shared: int) -> DataFrame:
    """(b, one, two): whether pairs (a, b, one, two) that are similar by their whole sets say so, for each ``b``."""
    sets = lambda name: classes.select(F.col("k").alias(name), F.col("words").alias(f"w{name}"))
    both = pairs.join(sets("a"), "a").join(sets("b"), "b").select("b", "one", "two", F.split("wa", " ").alias("x"), F.split("wb", " ").alias("y"))
    both = both.withColumn("_i", F.size(F.array_intersect("x", "y")))
    fits = both.filter((F.col("_i") >= shared) & (F.col("_i") / (F.size("x") + F.size("y") - F.col("_i")) >= threshold))
    return fits.groupBy("b").agg(F.max("one").alias("one"), F.max("two").alias("two"))


def token_set(text: Column) -> Column:
    """The different content tokens of a text in order, a space between."""
    return F.array_join(F.sort_array(F.array_distinct(T.content_tokens(text))), " ")


def token_set_key(text: Column) -> Column:
    return F.unhex(F.sha1(token_set(text)))


def leaked(splits: DataFrame, key: str, docs: DataFrame, text_col: str, threshold: float = 0.9, shared: int = 3) -> DataFrame:
    """How many rows of each later split have a near copy in an earlier one: (pair, n).

    ``splits``: split and ``token_set_key`` of each of ``docs``, so that no text goes through the splitting.

    Rows with equal sets of tokens are one class with a count for each split, kept
    on disk; copies are never made into pairs, and a class that has copies in an
    earlier split looks for nothing there. Others meet by their rarest tokens, by
    the counts of ``RANGES`` ranges of hashes, so a set is ordered in its own row
    and only these tokens are shuffled, with a sketch of the set that rules most
    meetings out. Each class is compared by whole sets with the likeliest one
    first, with all others it met only if that one isn't similar. The result is
    exact but for tokens of equal 64-bit hashes.
    """
    names = ("train", "validation", "test")
    sizes = splits.groupBy(F.col(key).alias("k")).agg(*(F.count_if(F.col("split") == s).alias(s) for s in names))
    sets = docs.select(token_set(F.col(text_col)).alias("words")).filter((F.col("words") != "") & (F.size(F.split("words", " ")) >= shared))
    sets = sets.groupBy(F.unhex(F.sha1("words")).alias("k")).agg(F.first("words").alias("words"))
    classes = sets.join(sizes, "k").persist(StorageLevel.DISK_ONLY)
    no = lambda c: F.col(c) == 0
    seeking = classes.withColumns({
        "need_train": no("train") & (~no("validation") | ~no("test")), "need_validation": no("validation") & ~no("test"), "hashes": F.transform(F.split("words", " "), lambda w: F.xxhash64(w)),
    })
    counts = np.zeros(RANGES, dtype=np.int64)
    for r in seeking.select(F.explode("hashes").alias("h")).groupBy(F.col("h").bitwiseAND(RANGES - 1).alias("at")).agg(F.count("*").alias("n")).collect():
        counts[r["at"]] = r["n"]
    met = _near(seeking, counts, threshold)
    likely = met.groupBy("b").agg(*(F.min_by("a", F.when(F.col(c), F.col("differ"))).alias(c) for c in ("one", "two")))
    likely = likely.select("b", F.inline(F.array(*(F.struct(F.col(c).alias("a"), F.lit(c == "one").alias("one"), F.lit(c == "two").alias("two")) for c in ("one", "two"))))).filter("a IS NOT NULL")
    first = _confirmed(likely, classes, threshold, shared).persist(StorageLevel.DISK_ONLY)
    left = met.join(first.select("b", F.col("one").alias("_one"), F.col("two").alias("_two")), "b", "left")
    left = left.withColumns({c: F.col(c) & ~F.coalesce(f"_{c}", F.lit(False)) for c in ("one", "two")}).filter("one OR two").select("a", "b", "one", "two").distinct()
    found = first.unionByName(_confirmed(left, classes, threshold, shared)).groupBy(F.col("b").alias("k")).agg(F.max("one").alias("one"), F.max("two").alias("two"))
    rows = classes.join(found, "k", "left").select(*names, *(((F.col(s) > 0) | F.coalesce(c, F.lit(False))).alias(f"in_{s}") for s, c in (("train", "one"), ("validation", "two"))))
    ways = [("train", "validation"), ("train", "test"), ("validation", "test")]
    sums = rows.agg(*(F.coalesce(F.sum(F.when(F.col(f"in_{a}"), F.col(b))), F.lit(0)).alias(f"{a}->{b}") for a, b in ways))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(f"{a}->{b}").alias("pair"), F.col(f"`{a}->{b}`").alias("n")) for a, b in ways))))


def merge_new(existing: DataFrame, new: DataFrame, key: Column, order: Column) -> DataFrame:
    """Existing rows, and those new ones whose key neither they nor an earlier new row has. A null key is like no other: its rows all stay."""
    fresh = new.withColumn("_key", key).join(existing.select(key.alias("_key")).distinct(), "_key", "left_anti")
    first = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("_key", F.when(F.col("_key").isNull(), order)).orderBy(order))).filter("_r = 1 OR _key IS NULL").drop("_r", "_key")
    return existing.unionByName(first)


def statistics(df: DataFrame, question: str) -> DataFrame:
    """Counts by split, source, and each crossed, with question lengths, in one pass."""
    n = F.length(question)
    return df.groupingSets([["split"], ["source"], ["split", "source"], []], "split", "source").agg(
        F.count("*").alias("n"), F.min(n).alias("min_chars"), F.avg(n).alias("mean_chars"), F.max(n).alias("max_chars"), F.grouping_id().alias("level")
    )


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows of each value of a taxonomy; 0 for one that no row has."""
    spark = df.sparkSession
    names = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, place int")
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return names.hint("broadcast").join(n, "value", "left").select("value", "place", F.coalesce("n", F.lit(0)).alias("n"))


def uncovered(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Values of a taxonomy that no row has."""
    return zero_filled(df, column, values).filter("n = 0").select("value")


def random_negatives(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Each row with another one: the next by a seeded hash of the key, around the end."""
    hashed = df.select(key, F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), F.lit(12)), 16, 10).cast("long").alias("_h"))
    ranked = global_rank(hashed, "_h", (key,)).select(key, "place")
    n = F.lit(df.count())
    other = ranked.select(F.col("place").alias("_p"), F.col(key).alias("negative"))
    return ranked.join(other, F.pmod(F.col("place") + 1, n) == F.col("_p")).select(F.col(key).alias("positive"), "negative")


def shifted_pairs(df: DataFrame, order: str, shift: int = 37) -> DataFrame:
    """Each row with the row ``shift`` places on, around the end: negatives for a scorer.

    Places come from counts of ranges, so no task sorts the whole table.
    """
    ranked = global_rank(df, order)
    n = F.lit(df.count())
    other = ranked.select(F.col("place").alias("_p"), F.col(order).alias("negative"))
    return ranked.join(other, F.pmod(F.col("place") + shift, n) == F.col("_p")).select(F.col(order).alias("positive"), "negative")


#: Different values of a bracket that are told apart at once.
TOLD_APART = 50_000


def _values_at(values: DataFrame, n: int, low: int, high: int, rough: float) -> dict[int, float]:
    """The values at two places (from 0) in order: a bracket is narrowed until few different values are in it."""
    part, before, size = values, 0, n
    while True:
        near = lambda place, by: min(max((place - before + 0.5) / size + by, 0.0), 1.0)  # noqa: B023, E731
        a, b = part.approxQuantile("x", [near(low, -2 * rough), near(high, 2 * rough)], rough)
        inside = part.filter((F.col("x") >= a) & (F.col("x") <= b))
        got = part.agg(F.count_if(F.col("x") < a).alias("below"), F.count_if((F.col("x") >= a) & (F.col("x") <= b)).alias("n")).first()
        counts = inside.groupBy("x").agg(F.count("*").alias("c"))
        rows = counts.limit(TOLD_APART + 1).collect()
        before += got["below"]
        if len(rows) <= TOLD_APART:
            return _found(rows, before, (low, high))
        if got["n"] == size:  # no longer narrowed: fewer rows than the rough quantiles tell apart
            return _found(counts.collect(), before, (low, high))
        part, size = inside, got["n"]


def _found(rows: list, before: int, places: tuple[int, ...]) -> dict[int, float]:
    at = {}
    for x, c in sorted((r["x"], r["c"]) for r in rows):
        at.update({p: x for p in places if before <= p < before + c})
        before += c
    return at


def exact_quantiles(df: DataFrame, column: str, shares: tuple[float, ...], buckets: int = 2048) -> list[float | None]:
    """Quantiles of a numeric column, interpolated, from exact counts; null and NaN don't count.

    Rough quantiles, with an error of one in ``buckets``, bracket each wanted place; the values in all brackets are
    counted at once. Where those are too many to tell apart, each bracket is
    narrowed in the same way. Rows are only compared with bounds.
    """
    values = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    n, rough = values.count(), 1 / buckets
    if not n:
        return [None for _ in shares]
    places = [(math.floor(q * (n - 1)), math.ceil(q * (n - 1))) for q in shares]
    cuts = values.approxQuantile("x", [min(max((p + 0.5) / n + by, 0.0), 1.0) for low, high in places for p, by in ((low, -2 * rough), (high, 2 * rough))], rough)
    brackets = list(zip(cuts[::2], cuts[1::2]))
    within = [(F.col("x") >= a) & (F.col("x") <= b) for a, b in brackets]
    below = values.agg(*(F.count_if(F.col("x") < a).alias(f"b{i}") for i, (a, _) in enumerate(brackets))).first()
    rows = values.filter(reduce(lambda a, b: a | b, within)).groupBy("x").agg(F.count("*").alias("c")).limit(TOLD_APART + 1).collect()
    found = []
    for i, ((low, high), (a, b), q) in enumerate(zip(places, brackets, shares)):
        at = _found([r for r in rows if a <= r["x"] <= b], below[f"b{i}"], (low, high)) if len(rows) <= TOLD_APART else _values_at(values, n, low, high, rough)
        found.append(at[low] + (at[high] - at[low]) * (q * (n - 1) - low))
    return found


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted ``bounds`` lie below a value: among every sixteenth, then among those in between."""
    groups = [bounds[i : i + 16] for i in range(0, len(bounds), 16)]
    below = lambda found: F.size(F.filter(found, lambda b: b < value))
    group = F.greatest(below(F.lit([g[0] for g in groups]).cast("array<double>")), F.lit(1))
    return F.lit(0) if not groups else (group - 1) * 16 + below(F.element_at(F.array(*(F.lit(g).cast("array<double>") for g in groups)), group))


def global_rank(df: DataFrame, order: str, ties: tuple[str, ...] = (), buckets: int = 256) -> DataFrame:
    """Adds place (from 0) in the order of a numeric column, then ``ties``: ranks within quantiles of it, plus what lies in the quantiles before."""
    bounds = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
    at = bucket_of(F.col(order), bounds)
    held = df.withColumn("_b", at)
    sizes = held.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_b"), (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(order, *ties)) - 1
    return held.withColumn("_r", rank).join(before, "_b").withColumn("place", F.col("_r") + F.col("_before")).drop("_b", "_r", "_before")
