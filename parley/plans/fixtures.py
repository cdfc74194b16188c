"""Queries of CVs, audio features and record shapes, made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import audio as A
from parley.operators import cv as C
from parley.operators import evaluation as E
from parley.plans import sql as Q
from parley.plans.tables import table
from parley.sources import readers as S

AS_OF = (2024, 6)
SIGNALS = {"data": ["Brand#11", "Brand#12", "Brand#13"], "network": ["Brand#21", "Brand#22"], "design": ["Brand#31"], "lead": ["Brand#41", "Brand#42", "Brand#43", "Brand#44"]}


def _month(at, months):
    return F.date_format(F.add_months(F.col("o_orderdate").cast("date"), months), "MM/yyyy")


def _cvs(spark, sf_dir):
    """A CV of every customer: each order is a role, from its month on for up to 30 months; a fifth have none."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    months = (F.col("o_orderkey") % 30).cast("int")
    line = F.concat(F.lit("Role "), F.col("o_orderkey").cast("string"), F.lit("  "), _month("o_orderdate", F.lit(0)), F.lit(" to "), F.when(F.col("o_orderkey") % 11 == 0, "present").otherwise(_month("o_orderdate", months)))
    roles = o.filter("o_custkey % 5 > 0").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda r: r["l"]), "\n").alias("roles"))
    rows = c.join(roles, F.col("c_custkey") == F.col("o_custkey"), "left")
    phone = F.format_string("+94 %09d", F.col("c_custkey") + 100_000_000)
    text = F.concat(
        F.lit("Person "), F.col("c_custkey").cast("string"), F.lit("\nc"), F.col("c_custkey").cast("string"), F.lit("@mail.example\n"), phone, F.lit("\n\n"), F.when(F.col("c_custkey") % 2 == 0, "Work Experience\n").otherwise("EMPLOYMENT:\n"), F.coalesce("roles", F.lit("")),
        F.lit("\n2. Skills & Tools\n"), F.col("c_mktsegment"), F.lit("\nhttps://example.test/"), F.col("c_custkey").cast("string"), F.lit("\n"),
    )
    return rows.select(F.col("c_custkey").alias("cv_id"), text.alias("text"))


def cv_sections(spark, sf_dir):
    """Lines of each CV by section."""
    return C.lines(_cvs(spark, sf_dir), "cv_id", "text").groupBy("cv_id", "section").agg(F.count("*").alias("n"))


def cv_tenure(spark, sf_dir):
    """Months of experience, parallel roles once."""
    rows = C.lines(_cvs(spark, sf_dir), "cv_id", "text").filter("section = 'experience'")
    return C.tenure(rows, "cv_id", "line", AS_OF)


def cv_contacts(spark, sf_dir):
    c = C.contacts(F.col("text"))
    return _cvs(spark, sf_dir).select("cv_id", c.alias("c")).select("cv_id", F.array_join("c.emails", ",").alias("emails"), F.size("c.phones").alias("phones"), F.array_join("c.links", ",").alias("links"))


def _bought(spark, sf_dir):
    o, li, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("o_custkey").alias("cv_id")).agg(F.collect_set("p_brand").alias("have"), F.collect_set(F.when(F.col("l_quantity") > 45, F.col("p_brand"))).alias("shown"), F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


def cv_tracks(spark, sf_dir):
    return C.tracks(_bought(spark, sf_dir), "cv_id", "have", "shown", SIGNALS).select("cv_id", "place", "track", "matches", "confidence")


def cv_readiness(spark, sf_dir):
    n = F.col("n").cast("int")
    rows = _bought(spark, sf_dir)
    score = C.readiness(F.size("have"), F.size("shown"), n % 7, F.when(n % 9 > 0, n / 10), F.element_at(F.array(F.lit(0.0), F.lit(5.0), F.lit(8.0), F.lit(10.0)), (n % 4 + 1).cast("int")), n % 5, n % 6, F.col("q"))
    return rows.select("cv_id", F.round(score, 6).alias("readiness"))


def cv_confidence(spark, sf_dir):
    """Share of a CV's expected parts that were found."""
    c = C.contacts(F.col("text"))
    rows = _cvs(spark, sf_dir).select("cv_id", (F.size(c["emails"]) > 0).alias("mail"), (F.size(c["links"]) > 0).alias("link"))
    found = C.lines(_cvs(spark, sf_dir), "cv_id", "text").groupBy("cv_id").agg(F.collect_set("section").alias("s"))
    signals = [F.col("mail"), F.col("link"), F.array_contains("s", "experience"), F.array_contains("s", "skills"), F.array_contains("s", "education"), F.size("s") >= 3]
    return rows.join(found, "cv_id").select("cv_id", C.share_found(*signals).alias("confidence"))


def audio_scores(spark, sf_dir):
    """Delivery from features: a vector's parts stand for level, crossings and pitch."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("e"))
    pitch = F.transform(F.slice("e", 9, 8), lambda x: F.when(x > 0.25, F.lit(float("nan"))).otherwise(100 + x))
    few = F.col("vec_id") % 10 == 0
    level = F.when(few, F.array().cast("array<double>")).otherwise(F.slice("e", 1, 4))
    a = A.confidence(pitch, level, F.lit(60.0))
    b = A.fluency((F.col("vec_id") % 70) / 100, F.when(few, F.array().cast("array<double>")).otherwise(F.slice("e", 5, 4)), F.col("vec_id") % 4, F.col("vec_id") % 90)
    return v.select("vec_id", F.round(a, 5).alias("confidence"), F.round(b, 5).alias("fluency"))


def feature_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("e"))
    f = A.feature_vector(F.col("vec_id") % 220, F.lit(70.0), F.lit(60.0), F.slice("e", 1, 4), F.slice("e", 9, 8), F.lit(0.2), F.slice("e", 1, 13))
    return v.select("vec_id", F.size(f).alias("n"), F.round(f[0], 5).alias("wpm"), F.round(f[3], 5).alias("speed"), F.round(f[4], 5).alias("level"), F.round(f[5], 5).alias("pitch"), F.round(f[20], 5).alias("last"))


def transcript_clean(spark, sf_dir):
    """Words said over and over, and space around marks: every third word of a turn is said as often as its turn's number."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    said = F.array_join(F.flatten(F.transform(words, lambda w, i: F.when(i % 3 == 0, F.array_repeat(w, (F.col("turn") % 5 + 1).cast("int"))).otherwise(F.array(w)))), " ")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))
    return t.select("conv_id", "turn", F.md5(A.collapse_repeats(F.col("said"))).alias("once"), F.md5(A.punctuation(F.col("said"))).alias("spaced"))


def promotion_gate(spark, sf_dir):
    """Runs of forty groups of buyers: even orders give a run's base, odd ones the run."""
    odd = F.col("o_orderkey") % 2 == 1
    closed = lambda wanted, states: F.count_if(wanted & F.col("o_orderstatus").isin(states)) / F.greatest(F.count_if(wanted), F.lit(1))
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("run")).agg(
        (F.coalesce(F.avg(F.when(~odd, F.col("o_totalprice"))), F.lit(0.0)) / 10_000).alias("base_perplexity"), (F.coalesce(F.avg(F.when(odd, F.col("o_totalprice"))), F.lit(0.0)) / 11_900).alias("perplexity"),
        closed(~odd, ["F"]).alias("base_rouge_l"), closed(odd, ["F", "P"]).alias("rouge_l"), (F.count_distinct("o_orderpriority") / 5).alias("domain_coverage"), (F.count("*") % 300).cast("double").alias("latency_ms"),
    )
    out = E.gate(rows)
    return out.select("run", *(F.round(c, 4).alias(c) for c in ("base_perplexity", "perplexity", "base_rouge_l", "rouge_l", "domain_coverage", "latency_ms")), "perplexity_ok", "rouge_ok", "coverage_ok", "latency_ok", "approved")


def record_shapes(spark, sf_dir):
    k = F.col("doc_id") % 6
    has = lambda *n: F.when(k.isin(*n), F.col("text"))
    cols = {"instruction": has(0), "input": has(5), "output": has(0, 5), "prompt": has(1), "completion": has(1, 2), "question": has(2, 3), "answer": has(2), "text": F.col("text")}
    return table(spark, sf_dir, "documents").select("doc_id", S.schema_kind(cols).alias("kind"))


QUERIES = [cv_sections, cv_tenure, cv_contacts, cv_tracks, cv_readiness, cv_confidence, audio_scores, feature_vectors, transcript_clean, promotion_gate, record_shapes]

_ROLES = """ro AS (SELECT o_custkey AS cv_id, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS s, CASE WHEN o_orderkey % 11 = 0 THEN 24293 ELSE year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 30 END AS e FROM orders WHERE o_custkey % 5 > 0),
rg AS (SELECT cv_id, least(s, e) AS s, least(greatest(s, e), 24293) AS e FROM ro WHERE least(s, e) <= 24293 AND greatest(s, e) - least(s, e) <= 540)"""
_BOUGHT = """bo AS (SELECT o_custkey AS cv_id, list(DISTINCT p_brand) AS have, coalesce(list(DISTINCT p_brand) FILTER (l_quantity > 45), []) AS shown, count(*) AS n, sum(l_quantity) AS q
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1)"""
_ABS = "(SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS e FROM embeddings)"


def _steady(a: str, factor: int, default: float) -> str:
    return f"CASE WHEN len({a}) > 0 THEN greatest(0, least(100, 100 - list_stddev_pop({a}) / (list_avg({a}) + 1e-6) * {factor})) ELSE {default}::DOUBLE END"


ORACLE = {
    "cv_sections": """SELECT c_custkey AS cv_id, 'header' AS section, 3::BIGINT AS n FROM customer UNION ALL SELECT c_custkey, 'skills', 2 FROM customer
UNION ALL SELECT o_custkey, 'experience', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 5 > 0 GROUP BY 1""",
    "cv_tenure": f"""WITH {_ROLES}, m AS (SELECT DISTINCT cv_id, unnest(range(s, e + 1)) AS m FROM rg), c AS (SELECT cv_id, count(*) AS months FROM m GROUP BY 1), y AS (SELECT *, round(months / 12, 1) AS years FROM c)
SELECT cv_id, months, years, CASE WHEN years < 1 THEN 'entry' WHEN years < 3 THEN 'junior' WHEN years < 6 THEN 'mid' WHEN years < 10 THEN 'senior' ELSE 'principal' END AS seniority FROM y""",
    "cv_contacts": "SELECT c_custkey AS cv_id, 'c' || c_custkey || '@mail.example' AS emails, 1::INT AS phones, 'https://example.test/' || c_custkey AS links FROM customer",
    "cv_tracks": f"""WITH {_BOUGHT}, t(i, track, w) AS (VALUES {", ".join(f"({i}, {Q.lit(k)}, {Q.arr(v)})" for i, (k, v) in enumerate(SIGNALS.items()))}),
h AS (SELECT cv_id, i, track, len(list_intersect(w, have)) AS m, round(least(1, (len(list_intersect(w, have)) + len(list_intersect(list_intersect(w, have), shown))) / (len(w) * 2) * 2.4::DOUBLE), 2) AS c FROM bo, t)
SELECT cv_id, (row_number() OVER (PARTITION BY cv_id ORDER BY m DESC, c DESC, i))::INT AS place, track, m::INT AS matches, c AS confidence FROM h WHERE m > 0""",
    "cv_readiness": f"""WITH {_BOUGHT} SELECT cv_id, round(least(100, least(len(have) * 2.2::DOUBLE, 22) + least(len(shown) * 3.0::DOUBLE, 18) + least(n % 7 * 2.2::DOUBLE, 14) + least(CASE WHEN n % 9 > 0 THEN n / 10 ELSE 0 END * 4.0::DOUBLE, 20)
  + [0, 5, 8, 10][n % 4 + 1] + least(n % 5 * 3.0::DOUBLE, 8) + least(n % 6 * 2.0::DOUBLE, 8) + CASE WHEN q > 1800 THEN 4 WHEN q > 600 THEN 2 ELSE 0 END), 6) AS readiness FROM bo""",
    "cv_confidence": """SELECT c_custkey AS cv_id, CASE WHEN c_custkey % 5 > 0 AND c_custkey IN (SELECT o_custkey FROM orders) THEN 0.83::DOUBLE ELSE 0.5 END AS confidence FROM customer""",
    "audio_scores": f"""WITH v AS (SELECT vec_id, e, CASE WHEN vec_id % 10 = 0 THEN [] ELSE e[1:4] END AS rms, CASE WHEN vec_id % 10 = 0 THEN [] ELSE e[5:8] END AS zcr, list_transform(list_filter(e[9:16], lambda x: x <= 0.25), lambda x: 100 + x) AS f0 FROM {_ABS})
SELECT vec_id, round((CASE WHEN len(f0) > 5 THEN {_steady('f0', 200, 50)} ELSE 50 END * 0.40::DOUBLE + CASE WHEN len(rms) > 0 THEN least(100, greatest(0, list_avg(rms) / 0.15::DOUBLE * 80)) ELSE 50 END * 0.35::DOUBLE + {_steady('rms', 60, 50)} * 0.25::DOUBLE) * 0.70::DOUBLE + 18.0::DOUBLE, 5) AS confidence,
round(CASE WHEN s < 0.10::DOUBLE THEN 75 WHEN s <= 0.30::DOUBLE THEN 100 WHEN s <= 0.50::DOUBLE THEN greatest(0, 100 - (s - 0.30::DOUBLE) * 200) ELSE 10 END * 0.40::DOUBLE + {_steady('zcr', 80, 60)} * 0.25::DOUBLE + greatest(0, 100 - vec_id % 4 / greatest(vec_id % 90, 1) * 100 * 15) * 0.35::DOUBLE, 5) AS fluency
FROM (SELECT *, vec_id % 70 / 100 AS s FROM v)""",
    "feature_vectors": f"""WITH v AS (SELECT vec_id, e, (vec_id % 220)::DOUBLE AS w FROM {_ABS})
SELECT vec_id, 21::INT AS n, w AS wpm, round(CASE WHEN w <= 0 THEN 50 WHEN w < 80 THEN w / 80 * 55 WHEN w < 120 THEN 55 + (w - 80) / 40 * 25 WHEN w <= 160 THEN 80 + (w - 120) / 40 * 20 WHEN w <= 200 THEN greatest(50, 100 - (w - 160) / 40 * 30) ELSE 20 END, 5) AS speed,
round(list_avg(e[1:4]), 5) AS level, round(list_avg(e[9:16]), 5) AS pitch, round(e[13], 5) AS last FROM v""",
    "transcript_clean": rf"""WITH w AS (SELECT conv_id, turn, {Q.words("coalesce(text, '')")} AS ws FROM conversations),
f AS (SELECT conv_id, turn, flatten(list_transform(ws, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN list_transform(range(0, turn % 5 + 1), lambda z: x) ELSE [x] END)) AS fs FROM w),
g AS (SELECT conv_id, turn, list_filter(fs, lambda x, i: NOT (i > 2 AND fs[greatest(i - 1, 1)] = x AND fs[greatest(i - 2, 1)] = x)) AS kept, array_to_string(fs, ' ') AS said FROM f)
SELECT conv_id, turn, md5(array_to_string(kept, ' ')) AS once, md5(trim(regexp_replace(regexp_replace(regexp_replace(said, '\s+([.,!?])', '', 'g'), '([.,!?])(\S)', ' ', 'g'), '\s+', ' ', 'g'))) AS spaced FROM g""",
    "record_shapes": """SELECT doc_id, CASE WHEN text IS NULL THEN 'unknown' ELSE ['instruction_io', 'prompt_completion', 'question_answer', 'question_only', 'raw_text', 'instruction_io'][doc_id % 6 + 1] END AS kind FROM documents""",
    "promotion_gate": """WITH r AS (SELECT o_custkey % 40 AS run, coalesce(avg(o_totalprice) FILTER (o_orderkey % 2 = 0), 0) / 10000 AS base_perplexity, coalesce(avg(o_totalprice) FILTER (o_orderkey % 2 = 1), 0) / 11900 AS perplexity,
  count(*) FILTER (o_orderkey % 2 = 0 AND o_orderstatus = 'F') / greatest(count(*) FILTER (o_orderkey % 2 = 0), 1) AS base_rouge_l, count(*) FILTER (o_orderkey % 2 = 1 AND o_orderstatus IN ('F', 'P')) / greatest(count(*) FILTER (o_orderkey % 2 = 1), 1) AS rouge_l,
  count(DISTINCT o_orderpriority) / 5 AS domain_coverage, (count(*) % 300)::DOUBLE AS latency_ms FROM orders GROUP BY 1),
c AS (SELECT *, (base_perplexity - perplexity) / greatest(base_perplexity, 1e-5) * 100 >= 15 AS perplexity_ok, (rouge_l - base_rouge_l) / greatest(base_rouge_l, 1e-5) * 100 >= 10 AS rouge_ok, domain_coverage >= 0.9 AS coverage_ok, latency_ms <= 150 AS latency_ok FROM r)
SELECT run, round(base_perplexity, 4) AS base_perplexity, round(perplexity, 4) AS perplexity, round(base_rouge_l, 4) AS base_rouge_l, round(rouge_l, 4) AS rouge_l, round(domain_coverage, 4) AS domain_coverage, round(latency_ms, 4) AS latency_ms, perplexity_ok, rouge_ok, coverage_ok, latency_ok, perplexity_ok AND rouge_ok AND coverage_ok AND latency_ok AS approved FROM c""",
}
