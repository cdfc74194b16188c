"""The corpus pipeline and the queries of the subpackage."""

import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import langid, minhash, mixing, registry, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, names = docs.count(), docs.columns
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    known = corpus_pipeline.drop_unknown_language(spark, docs, SF)
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert clean.columns == known.columns == single.columns == mixed.columns == names
    toxic = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    kept = {r[0] for r in clean.select("doc_id").collect()}
    assert n - len(toxic) * 2 <= len(kept) < n and len(toxic - kept) > len(toxic) / 2
    assert 0.95 * n <= known.count() <= n
    assert single.count() == minhash.near_duplicates(docs, percent=corpus_pipeline.NEAR_PERCENT).filter("kept").count()
    taken = registry.queries()["op2_source_mix"](spark, SF).agg({"copies": "sum"}).first()[0]
    assert mixed.count() == taken


ODD = "doc_id long, text string, lang string, source string, n_chars long, copies int, row string, component_id long"
EVEN = [f"w{i}" for i in range(200)]


def odd(spark, rows):
    """Rows (doc_id, text) with other columns, some of which operators use too."""
    return spark.createDataFrame([(i, t, "en", ("a", "b", None)[k % 3], 1, k, f"r{k}", 7) for k, (i, t) in enumerate(rows)], ODD)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_duplicate_stage_keeps_every_text(spark):
    a, b, c = "a b c d e f g", " ".join(EVEN), "q"
    near = b + " more"
    docs = odd(spark, [(3, a), (5, b), (5, a), (7, c), (8, near), (None, "x y"), (None, "x y"), (None, None), (9, ""), (9, None), (7, c)])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert pairs(got) == sorted([(3, a), (5, b), (7, c), (None, "x y"), (None, None), (9, ""), (9, None)], key=str)


def test_near_duplicate_stage_against_all_pairs_at_80(spark):
    rng = random.Random(8)
    docs = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(104)]
        docs.append((len(docs), " ".join(words)))
        for changed in (1, 2, 3):
            copy = list(words)
            for at in rng.sample(range(10, 94), changed):
                copy[at] = f"new{at}"
            docs.append((len(docs), " ".join(copy)))
    for size in (89, 90, 91):
        docs += [(len(docs), " ".join(f"s{size}w{i}" for i in range(104))), (len(docs) + 1, " ".join(f"s{size}w{i}" for i in range(size - 6)))]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in docs}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = {r["doc_id"] for r in stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF).collect()}
    assert got == set(group.values())
    assert minhash.bands_for(85) == minhash.BANDS and (1 - 0.8**minhash.ROWS) ** minhash.bands_for(80) < 8.1e-6


def test_stages_with_odd_rows(spark):
    rows = [(1, None), (1, ""), (2, "the quick brown fox"), (2, "the quick brown fox"), (None, "some other words here"), (3, "12 34"), (4, "w " * 900_000)]
    docs, none = odd(spark, rows), spark.createDataFrame([], ODD)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, none, SF).count() == 0, name
        got = step(spark, docs, SF)
        if name != "sentencepiece":
            assert got.columns == docs.columns, name
            assert set(pairs(got)) <= set(pairs(docs)), name
    assert pairs(corpus_pipeline.drop_toxic(spark, docs, SF)) == pairs(docs)
    known = {t for _, t in pairs(corpus_pipeline.drop_unknown_language(spark, docs, SF))}
    assert None not in known and "" not in known and "12 34" not in known
    mixed = corpus_pipeline.mix(spark, docs, SF).collect()
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs.withColumn("doc_id", F.col("copies").cast("long"))).collect()}
    assert {k: sum(r["copies"] == k for r in mixed) for k in taken} == taken
    assert {r["copies"] for r in mixed} >= {0, 1}
    encoded = corpus_pipeline.encode(spark, docs, SF).collect()
    assert len(encoded) == len(rows) and sum(r["n_tokens"] == 0 for r in encoded) == 2


def test_run_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r[0] for r in toxicity.grade_toxicity(docs, labels).filter("toxic").select("doc_id").collect()}
    left = docs.filter(~F.col("doc_id").isin(list(toxic)))
    found = langid.identify(left, left.filter(~langid.held_out())).collect()
    left = {r["doc_id"]: r for r in left.collect() if r["doc_id"] in {f["doc_id"] for f in found if f["lang_pred"] != "und" and f["score"] >= corpus_pipeline.LEAST_LANGUAGE}}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, r in left.items() if (w := r["text"].encode().lower().split())}
    group = {d: d for d in left}
    for a in sets:
        for b in sets:
            if a < b and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.NEAR_PERCENT * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    stay = [left[d] for d in left if group[d] == d]
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(spark.createDataFrame(stay, docs.schema)).collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    got: dict[int, int] = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        assert r["text_crc32"] == r["decoded_crc32"] == zlib.crc32(left[r["doc_id"]]["text"].encode())
    assert got == {d: n for d, n in mixed.items() if n} and len(out) > 50


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    got, want = registry.queries()[name](spark, SF).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    key = got.columns[0]
    got, want = got.sort_values(key).reset_index(drop=True), want[list(got.columns)].sort_values(key).reset_index(drop=True)
    for k in got.columns:
        assert ((got[k] == want[k]) | (got[k].isna() & want[k].isna())).all(), k
