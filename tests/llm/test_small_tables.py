"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names have defined results."""

import zlib

import pytest
from pyspark.sql import functions as F

from parley.llm import gif, langid, licenses, minhash, mixing, pieces, quality, sharding, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, size int, score double"
ROWS = [
    (1, None, None, None, None, None, None, None), (2, "", "en", "a", 0, "x", 1, 0.5), (3, " \t\n ", "en", "a", 4, "x", 1, 0.5), (4, "one two", "en", "b", 7, "x", 1, 0.5),
    (5, "the quick brown fox jumps over the lazy dog " * 3, "en", "b", 1, "x", 1, 0.5), (6, "the quick brown fox jumps over the lazy dog " * 3, "en", None, 1, "x", 1, 0.5), (6, "the quick brown fox jumps over the lazy dog " * 3, "en", None, 1, "x", 1, 0.5),
    (7, "w%d " * 3000 % tuple(range(3000)), "de", "c", 1, "x", 1, 0.5), (8, "Under the MIT License. CC BY-NC; apache license, version 2 é1 under  the mit license", "fr", "c", 1, "x", 1, 0.5), (9, "12345 ... —", "fr", "c", 1, "x", 1, 0.5),
]
LABELS = [(i, i % 2, int(i in (4, 8))) for i in range(2, 10)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def by_id(df, id_col="doc_id"):
    return {r[id_col]: r for r in df.collect()}


def test_licenses(docs, empty):
    got = by_id(licenses.scan_licenses(docs))
    assert licenses.scan_licenses(docs).count() == len(ROWS)
    r = got[8]
    assert (r["n_base"], r["first_word"], r["last_word"]) == (4, 0, 12)
    assert r["base_labels"] == "apache-2,cc-by-nc,mit" and r["n_words"] == 16 and r["score"] == 1.0
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["labels"], got[1]["score"]) == (0, 0, None, "", 0.0)
    assert licenses.scan_licenses(empty).count() == 0


def test_long_notice_is_found_by_its_key_phrase(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of that software"
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["labels"] == "mit" and r["base_labels"] == "" and 0 < r["score"] < 1


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    got = {}
    for r in rows:
        got.setdefault(r["target"], [0, r["source_size"]])[0] += r["taken"]
    assert all(t <= 3 * size + 1e-6 for t, (_, size) in got.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(empty).count() == 0


def test_targets_stop_at_three_times_the_source():
    import numpy as np

    t = mixing.targets_of(np.array([10.0, 1000.0, 1000.0]), np.array([5.0, 2.0, 1.0]))
    assert t[0] == 30 and t.sum() == pytest.approx(2010) and t[1] == pytest.approx(2 * t[2])
    assert (mixing.targets_of(np.zeros(2), np.array([5.0, 2.0])) == 0).all()


def test_mix_comes_near_its_targets(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i * 7 % 50), f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 3 for r in rows)


def test_hot_stratum_is_dealt_evenly(spark):
    df = spark.createDataFrame([(i, "a b c", "x" if i < 2000 else "y") for i in range(2500)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("copies").alias("hi"), F.min("copies").alias("lo")).collect()
    assert all(abs(r["t"] - r["g"]) <= 3 and r["hi"] - r["lo"] <= 1 for r in rows)


def brute_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, used, room = (lo + hi) // 2, 1, (lo + hi) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        lo, hi = (lo, mid) if used <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("buckets,singles", [(1 << 14, 50_000), (8, 10)])
def test_sharding_is_the_minimax_partition(spark, monkeypatch, buckets, singles):
    monkeypatch.setattr(sharding, "BUCKETS", buckets)
    monkeypatch.setattr(sharding, "SINGLES", singles)
    df = spark.createDataFrame([(i, "x" * (i * 37 % 91) + str(i // 3)) for i in range(300)], "doc_id long, text string")
    rows = sharding.shard_documents(df).collect()
    groups = df.select(F.xxhash64("text").alias("k"), (F.octet_length("text") + 1).alias("n")).groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()
    held = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(r)
    assert max(sum(r["size"] for r in v) for v in held.values()) == brute_capacity([g["n"] for g in groups], 16)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in held.values())
    text = dict(df.collect())
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    where = {}
    assert all(where.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"] for r in rows)


def test_sharding_of_odd_rows(docs, empty):
    rows = by_id(sharding.shard_documents(docs))
    assert rows[1]["size"] == 1 and rows[1]["text_crc32"] == 0 and rows[2]["shard"] == rows[1]["shard"] and rows[1]["grown_shard"] is None
    assert sharding.shard_documents(docs).count() == len(ROWS)
    assert sharding.shard_documents(empty).count() == 0


def test_near_duplicates_of_odd_rows(docs, empty):
    rows = minhash.near_duplicates(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS)
    assert [got[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and all(got[i]["kept"] for i in (1, 2, 3, 4, 7))
    assert got[6]["component_id"] == 5 and not got[6]["kept"]
    assert minhash.near_duplicates(empty).count() == 0


def test_vectors_of_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, nan], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1), (11, [0.0, 1.0], 1), (11, [0.0, 1.0], 1), (12, [], 1)]
    kind = "vec_id long, embedding array<float>, label int, size int"
    df = spark.createDataFrame([(*r, 0) for r in rows], kind)
    got = by_id(vectors.near_duplicate_vectors(df), "vec_id")
    assert vectors.near_duplicate_vectors(df).count() == len(rows)
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (1, 2, 3)] == [(2, 1), (2, 1), (2, 1)]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (4, 5, 6, 7, 8, 9, 10, 12)) and got[11]["n_links"] == 1
    assert vectors.near_duplicate_vectors(spark.createDataFrame([], kind)).count() == 0


def test_languages_of_odd_rows(docs, empty):
    got = by_id(langid.document_languages(docs))
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[9]["lang_pred"] == "und" and got[1]["score"] == 0
    assert got[5]["lang_pred"] in ("en", "de", "fr") and 0 <= got[5]["score"] <= 1
    assert langid.document_languages(empty).count() == 0


def test_quality_of_odd_rows(docs, empty, labels):
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["doc_id"] for r in rows if r["held_out"]} == {i for i in range(1, 10) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert quality.score_quality(docs, labels.limit(0)).count() == len(ROWS) and quality.score_quality(empty, labels).count() == 0


def test_toxicity_of_odd_rows(docs, empty, labels):
    rows = toxicity.grade_toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["severity"] <= 3 for r in rows)
    assert toxicity.grade_toxicity(docs, labels.limit(0)).filter("severity > 0").count() == 0 and toxicity.grade_toxicity(empty, labels).count() == 0


def test_pieces_of_odd_rows(docs, empty):
    rows = pieces.encode_texts(docs).collect()
    assert len(rows) == len(ROWS) and all(r["text_crc32"] == r["decoded_crc32"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_texts(pieces.encode_texts(docs)).collect()}
    assert back == {r[0]: r[1] or "" for r in ROWS}
    assert pieces.encode_texts(empty).count() == 0


def test_media_of_odd_rows(docs, empty):
    got = by_id(gif.store_texts(docs))
    assert got[1]["payload_bytes"] == got[2]["payload_bytes"] == 64 and got[1]["media_sha256"] == got[2]["media_sha256"]
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= r["n_bytes"] for r in got.values())
    assert gif.store_texts(empty).count() == 0
