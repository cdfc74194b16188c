"""Queries that once did part of the job, against plain versions of the whole."""

import math
import random
import re
from collections import Counter

import numpy as np

from parley.functions import lexicons as L
from parley.operators import retrieval, spans
from parley.plans import analytics, corpus, services

SF = "/root/testdata/sf0.001"


def content(text):
    return [w for w in re.findall(r"[a-z0-9+#]+", (text or "").lower()) if w not in L.STOPWORDS]


def test_spans_against_all_spans(spark):
    rng = random.Random(5)
    some = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    items = [(i, "\n".join(some(rng.randrange(1, 9), 14))) for i in range(12)]
    docs = [(i, rng.choice(["\n", " ", " the "]).join(some(rng.randrange(0, 40), 20))) for i in range(80)] + [(80, None), (5, items[0][1]), (5, items[0][1])]
    want = {}
    for i, item in items:
        s = set(content(item))
        for d, text in docs:
            w = content(text)
            for a in range(len(w)):
                for b in range(a + 1, len(w) + 1):
                    k, u = len(s & set(w[a:b])), len(s | set(w[a:b]))
                    if k >= 3 and 10 * k >= 6 * u:
                        want[i, d] = max(want.get((i, d), (0, 0)), (k / u, k))
    got = spans.spans_like(spark.createDataFrame(items, "i int, t string"), spark.createDataFrame(docs, "d long, t string"), "i", "d", "t", "t").collect()
    assert len(got) == len(want) > 20 and {(r["i"], r["d"]): (r["similarity"], r["shared"]) for r in got} == want


def test_contamination_finds_every_document_that_holds_an_item(spark, tmp_path):
    item = "alpha beta\ngamma delta epsilon"
    docs = [(1, f"one two {item} three"), (2, item), (3, item), (4, "x " * 30 + "alpha beta gamma delta epsilon" + " y" * 30), (5, "alpha x1 x2 x3 x4 beta")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(r) for r in corpus.contamination(spark, str(tmp_path)).select("item_id", "doc_id", "shared", "similarity").collect())
    assert got == [(7, d, 5, 1.0) for d in (1, 2, 3, 4)]


def test_rouge_l_and_character_errors_of_whole_turns(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'assistant'").orderBy("conv_id", "turn").collect()
    pairs = {f"{x['conv_id']}-{x['turn']}": (x["text"], y["text"]) for x, y in zip(turns, turns[1:], strict=False) if x["conv_id"] == y["conv_id"]}
    assert any("\n" in a for a, _ in pairs.values())

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    want = {}
    for k, (a, b) in pairs.items():
        x, y = (re.findall("[a-z0-9]+", t.lower()) for t in (a, b))
        n = common(x, y)
        want[k] = round(2 * n / (len(x) + len(y)), 6) if n else 0.0
    got = {r["id"]: r["rouge_l"] for r in analytics.rouge_l(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    cer = sum(edits(a, b) for a, b in pairs.values()) / sum(len(b) for _, b in pairs.values())
    assert abs(analytics.character_errors(spark, SF).first()["cer"] - cer) < 2e-6


def test_tfidf_has_word_pairs(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def terms(text):
        one = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in L.SCORE_STOP]
        return Counter(one + [f"{a} {b}" for a, b in zip(one, one[1:], strict=False)])

    counts = {d: terms(t) for d, t in docs}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def weights(c):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vectors = {d: weights(c) for d, c in counts.items()}
    got = {(r["item_id"], r["place"]): r["score"] for r in analytics.tfidf_topk(spark, SF).collect()}
    want = {}
    for i, text in items:
        q = weights(terms(text))
        best = sorted((s for s in (sum(x * v.get(t, 0.0) for t, x in q.items()) for v in vectors.values()) if s > 0), reverse=True)[:5]
        want |= {(i, k + 1): s for k, s in enumerate(best)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_embedding_search_meets_all_vectors(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    v = np.array([r["embedding"] for r in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = {r["vec_id"]: r["label"] for r in rows}
    want = []
    for at in np.flatnonzero(ids % 100 == 0):
        near = np.round(v @ v[at], 6)
        order = [i for i in np.lexsort((ids, -near)) if i != at][:5]
        want += [(int(ids[at]), k + 1, int(ids[i]), float(near[i])) for k, i in enumerate(order)]
    for block in (retrieval.BLOCK, 60):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        got = sorted((r["query"], r["place"], r["id"], r["similarity"]) for r in analytics.embedding_topk(spark, SF).collect())
        assert got == sorted(want)
    assert any(label[q] != label[d] for q, _, d, _ in want)


def test_embedding_search_within_a_group(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 0), (4, [0.0, 0.0], None), (5, None, 1)], "id long, v array<float>, g int")
    near = lambda group: sorted((r["query"], r["place"], r["id"]) for r in retrieval.top_by_vector(df.filter("id IN (1, 4)"), df, 2, "id", "v", group).collect())
    assert near(None) == [(1, 1, 2), (1, 2, 3), (4, 1, 1), (4, 2, 2)]
    assert near("g") == [(1, 1, 3)]
    alone = retrieval.top_by_vector(df.filter("id = 5"), df, 1, "id", "v").collect()
    assert [(r["query"], r["id"], r["similarity"]) for r in alone] == [(5, 1, 0.0)]


def test_merged_corpus_keeps_null_languages_and_texts(spark, tmp_path):
    rows = [(1, "a  b", "en"), (2, "A b", None), (3, "c", None), (4, "C", "fr"), (5, None, "fr"), (6, None, None), (7, None, "en"), (8, None, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["lang"]) for r in corpus.merged_corpus(spark, str(tmp_path)).collect())
    assert got == [(1, "en"), (3, None), (5, "fr"), (6, None), (7, "en"), (8, "fr")]


def test_items_in_blocks_give_the_same_spans(spark, monkeypatch):
    from parley.operators import spans
    from parley.plans import corpus

    whole = sorted(map(tuple, corpus.contamination(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(spans, "ITEM_TOKENS", 40)
    assert sorted(map(tuple, corpus.contamination(spark, "/root/testdata/sf0.001").collect())) == whole


def test_answers_of_every_conversation_are_scored(spark, tmp_path):
    turns = [(c, t, role, text) for c in range(6) for t, role, text in ((0, "assistant", "What is an index?"), (1, "user", "An index is a sorted copy of a column, so a search reads few pages."))]
    spark.createDataFrame([*turns, (6, 0, "assistant", "Hello?")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = {r["conv_id"]: tuple(r)[1:] for r in services.conversation_scores(spark, str(tmp_path)).collect()}
    assert {c: n for c, (*_, n) in rows.items()} == dict.fromkeys(range(6), 1) | {6: 0}
    assert len({rows[c] for c in range(6)}) == 1 and rows[6][:2] == (50.0, 50.0) != rows[0][:2]
