"""Operators against plain versions."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from parley.llm import components, gif, langid, minhash, pieces, quality, toxicity, vectors
from parley.llm.bytewords import NOT_SPACE, chunks, hash_word, hash_words

SF = "/root/testdata/sf0.001"


def test_words_are_those_of_bytes_split():
    texts = ["", "a", " b  cc\n", "x" * 700 + " y", "é ü\xa0z", None]
    for size in (1, 1 << 20):
        for c in chunks(pa.array(texts), size):
            starts, ends, first = c.words(NOT_SPACE)
            for i in range(c.n):
                got = [c.data[s:e].tobytes() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
                assert got == (texts[c.first + i] or "").encode().lower().split()
            assert [int(x) for x in hash_words(c, starts, ends)] == [hash_word(c.data[s:e].tobytes().decode()) for s, e in zip(starts, ends)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500 + i) for i in range(60)]
    low = {}

    def top(x):
        while low.get(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            low[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: top(x) for e in edges if e[0] != e[1] for x in e}
    assert got == want


@pytest.mark.parametrize("groups,small,few", [(12, 16, 16), (2, 4, 0), (2, 2, 1), (2, 16, 16)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, groups, small, few):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "FEW", few)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(4000)}" for _ in range(80)] for _ in range(groups)]
    texts = []
    for i in range(160):
        words = list(base[i % groups])
        for _ in range(rng.randrange(5)):
            words[rng.randrange(80)] = f"z{rng.randrange(9000 if groups > 2 else 40)}"
        texts.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(76)} for i, t in texts}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    assert got == label


@pytest.mark.parametrize("similarity", [0.5, 0.6, 0.7, 0.8])
def test_pairs_share_a_band_as_often_as_banding_says(similarity):
    rng = np.random.default_rng(round(100 * similarity))
    both, size, pairs = 0, 400, 600
    common = round(2 * size * similarity / (1 + similarity))
    for _ in range(pairs):
        x = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
        sets = np.concatenate([np.sort(x[:size]), np.sort(x[size - common :])])
        keys = minhash.band_keys(minhash.signatures(sets, np.array([0, size, 2 * size])))
        both += (keys[0] == keys[1]).any()
    true = common / (2 * size - common)
    want = 1 - (1 - true**minhash.ROWS) ** minhash.BANDS
    assert abs(both / pairs - want) < 4 * max((want * (1 - want) / pairs) ** 0.5, 0.003)


@pytest.mark.parametrize("changed", [1, 8])
def test_verified_pairs_grow_with_a_hot_family(spark, monkeypatch, changed):
    rng = random.Random(10)
    base = [f"w{i}" for i in range(200)]
    pairs, made = minhash._verified, []
    monkeypatch.setattr(minhash, "_verified", lambda p, sets, percent: (made.append(p.count()), pairs(p, sets, percent))[1])
    seen = []
    for n in (200, 400, 800):
        rows = [(0, " ".join(base))]
        for i in range(1, n):
            words = list(base)
            for at in rng.sample(range(200), changed):
                words[at] = f"v{rng.randrange(100_000)}"
            rows.append((i, " ".join(words)))
        made.clear()
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).agg({"component_id": "max"}).first()[0]
        assert found == (0 if changed == 1 else n - 1)
        seen.append(sum(made))
    assert seen[1] <= 2.3 * seen[0] + 50 and seen[2] <= 2.3 * seen[1] + 50 and seen[2] <= 3 * 800, seen


def test_vector_links_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((6, 32))
    x = np.concatenate([c + 0.12 * rng.standard_normal((60, 32)) for c in centre] + [rng.standard_normal((40, 32))])
    rows = [(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    same = (np.arange(len(x))[:, None] - np.arange(len(x))) % 2 == 0
    want = ((unit @ unit.T >= 0.98) & same).sum(axis=1) - 1
    assert [got[i] for i in range(len(x))] == want.tolist() and want.sum() > 0


def test_pieces_against_the_library():
    model = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    v = pieces.Vocabulary()
    model.trainer_spec.model_type = 1  # unigram, with the same scores
    for i, s in v.score.items():
        model.pieces[i].score = s
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = ["Hello world", "a  b", "tab\tand\n\nlines", "naïve 你好 🙂 x", " lead", "trail ", "%%%%% ### aaaa"]
    (batch,) = pieces._encode(pieces.MODEL, "rank")([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])])
    assert batch.column(2).to_pylist() == library.encode(texts)


def test_pieces_against_brute_force():
    v = pieces.Vocabulary()

    def best(word):
        table = [(0.0, ())]
        for e in range(1, len(word) + 1):
            table.append(max((table[s][0] + v.piece[word[s:e]][1], table[s][1] + (v.piece[word[s:e]][0],)) for s in range(e) if word[s:e] in v.piece))
        return table[-1][0]

    words = [" interview", " interviews", " interviewer", " in", " data", " database", "x", " ", "zzzzz"]
    for w, ids in zip(words, v.encode_words(words)):
        assert sum(v.score[i] for i in ids) == best(w.replace(" ", pieces.MARK))


def test_forward_sums_all_segmentations():
    vocabulary = langid.pieces()
    seg = langid.Segments(vocabulary)
    p = np.random.default_rng(6).random((len(vocabulary), 2))
    p /= p.sum(axis=0)
    index = {w: i for i, w in enumerate(vocabulary)}

    def total(word, k):
        a = [1.0] + [0.0] * len(word)
        for e in range(1, len(word) + 1):
            a[e] = sum(a[s] * p[index[word[s:e]], k] for s in range(max(0, e - seg.longest), e) if word[s:e] in index)
        return a[-1]

    for word in (b" the", b" interviewing", " größe".encode(), b" abcdefghijklmnopqrstuvwxyz"):
        got = seg.forward(np.frombuffer(word, dtype=np.uint8)[None, :], p)[0]
        assert np.allclose(got, [np.log(total(word, k)) for k in (0, 1)])


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.document_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_isotonic_is_the_nearest_rising_fit():
    y, n = np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8]), np.array([1.0, 2, 1, 1, 3, 1])
    got = quality.isotonic(y, n)
    assert (np.diff(got) >= -1e-12).all() and np.allclose(got[1:4], 0.375) and np.allclose(got[4:], 0.875)


def test_toxicity_finds_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.grade_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels.withColumnRenamed("toxic", "y"), "doc_id").collect()
    assert np.mean([r["toxic"] for r in rows if r["y"] == 1]) > 0.7 and np.mean([r["toxic"] for r in rows if r["y"] == 0]) < 0.03


def test_ordinal_gradient_rises_to_the_optimum():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2, 400)
    grade = np.minimum(3, x * 2 + rng.integers(0, 2, 400))
    w, theta = toxicity.fit(np.flatnonzero(x), np.zeros(x.sum(), dtype=int), np.ones(x.sum()), grade, 1, 4)
    assert w[0] > 1 and (np.diff(theta) > 0).all()


def test_lzw_round_trip():
    for data in (b"", b"a", b"ab" * 4000, bytes(range(256)) * 20, os.urandom(30_000), b"\0" * 50_000):
        assert gif.decompress(gif.compress(data), 8, 1 << 30) == data


def test_gif_rules():
    """Transparency keeps what is below; disposal 2 clears the image's area, 3 brings back what was there."""
    import struct

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def image(samples, disposal, clear=None, left=0):
        data = gif.compress(bytes(samples), 2)
        control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 5, clear or 0, 0)
        return control + struct.pack("<BHHHHB", 0x2C, left, 0, len(samples), 1, 0) + b"\x02" + bytes([len(data)]) + data + b"\0"

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0xF1, 0, 0) + palette
    data = head + image([1, 1], 1) + image([2, 3], 3, clear=3) + image([3], 2, left=1) + image([0, 0], 1, clear=0) + b"\x3b"
    frames = [(f.start, f.delay, f.canvas.copy().tolist()[0]) for f in gif.decode(data)]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert [f[0] for f in frames] == [0, 5, 10, 15]
    assert [f[2] for f in frames] == [[red, red], [green, red], [red, blue], [red, none]]


def test_gif_frames_table(spark):
    rows = [(1, gif.encode(gif.pad(b"hello" * 20_000))), (2, None), (3, b"no gif")]
    got = gif.decode_frames(spark.createDataFrame(rows, "doc_id long, data binary")).orderBy("id", "frame").collect()
    one = [r for r in got if r["id"] == 1]
    assert b"".join(r["samples"] for r in one) == gif.pad(b"hello" * 20_000) and [r["start_cs"] for r in one] == [0, 10]
    assert all(sum(r["histogram"]) == r["width"] * r["height"] for r in one[:1]) and all(r["error"] for r in got if r["id"] != 1)
