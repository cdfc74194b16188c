"""Byte pairs, alignment of tokenizers and vector codes against libraries and plain versions."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm import alignment, bytepairs, codes, registry

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [
    None, "", " ", "a", "\n\n  x", "<|endoftext|> and <s>", "ends in spaces   ", "naïve 漢字かな 🙂👍🏽 é", "▁mark ▁▁ mark", "tab\tand\r\nline", "\x00\x01 control", "x" * 5000, "=" * 3001, "ab " * 4000, " " * 2000 + "y",
    "漢字" * 900, "don't we'll I'm", "123456789 12a34", "repeat", "repeat",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    found = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    mixed = ["".join(rng.choice("ab \n\t1'sé漢🙂<|end>▁-=") for _ in range(rng.randint(0, 400))) for _ in range(150)]
    return found + ODD + mixed


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def library():
    merges = bytepairs.Merges.from_ranks()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges.whole, special_tokens={})


def test_byte_pairs_as_the_library_has_them(docs, texts):
    rows, model = {r["doc_id"]: r for r in bytepairs.encode_texts(docs, decoded=True).collect()}, library()
    for k, t in enumerate(texts):
        assert rows[k]["ids"] == model.encode_ordinary(t or "") and rows[k]["n_tokens"] == len(rows[k]["ids"]) and bytes(rows[k]["decoded"]) == (t or "").encode()
    back = {r["doc_id"]: r["text"] for r in bytepairs.decode_texts(bytepairs.encode_texts(docs)).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}


def test_op13_digests(spark):
    model, rows = library(), registry.op13_byte_bpe(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_byte_pairs_of_one_long_word_and_of_parts(spark):
    rng, model, encoder = random.Random(7), library(), bytepairs.Encoder(bytepairs.Merges.from_ranks())
    for text in ("".join(rng.choice("abcdefgh") for _ in range(20_000)), "ab  cd e   f " * 3000, "\n ".join("word" for _ in range(5000))):
        assert encoder.encode([text])[0].tolist() == model.encode_ordinary(text)
        assert "".join(bytepairs.cuts(text, 50)) == text
        assert [i for part in bytepairs.cuts(text, 50) for i in model.encode_ordinary(part)] == model.encode_ordinary(text)
    both = [encoder._long(w) == encoder._side_by_side([w], 64)[0] for w in (bytes(rng.choices(b"abcde \xc3\xa9", k=rng.randint(2, 64))) for _ in range(300))]
    assert all(both)


def test_byte_pairs_keep_rows_that_repeat_and_foreign_columns(spark):
    df = spark.createDataFrame([("k", "one two", 1, "n"), ("k", "one two", 2, "n"), (None, None, 3, None)], "doc_id string, text string, ids int, n_tokens string")
    rows = bytepairs.encode_texts(df).collect()
    assert sorted((r["doc_id"] or "", r["n_tokens"]) for r in rows) == [("", 0), ("k", 2), ("k", 2)]
    assert bytepairs.encoded_digests(df.limit(0)).count() == 0
    assert bytepairs.decode_texts(spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")).collect() == [(1, None), (2, "")]


def plain_alignment(texts):
    """Results of alignment from the libraries and all pairs of tokens."""
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letter = bytepairs.byte_characters()
    a_text = lambda i: bytes(letter[c] for c in a_model.id_to_token(i))
    b_text = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    out, count = [], {}
    for t in texts:
        links, groups = [], []
        if t:
            a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t, num_threads=1)
            if b"".join(map(a_text, a)) == b"".join(map(b_text, b)) == (" " + t).encode():
                spans = []
                for ids, text in ((a, a_text), (b, b_text)):
                    ends = np.cumsum([len(text(i)) for i in ids]).tolist()
                    spans.append(list(zip([0, *ends[:-1]], ends, ids)))
                ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                for lo, hi in zip([0, *ends[:-1]], ends):
                    groups.append([[i for s, e, i in side if lo <= s and e <= hi] for side in spans])
                at = 0
                for s, e, i in spans[0]:
                    while spans[1][at][1] <= s:
                        at += 1
                    k = at
                    while k < len(spans[1]) and spans[1][k][0] < e:
                        links.append((i, spans[1][k][2]))
                        k += 1
        for p in links:
            count[p] = count.get(p, 0) + 1
        out.append((groups, links))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for groups, links in out:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [alignment.HOT, 50])
def test_alignment_against_all_pairs(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(alignment, "HOT", hot)
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(docs).collect()}
    want = plain_alignment(texts)
    assert len(rows) == len(texts) and [rows[k] for k in range(len(texts))] == want


def test_groups_and_links_of_texts(docs, texts):
    """Single documents' groups and links are those that the digests count."""
    rows = {r["doc_id"]: r for r in alignment.align(alignment.tokenise_both(docs)).collect()}
    for k, want in enumerate(plain_alignment(texts)):
        text = ";".join("|".join(",".join(map(str, side)) for side in (g["a"], g["b"])) for g in rows[k]["groups"])
        assert (len(rows[k]["groups"]), len(rows[k]["links"]), hashlib.sha256(text.encode()).hexdigest() if text else "") == (want[2], want[3], want[6])


def test_alignment_of_one_long_group(spark):
    """Tokens whose ends don't meet for long make one group; links stay linear."""
    a, b = [3] * 40_001, [2] + [3] * 40_000 + [1]
    row = (1, [7] * len(a), np.cumsum(a).tolist(), [9] * len(b), np.cumsum(b).tolist())
    df = spark.createDataFrame([row], "doc_id long, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>")
    (got,) = alignment.align(df).select(F.size("groups").alias("g"), F.size("links").alias("n"), F.size(F.col("groups")[0]["a"]).alias("a")).collect()
    assert got == (1, len(a) + len(b) - 1, len(a))


def test_alignment_of_rows_that_repeat_and_none(spark):
    df = spark.createDataFrame([("k", "same words", 1), ("k", "same words", 2), (None, None, 3)], "doc_id string, text string, links int")
    rows = alignment.align_documents(df).collect()
    assert sorted(r["n_links"] for r in rows)[0] == 0 and len(rows) == 3 and len({tuple(r) for r in rows}) == 2
    assert alignment.align_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("kept", [alignment.KEPT, 40])
def test_units_are_encoded_once_while_kept(kept, monkeypatch):
    """Units met before aren't encoded again; results stay where some have been forgotten in between."""
    monkeypatch.setattr(alignment, "KEPT", kept)
    both = alignment.Tokenizers()
    units, asked = alignment.Units(both), []
    for words in ([" one", " two", " three"], [" two", " naïve", " 漢字"], [" one", " " + "x" * 90], [" one", " " + "x" * 90]):
        hashes = np.array(sorted(hash(w) % 2**60 for w in words), dtype=np.uint64)
        words = sorted(words, key=lambda w: hash(w) % 2**60)
        found, same = units.find(hashes, lambda new: asked.extend(words[k] for k in new) or [words[k] for k in new])  # noqa: B023
        want, whole = both.encode(words)
        assert same.tolist() == whole.tolist() and all((x == y).all() for f, w in zip(found, want) for x, y in zip(f, w))
    assert kept == 40 or sorted(asked) == sorted([" one", " two", " three", " naïve", " 漢字", " " + "x" * 90])


def test_copies_share_their_units(spark):
    """Groups and links are found once for the different units of a row, not for each document."""
    df = spark.createDataFrame([(k, "the same words, naïve words 漢字") for k in range(50)], "doc_id long, text string").coalesce(1)
    (row,) = alignment.tokenise_units(df).collect()
    (one,) = alignment.tokenise_both(df.limit(1)).collect()
    assert len(row["doc_id"]) == 50 and len(row["a_ids"]) <= len(one["a_ids"]) and len(row["units"]) == 50 * (len(row["bounds"]) - 1)
    got = {tuple(r)[1:] for r in alignment.documents_of(alignment.tokenise_units(df)).select("doc_id", "n_a", "n_b", "groups_sha256").collect()}
    (want,) = plain_alignment(["the same words, naïve words 漢字"])
    assert got == {(want[0], want[1], want[6])}


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and the digest by whole numbers of unlimited size."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    v = [[int(np.floor(4096 * float(x))) for x in r[1]] for r in kept]
    d = len(v[0])
    cut = [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
    books = [[x[lo:hi] for x in v[:entries]] for lo, hi in cut]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    code = lambda x: [min(range(len(book)), key=lambda e: (far(x[lo:hi], book[e]), e)) for (lo, hi), book in zip(cut, books)]
    for _ in range(rounds):
        now = [code(x) for x in v]
        for p, (lo, hi) in enumerate(cut):
            for e in range(len(books[p])):
                own = [x[lo:hi] for x, c in zip(v, now) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    found = [code(x) for x in v]
    error = [sum(far(x[lo:hi], books[p][c[p]]) for p, (lo, hi) in enumerate(cut)) for x, c in zip(v, found)]
    total = {}
    for r, e in zip(kept, error):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted((r[0], "".join(f"{e:02x}" for e in c), e2, total[r[2]], digest) for r, c, e2 in zip(kept, found, error))


VECTORS = "vec_id long, embedding array<double>, label string, code string, error int"


def vector_rows(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dim)) * scale
    return [(int(i), (centre[rng.integers(5)] + rng.normal(size=dim) * 0.2 * scale).tolist(), [None, "a", "b"][int(rng.integers(3))], "x", 1) for i in rng.permutation(n)]


@pytest.mark.parametrize("n,dim,scale", [(300, 16, 1.0), (120, 13, 1.0), (5, 8, 1.0), (60, 16, 5000.0), (40, 3, 1.0)])
def test_codes_against_plain_rounds(spark, n, dim, scale):
    rows = vector_rows(n, dim, n + dim, scale)
    rows += [(1000 + k, v, "a", "x", 1) for k, v in enumerate(([None] * dim, None, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1)))] + rows[:7]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in codes.code_vectors(df).collect())
    assert got == plain_codes(rows)


def test_codes_of_other_lengths_and_none(spark):
    rows = vector_rows(40, 16, 1) + [(i + 100, v, "z", c, e) for i, v, _, c, e in vector_rows(30, 8, 2)]
    got = sorted(tuple(r) for r in codes.code_vectors(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == plain_codes(rows[:40]) + plain_codes(rows[40:])
    assert codes.code_vectors(spark.createDataFrame([(1, None, "a", "x", 1)], VECTORS)).count() == 0


def test_op12_against_plain_rounds(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in registry.op12_vector_codes(spark, SF).collect()) == plain_codes(rows)


def test_rounds_add_up_only_changes(spark):
    """After the first round, sums move by parts that changed their entry and by nothing else."""
    x = np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist()), pa.array([b"\x00\x01", b"\x01\x01", b"\x00\x00"]), pa.array([b"\x01\x01", b"\x01\x01", None])], names=["v", "code", "prev"])
    (out,) = codes._changes(2, 2)([batch])
    found = {(r["part"], r["entry"]): r["sums"] for r in out.to_pylist()}
    s = codes.SCALE
    assert found == {(0, 0): [2, 6 * s], (0, 1): [-1, -1 * s], (1, 0): [1, 6 * s]}
