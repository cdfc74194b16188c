"""Uploaded files, transcripts in Sinhala, performance classes and quantiles against plain versions."""

import random
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from parley.operators import audio, corpus, performance, transcripts
from parley.sources import documents

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def write_docx(path, paragraphs):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        escaped = [p.replace("&", "&amp;").replace("<", "&lt;") for p in paragraphs]
        body = "".join(f'<w:p><w:pPr><w:rPr/></w:pPr><w:r><w:t xml:space="preserve">{p[: len(p) // 2]}</w:t></w:r><w:r><w:t xml:space="preserve">{p[len(p) // 2 :]}</w:t></w:r></w:p>' if "&" not in p else f'<w:p><w:r><w:t>{p}</w:t></w:r></w:p>' for p in escaped)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {W}><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:sectPr/></w:body></w:document>')


def test_texts_of_files_and_broken_ones(spark, tmp_path):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text IS NOT NULL AND length(text) > 0").orderBy("doc_id").limit(12).collect()]
    clean = lambda t: "".join(c for c in t if c >= " " or c == "\n")
    for r in rows:
        write_docx(tmp_path / f"{r['doc_id']}.docx", clean(r["text"]).split("\n"))
        (tmp_path / f"{r['doc_id']}.TXT").write_bytes(clean(r["text"]).encode() + b"\xff\xfe")
    (tmp_path / "bad.docx").write_bytes(b"PK no zip")
    with zipfile.ZipFile(tmp_path / "empty.docx", "w") as z:
        z.writestr("other.xml", "<a/>")
    with zipfile.ZipFile(tmp_path / "torn.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document")
    (tmp_path / "cv.pdf").write_bytes(b"%PDF-1.4")
    texts = documents.read_texts(spark, str(tmp_path)).persist()
    got = {r["path"].rsplit("/", 1)[1]: r for r in texts.collect()}
    for r in rows:
        assert got[f"{r['doc_id']}.docx"]["text"] == "\n".join(p for p in clean(r["text"]).split("\n") if p.strip())
        assert got[f"{r['doc_id']}.TXT"]["text"] == clean(r["text"])
    broken = {k for k, r in got.items() if r["error"]}
    assert broken == {"bad.docx", "empty.docx", "torn.docx", "cv.pdf"} and all(got[k]["text"] is None for k in broken)
    assert documents.readable(texts).count() == 24 and "error" not in documents.readable(texts).columns
    assert {r["kind"]: (r["read"], r["failed"]) for r in documents.failures(texts).collect()} == {"docx": (12, 3), "txt": (12, 0), "pdf": (0, 1)}


def plain_sinhala(text):
    text = unicodedata.normalize("NFC", text)
    text = re.sub("(?<![\u0d80-\u0dff])[\u200d\u200c]|[\u200d\u200c](?![\u0d80-\u0dff])", "", text)
    out, last, run = [], None, 0
    for w in text.split():
        run = run + 1 if w == last else 1
        last = w
        if run < 3:
            out.append(w)
    text = re.sub("([.,!?\u0df4])(\\S)", r"\1 \2", re.sub("\\s+([.,!?\u0df4])", r"\1", " ".join(out)))
    return re.sub(r"\s+", " ", text).strip()


def test_transcripts_against_the_standard_library(spark):
    rng = random.Random(8)
    signs = ["e\u0301", "\u00e9", "\u0d9a", "\u0dca", "\u200d", "\u200c", "\u0db1\u0dd2", "\u0dd9\u0dcf", " ", " ", "a", ".", ",", "\u0df4", "no no no no ", "\n"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(300)] + ["word " * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, None)], "i int, t string")
    got = {r["i"]: r for r in rows.select("i", transcripts.clean(F.col("t"), F.lit("si")).alias("si"), transcripts.clean(F.col("t"), F.lit("en")).alias("en"), transcripts.plain_for_errors(F.col("t")).alias("plain")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["si"] == plain_sinhala(t) and got[i]["en"] == re.sub(r"\s+", " ", t).strip()
        assert got[i]["plain"] == " ".join(unicodedata.normalize("NFC", t).replace("\u200d", "").replace("\u200c", "").split())
    assert got[1000]["si"] == got[1000]["en"] == got[1000]["plain"] == ""


def test_forest_and_bands(spark):
    model = performance.fit_performance(performance.made_up(spark))
    fresh = performance.made_up(spark, 300, seed=7)
    rows = performance.performance_classes(fresh, "features", model, F.lit(0.0), F.lit(0.0)).collect()
    assert all(r["by"] == "forest" for r in rows) and sum(performance.CLASSES.index(r["class"]) == r["label"] for r in rows) > 285
    odd = [(1, None, 90.0), (2, [1.0] * 20, 60.0), (3, [None] * 21, 10.0), (4, [float("nan")] * 21, 85.0)]
    rows = performance.performance_classes(spark.createDataFrame(odd, "i int, f array<double>, s double"), "f", model, F.col("s"), F.col("s")).collect()
    assert {r["i"]: (r["class"], r["by"]) for r in rows} == {1: ("ADVANCED", "bands"), 2: ("INTERMEDIATE", "bands"), 3: ("BEGINNER", "bands"), 4: ("ADVANCED", "bands")}


@pytest.mark.parametrize("told", [50_000, 5])
def test_quantiles_of_many_equal_and_different_values(spark, monkeypatch, told):
    monkeypatch.setattr(corpus, "TOLD_APART", told)
    rng = random.Random(told)
    values = [rng.gauss(0, 1) for _ in range(700)] + [0.25] * 400 + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    held = sorted(v for v in values if v is not None and v == v)
    want = []
    for q in (0.0, 0.25, 0.5, 0.993, 1.0):
        at = q * (len(held) - 1)
        want.append(held[int(at)] + (held[min(int(at) + 1, len(held) - 1)] - held[int(at)]) * (at - int(at)))
    assert corpus.exact_quantiles(df, "x", (0.0, 0.25, 0.5, 0.993, 1.0)) == pytest.approx(want, abs=1e-12)
    assert corpus.exact_quantiles(df.limit(0), "x", (0.5,)) == [None]


def test_buckets_count_the_bounds_below(spark):
    bounds = [float(i) for i in range(100)]
    rows = spark.createDataFrame([(float(x) / 2 - 3,) for x in range(220)], "x double").select("x", corpus.bucket_of(F.col("x"), bounds).alias("b"), corpus.bucket_of(F.col("x"), []).alias("none")).collect()
    assert all(r["b"] == sum(b < r["x"] for b in bounds) and r["none"] == 0 for r in rows)


def test_long_runs_of_words_stay_linear(spark):
    got = spark.createDataFrame([("a " * 30_000 + "b b b",)], "t string").select(audio.collapse_repeats(F.col("t"))).first()[0]
    assert got == "a a b b"
