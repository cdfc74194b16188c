"""Texts out of uploaded files: Word documents and plain texts, broken ones reported and never scored."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY = "word/document.xml"
SCHEMA = "path string, kind string, bytes long, text string, error string"


def paragraph_text(p: ElementTree.Element) -> str:
    """A paragraph's runs, with its tabs and line breaks."""
    parts = {f"{W}t": lambda x: x.text or "", f"{W}tab": lambda x: "\t", f"{W}br": lambda x: "\n", f"{W}cr": lambda x: "\n"}
    return "".join(parts[x.tag](x) for r in p.iter(f"{W}r") for x in r if x.tag in parts)


def word_text(content: bytes) -> str:
    """The paragraphs of a document's body that aren't blank, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read(BODY)).find(f"{W}body")
    found = [] if body is None else [paragraph_text(p) for p in body.findall(f"{W}p")]
    return "\n".join(t for t in found if t.strip())


def _read(path: str, content: bytes) -> tuple[str, str | None, str | None]:
    kind = path.rsplit("/", 1)[-1].lower().rpartition(".")[2]
    try:
        if kind in ("docx", "doc"):
            return kind, word_text(content), None
        if kind == "pdf":
            return kind, None, "no reader for pdf"
        return kind, content.decode("utf-8", "ignore"), None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, NotImplementedError, RuntimeError, EOFError) as e:
        return kind, None, f"{type(e).__name__}: {e}"[:200]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            path, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            kind, text, error = _read(path, content)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([kind]), pa.array([len(content)]), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["path", "kind", "bytes", "text", "error"])


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, bytes, text and error of each file below a folder.

    ``docx`` and ``doc`` are read as Word documents, others but ``pdf`` as UTF-8
    without what isn't. A file that can't be read has an error and no text; Spark passes over empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInArrow(_extract, SCHEMA)


def readable(texts: DataFrame) -> DataFrame:
    """The rows that may be scored."""
    return texts.filter("error IS NULL").drop("error")


def failures(texts: DataFrame) -> DataFrame:
    """How many files of each kind were read and how many failed, with one error (the first by text)."""
    return texts.groupBy("kind").agg(F.count_if(F.col("error").isNull()).alias("read"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.min("error").alias("error"))
