"""A training corpus from the documents table: five stages, each one operator."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import langid, minhash, mixing, pieces, toxicity
from parley.llm.staging import discard, passing, stage
from parley.sources.readers import with_position

#: A document whose language is less sure than this goes.
LEAST_LANGUAGE = 0.5
#: Documents that share this much of their shingles, in percent, are near duplicates here; op6 has a threshold of its own.
NEAR_PERCENT = 80


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names of their own, so that an operator's results can't clash with them; and which is which."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(n).alias(c) for c, n in names.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels, doesn't find toxic. Null and empty texts aren't toxic; every row is judged by its own text."""
    rows, names = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    graded = toxicity.grade_toxicity(rows, labels, id_col=names["doc_id"], text_col=names["text"], carry=tuple(names.values()))
    return _named(graded.filter("NOT toxic"), names)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, found with some confidence; learned from rows that aren't held out.

    Null texts and those without a letter have no language and go; so does every row if none has a known language to learn from.
    """
    rows, names = _numbered(docs)
    training = docs.select("doc_id", "text", "lang").filter(~F.coalesce(langid.held_out(), F.lit(True)))
    found = langid.identify(rows, training, id_col=names["doc_id"], text_col=names["text"], carry=tuple(names.values()))
    return _named(found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)), names)


def _rowed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The numbered columns and ``row``, a number of each row's own that stays the same; ids may repeat or be null.

    A table read from Parquet has it from the scan: a row's place in its files.
    Other frames are written once, with a number.
    """
    named, names = _numbered(docs)
    try:
        placed = with_position(docs, "_row_of_pipeline")
        placed.schema  # noqa: B018
    except AnalysisException:
        return stage(named.withColumn("row", F.monotonically_increasing_id()), "pipeline-rows"), names
    return placed.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col("_row_of_pipeline").alias("row")), names


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = NEAR_PERCENT) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id.

    Rows are told apart even if they share an id: of texts in different groups
    each keeps a row. Within a group an id comes before null, equal ids go by a
    hash of the text, and of rows alike one stays. Texts that are null or have
    no words are near duplicates of nothing, so their rows all stay.
    """
    rows, names = _rowed(docs)
    doc_id, text = names["doc_id"], names["text"]
    group = minhash.near_duplicates(rows, percent=percent, id_col="row", text_col=text).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("i"), F.xxhash64(text).alias("h"), "row")
    stays = rows.select("row", order.alias("o")).join(group, "row").groupBy("component_id").agg(F.min("o").alias("o")).select("o.row")
    return _named(rows.join(stays, "row", "left_semi"), names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it, by its own text and source.

    A null source is a source; null texts and those without words weigh nothing
    and stay once; rows of one id are taken each for itself.
    """
    rows, names = _rowed(docs)
    taken = mixing.mix_sources(rows, id_col="row", text_col=names["text"], source_col=names["source"], order_col=names["doc_id"]).filter("copies > 0").select(F.col("doc_id").alias("row"), "copies")
    out = rows.join(taken, "row")
    return _named(out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; a null text has none. Rows that repeat are encoded each."""
    return pieces.encode_texts(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Fitted models, Newton iterations and Viterbi have no SQL; tests hold the stages and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written for itself or read goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with passing() as spared:
            done = spared(stage(step(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
