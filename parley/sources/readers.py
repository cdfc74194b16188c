"""Readers and writers for the record formats in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

CORRUPT = "_corrupt_record"
WRAPPERS = ("data", "records", "samples", "examples")
#: Other names of a split.
SPLITS = {"val": "validation", "valid": "validation", "dev": "validation", "eval": "validation"}


def read_jsonl(spark: SparkSession, path, schema: str, bad: str = "keep") -> DataFrame:
    """JSON lines by a declared schema. Bad lines: 'keep' them in a column, 'drop' them, or 'fail'."""
    if bad == "keep":
        return spark.read.schema(S.StructType.fromDDL(schema).add(CORRUPT, "string")).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return spark.read.schema(schema).option("mode", {"drop": "DROPMALFORMED", "fail": "FAILFAST"}[bad]).json(path)


def bad_lines(spark: SparkSession, path, schema: str) -> DataFrame:
    """How many lines of each file can't be read by the schema, and one of them (the first in order of text); blank lines aren't lines."""
    rows = spark.read.text(path).filter(F.trim("value") != "").withColumn("file", F.col("_metadata.file_name"))
    made = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return rows.filter(made[CORRUPT].isNotNull()).groupBy("file").agg(F.count("*").alias("bad"), F.min("value").alias("first"))


def read_manifest(spark: SparkSession, manifest, schema: str, limit: int | None = None, order: Column | None = None) -> DataFrame:
    """Rows of all shards (JSON lines, gz or plain) that a manifest lists (``{"shards": [{"path": ...}]}``), malformed lines left out, with the shard's name; at most ``limit`` of each shard if given."""
    rows = spark.read.schema("shards array<struct<path:string>>").option("multiLine", True).json(manifest)
    paths = [r["path"] for r in rows.select(F.explode("shards.path").alias("path")).collect()]
    df = read_jsonl(spark, paths, schema, "drop").withColumn("shard", F.col("_metadata.file_name"))
    if limit is None:
        return df
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("shard").orderBy(F.lit(0) if order is None else order))).filter(F.col("_r") <= limit).drop("_r")


def read_splits(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All split files of a folder as one table with a ``split`` column; a file's name tells its split, whatever it is called there."""
    df = spark.read.schema(schema).json(f"{folder.rstrip('/')}/*.jsonl").withColumn("_n", F.regexp_extract(F.lower(F.col("_metadata.file_name")), "(train|test|validation|valid|val|dev|eval)", 1))
    return df.withColumn("split", F.coalesce(*(F.when(F.col("_n") == k, v) for k, v in SPLITS.items()), F.col("_n"))).drop("_n")


def read_wrapped(spark: SparkSession, path, schema: str) -> DataFrame:
    """Whole JSON files: a list of records, or an object that holds it under one of the usual names."""
    row = S.StructType.fromDDL(schema)
    outer = S.StructType([*row.fields, *(S.StructField(w, S.ArrayType(row)) for w in WRAPPERS)])
    raw = spark.read.schema(outer).option("multiLine", True).json(path)
    inside = raw.select(F.explode(F.coalesce(*(F.col(w) for w in WRAPPERS))).alias("r")).select("r.*")
    plain = raw.filter(F.coalesce(*(F.col(w) for w in WRAPPERS)).isNull()).select(*row.names)
    return plain.unionByName(inside)


def first_of_each_file(df: DataFrame, n: int, order: Column) -> DataFrame:
    """At most ``n`` rows of each input file."""
    rows = df.withColumn("_file", F.col("_metadata.file_path"))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("_file").orderBy(order))).filter(F.col("_r") <= n).drop("_r", "_file")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Without private columns (whose name starts with an underscore)."""
    df.select(*(c for c in df.columns if not c.startswith("_"))).write.json(path)


def with_position(files: DataFrame, name: str = "position") -> DataFrame:
    """A table read from Parquet files with each row's place: files in order of their path, rows as they lie in them, from 0 without gaps.

    The place comes with the scan, so it is the same however the files are cut
    into tasks, and nothing is sorted but the list of files, which has a row a file.
    """
    rows = files.select(F.struct("*").alias("_all"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = files.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at")).groupBy("_path").agg((F.max("_at") + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_path", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(starts, F.col("_file") == F.col("_path")).select("_all.*", (F.col("_before") + F.col("_row")).alias(name))


def with_positional_id(files: DataFrame, prefix: str, digits: int = 5) -> DataFrame:
    """Adds raw_id from a row's place, such as interviews-00017."""
    return with_position(files, "_place").withColumn("raw_id", F.format_string(f"{prefix}-%0{digits}d", "_place")).drop("_place")


def read_split(records: DataFrame, split: str, caller: str, level: int, audit: str | None = None) -> DataFrame:
    """Rows of one split of a table with a ``split`` column. The test split is for callers of level 8 up; each try is logged at ``audit``."""
    name = SPLITS.get(split, split)
    granted = name != "test" or level >= 8
    if audit:
        spark = records.sparkSession
        spark.range(1).select(F.current_timestamp().alias("timestamp"), F.lit(level).alias("notebook_id"), F.lit(caller).alias("caller"), F.lit(name).alias("split_requested"), F.lit(granted).alias("access_granted")).write.mode("append").parquet(audit)
    if not granted:
        raise PermissionError(f"{caller} may not read the test split")
    return records.filter(F.col("split") == name)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of each file; Spark passes over empty ones."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def forbidden_files(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.lower("path").alias("path"))
    return files.filter(F.exists(F.array(*(F.lit(e) for e in extensions)), lambda e: F.endswith("path", e)))


def schema_kind(columns: dict[str, Column]) -> Column:
    """Which of seven record shapes a row has, most specific first; ``columns`` gives those that exist."""
    has = lambda *names: F.coalesce(*(columns[n].isNotNull() for n in names if n in columns), F.lit(False)) if len([n for n in names if n in columns]) < 2 else _any(*(columns[n].isNotNull() for n in names if n in columns))
    return (
        F.when(has("messages"), "chat_messages").when(has("output") & has("instruction", "input"), "instruction_io").when(has("interview_question"), "research_plan")
        .when(has("prompt") & has("completion"), "prompt_completion").when(has("question") & has("answer", "expected_answer", "response"), "question_answer")
        .when(has("question"), "question_only").when(has("text"), "raw_text").otherwise("unknown")
    )


def _any(*flags: Column) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out
