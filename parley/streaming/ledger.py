"""State, event log and outbox of interviews, written once and together for each batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.streaming.events import STATES, state_name, state_rank

TABLES = ("state", "events", "outbox")
BATCH = "_batch"
#: Events that others are told of.
TOLD = ("completed", "aborted")


def event_rows(commands: DataFrame) -> DataFrame:
    """The append-only log: interview_id, type, payload, at. ``commands``: interview_id, kind, at, payload (JSON or null)."""
    kind = F.col("kind")
    name = F.when(kind.isin(list(STATES)), F.concat(F.lit("interview."), kind)).when(kind.isin("turn", "repeat"), F.concat(F.lit("answer."), kind)).when(kind == "failed", "report.failed")
    return commands.select("interview_id", name.alias("type"), "payload", "at").filter("type IS NOT NULL")


def outbox_rows(commands: DataFrame) -> DataFrame:
    """A message for each end of an interview: id, aggregate, aggregate_id, type, payload, created_at, published_at (null: pending). The id comes from the row itself."""
    rows = commands.filter(F.col("kind").isin(list(TOLD)))
    kind = F.concat(F.lit("interview."), F.col("kind"))
    payload = F.to_json(F.struct(F.col("interview_id").alias("interviewId"), F.col("user_id").alias("userId")))
    key = F.sha2(F.concat_ws("|", F.col("interview_id").cast("string"), kind, F.col("at").cast("string")), 256)
    return rows.select(
        key.alias("id"), F.lit("interview").alias("aggregate"), F.col("interview_id").cast("string").alias("aggregate_id"), kind.alias("type"), payload.alias("payload"), F.col("at").alias("created_at"), F.lit(None).cast("timestamp").alias("published_at"),
    )


def furthest(kind: Column, at: Column) -> Column:
    """Orders a session's commands: the furthest state first, the earliest of equals."""
    return F.struct(state_rank(kind).alias("rank"), (-F.unix_micros(at)).alias("early"))


def state_rows(commands: DataFrame) -> DataFrame:
    """interview_id, state and its order, of the sessions that a batch moves."""
    rows = commands.filter(F.col("kind").isin(list(STATES)))
    order = furthest(F.col("kind"), F.col("at"))
    return rows.groupBy("interview_id").agg(F.max_by(state_name(F.col("kind")), order).alias("state"), F.max(order).alias("order"))


def _place(root: str, table: str, batch: int) -> str:
    return f"{root.rstrip('/')}/{table}/{BATCH}={batch}"


def committed(spark: SparkSession, root: str) -> DataFrame:
    """The batches that were written whole: a row each in the ledger."""
    kind = f"{BATCH} long"
    try:
        return spark.read.parquet(f"{root.rstrip('/')}/ledger").select(F.col(BATCH).cast("long"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def batch_writer(root: str, between: Callable[[str], None] = lambda table: None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch's rows go to three tables, then its number to the ledger.

    Only what the ledger names counts, so a batch is seen whole or not at all. A
    batch that is run again after a failure is passed over if it is in the
    ledger; otherwise its folders are written anew, so no row is there twice.
    ``between`` is called after each table (tests fail there).
    """

    def write(commands: DataFrame, batch: int) -> None:
        spark = commands.sparkSession
        if not committed(spark, root).filter(F.col(BATCH) == batch).isEmpty():
            return
        held = commands.persist()
        try:
            for table, rows in (("state", state_rows(held)), ("events", event_rows(held)), ("outbox", outbox_rows(held))):
                rows.write.mode("overwrite").parquet(_place(root, table, batch))
                between(table)
            spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").parquet(_place(root, "ledger", batch))
        finally:
            held.unpersist()

    return write


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table's committed batches; ``state`` gives the state of each interview after all of them."""
    rows = spark.read.parquet(f"{root.rstrip('/')}/{table}").withColumn(BATCH, F.col(BATCH).cast("long"))
    rows = rows.join(committed(spark, root), BATCH, "left_semi").drop(BATCH)
    if table != "state":
        return rows
    return rows.groupBy("interview_id").agg(F.max_by("state", "order").alias("state"))


def run(commands: DataFrame, root: str, checkpoint: str, **how):
    """Starts the stream of commands; ``how`` goes to the trigger, such as availableNow=True."""
    return commands.writeStream.foreachBatch(batch_writer(root)).option("checkpointLocation", checkpoint).trigger(**how).start()
