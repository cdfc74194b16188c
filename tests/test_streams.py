"""Streams that stop midway and go on, and live sessions against their replay."""

import time

import pytest
from pyspark.sql import functions as F

from parley.operators import sessions
from parley.streaming import events as V
from parley.streaming import ledger, live

COMMAND = "interview_id long, user_id long, kind string, at timestamp, payload string"


@pytest.fixture
def commands(spark, tmp_path):
    """Files of commands, a batch each."""
    kinds = ["planned", "started", "turn", "repeat", "completed", "aborted", "failed", "other"]
    rows = [(i % 5, i % 3, kinds[(i * 5 + i // 5) % 8], i) for i in range(48)]
    df = spark.createDataFrame(rows, "interview_id long, user_id long, kind string, s long").select("interview_id", "user_id", "kind", F.timestamp_seconds("s").alias("at"), F.lit('{"a": 1}').alias("payload"))
    for k in range(4):
        df.filter(F.col("at").cast("long").between(12 * k, 12 * k + 11)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df


def stream(spark, tmp_path):
    return spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("stop_after", ["state", "events", "outbox"])
def test_a_batch_that_stops_midway_is_written_once(spark, commands, tmp_path, stop_after):
    root, checkpoint, seen = str(tmp_path / "tables"), str(tmp_path / "cp"), []

    def fail(table):
        seen.append(table)
        if table == stop_after and len(seen) > 5:
            raise RuntimeError("stopped")

    query = stream(spark, tmp_path).writeStream.foreachBatch(ledger.batch_writer(root, fail)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="stopped"):
        query.awaitTermination()
    done = {r[0] for r in ledger.committed(spark, root).collect()}
    assert len(done) in (1, 2) and ledger.read(spark, root, "events").count() < ledger.event_rows(commands).count()
    ledger.run(stream(spark, tmp_path), root, checkpoint, availableNow=True).awaitTermination()
    order = lambda df: sorted(map(str, df.collect()))
    assert order(ledger.read(spark, root, "events").select("interview_id", "type", "payload", "at")) == order(ledger.event_rows(commands))
    box = ledger.read(spark, root, "outbox")
    assert order(box.select(*ledger.outbox_rows(commands).columns)) == order(ledger.outbox_rows(commands)) and box.count() == box.select("id").distinct().count() == V.pending(box).count()
    states = {r["interview_id"]: r["state"] for r in ledger.read(spark, root, "state").collect()}
    assert states == {r["interview_id"]: r["state"] for r in V.current_state(commands, "interview_id", "kind", "at").collect()}


def test_a_batch_that_runs_again_changes_nothing(spark, commands, tmp_path):
    root = str(tmp_path / "tables")
    write = ledger.batch_writer(root)
    for batch in (0, 0, 1, 0):
        write(commands.filter(F.col("interview_id") % 2 == batch), batch)
    assert ledger.read(spark, root, "events").count() == ledger.event_rows(commands).count()
    write(commands.limit(0), 2)
    assert ledger.read(spark, root, "state").count() == 5 and ledger.committed(spark, root).count() == 3


def test_nothing_is_committed_before_the_first_batch(spark, tmp_path):
    assert ledger.committed(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def watched(made, name, tmp_path, done):
    """Runs a stream with timers, which has batches without end, until its table is as wanted."""
    query = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 60
        while query.isActive and not done(made.sparkSession.table(name)) and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert query.exception() is None


def answers(spark):
    kinds = ["dont_know", "thin", "substantive", "clarify", "dont_know", "silent", "dont_know", "substantive"]
    rows = [(s, t, kinds[(s * 3 + t * (s + 1)) % 8], 20.0 + 13 * ((s + t) % 6) if t % 5 else None, 9 - t) for s in range(8) for t in range(10)]
    return spark.createDataFrame(rows, "conv_id long, turn long, intent string, technical double, remaining long")


def test_live_moves_are_those_of_the_replay(spark, tmp_path, rocks):
    rows = answers(spark)
    for lo, hi in ((0, 2), (3, 3), (4, 9)):
        rows.filter(F.col("turn").between(lo, hi)).orderBy(F.desc("turn")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    made = live.moves(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    watched(made, "moves", tmp_path, lambda t: t.count() >= 80)
    got = sorted((r["conv_id"], r["turn"], r["action"]) for r in spark.table("moves").collect())
    want = sorted((r["conv_id"], r["turn"], r["action"]) for r in sessions.decide(rows).collect())
    assert got == want and len({a for _, _, a in got}) >= 4


def test_an_idle_session_ends(spark, tmp_path, rocks):
    rows = answers(spark).filter("turn < 3")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    made = live.moves(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), idle=500)
    watched(made, "idle", tmp_path, lambda t: t.filter("action = 'close'").count() >= 8)
    closed = spark.table("idle").filter("action = 'close'").collect()
    assert sorted(r["conv_id"] for r in closed) == list(range(8)) and all(r["turn"] == 3 and r["intent"] == "idle" for r in closed)
