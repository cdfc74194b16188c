"""Session events: the same transformations for batch tables and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: State that an event leads to, by its rank: a later state is never left for an earlier one.
STATES = {"planned": ("PENDING", 0), "started": ("LIVE", 1), "completed": ("COMPLETED", 2), "aborted": ("ABORTED", 2)}


def state_rank(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, r) for k, (_, r) in STATES.items()))


def state_name(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, s) for k, (s, _) in STATES.items()))


def current_state(events: DataFrame, session: str, kind: str, ts: str) -> DataFrame:
    """The state of each session: that of the furthest event, the first of equals (an ended session stays as it ended)."""
    known = events.filter(F.col(kind).isin(list(STATES)))
    order = F.struct(state_rank(F.col(kind)), -F.unix_micros(F.col(ts).cast("timestamp")))
    return known.groupBy(session).agg(F.max_by(state_name(F.col(kind)), order).alias("state"), F.count("*").alias("events"))


def pending(outbox: DataFrame) -> DataFrame:
    """Messages that weren't published, in order."""
    return outbox.filter(F.col("published_at").isNull()).orderBy("created_at", "id")


def over_limit(events: DataFrame, key: str, ts: str, limit: int, interval: str = "60 seconds") -> DataFrame:
    """Keys with more than ``limit`` events in a fixed interval."""
    rows = events.groupBy(key, F.window(ts, interval).alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    return rows.select(key, F.col("w.start").alias("start"), "n")


def windowed(events: DataFrame, ts: str, value: str, by: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows of event time; on a stream, rows later than ``late`` are left out."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key without a pause of ``gap``."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """The first event of each key."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(ts))).filter("_r = 1").drop("_r")


def live_states(events: DataFrame, session: str, kind: str) -> DataFrame:
    """A stream of state changes: (session, state, events) for each batch in which a session's state moves on."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rank, name, n = state.get if state.exists else (-1, "", 0)
        before = name
        for rows in batches:
            for k in rows[kind]:
                if k in STATES:
                    n += 1
                    if STATES[k][1] > rank:
                        name, rank = STATES[k]
        state.update((rank, name, n))
        if name != before:
            yield pd.DataFrame({session: [key[0]], "state": [name], "events": [n]})

    key_type = events.schema[session].dataType.simpleString()
    return events.groupBy(session).applyInPandasWithState(step, f"{session} {key_type}, state string, events long", "rank int, name string, n long", "append", GroupStateTimeout.NoTimeout)


def parsed(uploads: DataFrame, body: str, schema: str) -> DataFrame:
    """Adds parsed (null unless it could be read) and status: PENDING without a body, PARSED, or FAILED; the same on a stream."""
    made = F.from_json(F.col(body), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = uploads.withColumn("_made", made)
    good = F.col("_made").isNotNull() & F.col("_made._bad").isNull()
    status = F.when(F.col(body).isNull(), "PENDING").when(good, "PARSED").otherwise("FAILED")
    return rows.withColumns({"parsed": F.when(good, F.col("_made").dropFields("_bad")), "status": status}).drop("_made")
