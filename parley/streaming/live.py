"""Live interviews: the interviewer's next move after each answer, with state for each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.functions import lexicons as L

#: Answers back that a gap counts, and follow-ups of a session.
LOOK_BACK, FOLLOWUPS = 2, 1
#: Milliseconds without an answer after which a session is closed, and after which what is kept of it goes.
IDLE, KEPT = 30 * 60_000, 24 * 3_600_000


def next_move(intent: str, technical: float | None, remaining: int, gaps: int, used: int) -> tuple[str, bool]:
    """The move, and whether the answer asks for a follow-up; the rules of ``sessions.decide``."""
    wants = remaining > 1 and (intent == "thin" or (intent == "substantive" and technical is not None and technical >= L.BAND_STRONG))
    if intent in ("clarify", "silent"):
        return "repeat", wants
    if intent == "dont_know":
        return ("easier" if gaps >= 1 and remaining > 1 else "next"), wants
    if wants and used < FOLLOWUPS:
        return "followup", wants
    return ("end" if intent == "substantive" and remaining <= 0 else "next"), wants


class Interviewer(StatefulProcessor):
    """Keeps of each session the follow-ups used and the last intents; a timer closes it when no answer comes."""

    def __init__(self, key: str, idle: int = IDLE, kept: int = KEPT):
        self.key, self.idle, self.kept = key, idle, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "used int, turns int, deadline long", ttlDurationMs=self.kept)
        self.intents = handle.getMapState("intents", "at int", "intent string", ttlDurationMs=self.kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used, turns, deadline = self.session.get() if self.session.exists() else (0, 0, 0)
        out = []
        answers = pd.concat(list(rows)).sort_values("turn", kind="stable")
        for turn, intent, technical, remaining in answers[["turn", "intent", "technical", "remaining"]].itertuples(index=False):
            before = [self.intents.getValue((k,))[0] for k in range(max(turns - LOOK_BACK, 0), turns) if self.intents.containsKey((k,))]
            action, wants = next_move(intent, None if pd.isna(technical) else technical, int(remaining), sum(x == "dont_know" for x in before), used)
            used = min(used + wants, FOLLOWUPS)
            self.intents.updateValue((turns,), (intent,))
            if self.intents.containsKey((turns - LOOK_BACK,)):
                self.intents.removeKey((turns - LOOK_BACK,))
            turns += 1
            out.append((turn, intent, action))
        if deadline:
            self.handle.deleteTimer(deadline)
        deadline = timerValues.getCurrentProcessingTimeInMs() + self.idle
        self.handle.registerTimer(deadline)
        self.session.update((int(used), int(turns), int(deadline)))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The session is idle: it is closed, and nothing is kept of it."""
        turns = self.session.get()[1] if self.session.exists() else 0
        self.session.clear()
        self.intents.clear()
        yield self._frame(key, [(turns, "idle", "close")])

    def close(self) -> None:
        pass

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(rows), "turn": [int(r[0]) for r in rows], "intent": [r[1] for r in rows], "action": [r[2] for r in rows]})


def moves(answers: DataFrame, session: str = "conv_id", idle: int = IDLE, kept: int = KEPT) -> DataFrame:
    """A stream of moves: session, turn, intent, action for every answer of a stream (session, turn, intent, technical, remaining), and an idle close.

    A session's answers come in order of their turn; those of one batch are put
    in order. Needs a state store that keeps columns apart, as RocksDB does
    (``spark.sql.streaming.stateStore.providerClass``). Values of a session go
    ``kept`` milliseconds after they were last written.
    """
    kind = answers.schema[session].dataType.simpleString()
    rows = answers.select(session, "turn", "intent", "technical", "remaining")
    return rows.groupBy(session).transformWithStateInPandas(
        statefulProcessor=Interviewer(session, idle, kept), outputStructType=f"{session} {kind}, turn long, intent string, action string", outputMode="append", timeMode="processingTime",
    )
