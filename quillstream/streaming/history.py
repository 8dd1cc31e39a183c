"""The turns before each turn, kept as state by session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.session import HISTORY

_STATE = "questions array<string>, answers array<string>"
_OUT = "session_id string, turn_no long, question string, n_history int, last_question string"


def with_history(turns: DataFrame, n: int = HISTORY, idle: str | None = None) -> DataFrame:
    """For each arriving turn (session_id, turn_no, question, answer): how many
    turns before it are held, at most n, and the question before it.  With ``idle``
    (such as "1 hour") the state of a session that is idle for so long is dropped;
    such a stream keeps looking for idle sessions and does not end by itself."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        questions, answers = (list(x) for x in state.get) if state.exists else ([], [])
        for rows in batches:
            rows = rows.sort_values("turn_no")
            out = []
            for turn_no, question, answer in zip(rows["turn_no"], rows["question"], rows["answer"]):
                out.append((key[0], turn_no, question, len(questions), questions[-1] if questions else None))
                questions, answers = [*questions, question][-n:], [*answers, answer][-n:]
            yield pd.DataFrame(out, columns=["session_id", "turn_no", "question", "n_history", "last_question"])
        state.update((questions, answers))
        if idle:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return turns.groupBy("session_id").applyInPandasWithState(step, _OUT, _STATE, "append", timeout)


_TURNS = "turn_no long, question string, answer string"
_ORDERED = "session_id string, turn_no long, question string, history array<struct<question:string,answer:string>>"


class _Ordered(StatefulProcessor):
    """A session's turns in their order, as list state, and a timer for its end."""

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.turns = handle, handle.getListState("turns", _TURNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {t[0]: tuple(t) for t in self.turns.get()} if self.turns.exists() else {}
        came = set()
        for batch in rows:
            for turn in zip(batch["turn_no"].tolist(), batch["question"], batch["answer"]):
                held[turn[0]] = turn
                came.add(turn[0])
        turns = [held[k] for k in sorted(held)]
        self.turns.put(turns)
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        # a turn's history changes if one of the turns before it came now
        out = []
        for i, (turn_no, question, _) in enumerate(turns):
            before = turns[max(0, i - self.n) : i]
            if turn_no in came or any(t[0] in came for t in before):
                out.append((key[0], turn_no, question, [{"question": q, "answer": a} for _, q, a in before]))
        yield pd.DataFrame(out, columns=["session_id", "turn_no", "question", "history"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        yield pd.DataFrame([], columns=["session_id", "turn_no", "question", "history"])

    def close(self) -> None:
        pass


def ordered_history(turns: DataFrame, n: int = HISTORY, idle: str | None = None) -> DataFrame:
    """For arriving turns (session_id, turn_no, question, answer) the n turns before them by
    number, oldest first, whatever the order of arrival: a turn whose history a late one
    changes comes out again, and the last row of a turn holds.  A turn that comes again
    replaces itself.  A session's turns are kept until it is idle for so long (such as
    "1 hour"), without ``idle`` for good.  Needs the RocksDB state store."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    return turns.groupBy("session_id").transformWithStateInPandas(_Ordered(n, idle_ms), _ORDERED, "Update", "ProcessingTime" if idle else "None")
