"""Undo and redo over an unbounded command log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import step

STATE = "session long, depth long, live array<long>, late long, closed boolean"


class Replay(StatefulProcessor):
    """A session's history as list state, its depth and last command as value state. With
    ``idle`` a timer follows each batch; a session without commands for so long is dropped."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getListState("history", "event_id long")
        self.at = handle.getValueState("at", "depth long, last long, late long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        depth, last, late = self.at.get() if self.at.exists() else (0, -1, 0)
        history = [e for (e,) in self.history.get()]
        kept = len(history)  # so many are stored as they are
        new = pd.concat(list(rows)).sort_values("n")
        for n, op, e in zip(new["n"].tolist(), new["op"], new["event_id"].tolist(), strict=True):
            if n <= last:
                late += 1
                continue
            if op == "do":
                kept = min(kept, depth)
            depth, last = step(history, depth, op, e), n
        self._store(history, kept)
        self.at.update((depth, last, late))
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame({"session": [key[0]], "depth": [depth], "live": [history[:depth]], "late": [late], "closed": [False]})

    def _store(self, history: list[int], kept: int) -> None:
        """Append what is new; rewrite only where a command cut the history."""
        stored = sum(1 for _ in self.history.get())
        if kept == stored:
            if history[kept:]:
                self.history.appendList([(e,) for e in history[kept:]])
        elif history:
            self.history.put([(e,) for e in history])
        else:
            self.history.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        late = self.at.get()[2] if self.at.exists() else 0
        self.history.clear()
        self.at.clear()
        yield pd.DataFrame({"session": [key[0]], "depth": [0], "live": [[]], "late": [late], "closed": [True]})

    def close(self) -> None:
        pass


def replay_stream(log: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(session, depth, live, late, closed) after each batch of a streamed log (session, n,
    op, event_id); update mode, with the RocksDB state store. Commands are applied in order
    of n within a batch; one whose n is not above the last applied came late and is counted,
    not applied. With ``idle_ms`` a session that gets no command for so many milliseconds of
    processing time is closed and its state dropped; a later command starts it anew. Batches
    then follow each other without new commands, as timers need them."""
    return log.groupBy("session").transformWithStateInPandas(Replay(idle_ms), STATE, "Update", "None" if idle_ms is None else "ProcessingTime")
