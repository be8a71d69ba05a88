"""Session history as keyed state (ST3, C15): a stream of turns, a history per session.

A session's turns are a list in the state store; a turn whose answer failed is rolled back, a session that was idle for too long begins
anew at its next turn, and state that nobody touches for ``ttl_ms`` leaves the store by itself. The state needs the RocksDB store, which
``started`` asks for while it starts a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUTPUT = "session_id string, turns int, last_role string, last_text string, expired int"
TURN = "role string, text string"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class History(StatefulProcessor):
    """turns (session_id, seq, role, text, ok, at in seconds) -> the session's state after each batch.

    ``turns`` counts those of the present session that were not rolled back; at most ``keep`` of them are held. ``expired`` counts the sessions
    before it under the same id."""

    def __init__(self, keep: int, idle_s: float | None, ttl_ms: int | None):
        self.keep, self.idle_s, self.ttl_ms = keep, idle_s, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", TURN, self.ttl_ms)
        self.counts = handle.getValueState("counts", "turns int, expired int, last double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        count, expired, last = self.counts.get() if self.counts.exists() else (0, 0, None)
        # A batch's turns of one session are held here together: they come in any order.
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            if self.idle_s is not None and last is not None and row.at - last > self.idle_s:
                held, count, expired = [], 0, expired + 1
            last = float(row.at)
            if row.ok:
                held.append((row.role, row.text))
                count += 1
            elif held and held[-1][0] == "user":
                held.pop()
                count -= 1
        held = held[-self.keep :]
        if held:
            self.turns.put(held)
        else:
            self.turns.clear()
        self.counts.update((count, expired, last))
        role, text = held[-1] if held else (None, None)
        yield pd.DataFrame([(key[0], count, role, text, expired)], columns=["session_id", "turns", "last_role", "last_text", "expired"])

    def close(self) -> None:
        pass


def remember(turns: DataFrame, keep: int = 20, idle_s: float | None = None, ttl_ms: int | None = None) -> DataFrame:
    """A stream of turns as a stream of session states (History)."""
    mode = "ProcessingTime" if ttl_ms else "None"
    return turns.groupBy("session_id").transformWithStateInPandas(History(keep, idle_s, ttl_ms), OUTPUT, "Update", mode)


def started(states: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The stream of states, appended to the table ``out`` with the number of its batch: from what is there to its end, or on and on ``every`` so
    often. With a time to live the stream has to go on (such state makes Spark plan batches without an end). A batch that is
    written again after a failure is the same rows under the same number."""
    spark = states.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = states.writeStream.outputMode("update").foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
        writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(STORE, before)
