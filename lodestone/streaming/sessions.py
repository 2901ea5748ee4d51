"""Session memory: the newest messages of each session, kept in stream state.

A message is redacted, appended to its session's list, and the list is cut to
the newest. A session that has no new message for a while is forgotten, by the
time in the messages: a timer stands at its last message plus its life time and
goes off when the watermark passes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions import text as T
from lodestone.operators import history as H

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOST = 20
LIFE_SECONDS = 7 * 24 * 3600
COLUMNS = ["at", "turn", "role", "text"]
WINDOW = "user_id string, session_id string, expired boolean, at array<long>, turn array<long>, role array<string>, text array<string>"


class SessionWindow(StatefulProcessor):
    """State of a session: a list of at most `most` messages and one timer."""

    def __init__(self, most: int, life_ms: int):
        self.most, self.life = most, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getListState("window", "at long, turn long, role string, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(m) for m in self.window.get()]
        for part in rows:  # a session's batch may be long; only the newest are held
            new = zip(*(part[c].astype(object).where(part[c].notna(), None) for c in COLUMNS), strict=True)
            kept = sorted([*kept, *new], key=lambda m: m[:2])[-self.most :]
        self.window.put(kept)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(kept[-1][0]) + self.life)
        yield self._row(key, False, kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield self._row(key, True, [])

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, expired: bool, kept: list[tuple]) -> pd.DataFrame:
        lists = {c: [[m[i] for m in kept]] for i, c in enumerate(COLUMNS)}
        return pd.DataFrame({"user_id": [key[0]], "session_id": [key[1]], "expired": [expired]} | lists)


def session_windows(messages: DataFrame, most: int = MOST, life_seconds: int = LIFE_SECONDS, late: str = "1 hour") -> DataFrame:
    """Each session's newest messages after every batch that changes them, of a
    stream (user_id, session_id, ts, turn, role, text): texts are redacted before
    they are kept, equal times go by turn. A row with `expired` and empty lists
    says that a session is forgotten. Null texts stay null; messages later than
    the watermark are left out. The session needs `STATE_STORE` as the provider
    of its state store."""
    rows = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("ts", F.col("user_id").cast("string").alias("user_id"), F.col("session_id").cast("string").alias("session_id"), F.unix_millis("ts").alias("at"), F.col("turn").cast("long").alias("turn"), "role", T.redact(F.col("text")).alias("text"))
    return rows.groupBy("user_id", "session_id").transformWithStateInPandas(SessionWindow(most, life_seconds * 1000), WINDOW, "Update", "EventTime")


def newest_messages(messages: DataFrame, most: int = MOST) -> DataFrame:
    """The same windows of a whole table, as (user_id, session_id, turn, role, text)."""
    rows = messages.select(F.struct(F.col("user_id").cast("string").alias("user_id"), F.col("session_id").cast("string").alias("session_id")).alias("conv_id"), F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "turn").alias("turn"), "role", T.redact(F.col("text")).alias("text"))
    return H.last_turns(rows, most).select(F.col("conv_id.user_id"), F.col("conv_id.session_id"), F.col("turn.turn").cast("long").alias("turn"), "role", "text")


def run_session_windows(spark: SparkSession, messages: DataFrame, path: str, most: int = MOST, life_seconds: int = LIFE_SECONDS, late: str = "1 hour") -> DataFrame:
    """Run a stream over what there is now, write every batch under its number
    below `path`, and give the windows of sessions that aren't forgotten, as
    (user_id, session_id, turn, role, text)."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/windows/batch={number}")
        windows = session_windows(messages, most, life_seconds, late)
        windows.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    log = spark.read.parquet(f"{path}/windows").groupBy("user_id", "session_id").agg(F.max_by(F.struct("expired", "turn", "role", "text"), F.struct("batch", ~F.col("expired"))).alias("w"))
    kept = log.filter("NOT w.expired").select("user_id", "session_id", F.explode(F.arrays_zip("w.turn", "w.role", "w.text")).alias("m"))
    return kept.select("user_id", "session_id", F.col("m.turn").alias("turn"), F.col("m.role").alias("role"), F.col("m.text").alias("text"))
