"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accepted_attempts(events: DataFrame, seconds: int = 60, most: int = 10) -> DataFrame:
    """Streaming rate limiter over (id, key, ts): rejected attempts leave no
    trace, so the state of a key is at most `most` times. Attempts within a
    micro-batch go in order of time; a later batch isn't set against earlier
    times it may hold."""

    def limit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "id"])
        accepted = []
        for ts in rows["ts"]:
            now = ts.timestamp()
            recent = [t for t in recent if now - t < seconds]
            accepted.append(len(recent) < most)
            if accepted[-1]:
                recent.append(now)
        state.update((recent,))
        yield pd.DataFrame({"id": rows["id"], "key": rows["key"], "accepted": accepted})

    rows = events.select("id", "key", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("key").applyInPandasWithState(limit, "id long, key long, accepted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and window; what comes later than `late` is left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def latest_facts(facts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch of (user_id, subject, predicate, object, ts,
    action), its own last writes only, under its batch number, so a batch that
    runs again replaces itself. Read with `tables.latest`."""

    def write(batch: DataFrame, number: int) -> None:
        key = ["user_id", "subject", "predicate"]
        last = batch.groupBy(*key).agg(F.max_by(F.struct("object", "ts", "action"), "ts").alias("r")).select(*key, "r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
