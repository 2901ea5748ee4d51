"""Conversation history: windows by count and by budget, questions, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_turns(messages: DataFrame, n: int = 50) -> DataFrame:
    """The last n messages of each conversation."""
    return messages.withColumn("back", F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)")).filter(F.col("back") <= n)


def budget_suffix(messages: DataFrame, cost: Column, budget: int, keep_newest: bool = True, spent: Column | None = None) -> DataFrame:
    """The newest messages whose costs (0 or more) together fit the budget,
    after what is `spent`; the newest stays whatever it costs if `keep_newest`."""
    out = messages.withColumn("cost", cost).withColumn("back", F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)"))
    out = out.withColumn("used", F.expr("sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)") + (spent if spent is not None else F.lit(0)))
    fits = F.col("used") <= budget
    return out.filter(fits | (F.col("back") == 1) if keep_newest else fits)


def memory_split(messages: DataFrame, line_cost: Column, budget: int) -> DataFrame:
    """Adds part: `all` where the whole history fits; else `older` for the
    oldest messages that fit together and `recent` for the rest."""
    out = messages.withColumn("cost", line_cost)
    total = F.expr("sum(cost) OVER (PARTITION BY conv_id)")
    run = F.expr("sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
    return out.withColumn("part", F.when(total <= budget, "all").when(run <= budget, "older").otherwise("recent")).drop("cost")


def cut_after(messages: DataFrame, cuts: DataFrame) -> DataFrame:
    """Without the messages after each conversation's cut (conv_id, last_turn)."""
    return messages.join(cuts, "conv_id", "left").filter(F.col("last_turn").isNull() | (F.col("turn") <= F.col("last_turn"))).drop("last_turn")


def question_of(messages: DataFrame) -> DataFrame:
    """Each assistant message with the last user message before it."""
    asked = F.expr("last(CASE WHEN role = 'user' THEN text END, true) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
    return messages.withColumn("question", asked).filter("role = 'assistant'")


def rate_limited(events: DataFrame, seconds: int = 60, most: int = 10) -> DataFrame:
    """Whether each attempt (key, ts, id) is accepted: fewer than `most` were
    accepted in the seconds before it. Rejected attempts don't count, so a
    key's attempts are walked in order, with a queue of at most `most` times.
    They are sorted by Spark and pass in batches: no key is gathered in memory,
    though all of it is walked by one task."""
    from collections import deque

    import pandas as pd

    def walk(parts):
        key, recent = None, deque()
        for rows in parts:
            accepted = []
            for of, ts in zip(rows["key"], rows["ts"], strict=True):
                of = None if pd.isna(of) else of
                if of != key:
                    key, recent = of, deque()
                while recent and (ts - recent[0]).total_seconds() >= seconds:
                    recent.popleft()
                accepted.append(len(recent) < most)
                if accepted[-1]:
                    recent.append(ts)
            yield rows[["id", "key"]].assign(accepted=accepted)

    in_order = events.select("id", "key", "ts").repartition("key").sortWithinPartitions("key", "ts", "id")
    return in_order.mapInPandas(walk, "id long, key long, accepted boolean")
