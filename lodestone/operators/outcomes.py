"""Tasks of one row each with an outcome table, so that runs can be repeated.

A task is any function of a row's input; a model call, an extraction, an
experiment. What it gives or how it failed is kept by id. A rerun takes the rows
that have no result yet and were not tried too often; rows that are done are
skipped, also when other columns of theirs have changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import staged, unstage
from lodestone.sources.keyed import PUT, KeyedTable

DONE, FAILED = "done", "failed"
OUTCOME = "id string, status string, output string, error string, attempts int"
LONGEST_ERROR = 500


class Outcomes:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table = KeyedTable(spark, path, OUTCOME, ["id"], buckets)

    def todo(self, rows: DataFrame, most_attempts: int) -> DataFrame:
        """Rows (id, ...) without a result that were tried fewer than
        `most_attempts` times, each id once, with the tries so far."""
        known = self.table.read().select("id", "status", "attempts")
        left = rows.withColumn("id", F.col("id").cast("string")).filter("id IS NOT NULL").dropDuplicates(["id"]).join(known, "id", "left")
        tried = F.coalesce("attempts", F.lit(0))
        return left.filter((F.coalesce("status", F.lit("")) != DONE) & (tried < most_attempts)).withColumn("attempts", tried).drop("status")

    def run(self, rows: DataFrame, task: Callable[[str | None], str | None], input_col: str = "input", most_attempts: int = 3) -> dict[str, int]:
        """Run `task` on the input of each row that is left, and commit all
        outcomes at once; how many were done and failed. An error is an outcome
        of its row alone. A task that an executor loses is run again, so tasks
        should bear that; only one outcome of a row is ever committed."""

        def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for i, given, attempts in zip(batch["id"], batch["input"], batch["attempts"], strict=True):
                    try:
                        result = task(given)
                        out.append((i, DONE, None if result is None else str(result), None, attempts + 1))
                    except Exception as e:  # noqa: BLE001  whatever the task raises is the row's outcome
                        out.append((i, FAILED, None, f"{type(e).__name__}: {e}"[:LONGEST_ERROR], attempts + 1))
                yield pd.DataFrame(out, columns=["id", "status", "output", "error", "attempts"])

        left = self.todo(rows.select("id", F.col(input_col).alias("input")), most_attempts)
        outcomes = staged(left.select("id", "input", "attempts").mapInPandas(tried, OUTCOME), "outcomes")
        counts = {r["status"]: r["n"] for r in outcomes.groupBy("status").agg(F.count("*").alias("n")).collect()}
        if counts:
            self.table.merge(uuid.uuid4().hex, outcomes, PUT)
        unstage(outcomes)
        return {DONE: counts.get(DONE, 0), FAILED: counts.get(FAILED, 0)}

    def read(self) -> DataFrame:
        return self.table.read()

    def scored(self, items: DataFrame, score: Column) -> DataFrame:
        """Items (id, expected) beside their outcome, with `score` of output and
        expected; failed items, and those never tried, have no score."""
        both = items.withColumn("id", F.col("id").cast("string")).join(self.read(), "id", "left")
        return both.withColumn("score", F.when(F.col("status") == DONE, score))
