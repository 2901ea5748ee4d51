"""Routed retrieval: one search for all questions that need one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.session import staged

OFF, PLAIN, DOMAIN, CORRECTIVE = "off", "plain", "domain", "corrective"


def route_of(enabled: Column, domain: Column, corrective: Column) -> Column:
    """Off without retrieval; plain for questions of no domain; domain questions
    are corrected where that is switched on. Nulls count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~yes(enabled), OFF).when(~yes(domain), PLAIN).when(yes(corrective), CORRECTIVE).otherwise(DOMAIN)


def routed_search(asked: DataFrame, search: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(questions, hits) of `asked` (query_id, route, and what `search` needs).

    Every question but those switched off goes through one search. A plain
    question whose grade is incorrect loses its hits and has no grade; a domain
    question keeps its hits ungraded; a corrective one that is incorrect is
    searched once more as `rewrite` puts it, in one second search for all of
    them, and takes that if it has hits. Questions are (query_id, route, grade,
    rewritten, confidence, hits), hits (query_id, id, score, rank).
    """
    asked = staged(asked, "routed-questions")
    first = staged(search(asked.filter(F.col("route") != OFF)), "routed-hits")

    def graded(questions: DataFrame, hits: DataFrame) -> DataFrame:
        top = questions.select("query_id").join(hits, "query_id", "left").groupBy("query_id").agg(F.max("score").alias("top"), F.count("score").alias("n"))
        return top.select("query_id", "n", R.grade(F.col("top"), F.col("n")).alias("grade"))

    judged = staged(asked.select("query_id", "route").join(graded(asked, first), "query_id"), "routed-grades")
    wrong = judged.filter((F.col("route") == CORRECTIVE) & (F.col("grade") == "incorrect")).select("query_id")
    again = rewrite(asked.join(wrong, "query_id", "left_semi"))
    second = staged(search(again), "routed-hits")
    better = graded(again, second).select("query_id", F.col("n").alias("n2"), F.col("grade").alias("grade2"))
    both = judged.join(better, "query_id", "left")
    rewritten = F.col("grade2").isNotNull()
    takes = rewritten & (F.col("n2") > 0)
    grade = F.when(F.col("route") == CORRECTIVE, F.when(takes, F.col("grade2")).otherwise(F.col("grade")))
    drops = (F.col("route") == PLAIN) & (F.col("grade") == "incorrect") | (F.coalesce(grade, F.lit("")) == "incorrect")
    hits = F.when(drops | (F.col("route") == OFF), 0).otherwise(F.when(takes, F.col("n2")).otherwise(F.col("n")))
    confidence = F.when(F.col("route") == CORRECTIVE, R.confidence(grade, rewritten))
    questions = staged(both.select("query_id", "route", grade.alias("grade"), rewritten.alias("rewritten"), takes.alias("second"), confidence.alias("confidence"), hits.cast("bigint").alias("hits")), "routed-answers")
    use = questions.filter("hits > 0").select("query_id", "second")
    kept = first.join(use.filter("NOT second"), "query_id", "left_semi").unionByName(second.join(use.filter("second"), "query_id", "left_semi"))
    return questions.drop("second"), kept.select("query_id", "id", "score", "rank")
