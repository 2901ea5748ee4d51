"""Routing questions, answering from hits, scoring answers, and the document lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFUSAL = "未查到相关内容"
PENDING, PARSED, VECTORIZED = "pending", "parsed", "vectorized"


def any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.lit(words), lambda w: F.contains(text, w)) if words else F.lit(False)


def asks_for_title(question: Column, titles: list[str], asking: str, short: int = 4, long: int = 6) -> Column:
    """The question holds a title: a long one, or a short one with words that ask for a book."""
    asks = F.rlike(question, F.lit(asking))
    known = [t for t in titles if len(t) >= short]
    return (F.length(F.trim(question)) >= 2) & (any_of(question, [t for t in known if len(t) >= long]) | (asks & any_of(question, known)))


def route(question: Column, flag: Column, titles: list[str], asking: str, classics: list[str], hints: list[str]) -> Column:
    """(domain, reason): a known title, then a classic, then the model's flag;
    hint words count only where the model gave none. A null question is empty."""
    question = F.coalesce(question, F.lit(""))
    row = lambda domain, reason: F.struct(F.lit(domain).alias("domain"), F.lit(reason).alias("reason"))
    return (
        F.when(asks_for_title(question, titles, asking), row(True, "title"))
        .when(any_of(question, classics), row(True, "classic"))
        .when(flag, row(True, "model"))
        .when(~flag, row(False, "model"))
        .when(any_of(question, hints), row(True, "hint"))
        .otherwise(row(False, "no_hint"))
    )


def answer_scores(answer: Column, queries: Column, retries: Column) -> dict[str, Column]:
    """Scores without a model. Of length, an empty answer scores 0.5 and a short one 0."""
    answer = F.coalesce(answer, F.lit(""))
    return {
        "query_success": (F.coalesce(queries, F.lit(0)) > 0).cast("int"),
        "retry_count": F.coalesce(retries, F.lit(0)).cast("int"),
        "answer_nonempty": (answer != "").cast("int"),
        "answer_length_ok": F.when(F.length(answer) >= 10, 1.0).when(answer == "", 0.5).otherwise(0.0),
    }


def extractive_answers(questions: DataFrame, hits: DataFrame, refusal: str = REFUSAL) -> DataFrame:
    """(query_id, answer, contexts) of all questions: the texts of their hits
    (query_id, rank, text) by rank, line by line; without any, the refusal. How
    many hits a question has is bounded by the search before."""
    texts = hits.select("query_id", "rank", F.trim("text").alias("body")).filter("body <> ''")
    joined = texts.groupBy("query_id").agg(F.expr("listagg(body, '\n') WITHIN GROUP (ORDER BY rank)").alias("answer"), F.count("*").alias("contexts"))
    return questions.select("query_id").join(joined, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(refusal)).alias("answer"), F.coalesce("contexts", F.lit(0)).alias("contexts"))


def reference_contexts(candidates: DataFrame, k: int = 3) -> DataFrame:
    """The k best candidates (query_id, id, text, score, expect) of each query:
    among those that hold all expected strings if there are any, else those
    that hold some if together they hold all, else all."""
    held = F.filter("expect", lambda e: F.contains("text", e))
    rows = candidates.withColumns({"held": held, "whole": F.size(held) == F.size("expect")})
    marks = rows.groupBy("query_id").agg(F.bool_or(F.col("whole") & (F.size("expect") > 0)).alias("covered"))
    wanted = rows.select("query_id", F.size(F.array_distinct("expect")).alias("wanted")).distinct()
    met = rows.select("query_id", F.explode("held").alias("e")).distinct().groupBy("query_id").agg(F.count("*").alias("met"))
    marks = marks.join(wanted, "query_id").join(met, "query_id", "left")
    rows = rows.join(marks, "query_id").filter(F.when(F.col("covered"), F.col("whole")).when(F.col("met") == F.col("wanted"), F.size("held") > 0).otherwise(True))
    rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "rank", "score", "text")


def advance(docs: DataFrame, parse: DataFrame, vectorise: DataFrame) -> DataFrame:
    """Documents (doc_id, status) after a batch of requests (doc_id each): what
    is parsed goes back to parsed, what is vectorised must be parsed by then;
    a pending document keeps its status and gets an error."""
    to_parse = parse.select("doc_id", F.lit(True).alias("__parse")).distinct()
    to_index = vectorise.select("doc_id", F.lit(True).alias("__index")).distinct()
    rows = docs.join(to_parse, "doc_id", "left").join(to_index, "doc_id", "left")
    rows = rows.withColumn("status", F.when(F.col("__parse"), PARSED).otherwise(F.col("status")))
    failed = F.col("__index") & (F.col("status") == PENDING)
    rows = rows.withColumn("error", F.when(failed, "not_parsed"))
    return rows.withColumn("status", F.when(F.col("__index") & (F.col("status") != PENDING), VECTORIZED).otherwise(F.col("status"))).drop("__parse", "__index")


def index_rows(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of vectorised documents with what the document says of itself."""
    known = docs.filter(F.col("status") == VECTORIZED).select("doc_id", *[c for c in docs.columns if c not in ("doc_id", "status", "error") and c not in chunks.columns])
    return chunks.join(known, "doc_id")


def synthetic_questions(centres: DataFrame, templates: list[str], seen: DataFrame) -> DataFrame:
    """(doc_id, question) for each document's central chunk (doc_id, title) and
    each template with `{name}`, without questions that are `seen` (query)."""
    filled = F.transform(F.lit(templates), lambda t: F.replace(t, F.lit("{name}"), F.col("title")))
    asked = centres.select("doc_id", F.explode(F.array_distinct(filled)).alias("question"))
    return asked.join(seen.select(F.col("query").alias("question")), "question", "left_anti").select("doc_id", "question")
