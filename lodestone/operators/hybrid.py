"""Hybrid search as it is served: dense and sparse lists of a question and its
variants, fused, reranked, made diverse, and without what the reader may not see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.operators import tables as O
from lodestone.operators.containment import sparse_search
from lodestone.session import staged

LEAST_SCORE = 0.35
TERM_CHARACTERS = 2


def mixed_search(docs: DataFrame, asked: DataFrame, words: Column, k: int = 4, min_score: float = LEAST_SCORE, lam: float | None = 0.5, dense_weight: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """(query_id, id, score, rank) of the k best documents (id, title, text,
    vector) of each question (query_id, vector, variants, terms).

    Dense search by the vector and sparse search by the word lists of all
    variants give max(4k, 20) candidates each. They are fused by rank, get back
    their dense score (or the fixed one of sparse hits), and are reranked by the
    question's terms of two characters or more in title and text. Of more than k
    the diverse ones stay, by `lam`, or with null the first. Of these, hits stay
    that have `min_score` or came from the sparse list.
    """
    wide = max(4 * k, 20)
    dense = staged(R.dense_search(docs.select("id", "vector"), asked.select("query_id", "vector"), wide), "mixed-dense")
    sparse = staged(sparse_search(docs, asked.select("query_id", "variants"), words, wide), "mixed-sparse")
    fused = R.rrf([dense, sparse], [dense_weight, sparse_weight]).withColumn("rrf_score", F.round("rrf_score", 9))
    fused = R.restore_scores(R.ranked(fused, order="rrf_score DESC, id"), dense)
    full = fused.join(docs.select("id", "title", "text"), "id").join(asked.select("query_id", "terms"), "query_id")
    terms = F.filter(F.array_distinct("terms"), lambda t: F.length(t) >= TERM_CHARACTERS)
    held = lambda c: F.size(F.filter(terms, lambda t: F.contains(F.coalesce(c, F.lit("")), t)))
    hits = staged(R.rule_rerank(full.withColumns({"title_hits": held(F.col("title")), "body_hits": held(F.col("text"))}), F.col("title_hits"), F.col("body_hits")).select("query_id", "id", "score", "rank"), "mixed-hits")
    if lam is None:
        picked = hits.filter(F.col("rank") <= k)
    else:
        bags = docs.join(hits.select("id").distinct(), "id", "left_semi").select("id", F.array_distinct(F.filter(words, lambda w: F.length(w) >= TERM_CHARACTERS)).alias("words"))
        picked = R.mmr(hits.join(bags, "id"), k, lam=lam)
    kept = picked.join(sparse.select("query_id", "id", F.lit(True).alias("sparse")), ["query_id", "id"], "left")
    return R.ranked(kept.filter((F.col("score") >= min_score) | F.col("sparse")).withColumnRenamed("rank", "before"), order="before").select("query_id", "id", "score", "rank")


def served_search(docs: DataFrame, asked: DataFrame, words: Column, blocked: DataFrame, k: int = 4, **options) -> DataFrame:
    """(query_id, id, score, rank) of the k best documents (id, doc_id, dept,
    roles, title, text, vector) that each reader (query_id, user_dept,
    user_role, and what `mixed_search` takes) may see: twice as many are
    searched, documents of `blocked` (doc_id) and those that access rules deny
    are dropped, and k stay."""
    hits = mixed_search(docs, asked, words, 2 * k, **options).withColumnRenamed("rank", "before")
    rules = docs.select("id", "doc_id", "dept", "roles")
    seen = hits.join(rules, "id").join(asked.select("query_id", "user_dept", "user_role"), "query_id").join(blocked.select("doc_id").distinct(), "doc_id", "left_anti")
    allowed = seen.filter(O.acl_ok(F.col("dept"), F.col("roles"), F.col("user_dept"), F.col("user_role")))
    return R.ranked(allowed, k, "before").select("query_id", "id", "score", "rank")
