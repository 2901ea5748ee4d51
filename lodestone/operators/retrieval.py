"""Retrieval: dense and sparse search, fusion, reranking, diversity and grading.

Hits are rows (query_id, id, score, rank), ranks from 1 and without ties: equal
scores go by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import blocks as B
from lodestone.session import staged

RRF_K = 60
SPARSE_ONLY_SCORE = 0.45
HIGH, LOW = 0.72, 0.30
QUERIES_AT_ONCE = 4096
SPARSE_QUERIES_AT_ONCE = 1024
ROWS_AT_ONCE = 256


def ranked(hits: DataFrame, k: int | None = None, order: str = "score DESC, id", by: str = "query_id") -> DataFrame:
    out = hits.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY {order})"))
    return out.filter(F.col("rank") <= k) if k else out


def dense_search(index: DataFrame, queries: DataFrame, k: int, min_score: float | None = None, digits: int = 6) -> DataFrame:
    """The k largest inner products of each query (query_id, vector) with all
    rows of `index` (id, vector), rounded, and `min_score` or more.

    Queries are stored in blocks of about QUERIES_AT_ONCE, which meet the chunks
    of the index. A task multiplies a chunk with a block and passes on the k best
    of each query, so what is shuffled and held doesn't grow with the index, and
    nothing passes through the driver. Null vectors match nothing.
    """
    queries = queries.filter("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = B.query_blocks(queries, queries.count(), QUERIES_AT_ONCE)

    def prepare(ids: pa.Array, vectors: pa.Array):
        return ids.to_numpy(), B.matrix_of(vectors).T

    def score(asked, ids: pa.Array, vectors: pa.Array):
        ids, rows = ids.to_numpy(), max(1, B.TILE_CELLS // len(asked[0]))
        for start in range(0, len(ids), rows):
            scores = B.matrix_of(vectors.slice(start, rows)) @ asked[1]
            yield ids[start : start + rows], np.round(scores, digits, out=scores)

    held = index.filter("vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), "vector")
    found = ranked(B.search(held, blocks, k, prepare, score, rows=QUERIES_AT_ONCE), k)
    return found if min_score is None else found.filter(F.col("score") >= min_score)


def dropoff_cut(hits: DataFrame, least: float = 0.6, ratio: float = 0.6) -> DataFrame:
    """Hits of `least` or more, up to the first that falls below `ratio` times
    the one before."""
    kept = hits.filter(F.col("score") >= least).withColumn("before", F.expr("lag(score) OVER (PARTITION BY query_id ORDER BY rank)"))
    kept = kept.withColumn("fell", F.coalesce((F.col("score") / F.col("before") < ratio).cast("int"), F.lit(0)))
    return kept.withColumn("cut", F.expr("max(fell) OVER (PARTITION BY query_id ORDER BY rank)")).filter("cut = 0").drop("before", "fell", "cut")


def grade(top_score: Column, hits: Column, high: float = HIGH, low: float = LOW) -> Column:
    return F.when(hits == 0, "incorrect").when(top_score >= high, "correct").when(top_score < low, "incorrect").otherwise("ambiguous")


def confidence(graded: Column, rewritten: Column) -> Column:
    return F.when((graded == "correct") & ~rewritten, "high").when((graded == "incorrect") & rewritten, "refused").otherwise("medium")


def refuses(graded: Column, top_score: Column, chunks: Column, facts: Column, refused: Column) -> Column:
    """Graph facts never refuse; then what was refused before, the grade (of the
    top score if there is none), and having no chunk."""
    graded = F.coalesce(graded, F.when(top_score.isNotNull(), grade(top_score, F.lit(1))))
    return F.when(facts > 0, False).when(refused, True).when(graded == "incorrect", True).otherwise(chunks == 0)


def final_answer(answer: Column, conf: Column, cited: Column, facts: Column, refusal: str = "未查到相关内容") -> Column:
    return F.when(~cited & (facts == 0), refusal).when(conf == "medium", F.concat(F.lit("（仅供参考）"), answer)).otherwise(answer)


def postings(docs: DataFrame, words: Column) -> DataFrame:
    """(id, term, tf) of documents (id and what `words` needs)."""
    return docs.select("id", F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def term_weights(docs: DataFrame, words: Column, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf) of all terms; those in over half the documents get
    epsilon times the mean idf. Counts are combined in each task first, so no
    postings are shuffled."""
    df = docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("corpus"))))  # one row
    df = df.withColumn("idf", F.log(F.col("corpus") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("idf").alias("mean_idf"))
    return df.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))  # one row


def bm25_search(docs: DataFrame, queries: DataFrame, words: Column, query_words: Column, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k best Okapi scores above 0 (query_id, id, score, rank) of documents
    (id) for each query; a query's repeated words count again.

    Queries are stored in blocks of about SPARSE_QUERIES_AT_ONCE with their
    weighted terms, which meet the chunks of the documents' words. A task adds up
    what a document's terms weigh and passes on the k best of each query, so
    neither postings nor pairs are shuffled, a common term has no task of its
    own, and nothing passes through the driver. Words are taken once.
    """
    docs = docs.select(F.col("id").cast("long").alias("id"), words.alias("words"))
    docs = staged(docs.withColumn("size", F.size("words").cast("double")), "bm25-words")
    mean = docs.agg(F.avg("size")).first()[0] or 1.0
    idf = term_weights(docs, F.col("words"))
    asked = queries.select("query_id", F.explode(query_words).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = asked.join(idf, "term").select("query_id", "term", (F.col("times") * F.col("idf") * (k1 + 1)).alias("weight"))
    blocks = B.query_blocks(asked, queries.count(), SPARSE_QUERIES_AT_ONCE)

    def prepare(queries: pa.Array, terms: pa.Array, weights: pa.Array):
        ids, at = np.unique(queries.to_numpy(), return_inverse=True)
        codes = terms.dictionary_encode()
        known, codes = codes.dictionary, codes.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        starts = np.searchsorted(codes[order], np.arange(len(known) + 1))  # of the queries of each term
        return ids, known, starts, at[order], weights.to_numpy()[order]

    def score(asked, ids: pa.Array, words: pa.Array):
        queries, known, starts, at, weight = asked
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        codes = pc.fill_null(pc.index_in(words.flatten(), known), -1).to_numpy()
        for start in range(0, len(ids), ROWS_AT_ONCE):
            own = sizes[start : start + ROWS_AT_ONCE]
            found = codes[ends[start] : ends[start + len(own)]]
            met = found >= 0
            pairs, n = np.unique(np.repeat(np.arange(len(own)), own)[met] * len(known) + found[met], return_counts=True)
            row, term = np.divmod(pairs, len(known))
            gain = n / (n + k1 * (1 - b + b * own[row] / mean))
            scores, asking = np.zeros(len(own) * len(queries)), starts[term + 1] - starts[term]
            bounds = np.searchsorted(np.cumsum(asking), np.arange(0, max(1, asking.sum()), B.TILE_CELLS), side="right")
            for lo, hi in zip(bounds, [*bounds[1:], len(pairs)], strict=True):
                each = asking[lo:hi]
                places = np.arange(each.sum()) + np.repeat(starts[term[lo:hi]] - (np.cumsum(each) - each), each)
                scores += np.bincount(np.repeat(row[lo:hi] * len(queries), each) + at[places], weight[places] * np.repeat(gain[lo:hi], each), len(scores))
            scores = scores.reshape(len(own), len(queries))
            yield ids.slice(start, ROWS_AT_ONCE).to_numpy(), np.round(scores, 6, out=scores)

    return ranked(B.search(docs.select("id", "words"), blocks, k, prepare, score, 0.0), k)


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion (query_id, id, rrf_score) of ranked hits; ranks
    count from 1 here, so k stands for k + 1 from 0."""
    weights = weights or [1.0] * len(lists)
    both = None
    for hits, w in zip(lists, weights, strict=True):
        part = hits.select("query_id", "id", (F.lit(w) / (k + F.col("rank"))).alias("w"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("query_id", "id").agg(F.sum("w").alias("rrf_score"))


def restore_scores(fused: DataFrame, dense: DataFrame) -> DataFrame:
    """Fused hits with their dense score, or the fixed one of sparse-only hits."""
    own = dense.select("query_id", "id", F.col("score").alias("dense_score"))
    return fused.join(own, ["query_id", "id"], "left").withColumn("score", F.coalesce("dense_score", F.lit(SPARSE_ONLY_SCORE))).drop("dense_score")


def rule_score(title_hits: Column, body_hits: Column) -> Column:
    return F.least(F.lit(0.28), title_hits * 0.12 + body_hits * 0.03)


def rule_rerank(hits: DataFrame, title_hits: Column, body_hits: Column) -> DataFrame:
    """Adds base_score, rule_score and rerank_score, caps score at 1 and ranks
    by rerank score, rule score and the rank before."""
    out = hits.withColumns({"base_score": F.col("score"), "rule_score": F.round(rule_score(title_hits, body_hits), 6)})
    out = out.withColumn("rerank_score", F.round(F.col("base_score") + F.col("rule_score"), 6)).withColumn("score", F.least(F.lit(1.0), "rerank_score"))
    return ranked(out.withColumnRenamed("rank", "rank_before"), order="rerank_score DESC, rule_score DESC, rank_before")


def minmax(score: str, by: str = "query_id") -> Column:
    """Scaled to [0, 1] within a query; 0.5 where all are equal."""
    low, high = F.expr(f"min({score}) OVER (PARTITION BY {by})"), F.expr(f"max({score}) OVER (PARTITION BY {by})")
    return F.when(high == low, 0.5).otherwise((F.col(score) - low) / F.when(high != low, high - low))


def cross_rerank(hits: DataFrame, raw: Column, weight: float = 0.25) -> DataFrame:
    """Adds a scaled model score; `raw` comes from an injected pandas UDF."""
    out = hits.withColumn("raw_score", raw)
    return out.withColumn("cross_score", F.least(F.lit(1.0), F.col("score") + weight * minmax("raw_score")))


def mmr(hits: DataFrame, k: int, words: str = "words", lam: float = 0.5) -> DataFrame:
    """Maximal marginal relevance: the first hit, then the one that gains most
    by lam * score - (1 - lam) * likest Jaccard of the chosen. A query with k
    hits or fewer keeps them. A group is a query's candidate list, whose length
    the search before it bounds."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        bags = [set(w) for w in rows[words]]
        left, chosen = list(range(1, len(rows))), [0]
        while left and len(chosen) < k:
            like = lambda i: max(len(bags[i] & bags[j]) / max(1, len(bags[i] | bags[j])) for j in chosen)
            gains = [lam * rows["score"][i] - (1 - lam) * like(i) for i in left]
            chosen.append(left.pop(int(np.argmax(gains))))
        out = rows.iloc[chosen if len(rows) > k else range(len(rows))]
        return out.assign(rank=np.arange(1, len(out) + 1))[["query_id", "id", "score", "rank"]]

    return hits.select("query_id", "id", "score", "rank", words).groupBy("query_id").applyInPandas(choose, "query_id long, id long, score double, rank int")


def corrective(first: DataFrame, second: DataFrame) -> DataFrame:
    """One corrective pass over graded hits (query_id, hits, grade): a query
    whose first pass was incorrect takes the second if that has hits, and is
    left without hits if its grade is incorrect still."""
    again = second.select("query_id", F.col("hits").alias("hits2"), F.col("grade").alias("grade2"))
    both = first.join(again, "query_id", "left").withColumn("rewritten", (F.col("grade") == "incorrect") & F.col("grade2").isNotNull())
    use = F.col("rewritten") & (F.col("hits2") > 0)
    both = both.withColumn("final_grade", F.when(use, F.col("grade2")).otherwise(F.col("grade")))
    return both.select("query_id", "rewritten", "final_grade", F.when(F.col("final_grade") == "incorrect", 0).otherwise(F.when(use, F.col("hits2")).otherwise(F.col("hits"))).cast("bigint").alias("hits"), confidence(F.col("final_grade"), F.col("rewritten")).alias("confidence"))
