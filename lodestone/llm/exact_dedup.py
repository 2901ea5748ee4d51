"""Exact deduplication that stays even under hot groups.

Copies are combined three times: within each task (Catalyst's partial
aggregate), within salted digest groups, and across the salts. Every one of
these groupings has the full normalised text among its keys, so a digest
collision can never merge two different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import staged, table

WHITESPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE_RUN, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ASCII white space became
    one space; of equal texts the smallest id stays.

    Defined cases: a null text counts as empty; empty texts form one group; a
    null id never beats a real one, and a group of null ids only keeps all its
    rows under keep_id null; rows that repeat an id with the same text are the
    same document, so they share its verdict and each counts in group_size; an
    empty table gives an empty result; other columns are ignored, whatever
    their names. `digest` replaces SHA-256 in tests, to force collisions.
    """
    digest = digest or (lambda body: F.sha2(body, 256))
    bodies = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body")).withColumn("digest", digest(F.col("body")))
    salted = (
        bodies.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    winners = salted.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    by_digest = staged(
        winners.groupBy("digest").agg(F.count("*").alias("contents"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")),
        "exact-dedup",
    )
    # A digest with one content decides its rows by itself; texts meet again
    # only for digests that two different contents share.
    judged = bodies.join(by_digest.filter("contents = 1"), "digest").select("doc_id", "keep_id", "group_size", F.col("digest").alias("text_sha256"))
    shared = by_digest.filter("contents > 1").select("digest")
    if not shared.isEmpty():
        clashing = bodies.join(shared, "digest", "left_semi")
        by_content = clashing.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        judged = judged.unionByName(clashing.join(by_content, ["digest", "body"]).select("doc_id", "keep_id", "group_size", F.col("digest").alias("text_sha256")))
    return judged.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM d
"""
