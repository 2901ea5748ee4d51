"""Five corpus stages, each over all its predecessor kept.

Language ID, exact dedup, SimHash near-dedup, mixing to target weights and
SentencePiece encoding. Every stage takes (spark, docs, sf_dir).

Defined cases of all stages: an empty table gives an empty result; rows that
repeat an id are rows of their own; further columns pass through, whatever
their names but `pipeline_row`. Null and empty texts have no language and go in
the first stage; a later stage that meets them takes them as equal and empty,
and the mix, which counts words, drops texts without any. Of equal texts and of
near copies the row of the smallest id stays, a null id only where no other has
one; of equal ids the first row. The last stage gives each row that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.language_id import UNDETERMINED, train
from lodestone.llm.mixing import mix_sources
from lodestone.llm.piece_codec import encode_documents, load_pieces
from lodestone.llm.simhash import near_groups
from lodestone.session import discard, new_path, staged, table

LEAST_LANGUAGE_SCORE = 0.26  # both votes are won with 0.5 or more each
ROW = "pipeline_row"
READ: list[str] = []  # where the numbered rows of the stage before are


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised."""
    model = train(docs)
    columns = [docs[c] for c in docs.columns]
    judged = docs.select(F.struct(*columns).alias("d"), model.column(docs["text"]).alias("p"))
    return judged.filter((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= LEAST_LANGUAGE_SCORE)).select("d.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each text: of the smallest id that has it."""
    rows = _numbered(docs)
    texts = exact_dedup(rows, id_col=ROW).select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group"))
    return _first_rows(docs, rows, texts.join(rows.select(ROW, "doc_id"), ROW))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: of its smallest id."""
    rows = _numbered(docs)
    copies = near_groups(rows, id_col=ROW).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group"))
    return _first_rows(docs, rows, copies.join(rows.select(ROW, "doc_id"), ROW))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each row as often as the mix takes it, or drop it."""
    rows = _numbered(docs)
    taken = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    copies = mix_sources(rows, row_col=ROW).select(ROW, taken.alias("mix_copies")).filter("mix_copies > 0")
    joined = rows.select(ROW, F.struct(*docs.columns).alias("d")).join(copies, ROW)
    return joined.select("d", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("d.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document that is left."""
    return encode_documents(docs, load_pieces()).select("doc_id", "n_tokens", "ids", "score")


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written so that it stays: ids may repeat or
    be null. What the stage before wrote here is removed, as its result, the
    rows of this one, has been written since."""
    rows = staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")
    for path in READ:
        discard(docs.sparkSession, path)
    READ[:] = [rows.staged_path]
    return rows


def _first_rows(docs: DataFrame, rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of each group of `grouped` (row, doc_id, group), the row with the smallest id; null ids last."""
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)).alias("first"))
    return rows.join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").select(*docs.columns)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("sentencepiece", encode_stage),
]

# The stages learn, link and fit; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
