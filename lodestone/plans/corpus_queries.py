"""Queries of chapters, detail pages, routing, answers and the document lifecycle, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import answers as A
from lodestone.session import spread, table
from lodestone.sources import chapters as C
from lodestone.sources import detail_pages as P

QUERIES, SQL = {}, {}

TITLES, ASKING, CLASSICS, HINTS = ["lorem", "example", "abcdefgh"], "what|which", ["classic"], ["the ", "die ", "los "]
NEEDLES = ["the", "and"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as Markdown with a heading a line, in parts of 2,000 bytes or fewer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.regexp_replace("text", r"\n", "\n\n## ").alias("text"))
    return C.split_chapters(docs, 2000)


@query()
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).select("doc_id", F.col("source").alias("doc_name"), F.concat(F.lit("# "), F.coalesce("lang", F.lit("-")), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"))
    return C.build_chunks(docs).withColumn("section_path", F.array_join("section_path", " / "))


@query()
def needle_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", C.excerpt_column(F.col("text"), NEEDLES).alias("excerpt"))
    return found.filter("excerpt IS NOT NULL")


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    about = pages.select(F.col("page_id").alias("id"), F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("name"), F.create_map(F.lit("大类"), F.concat(F.lit("c"), (F.col("page_id") % 5).cast("string"))).alias("meta"))
    found = P.detail_sections(pages)
    return found.join(about, found["page_id"] == about["id"]).select("name", F.lit("Herb").alias("type"), "meta", "sections")


@query()
def detail_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.detail_sections(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.posexplode(P.headed_blocks(F.col("sections"))).alias("place", "b")).select("page_id", "place", "b.heading", "b.text", F.array_join("b.entities", ",").alias("entities"))


@query("""
SELECT 'BELONGS_TO' AS relation, 'page' || page_id AS subject, 'Herb' AS subject_type, 'c' || page_id % 5 AS object, 'Class' AS object_type FROM pages
""")
def kg_rule_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test pages have no headings that the link rules know, so classes alone are found."""
    return P.rule_edges(_details(spark, sf_dir))


@query("""
WITH q AS (SELECT conv_id, turn, text AS q, CASE WHEN turn % 3 = 0 THEN true WHEN turn % 3 = 1 THEN false END AS flag FROM conversations),
m AS (SELECT *, length(trim(q)) >= 2 AND (contains(q, 'example') OR contains(q, 'abcdefgh') OR (regexp_matches(q, 'what|which') AND contains(q, 'lorem'))) AS titled FROM q)
SELECT conv_id, turn, CASE WHEN titled OR contains(q, 'classic') THEN true WHEN flag IS NOT NULL THEN flag ELSE contains(q, 'the ') OR contains(q, 'die ') OR contains(q, 'los ') END AS domain,
  CASE WHEN titled THEN 'title' WHEN contains(q, 'classic') THEN 'classic' WHEN flag IS NOT NULL THEN 'model' WHEN contains(q, 'the ') OR contains(q, 'die ') OR contains(q, 'los ') THEN 'hint' ELSE 'no_hint' END AS reason FROM m
""")
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("turn") % 3 == 0, True).when(F.col("turn") % 3 == 1, False)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.route(F.col("text"), flag, TITLES, ASKING, CLASSICS, HINTS).alias("r")).select("conv_id", "turn", "r.*")


@query("""
SELECT conv_id, turn, CAST(turn % 4 > 0 AS INTEGER) AS query_success, CAST(turn % 3 AS INTEGER) AS retry_count, CAST(text <> '' AS INTEGER) AS answer_nonempty,
  CAST(CASE WHEN length(text) >= 10 THEN 1 WHEN text = '' THEN 0.5 ELSE 0 END AS DOUBLE) AS answer_length_ok FROM conversations WHERE role = 'assistant' AND text IS NOT NULL
""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = A.answer_scores(F.col("text"), F.col("turn") % 4, F.col("turn") % 3)
    return table(spark, sf_dir, "conversations").filter("role = 'assistant' AND text IS NOT NULL").select("conv_id", "turn", *[c.alias(n) for n, c in scores.items()])


@query("""
WITH h AS (SELECT conv_id AS query_id, turn AS rank, trim(text) AS body FROM conversations WHERE role = 'assistant' AND trim(text) <> ''),
j AS (SELECT query_id, string_agg(body, chr(10) ORDER BY rank) AS answer, count(*) AS contexts FROM h GROUP BY query_id)
SELECT query_id, coalesce(answer, '未查到相关内容') AS answer, coalesce(contexts, 0) AS contexts FROM (SELECT DISTINCT conv_id AS query_id FROM conversations) LEFT JOIN j USING (query_id)
""")
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns stand for a conversation's hits."""
    talk = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "role", "text")
    return A.extractive_answers(talk.select("query_id").distinct(), talk.filter("role = 'assistant'"))


@query("""
WITH c AS (SELECT conv_id AS query_id, turn AS id, text, length(text) AS score, contains(text, 'a') AS a, contains(text, 'q') AS b FROM conversations),
g AS (SELECT *, bool_or(a AND b) OVER w AS covered, bool_or(a) OVER w AND bool_or(b) OVER w AS together FROM c WINDOW w AS (PARTITION BY query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g WHERE CASE WHEN covered THEN a AND b WHEN together THEN a OR b ELSE true END)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, score, text FROM r WHERE rank <= 3
""")
def reference_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns stand for the candidates of one golden question."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), "text", F.length("text").cast("long").alias("score"), F.lit(["a", "q"]).alias("expect"))
    return A.reference_contexts(rows)


@query("""
WITH s AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'parsed' ELSE CASE o_orderstatus WHEN 'F' THEN 'vectorized' WHEN 'P' THEN 'parsed' ELSE 'pending' END END AS status, o_orderkey % 7 < 3 AS wanted FROM orders)
SELECT doc_id, CASE WHEN wanted AND status <> 'pending' THEN 'vectorized' ELSE status END AS status, CASE WHEN wanted AND status = 'pending' THEN 'not_parsed' END AS error FROM s
""")
def kb_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "vectorized").when(F.col("o_orderstatus") == "P", "parsed").otherwise("pending")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), status.alias("status"))
    return A.advance(docs, docs.filter("doc_id % 5 = 0"), docs.filter("doc_id % 7 < 3")).select("doc_id", "status", "error")


@query("""
WITH s AS (SELECT o_orderkey AS doc_id, o_orderpriority AS dept FROM orders WHERE o_orderstatus = 'F')
SELECT doc_id, l_linenumber AS chunk_idx, dept FROM s JOIN lineitem ON l_orderkey = doc_id
""")
def kb_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "vectorized").otherwise("pending").alias("status"), F.col("o_orderpriority").alias("dept"))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_idx"))
    return A.index_rows(chunks, docs).select("doc_id", "chunk_idx", "dept")


@query("""
WITH t(f) AS (VALUES ('What is {name}?'), ('{name}')), n AS (SELECT DISTINCT p_name AS title FROM part)
SELECT min_key AS doc_id, replace(f, '{name}', title) AS question FROM (SELECT p_name AS title, min(p_partkey) AS min_key FROM part GROUP BY p_name), t
WHERE replace(f, '{name}', title) NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0)
""")
def synthetic_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    centres = part.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("doc_id"))
    return A.synthetic_questions(centres, ["What is {name}?", "{name}"], part.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("query")))
