"""Queries of keyed tables, the graph import, global numbers, task outcomes,
session state, routed retrieval and test sets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import graph as K
from lodestone.operators import retrieval as R
from lodestone.operators import routing as W
from lodestone.operators.graph_import import GraphImport
from lodestone.operators.outcomes import Outcomes
from lodestone.operators.testset import make_test_set
from lodestone.plans.table_queries import GRAPH, _graph
from lodestone.session import new_path, spread, table
from lodestone.sources.keyed import DELETE, PUT, KeyedTable
from lodestone.streaming.sessions import run_session_windows

QUERIES, SQL = {}, {}
IMPORT_SIZE = 100_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH {GRAPH}
SELECT 'node' AS kind, label AS of, CAST(id AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dst, CASE WHEN id % 3 = 0 THEN concat(name, '!') ELSE name END AS name,
  CASE WHEN id % 3 = 0 THEN concat('kind=again,own=', label, ',third=', id) ELSE concat('kind=first,own=', label) END AS attributes FROM nodes
UNION ALL SELECT DISTINCT 'edge', relation, concat(src_label, ':', src), concat(dst_label, ':', dst), NULL, NULL FROM edges
WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.label = src_label AND n.id = src) AND EXISTS (SELECT 1 FROM nodes n WHERE n.label = dst_label AND n.id = dst)
""")
def graph_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import that stops after one batch and is run again; a third of the
    nodes comes again later with another name and further attributes."""
    nodes, edges = _graph(spark, sf_dir)
    words = lambda kind, *more: F.map_from_arrays(F.array(F.lit("kind"), F.lit("own" if not more else "third")), F.array(F.lit(kind), *(more or [F.col("label")])))
    text = F.col("id").cast("string")
    first = nodes.select("label", text.alias("id"), "name", words("first").alias("attributes"))
    again = nodes.filter("id % 3 = 0").select("label", text.alias("id"), F.concat("name", F.lit("!")).alias("name"), words("again", text).alias("attributes"))
    ends = edges.select("relation", "src_label", F.col("src").cast("string").alias("src"), "dst_label", F.col("dst").cast("string").alias("dst"))
    sink = GraphImport(spark, new_path(spark, "graph"))
    for most in (1, None):
        sink.run(first.unionByName(again), ends, IMPORT_SIZE, most)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    none = F.lit(None).cast("string")
    held = sink.nodes.read().select(F.lit("node").alias("kind"), F.col("label").alias("of"), F.col("id").alias("src"), none.alias("dst"), "name", shown.alias("attributes"))
    place = lambda end: F.concat(f"{end}_label", F.lit(":"), end).alias(end)
    return held.unionByName(sink.edges.read().select(F.lit("edge").alias("kind"), F.col("relation").alias("of"), place("src"), place("dst"), none.alias("name"), none.alias("attributes")))


@query("""
WITH f AS (SELECT lang AS label, source AS name, min(doc_id) AS seq FROM documents GROUP BY ALL)
SELECT label, name, concat('E', row_number() OVER (ORDER BY seq, label NULLS FIRST, name NULLS FIRST)) AS entity FROM f
""")
def kg_numbered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by language, in the order of the first document of each."""
    return K.numbered_entities(table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), F.col("source").alias("name"), F.col("doc_id").alias("seq")))


def _message_store(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """Messages written, every fifth turn edited, others deleted and
    some of these written again, with a compaction between."""
    messages = table(spark, sf_dir, "conversations")
    store = KeyedTable(spark, new_path(spark, "messages"), messages.schema, ["conv_id", "turn"])
    store.merge("insert", messages, PUT)
    store.merge("edit", messages.filter("turn % 5 = 0").select("conv_id", "turn", F.concat(F.lit("edited: "), "text").alias("text")))
    store.compact()
    store.merge("delete", messages.filter("turn % 7 = 3").select("conv_id", "turn"), DELETE)
    store.merge("again", messages.filter("turn % 7 = 3 AND conv_id % 10 = 0").select("conv_id", "turn", F.lit("back").alias("text")))
    return store


STORE = """
kept AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN NULL ELSE role END AS role, CASE WHEN turn % 7 = 3 THEN 'back' WHEN turn % 5 = 0 THEN 'edited: ' || text ELSE text END AS text
  FROM conversations WHERE turn % 7 <> 3 OR conv_id % 10 = 0)"""


@query(f"WITH {STORE} SELECT * FROM kept")
def keyed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message_store(spark, sf_dir).read()


@query(f"WITH {STORE} SELECT * FROM kept WHERE conv_id % 50 = 0")
def keyed_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _message_store(spark, sf_dir)
    store.compact()
    return store.get(table(spark, sf_dir, "conversations").filter("conv_id % 50 = 0"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN doc_id % 7 <> 0 THEN CAST(coalesce(length(text), 0) AS VARCHAR) END AS output,
  CASE WHEN doc_id % 7 = 0 THEN 'ValueError: seventh' END AS error, CASE WHEN doc_id % 7 = 0 THEN 3 WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS attempts FROM documents
""")
def task_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task that fails for every seventh row always and, in the first run, for
    every fifth; run four times."""
    docs, outcomes = table(spark, sf_dir, "documents"), Outcomes(spark, new_path(spark, "outcomes"))
    given = docs.select(F.col("doc_id").alias("id"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))).alias("input"))

    def task(first: bool):
        def length(text: str) -> str:
            i, _, body = text.partition(":")
            if int(i) % 7 == 0 or (first and int(i) % 5 == 0):
                raise ValueError("seventh")
            return str(len(body))

        return length

    for run in range(4):
        outcomes.run(given, task(run == 0))
    return outcomes.read()


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT concat('u', conv_id % 7) AS user_id, CAST(conv_id AS VARCHAR) AS session_id, turn, role, regexp_replace(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}', '[REDACTED]', 'g') AS text FROM r WHERE back <= 6
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest six messages of each session, kept by a stream over the table."""
    schema = table(spark, sf_dir, "conversations").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/conversations.parquet*")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60)
    messages = stream.select(F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("user_id"), F.col("conv_id").alias("session_id"), at.alias("ts"), "turn", "role", "text")
    return run_session_windows(spark, messages, new_path(spark, "sessions"), 6)


ROUTED = """
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
q AS (SELECT id AS query_id, vector, CASE WHEN id % 250 = 0 THEN 'off' WHEN id % 100 = 50 THEN 'plain' WHEN id % 400 = 0 THEN 'domain' ELSE 'corrective' END AS route FROM v WHERE id % 50 = 0),
s AS (SELECT 1 AS pass, query_id, vector FROM q WHERE route <> 'off' UNION ALL SELECT 2, query_id, list_reverse(vector) FROM q WHERE route = 'corrective'),
p AS (SELECT pass, query_id, id, round(list_dot_product(s.vector, v.vector), 6) AS score FROM s JOIN v ON v.id <> s.query_id),
h AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pass, query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p) WHERE rank <= 10 AND score >= CASE pass WHEN 1 THEN 0.75 ELSE 0.05 END),
g AS (SELECT query_id, pass, count(*) AS n, max(score) AS top FROM h GROUP BY ALL),
j AS (SELECT q.query_id, route, coalesce(a.n, 0) AS n, CASE WHEN a.n IS NULL OR a.top < 0.3 THEN 'incorrect' WHEN a.top >= 0.72 THEN 'correct' ELSE 'ambiguous' END AS grade, coalesce(b.n, 0) AS n2,
  CASE WHEN b.n IS NULL OR b.top < 0.3 THEN 'incorrect' WHEN b.top >= 0.72 THEN 'correct' ELSE 'ambiguous' END AS grade2 FROM q LEFT JOIN g a ON a.query_id = q.query_id AND a.pass = 1 LEFT JOIN g b ON b.query_id = q.query_id AND b.pass = 2),
x AS (SELECT *, route = 'corrective' AND grade = 'incorrect' AS rewritten FROM j),
y AS (SELECT *, rewritten AND n2 > 0 AS takes, CASE WHEN route = 'corrective' THEN CASE WHEN rewritten AND n2 > 0 THEN grade2 ELSE grade END END AS last FROM x),
z AS (SELECT *, CASE WHEN route = 'off' OR (route = 'plain' AND grade = 'incorrect') OR last = 'incorrect' THEN 0 WHEN takes THEN n2 ELSE n END AS hits FROM y)"""


def _routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions are vectors at ids that 50 divides, routed by id; a question is
    rewritten by reversing its vector, and the second search asks for less."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    n = F.col("id")
    route = W.route_of(n % 250 != 0, n % 100 != 50, n % 400 != 0)
    asked = vectors.filter("id % 50 = 0").select(n.alias("query_id"), "vector", route.alias("route"), F.lit(0.75).alias("least"))

    def search(questions: DataFrame) -> DataFrame:
        hits = R.dense_search(vectors, questions.select("query_id", "vector"), 11).filter("id <> query_id").drop("rank")
        return R.ranked(hits, 10).join(questions.select("query_id", "least"), "query_id").filter("score >= least").drop("least")

    return W.routed_search(asked, search, lambda wrong: wrong.withColumns({"vector": F.reverse("vector"), "least": F.lit(0.05)}))


@query(f"WITH {ROUTED} SELECT query_id, route, last AS grade, rewritten, CASE WHEN route = 'corrective' THEN CASE WHEN last = 'correct' AND NOT rewritten THEN 'high' WHEN last = 'incorrect' AND rewritten THEN 'refused' ELSE 'medium' END END AS confidence, CAST(hits AS BIGINT) AS hits FROM z")
def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir)[0]


@query(f"WITH {ROUTED} SELECT h.query_id, h.id, h.score, h.rank FROM h JOIN z USING (query_id) WHERE hits > 0 AND pass = CASE WHEN takes THEN 2 ELSE 1 END")
def routed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir)[1]


@query()
def test_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose expected strings are words of theirs, over all documents."""
    items = table(spark, sf_dir, "benchmark").withColumn("words", F.regexp_extract_all("text", F.lit(r"(\p{L}{3,})"), F.lit(1)))
    expect = F.when(F.col("item_id") % 5 == 0, F.array(F.lit("in no text at all"), F.lit(" "))).when(F.col("item_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.slice("words", 1, 2), F.slice(F.reverse("words"), 1, 1)))
    asked = items.select(F.col("item_id").alias("query_id"), V.character_vector("text").alias("vector"), expect.alias("expect"), F.lit(None).cast("array<string>").alias("docs"), (F.col("item_id") % 11 == 0).alias("refuse"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("doc"), "text", V.character_vector("text").alias("vector"))
    made = make_test_set(asked, chunks)
    return made.select("query_id", F.size("contexts").cast("bigint").alias("n_contexts"), F.md5(F.array_join("contexts", "|").cast("binary")).alias("digest"), "reference", "error")
