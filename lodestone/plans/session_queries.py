"""Queries of conversations, feedback, memories, traces and record functions, and their SQL.

Columns that the tables lack (owners, titles, details) are made from ids and texts by stated rules.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import records as D
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import evaluation as E
from lodestone.operators import history as H
from lodestone.operators import retrieval as R
from lodestone.operators import sessions as S
from lodestone.plans.table_queries import GRAPH, _graph
from lodestone.plans.text_queries import REDACTED_SQL
from lodestone.session import spread, staged, table

QUERIES, SQL = {}, {}
NOW = datetime(2024, 6, 1)
SYNONYMS = [("the", ["an"])]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    deleted = F.when(F.col("conv_id") % 10 == 0, F.lit(datetime(2024, 5, 1)))
    title = F.when(F.col("conv_id") % 3 == 0, S.PLACEHOLDER).otherwise(F.concat(F.lit("Topic "), F.col("conv_id").cast("string")))
    return ids.select("conv_id", F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("conv_id") % 5).cast("string"))).alias("user_id"), title.alias("title"), deleted.alias("deleted_at"))


CONVERSATIONS = """
convs AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN '' ELSE concat('u', conv_id % 5) END AS user_id, CASE WHEN conv_id % 3 = 0 THEN '新对话' ELSE concat('Topic ', conv_id) END AS title,
  CASE WHEN conv_id % 10 = 0 THEN TIMESTAMP '2024-05-01' END AS deleted_at FROM (SELECT DISTINCT conv_id FROM conversations))"""


@query(f"WITH {CONVERSATIONS} SELECT conv_id, title FROM convs WHERE deleted_at IS NULL AND user_id = 'u2' AND contains(lower(title), 'topic 1')")
def owned_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.owned_conversations(_conversations(spark, sf_dir), F.lit("u2"), "TOPIC 1").select("conv_id", "title")


@query(f"WITH {CONVERSATIONS} SELECT conv_id, CASE WHEN deleted_at IS NOT NULL THEN deleted_at WHEN conv_id % 7 = 0 THEN TIMESTAMP '2024-06-01' END AS deleted_at FROM convs")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir)
    return S.soft_delete(rows, rows.filter("conv_id % 7 = 0"), "conv_id", F.lit(NOW)).select("conv_id", "deleted_at")


@query(f"WITH {CONVERSATIONS} SELECT conv_id, coalesce(nullif(user_id, ''), 'seed') AS user_id FROM convs")
def own_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.own_orphans(_conversations(spark, sf_dir), "seed").select("conv_id", "user_id")


@query(f"""
WITH {CONVERSATIONS}, q AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn) FILTER (role = 'user'), '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS q FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN title <> '新对话' THEN title WHEN coalesce(q, '') = '' THEN '新对话' WHEN length(q) > 20 THEN substring(q, 1, 20) || '…' ELSE q END AS title FROM convs LEFT JOIN q USING (conv_id)
""")
def named_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.named_conversations(_conversations(spark, sf_dir), table(spark, sf_dir, "conversations")).select("conv_id", "title")


REVIEWS = """
reviews AS (SELECT user_id AS id, CASE event_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'resolved' WHEN 2 THEN 'ignored' ELSE 'lost' END AS to_status, event_type AS reviewer,
  CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'done' END AS note, event_id AS pos FROM events),
sound AS (SELECT * FROM reviews WHERE to_status = 'confirmed' OR (to_status IN ('resolved', 'ignored') AND trim(note) <> ''))"""


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events, n = table(spark, sf_dir, "events"), F.col("event_id") % 4
    to = F.when(n == 0, "confirmed").when(n == 1, "resolved").when(n == 2, "ignored").otherwise("lost")
    reviews = events.select(F.col("user_id").alias("id"), to.alias("to_status"), F.col("event_type").alias("reviewer"), F.when(F.col("event_id") % 3 == 0, " ").otherwise("done").alias("note"), F.col("event_id").alias("at"))
    return S.review_issues(events.select(F.col("user_id").alias("id")).distinct().withColumn("status", F.lit("open")), reviews)


@query(f"WITH {REVIEWS} SELECT id, coalesce(arg_max(to_status, pos), 'open') AS status, arg_max(reviewer, pos) AS reviewer FROM (SELECT DISTINCT user_id AS id FROM events) LEFT JOIN sound USING (id) GROUP BY id")
def issue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir)[0].select("id", "status", "reviewer")


@query(f"WITH {REVIEWS} SELECT id, pos, to_status, coalesce(lag(to_status) OVER (PARTITION BY id ORDER BY pos), 'open') AS from_status FROM sound")
def issue_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir)[1].select("id", F.col("at").alias("pos"), "to_status", "from_status")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id") + F.col("turn")
    details = F.when(n % 5 == 0, "not json").when(n % 3 == 0, F.concat(F.lit('{"feedback": "'), F.when(n % 2 == 0, "up").otherwise("down"), F.lit('", "refused": '), (n % 9 == 0).cast("string"), F.lit(', "evidence_gap": '), (n % 6 == 0).cast("string"), F.lit("}")))
    return table(spark, sf_dir, "conversations").withColumn("details", details)


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user' AND conv_id % 2 = 0")
    return asked.select(F.col("text").alias("query"), F.when(F.col("turn") % 4 == 0, F.array(F.lit("x"))).alias("expect"), F.when(F.col("turn") % 6 == 0, D.REFUSAL_CATEGORY).alias("category"))


FEEDBACK = f"""
{CONVERSATIONS}, m AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked, conv_id + turn AS n FROM conversations),
fb AS (SELECT m.conv_id, turn, title, user_id, coalesce(asked, '') AS question, text AS answer, CASE WHEN n % 2 = 0 THEN 'up' ELSE 'down' END AS feedback, n % 9 = 0 AS refused, n % 6 = 0 OR n % 9 = 0 AS evidence_gap,
  coalesce(asked, '') IN (SELECT text FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 AND text IS NOT NULL) AS in_golden
  FROM m JOIN convs USING (conv_id) WHERE role = 'assistant' AND n % 3 = 0 AND n % 5 <> 0)"""


@query(f"WITH {FEEDBACK} SELECT * FROM fb")
def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.feedback_rows(_messages(spark, sf_dir), _conversations(spark, sf_dir), _golden(spark, sf_dir))


@query(f"WITH {FEEDBACK} SELECT conv_id, turn, CASE feedback WHEN 'up' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM fb")
def thumb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_rows(spark, sf_dir).select("conv_id", "turn", S.thumb_score(F.col("feedback")).alias("score"))


@query(f"""
WITH {FEEDBACK}, q AS (SELECT regexp_replace(question, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}', '[REDACTED]', 'g') AS query FROM fb WHERE feedback = 'down' AND question <> '')
SELECT query, count(*) AS times FROM q WHERE query NOT IN (SELECT text FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 AND text IS NOT NULL) GROUP BY query
""")
def bad_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bad_cases(feedback_rows(spark, sf_dir), _golden(spark, sf_dir))


@query("SELECT count(*) AS total, count(*) FILTER (turn % 4 = 0) AS labelled, count(*) FILTER (turn % 4 <> 0) AS pending FROM conversations WHERE role = 'user' AND conv_id % 2 = 0")
def golden_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.golden_summary(_golden(spark, sf_dir))


@query("SELECT turn % 6 = 0 AS refusal, count(*) AS n FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 GROUP BY 1")
def refusal_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(spark, sf_dir).groupBy(D.is_refusal_item(F.col("category"), F.col("expect")).alias("refusal")).agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT vec_id AS id, vec_id // 50 % 40 AS user_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), q AS (SELECT id AS query_id, user_id, vector FROM v WHERE id % 50 = 0),
p AS (SELECT query_id, id, round(list_dot_product(q.vector, v.vector), 6) AS score FROM q JOIN v USING (user_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p)
SELECT query_id, id, score, rank FROM r WHERE rank <= 5 AND score > 0
""")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr("(vec_id div 50) % 40").alias("user_id"), F.col("embedding").alias("vector"))
    return S.memory_search(vectors, vectors.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), 5)


@query("SELECT user_id, event_type AS subject, count(*) AS n FROM events WHERE NOT (user_id % 3 = 0 AND event_type = 'click') AND user_id IS NOT NULL GROUP BY ALL")
def memory_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("user_id", F.col("event_type").alias("subject"), F.lit("did").alias("predicate"))
    return S.forget(facts, facts.filter("user_id % 3 = 0 AND subject = 'click'")).groupBy("user_id", "subject").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back FROM orders),
f AS (SELECT o_custkey AS query_id, string_agg(concat('- ', 'order ', o_orderkey, ' ', o_orderpriority), chr(10) ORDER BY o_orderkey) AS facts, string_agg(concat(CASE WHEN o_orderkey % 2 = 0 THEN '用户：' ELSE '助手：' END, 'turn ', o_orderkey), chr(10) ORDER BY o_orderkey) FILTER (back <= 3) AS turns FROM o GROUP BY 1)
SELECT c_custkey AS query_id, concat_ws(chr(10) || chr(10), '【长期记忆】' || chr(10) || facts, '【用户画像】' || chr(10) || '- segment: ' || nullif(c_mktsegment, ''), turns, '【当前输入】' || chr(10) || c_name) AS context FROM customer LEFT JOIN f ON query_id = c_custkey
""")
def memory_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for facts, and a customer's last three for the turns within the budget."""
    people, orders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("input"), F.col("c_mktsegment").alias("v")), table(spark, sf_dir, "orders")
    facts = orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("rank"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority").alias("text"))
    said = orders.select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn"), F.when(F.col("o_orderkey") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("o_orderkey").cast("string")).alias("text"))
    turns = H.budget_suffix(said, F.lit(10), 30).withColumnRenamed("conv_id", "query_id").select("query_id", "turn", "role", "text")
    return S.memory_context(people, facts, people.select("query_id", F.lit("segment").alias("k"), "v"), turns)


@query(f"""
WITH {GRAPH},
b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY relation, src_label, dst_label ORDER BY src, dst) - 1) / 500) AS INTEGER) AS batch FROM edges)
SELECT relation, src_label, dst_label, batch, count(*) AS edges, count(*) FILTER (NOT EXISTS (SELECT 1 FROM nodes n WHERE n.label = src_label AND n.id = src) OR NOT EXISTS (SELECT 1 FROM nodes n WHERE n.label = dst_label AND n.id = dst)) AS lost
FROM b WHERE batch % 2 = 0 GROUP BY ALL
""")
def import_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    batches = staged(S.import_batches(edges, nodes, edges.limit(0).withColumn("batch", F.lit(0))), "batches")
    return S.import_batches(edges, nodes.unionByName(nodes), batches.filter("batch % 2 = 1"))  # every second batch is done; each node stands twice


@query("""
WITH r AS (SELECT doc_id, source AS name FROM documents WHERE doc_id % 3 = 0), c AS (SELECT doc_id, lang AS name FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, name, CAST(NULL AS BIGINT) AS tokens FROM r UNION ALL SELECT doc_id, name, doc_id AS tokens FROM c WHERE doc_id IN (SELECT doc_id FROM r)
""")
def merge_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cached = docs.filter("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("name"), F.col("doc_id").alias("tokens"))
    return S.merge_extractions(docs.filter("doc_id % 3 = 0").select("doc_id", F.col("source").alias("name")), cached, "doc_id")


@query("""
WITH h AS (SELECT q.vec_id, q.label, v.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
t AS (SELECT label AS query_id, id, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) AS r FROM h) WHERE r <= 3 GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM t),
l AS (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY rank) AS before FROM k WHERE score >= 0.3),
c AS (SELECT *, max(CASE WHEN score / before < 0.95 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS cut FROM l)
SELECT query_id, id, score, rank FROM c WHERE cut = 0
""")
def match_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of a query are the vectors of one label at ids that 50 divides."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    hits = R.dense_search(vectors.select("id", "vector"), vectors.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), 3)
    names = vectors.select(F.col("id").alias("query_id"), "label")
    return S.match_entities(hits.join(names, "query_id").select(F.col("label").alias("query_id"), "id", "score"), 0.3, 0.95)


@query("""
WITH t AS (SELECT user_id AS trace_id, min(ts) FILTER (event_type = 'view') AS t0, min(ts) FILTER (event_type = 'click') AS t1, min(ts) FILTER (event_type = 'error') AS t2, sum(event_id) AS ti, sum(user_id) AS tk FROM events GROUP BY 1)
SELECT trace_id, (epoch_us(t2) - epoch_us(t0)) / 1000 AS latency_ms, (epoch_us(t1) - epoch_us(t0)) / 1000 AS first_token_ms, round(ti / 1e6 + tk / 1e6 * 3, 9) AS cost FROM t
""")
def trace_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "first").when(F.col("event_type") == "error", "end")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), kind.alias("kind"), "ts", F.col("event_id").alias("tokens_in"), F.col("user_id").alias("tokens_out"))
    return S.spans(events)


@query(f"WITH r AS (SELECT doc_id, lang, {REDACTED_SQL} AS t FROM documents) SELECT doc_id, lang, CASE WHEN length(t) > 2000 THEN substring(t, 1, 2000) || '...[truncated]' ELSE t END AS text FROM r")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as traces."""
    return S.trace_summary(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


@query("""
WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, concat(o_orderkey, ' | ', trim(o_orderpriority)) AS line FROM orders),
n AS (SELECT o_custkey, count(*) AS n, string_agg(line, chr(10) ORDER BY place) FILTER (place <= 5) AS lines FROM r GROUP BY 1)
SELECT o_custkey, concat('o_orderkey | o_orderpriority', chr(10), repeat('-', 40), chr(10), lines, CASE WHEN n > 5 THEN concat(chr(10), '... (截断，共 ', n, ' 条，显示前 5 条)') ELSE '' END) AS body FROM n
""")
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.result_table(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderkey", "o_orderpriority"], 5)


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS at,
  CASE event_id % 4 WHEN 1 THEN date_trunc('day', ts) + INTERVAL 24 HOUR - INTERVAL 8 HOUR - INTERVAL 1 MICROSECOND WHEN 0 THEN ts - INTERVAL 8 HOUR WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS day_end FROM events
""")
def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, iso = F.col("event_id") % 4, lambda p: F.date_format("ts", p)
    text = F.when(n == 0, iso("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(n == 1, iso("yyyy-MM-dd")).when(n == 2, F.concat(iso("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise("not a date")
    return table(spark, sf_dir, "events").select("event_id", D.iso_instant(text).alias("at"), D.log_bound(text, end=True).alias("day_end"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_id % 2 = 0 AS flagged, 'click' AS last,
  concat('{"k":', json_extract(props, '$.k'), ',"last":"click","nested":{"a":1,"b":[true]},"none":null}') AS patched, CASE WHEN event_id % 2 = 0 THEN 'a1,b' ELSE '' END AS herbs, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'x' END AS books FROM events
""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    flag = F.concat(F.lit("```json\n{\"ok\": "), F.when(even, '"Yes"').otherwise("0"), F.lit("}\n```"))
    said = F.when(even, 'so: {"herbs": ["a1", "A1", " b ", ""], "books": "none"} as asked').otherwise('```\n{"books": ["x"], "herbs": null}\n```')
    lists = D.json_lists(said, ["herbs", "books"])
    merged = D.patched(F.col("props"), F.lit('{"last": "click", "nested": {"a": 1, "b": [true]}, "none": null}'))
    scalars = D.scalar_attributes(merged)
    named = lambda k: F.array_join(lists[k], ",").alias(k)
    return spread(table(spark, sf_dir, "events").select("event_id", "props")).select("event_id", scalars["k"].alias("k"), D.json_flag(flag, "ok").alias("flagged"), scalars["last"].alias("last"), merged.alias("patched"), named("herbs"), named("books"))


@query("""
SELECT doc_id, concat_ws(chr(10), trim(source), nullif(trim(lang), trim(source)), nullif(concat('Part ', doc_id), '')) AS blob,
  concat('[文献: ', coalesce(nullif(source, ''), '文献'), '#', doc_id, '] ', lang) AS line, concat('lang: ', lang) AS entity FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL
""")
def search_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    blob = D.search_blob(F.col("source"), F.concat(F.lit(" "), "lang"), F.lit(""), F.lit(None).cast("string"), F.col("source"), path=F.array(F.concat(F.lit("Part "), F.col("doc_id").cast("string")), F.col("source")))
    return docs.select("doc_id", blob.alias("blob"), D.context_line(F.col("source"), F.col("doc_id"), F.concat(F.lit("  "), "lang")).alias("line"), D.entity_text(F.lit("lang"), F.col("lang")).alias("entity"))


@query("""
WITH t AS (SELECT item_id, text, regexp_extract_all(lower(text), '[a-zA-Z0-9_]+') AS w, replace(text, 'the', 'an') AS o FROM benchmark)
SELECT item_id, len(list_distinct(list_concat([trim(text)], w, CASE WHEN contains(text, 'the') THEN list_concat([trim(o)], regexp_extract_all(lower(o), '[a-zA-Z0-9_]+')) ELSE [] END))) AS terms FROM t
""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(D.query_terms(F.col("text"), SYNONYMS)).cast("bigint").alias("terms"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'own ' || lang ELSE '原文公有领域；维基文库整理 CC BY-SA 4.0' END AS license, source AS body, [lang, source] AS names, CASE WHEN doc_id % 2 = 0 THEN lang || chr(10) || source ELSE source END AS said FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def front_matter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    text = F.when(even, F.concat(F.lit("---\ntitle: x\nlicense: \"own "), "lang", F.lit("\"\n---\n\n"), "source")).otherwise(F.col("source"))
    names = D.distinct_names(F.array(F.col("lang"), F.upper("lang"), F.lit(" "), F.lit("x" * 21), F.concat(F.lit(" "), "source"), F.col("lang")))
    said = D.flat_content(F.when(even, F.to_json(F.array(F.to_json(F.struct(F.col("lang").alias("text"))), F.lit(""), F.col("source")))).otherwise(F.col("source")))
    cut = D.front_matter_split(text)
    return table(spark, sf_dir, "documents").filter("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", cut["license"].alias("license"), cut["body"].alias("body"), names.alias("names"), said.alias("said"))


@query("SELECT substring(o_orderpriority, 1, 1) AS status, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("status")).agg(F.count("*").alias("n"))


@query("""
WITH g AS (SELECT item_id AS id, CASE WHEN item_id % 9 = 0 THEN ' ' WHEN item_id % 8 = 1 THEN ' same' ELSE text END AS q FROM benchmark)
SELECT id, concat_ws(',', CASE WHEN trim(q) = '' THEN 'empty_query' WHEN id > min(id) OVER (PARTITION BY trim(q)) THEN 'duplicate_query' END,
  CASE WHEN id % 5 = 2 THEN 'expect_not_list' WHEN id % 5 IN (1, 3) THEN 'expect_blank_item' END, CASE WHEN id % 4 = 0 THEN 'empty_category' WHEN id % 4 = 2 THEN 'unknown_category' END,
  CASE WHEN id % 6 <> 0 AND id % 5 IN (0, 2) THEN 'no_expectation' END, CASE WHEN id % 7 IN (1, 2) THEN 'docs_not_strings' END) AS errors FROM g
""")
def golden_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda n, *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("item_id") % n + 1).cast("int"))
    query = F.when(F.col("item_id") % 9 == 0, " ").when(F.col("item_id") % 8 == 1, " same").otherwise(F.col("text"))
    expect, category = by(5, "[]", '["x", " "]', '"x"', '["x", 1]', '["x"]'), by(4, None, "方剂", "odd", "拒答")
    docs, source = by(7, '["a"]', "[1]", '"a"', None, None, None, None), F.when(F.col("item_id") % 6 == 0, "feedback")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), query.alias("query"), expect.alias("expect"), category.alias("category"), source.alias("source"), docs.alias("relevant_docs"))
    return E.golden_findings(items).select("id", F.array_join("errors", ",").alias("errors"))


def _vector(text: str) -> str:
    return f"list_transform(range(0, 64), lambda b: CAST(len(list_filter(string_split({text}, ''), lambda c: c <> '' AND unicode(c) % 64 = b)) AS DOUBLE))"


def _cosine(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-12) * greatest(sqrt(list_dot_product({b}, {b})), 1e-12)))"


def _share(one: str, many: str) -> str:
    """SQL of the share of the texts of `one` (x.t, x.v) that are near to one of `many` or cover it."""
    like = "len(list_intersect(list_distinct(string_split(x.t, '')), list_distinct(string_split(o.t, '')))) / greatest(1, len(list_distinct(list_concat(string_split(x.t, ''), string_split(o.t, '')))))"
    near = f"{_cosine('x.v', 'o.v')} >= 0.35 OR contains(x.t, o.t) OR contains(o.t, x.t) OR {like} >= 0.7"
    return f"len(list_filter({one}, lambda x: len(list_filter({many}, lambda o: {near})) > 0)) / len({one})"


SAMPLES = f"""
m AS (SELECT *, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS q, conv_id + turn AS n, coalesce(text, '') AS t FROM conversations),
s AS (SELECT conv_id, turn, n, q, CASE WHEN n % 7 = 0 THEN '未查到相关内容' WHEN n % 11 = 0 THEN '' ELSE t END AS answer, CASE WHEN n % 13 = 0 THEN '' ELSE substring(q, 1, 40) END AS reference,
  CASE WHEN n % 5 = 0 THEN [] ELSE ['the', 'and'] END AS expect, n % 6 = 0 AS refuse,
  list_filter(CASE WHEN n % 3 = 0 THEN [] ELSE [trim(substring(q, 1, 20)), trim(substring(q, 21, 20))] END, lambda x: x <> '') AS refs, list_filter(CASE WHEN n % 4 = 0 THEN [] ELSE [trim(substring(t, 1, 30)), trim(q)] END, lambda x: x <> '') AS ret
  FROM m WHERE role = 'assistant'),
v AS (SELECT *, {_vector('q')} AS qv, {_vector('answer')} AS av, {_vector('reference')} AS rv, {_vector("array_to_string(ret, chr(10))")} AS jv,
  list_transform(refs, lambda x: {{'t': x, 'v': {_vector('x')}}}) AS refx, list_transform(ret, lambda x: {{'t': x, 'v': {_vector('x')}}}) AS retx, contains(answer, '未查到') AS said FROM s),
c AS (SELECT *, {_cosine('av', 'qv')} AS aq, {_cosine('av', 'rv')} AS ar, {_cosine('av', 'jv')} AS aj, list_avg(list_transform(retx, lambda x: {_cosine('x.v', 'qv')})) AS rq,
  len(list_filter(expect, lambda k: contains(answer, k))) / 2 AS kw FROM v),
e AS (SELECT *, CASE WHEN refuse AND said THEN 1.0 WHEN refuse OR reference <> '' THEN ar ELSE 0.0 END AS sem FROM c),
six AS (SELECT conv_id * 1000 + turn AS id,
  round(CASE WHEN refuse THEN CASE WHEN said OR ret = [] THEN 1.0 ELSE 0.0 END WHEN ret = [] OR trim(answer) = '' THEN 0.0 ELSE aj END, 4) AS faithfulness,
  round(CASE WHEN refuse AND said THEN 1.0 WHEN NOT refuse AND trim(answer) = '' THEN 0.0 ELSE aq END, 4) AS answer_relevancy,
  round(CASE WHEN ret = [] THEN CASE WHEN refuse THEN 1.0 ELSE 0.0 END WHEN refs = [] THEN rq ELSE {_share('retx', 'refx')} END, 4) AS context_precision,
  round(CASE WHEN ret = [] THEN CASE WHEN refuse THEN 1.0 ELSE 0.0 END WHEN refs = [] THEN CASE WHEN refuse THEN 0.0 END ELSE {_share('refx', 'retx')} END, 4) AS context_recall,
  round(sem, 4) AS answer_semantic_similarity, round(CASE WHEN expect = [] THEN sem ELSE (kw + sem) / 2 END, 4) AS answer_correctness FROM e)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text, asked = F.col("conv_id") + F.col("turn"), F.coalesce("text", F.lit("")), F.coalesce("question", F.lit(""))
    none = F.array().cast("array<string>")
    rows = H.question_of(table(spark, sf_dir, "conversations")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), asked.alias("question"),
        F.when(n % 7 == 0, "未查到相关内容").when(n % 11 == 0, "").otherwise(text).alias("answer"), F.when(n % 13 == 0, "").otherwise(F.substring(asked, 1, 40)).alias("reference"),
        F.when(n % 5 == 0, none).otherwise(F.lit(["the", "and"])).alias("expect"), F.when(n % 6 == 0, D.REFUSAL_CATEGORY).alias("category"),
        T.clean_list(F.when(n % 3 == 0, none).otherwise(F.array(F.substring(asked, 1, 20), F.substring(asked, 21, 20)))).alias("refs"),
        T.clean_list(F.when(n % 4 == 0, none).otherwise(F.array(F.substring(text, 1, 30), asked))).alias("ret"),
    )
    vectors = {"q": "question", "a": "answer", "r": "reference"}
    encoded = rows.withColumns({c: V.character_vector(of) for c, of in vectors.items()} | {"joined": V.character_vector(F.array_join("ret", "\n"))})
    return encoded.withColumns({"ref_vectors": V.character_vectors("refs"), "ret_vectors": V.character_vectors("ret")})


@query(f"WITH {SAMPLES} SELECT * FROM six")
def six_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.six_metrics(_samples(spark, sf_dir))


METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_semantic_similarity", "answer_correctness"]
MEANS = ", ".join(f"round(avg({m}), 3) AS {m}, count({m}) AS n_{m}" for m in METRICS)


@query(f"WITH {SAMPLES} SELECT refuse, count(*) AS n, {MEANS} FROM six JOIN (SELECT conv_id * 1000 + turn AS id, refuse FROM s) USING (id) GROUP BY refuse")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six means with their counts, of items to be refused and of others."""
    scores = six_metrics(spark, sf_dir).join(_samples(spark, sf_dir).select("id", F.coalesce(F.col("category") == D.REFUSAL_CATEGORY, F.lit(False)).alias("refuse")), "id")
    parts = [E.means(scores.filter(F.col("refuse") == r), METRICS).withColumn("refuse", F.lit(r)) for r in (True, False)]
    both = parts[0].unionByName(parts[1])
    return both.select("refuse", "n", *[x for m in METRICS for x in (F.round(m, 3).alias(m), f"n_{m}")])
